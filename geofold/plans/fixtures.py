"""Rasters, points, zones and tiles derived from the driver's tables by whole-number arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geofold.functions.classes import class_name, lookup
from geofold.session import table

RES = 10.0
STATES = {"click": "pending", "purchase": "exported", "signup": "embedding", "view": "embedded", "error": "failed"}
MODELS = ["model_a", "model_b", "model_c"]
RECTS = [("r1", 0.0, 0.0, 500.0, 400.0), ("r2", 200.0, 100.0, 800.0, 900.0), ("r3", 600.0, 0.0, 1000.0, 100.0), ("r4", 5000.0, 5000.0, 6000.0, 6000.0)]
POLYGONS = [
    ("p1", 0, [12.0, 707.0, 33.0], [8.0, 51.0, 903.0]),
    ("p2", 0, [103.0, 902.0, 897.0, 502.0, 98.0], [11.0, 7.0, 801.0, 203.0, 797.0]),
    ("p3", 0, [2.0, 101.0, 99.0, 3.0], [2.0, 1.0, 88.0, 91.0]),
    ("p3", 1, [51.0, 302.0, 297.0, 48.0], [41.0, 38.0, 99.0, 97.0]),
]


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, row, col, x, y, truth, model_a, model_b, model_c, conf)."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    height = (e.agg(F.max("event_id")).first()[0] or 0) // 100 + 1  # the raster's metadata
    i, u = F.col("event_id"), F.col("user_id")
    row, col = F.floor(i / 100).cast("long"), i % 100
    p = e.select("event_id", "user_id", "value", row.alias("row"), col.alias("col"))
    t = ((F.floor(F.col("row") / 5) + F.floor(F.col("col") / 10)) % 7).cast("int")
    p = p.withColumn("truth", t)
    hit = lambda prime, share: (i * prime) % 100 < share
    return p.select(
        "event_id", "row", "col", (F.col("col") * 10 + 5).cast("double").alias("x"), ((F.lit(height) - F.col("row")) * 10 - 5).cast("double").alias("y"), "truth",
        F.when(u % 13 != 0, F.when(hit(7919, 15), (F.col("truth") + 1) % 7).otherwise(F.col("truth"))).cast("int").alias("model_a"),
        F.when(hit(104729, 25), (F.col("truth") + 3) % 7).otherwise(F.col("truth")).cast("int").alias("model_b"),
        F.when(u % 11 != 0, F.when(hit(1299709, 35), (F.col("truth") + 1 + i % 3) % 7).otherwise(F.col("truth"))).cast("int").alias("model_c"),
        (F.col("value") / (F.col("value") + 20.0)).alias("conf"),
    )


def points(px: DataFrame) -> DataFrame:
    """(point_id, row, col, x, y, label_str, label_int): every seventh pixel; names in odd spellings, some unknown."""
    i, name = F.col("event_id"), class_name("truth")
    text = F.when(i % 2 == 0, F.when(i % 35 == 0, F.lit("cloud")).when(i % 4 == 0, F.concat(F.lit(" "), F.upper(name), F.lit(" "))).otherwise(name))
    return px.where(i % 7 == 0).select(i.alias("point_id"), "row", "col", "x", "y", text.alias("label_str"), F.when(i % 2 == 1, F.col("truth")).alias("label_int"))


def rects(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RECTS, "zone_id string, west double, south double, east double, north double")


def polygons(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(POLYGONS, "zone_id string, part int, xs array<double>, ys array<double>")


def status_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, tile_id, status, ts): users as tiles, kinds of events as states."""
    e = table(spark, sf_dir, "events")
    status = F.coalesce(lookup(STATES, "event_type"), F.lit("failed"))
    return e.select("event_id", F.col("user_id").cast("string").alias("tile_id"), status.alias("status"), "ts")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tile_id, embedding, cls)."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("tile_id"), "embedding", (F.col("label") % 7).cast("int").alias("cls"))


def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tile_id, a, b, c): three seven-class distributions from slices of each embedding, squares scaled to one."""
    e = table(spark, sf_dir, "embeddings")

    def part(first: int):
        raw = F.transform(F.slice("embedding", first, 7), lambda v: v.cast("double") * v.cast("double") + 0.001)
        total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
        return F.transform(raw, lambda v: v / total)

    return e.select(F.col("vec_id").alias("tile_id"), part(1).alias("a"), part(8).alias("b"), part(15).alias("c"))
