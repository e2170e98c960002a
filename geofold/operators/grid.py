"""Grids: tiles, mosaics, resampling and common extents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geofold.functions.classes import N_CLASSES
from geofold.functions.geo import tile_id
from geofold.functions.votes import argmax

METHODS = ("nearest", "bilinear", "cubic")


def tile_grid(spark: SparkSession, west: float, south: float, east: float, north: float, res: float, size: int, overlap: int = 0, source: str = "tile") -> DataFrame:
    """(tile_id, row, col, bbox, status) from the north-west corner; edge tiles hang over the box."""
    side, step = size * res, (size - overlap) * res
    if step <= 0:
        raise ValueError("the overlap must be smaller than the tile")
    cols, rows = max(1, -int(-(east - west) // step)), max(1, -int(-(north - south) // step))
    i = spark.range(rows * cols).select((F.col("id") / cols).cast("long").alias("row"), (F.col("id") % cols).alias("col"))
    x, y = F.lit(west) + F.col("col") * step, F.lit(north) - F.col("row") * step
    box = F.struct(x.alias("west"), (y - side).alias("south"), (x + side).alias("east"), y.alias("north"))
    return i.select(tile_id(F.lit(source), F.col("row"), F.col("col")).alias("tile_id"), "row", "col", box.alias("bbox"), F.lit("pending").alias("status"))


def paint(predictions: DataFrame, tiles: DataFrame, size: int) -> DataFrame:
    """(tile_id, rank, row, col, value columns) on the global grid: each tile filled with its prediction.

    Predictions without a tile are left out; ``unmatched`` lists them.
    """
    values = [c for c in predictions.columns if c != "tile_id"]
    at = predictions.join(tiles.select("tile_id", "rank", "row0", "col0"), "tile_id")
    cells = at.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    return cells.select("tile_id", "rank", (F.col("row0") + F.col("r")).alias("row"), (F.col("col0") + F.col("c")).alias("col"), *values)


def unmatched(predictions: DataFrame, tiles: DataFrame) -> DataFrame:
    return predictions.join(tiles, "tile_id", "left_anti").select("tile_id")


def mosaic(pixels: DataFrame) -> DataFrame:
    """(row, col, cls): of overlapping tiles the one of lowest rank with data; gaps stay out."""
    return pixels.where("cls IS NOT NULL").groupBy("row", "col").agg(F.min_by("cls", "rank").alias("cls"))


def products(pixels: DataFrame, n: int = N_CLASSES) -> DataFrame:
    """(row, col, cls, confidence, probs) of painted probabilities: of overlapping tiles the one of lowest rank that has some."""
    one = pixels.where("probs IS NOT NULL").groupBy("row", "col").agg(F.min_by("probs", "rank").alias("probs"))
    return one.select("row", "col", argmax(F.col("probs")).alias("cls"), F.array_max("probs").alias("confidence"), padded("probs", n).alias("probs"))


def padded(probs, n: int):
    """An array of n probabilities: cut or filled with zeros."""
    p = F.col(probs) if isinstance(probs, str) else probs
    return F.slice(F.concat(p.cast("array<double>"), F.array_repeat(F.lit(0.0), n)), 1, n)


def extent(meta: DataFrame, how: str = "intersection") -> DataFrame:
    """One row (west, south, east, north, res) over raster metadata: the common extent and the finest resolution.

    ``empty`` is true where an intersection has no area. Rasters of different CRS are refused by ``align``.
    """
    lo, hi = (F.max, F.min) if how == "intersection" else (F.min, F.max)
    out = meta.agg(lo("west").alias("west"), lo("south").alias("south"), hi("east").alias("east"), hi("north").alias("north"), F.min(F.least("res_x", "res_y")).alias("res"))
    return out.withColumn("empty", (F.col("west") >= F.col("east")) | (F.col("south") >= F.col("north")))


def shape(west: float, south: float, east: float, north: float, res: float) -> tuple[int, int]:
    """(height, width) of a grid; halves round to the even number."""
    return max(1, round((north - south) / res)), max(1, round((east - west) / res))


def target(spark: SparkSession, west: float, south: float, east: float, north: float, res: float) -> DataFrame:
    """(row, col, x, y) of the cells of a grid."""
    h, w = shape(west, south, east, north, res)
    i = spark.range(h * w).select((F.col("id") / w).cast("long").alias("row"), (F.col("id") % w).alias("col"))
    return i.select("row", "col", (F.lit(west) + (F.col("col") + 0.5) * res).alias("x"), (F.lit(north) - (F.col("row") + 0.5) * res).alias("y"))


def resample(source: DataFrame, cells: DataFrame, west: float, north: float, res: float, value: str, method: str = "nearest") -> DataFrame:
    """(row, col, value) of a source grid (row, col, value) at the centres of ``cells``; an unknown method is nearest.

    bilinear and cubic weigh the 4 or 16 source cells around; cells without data are left out
    and the weights of the others scaled up, so edges shrink by nothing.
    """
    src = source.select(F.col("row").alias("sr"), F.col("col").alias("sc"), F.col(value).alias("v"))
    fr, fc = (F.lit(north) - F.col("y")) / res, (F.col("x") - F.lit(west)) / res
    if method not in METHODS[1:]:
        near = cells.select("row", "col", F.floor(fr).cast("long").alias("sr"), F.floor(fc).cast("long").alias("sc"))
        return near.join(src, ["sr", "sc"]).select("row", "col", F.col("v").alias(value))
    reach = (0, 1) if method == "bilinear" else (-1, 0, 1, 2)
    base = cells.select("row", "col", (fr - 0.5).alias("fr"), (fc - 0.5).alias("fc"))

    def weight(d):
        d = F.abs(d)
        if method == "bilinear":
            return F.greatest(F.lit(0.0), 1 - d)
        return F.when(d <= 1, 1.5 * d**3 - 2.5 * d**2 + 1).when(d < 2, -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2).otherwise(0.0)

    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in reach for b in reach])
    near = base.withColumn("s", F.explode(steps)).select("row", "col", "fr", "fc", (F.floor("fr") + F.col("s.a")).cast("long").alias("sr"), (F.floor("fc") + F.col("s.b")).cast("long").alias("sc"))
    wt = weight(F.col("fr") - F.col("sr")) * weight(F.col("fc") - F.col("sc"))
    hit = near.join(src, ["sr", "sc"]).where("v IS NOT NULL").select("row", "col", "v", wt.alias("w"))
    return hit.groupBy("row", "col").agg(F.sum(F.col("v") * F.col("w")).alias("s"), F.sum("w").alias("w")).where("w <> 0").select("row", "col", (F.col("s") / F.col("w")).alias(value))


def align(rasters: dict[str, DataFrame], meta: DataFrame, value: str = "cls", how: str = "intersection", method: str = "nearest") -> DataFrame:
    """(row, col, one column a raster): all rasters on the finest grid of their common extent."""
    spark = meta.sparkSession
    if meta.select("crs").distinct().count() > 1:
        raise ValueError("rasters of different CRS must be reprojected first")
    e = extent(meta, how).first()
    if e["empty"]:
        raise ValueError("the rasters have no common extent")
    cells = target(spark, e["west"], e["south"], e["east"], e["north"], e["res"])
    facts = {r["raster"]: r for r in meta.collect()}  # a row a raster
    out = cells.select("row", "col")
    for name, pixels in rasters.items():
        m = facts[name]
        out = out.join(resample(pixels, cells, m["west"], m["north"], m["res_x"], value, method).withColumnRenamed(value, name), ["row", "col"], "left")
    return out


def extract_tile(source: DataFrame, west: float, south: float, east: float, north: float, size: int, src_west: float, src_north: float, src_res: float, value: str, method: str = "bilinear") -> DataFrame:
    """(row, col, value) of size x size cells over a box, sampled from a source grid."""
    spark = source.sparkSession
    dx, dy = (east - west) / size, (north - south) / size
    i = spark.range(size * size).select((F.col("id") / size).cast("long").alias("row"), (F.col("id") % size).alias("col"))
    cells = i.select("row", "col", (F.lit(west) + (F.col("col") + 0.5) * dx).alias("x"), (F.lit(north) - (F.col("row") + 0.5) * dy).alias("y"))
    return resample(source, cells, src_west, src_north, src_res, value, method)


def reproject(source: DataFrame, cells: DataFrame, to_source, west: float, north: float, res: float, value: str, method: str = "bilinear") -> DataFrame:
    """Values of a source grid at cells of another CRS; ``to_source`` maps (x, y) columns into the source's."""
    x, y = to_source("x", "y")
    return resample(source, cells.select("row", "col", x.alias("x"), y.alias("y")), west, north, res, value, method)


def composite(scene: DataFrame, *by: str) -> DataFrame:
    """Per-pixel median of a stack of scenes (*by, v)."""
    return scene.where("v IS NOT NULL").groupBy(*by).agg(F.median("v").alias("v"))


def latest(scene: DataFrame, *by: str) -> DataFrame:
    """Per-pixel value of the scene acquired last (*by, v, acquired)."""
    return scene.where("v IS NOT NULL").groupBy(*by).agg(F.max_by("v", "acquired").alias("v"))


def clear_pixels(scene: DataFrame, start: str, end: str, cloud_below: float, low: int = 4, high: int = 7) -> DataFrame:
    """Scene pixels of a date range under a cloud share whose scene class is vegetation, soil, water or unclassified."""
    return scene.where(F.col("acquired").between(F.lit(start).cast("date"), F.lit(end).cast("date")) & (F.col("cloud") < cloud_below) & F.col("scl").between(low, high))
