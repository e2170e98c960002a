"""Zones over rasters: statistics, clips and pivots.

Pixels are (row, col, x, y, cls) with centre coordinates; zones are rectangles (zone_id,
west, south, east, north) or polygons (zone_id, part, xs, ys). A pixel is in a zone if
its centre is. The join runs over blocks of the grid: a zone is listed under every block
that its box meets, pixels carry their block, and only equal blocks are compared. So
the pixels are read once, whatever the number of zones, and neither side is assumed to
be small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geofold.functions.classes import CLASSES, class_name
from geofold.functions.geo import ACRE, in_ring

BLOCK = 2560.0  # side of a block in metres: 256 pixels of 10 m


def _blocks(zones: DataFrame, block: float) -> DataFrame:
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / block).cast("long"), F.floor(F.col(hi) / block).cast("long"))
    return zones.withColumn("bx", F.explode(span("west", "east"))).withColumn("by", F.explode(span("south", "north")))


def boxed(polygons: DataFrame) -> DataFrame:
    """Polygons with the box of each part."""
    return polygons.select("*", F.array_min("xs").alias("west"), F.array_min("ys").alias("south"), F.array_max("xs").alias("east"), F.array_max("ys").alias("north"))


def zone_union(polygons: DataFrame) -> DataFrame:
    """(zone_id, rings, west, south, east, north): the parts of a zone as one geometry of several rings, and its box."""
    one = boxed(polygons).groupBy("zone_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("part", "xs", "ys"))), lambda r: F.arrays_zip(r["xs"].alias("x"), r["ys"].alias("y"))).alias("rings"),  # a zone's own parts
        F.min("west").alias("west"), F.min("south").alias("south"), F.max("east").alias("east"), F.max("north").alias("north"),
    )
    return one


def in_zones(pixels: DataFrame, zones: DataFrame, block: float = BLOCK) -> DataFrame:
    """(zone_id, pixel columns): a pixel once for each zone that holds its centre."""
    polygon = "xs" in zones.columns
    shapes = _blocks(boxed(zones) if polygon else zones, block)
    p = pixels.withColumn("bx", F.floor(F.col("x") / block).cast("long")).withColumn("by", F.floor(F.col("y") / block).cast("long"))
    hit = p.join(shapes, ["bx", "by"]).where((F.col("x") > F.col("west")) & (F.col("x") < F.col("east")) & (F.col("y") > F.col("south")) & (F.col("y") < F.col("north")))
    if polygon:  # the parts of a zone are alternatives
        hit = hit.where(in_ring("x", "y", "xs", "ys"))
        return hit.select("zone_id", *pixels.columns).dropDuplicates(["zone_id", "row", "col"])
    return hit.select("zone_id", *pixels.columns)


def zone_stats(inside: DataFrame, zones: DataFrame, res: float) -> DataFrame:
    """(zone_id, cls, class, n, area_sq_m, hectares, acres, percentage) of the classes in each zone."""
    n = F.col("n")
    counts = inside.where("cls IS NOT NULL").groupBy("zone_id", "cls").agg(F.count("*").alias("n"))
    area, whole = res * res, F.sum("n").over(Window.partitionBy("zone_id"))
    return counts.select(
        "zone_id", "cls", class_name("cls").alias("class"), "n",
        F.round(n * F.lit(area), 1).alias("area_sq_m"), F.round(n * F.lit(area) / 10000.0, 2).alias("hectares"),
        F.round(n * F.lit(area) / ACRE, 2).alias("acres"), F.round(n * F.lit(100.0) / whole, 2).alias("percentage"),
    )


def zone_totals(inside: DataFrame, zones: DataFrame) -> DataFrame:
    """(zone_id, total_pixels, valid_pixels, nodata_pixels, dominant_class) of every zone, zero and NULL for empty ones."""
    ids = zones.select("zone_id").distinct()
    per = inside.groupBy("zone_id", "cls").agg(F.count("*").alias("n"))
    valid = F.sum(F.when(F.col("cls").isNotNull(), F.col("n")).otherwise(0))
    top = F.max(F.when(F.col("cls").isNotNull(), F.struct(F.col("n"), (-F.col("cls")).alias("k"))))
    sums = per.groupBy("zone_id").agg(F.sum("n").alias("total_pixels"), valid.alias("valid_pixels"), top.alias("top"))
    out = ids.join(sums, "zone_id", "left").select("zone_id", F.coalesce("total_pixels", F.lit(0)).alias("total_pixels"), F.coalesce("valid_pixels", F.lit(0)).alias("valid_pixels"), "top")
    return out.select("zone_id", "total_pixels", "valid_pixels", (F.col("total_pixels") - F.col("valid_pixels")).alias("nodata_pixels"), class_name(-F.col("top.k")).alias("dominant_class"))


def raster_stats(pixels: DataFrame, res: float) -> DataFrame:
    """(cls, class, n, hectares, percentage) of a whole raster."""
    n = F.col("n")
    counts = pixels.where("cls IS NOT NULL").groupBy("cls").agg(F.count("*").alias("n"))
    # at most one row a class
    return counts.select("cls", class_name("cls").alias("class"), "n", F.round(n * F.lit(res * res) / 10000.0, 2).alias("hectares"), F.round(n * F.lit(100.0) / F.sum("n").over(Window.partitionBy(F.lit(0))), 2).alias("percentage"))


def pivoted(stats: DataFrame) -> DataFrame:
    """A row per zone with {class}_pct and {class}_hectares, classes in alphabetic order, 0 where a class is missing."""
    names = sorted(CLASSES)
    wide = stats.groupBy("zone_id").pivot("class", names).agg(F.first("percentage").alias("pct"), F.first("hectares").alias("hectares"))
    return wide.na.fill(0.0)


def clip(inside: DataFrame) -> DataFrame:
    """(zone_id, row, col, cls): each zone's pixels with its own origin.

    The origins are a row a zone, summed before the exchange, so a large zone's pixels stay spread.
    """
    origin = inside.groupBy("zone_id").agg(F.min("row").alias("r0"), F.min("col").alias("c0"))
    return inside.join(origin, "zone_id").select("zone_id", (F.col("row") - F.col("r0")).alias("row"), (F.col("col") - F.col("c0")).alias("col"), "cls")


def coverage(inside: DataFrame, zones: DataFrame, pixels: DataFrame) -> DataFrame:
    """(zone_id, valid, total, coverage_pct, status): valid pixels inside over all pixels of the zone's box."""
    box = zones if "xs" not in zones.columns else boxed(zones).groupBy("zone_id").agg(F.min("west").alias("west"), F.min("south").alias("south"), F.max("east").alias("east"), F.max("north").alias("north"))
    total = in_zones(pixels, box).groupBy("zone_id").agg(F.count("*").alias("total"))
    valid = inside.where("cls IS NOT NULL").groupBy("zone_id").agg(F.count("*").alias("valid"))
    out = zones.select("zone_id").distinct().join(total, "zone_id", "left").join(valid, "zone_id", "left").na.fill(0, ["total", "valid"])
    return out.select("zone_id", "valid", "total", F.round(F.coalesce(F.try_divide(F.col("valid") * F.lit(100.0), F.col("total")), F.lit(0.0)), 2).alias("coverage_pct"), F.when(F.col("total") > 0, F.lit("success")).otherwise(F.lit("failed")).alias("status"))


def clip_box(pixels: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Pixels whose centre is inside a box: plain range predicates, which reach the scan."""
    return pixels.where(F.col("x").between(west, east) & F.col("y").between(south, north))
