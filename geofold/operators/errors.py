"""Where and how class maps are wrong. Input pairs are (point_id, t, p), with x and y where places count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geofold.functions.classes import class_name


def summary(pairs: DataFrame) -> DataFrame:
    """(n_points, n_errors, error_rate); zeros without points."""
    n, bad = F.count("*"), F.count_if(F.col("t") != F.col("p"))
    return pairs.agg(n.alias("n_points"), bad.alias("n_errors"), F.round(F.coalesce(F.try_divide(bad.cast("double"), n.cast("double")), F.lit(0.0)), 4).alias("error_rate"))


def class_error_rates(pairs: DataFrame) -> DataFrame:
    """(class, n, errors, rate) of true classes with at least one error."""
    n, bad = F.count("*"), F.count_if(F.col("t") != F.col("p"))
    return pairs.groupBy("t").agg(n.alias("n"), bad.alias("errors"), F.round(bad / n, 4).alias("rate")).where("errors > 0").select(class_name("t").alias("class"), "n", "errors", "rate")


def top_confusions(pairs: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent errors; ties go to the one seen first by point_id."""
    wrong = pairs.where("t <> p").groupBy("t", "p").agg(F.count("*").alias("n"), F.min("point_id").alias("seen"))
    top = wrong.orderBy(F.desc("n"), "seen").limit(k)
    return top.select(F.concat(class_name("t"), F.lit(" -> "), class_name("p")).alias("confusion"), "n")


def pairs_of_true(counts: DataFrame, k: int = 10) -> DataFrame:
    """(t, p, n, pct_of_true) of the k largest off-diagonal cells of a confusion table."""
    from pyspark.sql.window import Window

    share = F.round(F.col("n") * F.lit(100.0) / F.sum("n").over(Window.partitionBy("t")), 1)
    return counts.select("t", "p", "n", share.alias("pct_of_true")).where("t <> p AND n > 0").orderBy(F.desc("n"), "t", "p").limit(k)


def asymmetry(counts: DataFrame, k: int = 5) -> DataFrame:
    """(i, j, n_ij, n_ji, ratio): class pairs confused one way more than the other, ratio rounded before it is ranked."""
    off = counts.where("t <> p")
    lo, hi = F.least("t", "p"), F.greatest("t", "p")
    both = off.select(lo.alias("i"), hi.alias("j"), F.when(F.col("t") < F.col("p"), F.col("n")).otherwise(0).alias("f"), F.when(F.col("t") > F.col("p"), F.col("n")).otherwise(0).alias("b")).groupBy("i", "j").agg(F.sum("f").alias("n_ij"), F.sum("b").alias("n_ji"))
    ratio = F.round(F.greatest("n_ij", "n_ji") / (F.least("n_ij", "n_ji") + F.lit(1e-6)), 2)
    return both.where("n_ij + n_ji > 0").withColumn("ratio", ratio).orderBy(F.desc("ratio"), "i", "j").limit(k)


def omission_commission(metrics: DataFrame) -> DataFrame:
    """(class, omission, commission and their rates) from per-class metrics."""
    o, c = F.col("support") - F.col("correct"), F.col("predicted") - F.col("correct")
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(a.cast("double"), F.col(b).cast("double")), F.lit(0.0)), 4)
    return metrics.select(class_name("k").alias("class"), o.alias("omission"), c.alias("commission"), rate(o, "support").alias("omission_rate"), rate(c, "predicted").alias("commission_rate"))


def density(points: DataFrame, west: float, south: float, east: float, north: float, grid: int = 10) -> DataFrame:
    """(row, col, n, errors, rate) of the cells of a grid over (x, y, is_error); row 0 is the southern one."""
    dx, dy = (east - west) / grid or 1.0, (north - south) / grid or 1.0
    at = lambda v, lo, d: F.least(((F.col(v) - lo) / d).cast("int"), F.lit(grid - 1))
    cells = points.select(at("y", south, dy).alias("row"), at("x", west, dx).alias("col"), F.col("is_error").cast("long").alias("e"))
    return cells.groupBy("row", "col").agg(F.count("*").alias("n"), F.sum("e").alias("errors")).withColumn("rate", F.round(F.col("errors") / F.col("n"), 4))


def hotspots(cells: DataFrame, k: int = 10, least: int = 2) -> DataFrame:
    """The k cells of ``least`` points or more whose rate is above the mean of such cells."""
    busy = cells.where(F.col("n") >= least)
    mean = busy.agg(F.round(F.avg("rate"), 10).alias("mean"))  # one row
    return busy.join(F.broadcast(mean), F.col("rate") > F.col("mean")).select("row", "col", "n", "errors", "rate").orderBy(F.desc("rate"), "row", "col").limit(k)


def edges(pixels: DataFrame, cls: str = "cls", size: int = 3, block: int = 128) -> DataFrame:
    """(row, col, cls, edge): whether any neighbour with data in the size x size window has another class.

    Pixels are dealt once by squares of ``block`` cells, each with a rim of its neighbours'
    pixels (few more rows than pixels). Neighbourhoods are then summed up within a square's
    task: the grouping by square and cell needs no exchange of its own, and no self-join.
    """
    pad = size // 2
    block = max(block, 2 * pad, 1)  # so that no window reaches into more than two squares a side
    both = lambda v: F.array_distinct(F.array(*[F.floor((F.col(v) + d) / block).cast("long") for d in (-pad, pad)]))
    has = pixels.where(F.col(cls).isNotNull()).select("row", "col", F.col(cls).alias("k"))
    dealt = has.withColumn("br", F.explode(both("row"))).withColumn("bc", F.explode(both("col"))).repartition("br", "bc")
    steps = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr in range(-pad, pad + 1) for dc in range(-pad, pad + 1)])
    sent = dealt.withColumn("s", F.explode(steps)).select("br", "bc", (F.col("row") + F.col("s.dr")).alias("row"), (F.col("col") + F.col("s.dc")).alias("col"), "k", ((F.col("s.dr") == 0) & (F.col("s.dc") == 0)).alias("own"))
    inside = sent.where((F.floor(F.col("row") / block) == F.col("br")) & (F.floor(F.col("col") / block) == F.col("bc")))
    around = inside.groupBy("br", "bc", "row", "col").agg(F.max(F.when(F.col("own"), F.col("k"))).alias("cls"), F.min("k").alias("lo"), F.max("k").alias("hi"))
    return around.where("cls IS NOT NULL").select("row", "col", "cls", (F.col("lo") != F.col("hi")).alias("edge"))


def edge_errors(marked: DataFrame) -> DataFrame:
    """(edge, t, p) rows to one row: counts and rates at edges and inside, and their ratio."""
    count = lambda e, bad: F.count_if((F.col("edge") == e) & ((F.col("t") != F.col("p")) if bad else F.lit(True)))
    one = marked.agg(count(True, False).alias("edge_points"), count(True, True).alias("edge_errors"), count(False, False).alias("interior_points"), count(False, True).alias("interior_errors"))
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    er, ir = rate("edge_errors", "edge_points"), rate("interior_errors", "interior_points")
    both = (F.col("edge_points") > 0) & (F.col("interior_points") > 0)
    return one.select("*", F.round(er, 4).alias("edge_rate"), F.round(ir, 4).alias("interior_rate"), F.when(both, F.round(er / (ir + 1e-9), 2)).otherwise(F.lit(0.0)).alias("ratio"))


def error_points(points: DataFrame, pairs: DataFrame) -> DataFrame:
    """All points with is_error 0 or 1; points that could not be compared stay 0."""
    wrong = pairs.where("t <> p").select("point_id").distinct().withColumn("e", F.lit(1))
    return points.join(wrong, "point_id", "left").withColumn("is_error", F.coalesce("e", F.lit(0))).drop("e")
