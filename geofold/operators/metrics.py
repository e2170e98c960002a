"""Accuracy of class maps: confusion counts and everything that follows from them.

Counts are whole numbers and every ratio is divided once, so results don't depend on order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geofold.functions.classes import class_name

SMALL_SAMPLE = 30


def sample(points: DataFrame, raster: DataFrame, models: list[str]) -> DataFrame:
    """Points (row, col, truth) with the class that each model has there: (model, point_id, t, p), only valid pairs.

    An equi-join on the cell: Spark broadcasts whichever side is small, no side is assumed to be.
    """
    joined = points.where(F.col("truth").isNotNull()).join(raster.select("row", "col", *models), ["row", "col"])
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).cast("int").alias("p")) for m in models]))
    return joined.select("point_id", F.col("truth").cast("int").alias("t"), pairs.alias("s")).select("s.model", "point_id", "t", "s.p").where("p IS NOT NULL AND p >= 0")


def confusion(pairs: DataFrame, *by: str) -> DataFrame:
    """(*by, t, p, n)."""
    return pairs.groupBy(*by, "t", "p").agg(F.count("*").alias("n"))


def dense(counts: DataFrame, *by: str) -> DataFrame:
    """Confusion counts with zero cells for every pair of classes that stand on either side."""
    labels = counts.select(*by, F.explode(F.array("t", "p")).alias("k")).distinct()
    cells = labels.withColumnRenamed("k", "t").join(labels.withColumnRenamed("k", "p"), list(by)) if by else labels.withColumnRenamed("k", "t").crossJoin(labels.withColumnRenamed("k", "p"))
    return cells.join(counts, [*by, "t", "p"], "left").na.fill(0, ["n"])


def per_class(counts: DataFrame, *by: str) -> DataFrame:
    """(*by, k, support, predicted, correct, producer, user, f1, iou) for the union of classes; 0 where undefined."""
    sides = counts.select(*by, F.explode(F.array(F.struct(F.col("t").alias("k"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")), F.struct(F.col("p").alias("k"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted")))).alias("s"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit"))
    sums = sides.groupBy(*by, "s.k").agg(F.sum("s.support").alias("support"), F.sum("s.predicted").alias("predicted"), (F.sum("hit") / 2).cast("long").alias("correct"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    c, s, p = F.col("correct"), F.col("support"), F.col("predicted")
    return sums.select(*by, "k", "support", "predicted", "correct", ratio(c, s).alias("producer"), ratio(c, p).alias("user"), ratio(2 * c, s + p).alias("f1"), ratio(c, s + p - c).alias("iou"))


def overall(counts: DataFrame, *by: str) -> DataFrame:
    """(*by, n, correct, accuracy, kappa, f1_macro, f1_weighted, mean_iou); kappa is NULL where chance agreement is certain."""
    k = per_class(counts, *by)
    c, s, p = F.col("correct"), F.col("support"), F.col("predicted")
    n, d, e = F.sum("support"), F.sum("correct"), F.sum(s * p)
    f1 = F.coalesce(F.try_divide((2 * c).cast("double"), (s + p).cast("double")), F.lit(0.0))
    return k.groupBy(*by).agg(
        n.alias("n"), d.alias("correct"), F.try_divide(d.cast("double"), n.cast("double")).alias("accuracy"),
        F.try_divide((n * d - e).cast("double"), (n * n - e).cast("double")).alias("kappa"),
        F.avg(f1).alias("f1_macro"), F.try_divide(F.sum(f1 * s), n.cast("double")).alias("f1_weighted"), F.avg("iou").alias("mean_iou"),
    )


def small_samples(counts: DataFrame, *by: str, least: int = SMALL_SAMPLE) -> DataFrame:
    """Classes with fewer reference points than ``least``."""
    return counts.groupBy(*by, "t").agg(F.sum("n").alias("n")).where(F.col("n") < least).select(*by, class_name("t").alias("class"), "n")


def ranked(metrics: DataFrame, order: dict[str, int] | None = None) -> DataFrame:
    """Models by accuracy; ties keep the given order (by name without one)."""
    from geofold.functions.classes import lookup

    pos = lookup(order, "model") if order else F.col("model")
    # one row a model: the window holds as many rows as there are models
    return metrics.select("model", "n", "accuracy", F.row_number().over(Window.orderBy(F.desc("accuracy"), pos, "model")).alias("rank"))


def fold_summary(folds: DataFrame, *metrics: str) -> DataFrame:
    """(metric, mean, std) over folds; the spread is the population's."""
    rows = folds.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("s")).select("s.*")
    return rows.groupBy("metric").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def normalised(counts: DataFrame, *by: str) -> DataFrame:
    """Confusion counts as shares of their true class; 0 for a class that is never true."""
    whole = F.sum("n").over(Window.partitionBy(*by, "t"))
    return counts.withColumn("share", F.coalesce(F.try_divide(F.col("n").cast("double"), whole.cast("double")), F.lit(0.0)))
