"""Agreement between class maps of one grid."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geofold.functions.classes import N_CLASSES, class_name
from geofold.functions.votes import all_valid


def paired(a: DataFrame, b: DataFrame, col_a: str = "cls", col_b: str = "cls") -> DataFrame:
    """(row, col, a, b): maps of different shapes share their upper left part."""
    return a.select("row", "col", F.col(col_a).alias("a")).join(b.select("row", "col", F.col(col_b).alias("b")), ["row", "col"])


def agreement(pairs: DataFrame) -> DataFrame:
    """(valid_pixels, agreement_pct) over (a, b); 0 and 0 without common pixels."""
    ok = pairs.where("a IS NOT NULL AND b IS NOT NULL")
    n, same = F.count("*"), F.count_if(F.col("a") == F.col("b"))
    return ok.agg(n.alias("valid_pixels"), F.round(F.coalesce(F.try_divide(same * F.lit(100.0), n), F.lit(0.0)), 2).alias("agreement_pct"))


def class_iou(pairs: DataFrame) -> DataFrame:
    """(class, both, either, count_a, count_b, iou) for each class that either map has."""
    ok = pairs.where("a IS NOT NULL AND b IS NOT NULL").groupBy("a", "b").count()
    sides = ok.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("k"), "a", "b", "count")
    hit = lambda c: F.sum(F.when(F.col(c) == F.col("k"), F.col("count")).otherwise(0))
    both = F.sum(F.when(F.col("a") == F.col("b"), F.col("count")).otherwise(0))
    return sides.groupBy("k").agg(both.alias("both"), F.sum("count").alias("either"), hit("a").alias("count_a"), hit("b").alias("count_b")).select(class_name("k").alias("class"), "both", "either", "count_a", "count_b", F.round(F.col("both") / F.col("either"), 4).alias("iou"))


def agreement_map(pairs: DataFrame) -> DataFrame:
    """(row, col, agree): 1 or 0, NULL where either map has no data."""
    return pairs.select("row", "col", F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), (F.col("a") == F.col("b")).cast("int")).alias("agree"))


def pairwise(wide: DataFrame, models: list[str]) -> DataFrame:
    """(pair, agreement_pct) over pixels where all models have data; one pass for all pairs."""
    if len(models) < 2:
        raise ValueError("agreement needs two models")
    pairs = list(combinations(models, 2))
    one = wide.where(all_valid(models)).agg(F.count("*").alias("n"), *[F.count_if(F.col(a) == F.col(b)).alias(f"{a}_vs_{b}") for a, b in pairs])
    rows = F.explode(F.array(*[F.struct(F.lit(f"{a}_vs_{b}").alias("pair"), F.col(f"{a}_vs_{b}").alias("same")) for a, b in pairs]))
    return one.select("n", rows.alias("s")).select("s.pair", F.round(F.coalesce(F.try_divide(F.col("s.same") * F.lit(100.0), F.col("n")), F.lit(0.0)), 2).alias("agreement_pct"))


def full_agreement(wide: DataFrame, models: list[str]) -> DataFrame:
    """(valid_pixels, full_pct, mean_agreement): the share of models behind the most voted class, averaged."""
    votes = F.array(*[sum((F.col(m) == k).cast("int") for m in models) for k in range(N_CLASSES)])
    one = wide.where(all_valid(models)).select(F.array_max(votes).alias("top"))
    n = F.count("*")
    return one.agg(
        n.alias("valid_pixels"), F.round(F.coalesce(F.try_divide(F.count_if(F.col("top") == len(models)) * F.lit(100.0), n), F.lit(0.0)), 2).alias("full_pct"),
        F.round(F.coalesce(F.try_divide(F.sum("top").cast("double"), n * F.lit(len(models))), F.lit(0.0)), 4).alias("mean_agreement"),
    )


def class_agreement(wide: DataFrame, models: list[str]) -> DataFrame:
    """(class, pixels_any, pixels_all, mean_agreement) over pixels where any model says the class."""
    said = F.array(*models)
    rows = wide.where(all_valid(models)).select(F.explode(F.array_distinct(said)).alias("k"), said.alias("said"))
    votes = rows.select("k", F.size(F.filter(F.transform("said", lambda x: x == F.col("k")), lambda x: x)).alias("votes"))
    n = len(models)
    return votes.where(F.col("k").between(0, N_CLASSES - 1)).groupBy("k").agg(F.count("*").alias("pixels_any"), F.count_if(F.col("votes") == n).alias("pixels_all"), F.round(F.sum("votes") / (F.count("*") * F.lit(float(n))), 4).alias("mean_agreement")).select(class_name("k").alias("class"), "pixels_any", "pixels_all", "mean_agreement")


def fusion_stats(fused: DataFrame) -> DataFrame:
    """(source, n, pct) of fused pixels with data, by where they come from."""
    n = F.col("n")
    counts = fused.agg(F.count_if(F.col("source") == 1).alias("base"), F.count_if(F.col("source") == 2).alias("refinement"), F.count_if(F.col("source") > 0).alias("valid"))
    rows = F.explode(F.array(F.struct(F.lit("base").alias("source"), F.col("base").alias("n")), F.struct(F.lit("refinement").alias("source"), F.col("refinement").alias("n"))))
    return counts.select("valid", rows.alias("s")).select("s.source", "s.n", F.greatest("valid", F.lit(1)).alias("valid")).select("source", "n", F.round(n * F.lit(100.0) / F.col("valid"), 1).alias("pct"))
