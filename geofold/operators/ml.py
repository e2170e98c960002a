"""Classifiers on embeddings: training, cross-validation and prediction with pyspark.ml."""

from __future__ import annotations

from pyspark.ml import Estimator
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geofold.functions.classes import N_CLASSES
from geofold.functions.votes import argmax
from geofold.operators import labels as label_ops
from geofold.operators import metrics

#: Classifier names and what stands behind them.
KINDS = {"random_forest": "random_forest", "mlp": "mlp", "logistic": "logistic", "linear": "logistic", "boosted": "boosted", "xgboost": "boosted"}


def matched(embeddings: DataFrame, labelled: DataFrame) -> DataFrame:
    """(tile_id, embedding, cls) of the tiles that have both; an error if none has."""
    out = labelled.select("tile_id", "cls").join(embeddings.select("tile_id", "embedding"), "tile_id")
    if out.isEmpty():
        raise ValueError("no tile has both an embedding and a label")
    return out


def features(rows: DataFrame, balanced: bool = False) -> DataFrame:
    out = rows.withColumn("features", array_to_vector(F.col("embedding").cast("array<double>"))).withColumn("label", F.col("cls").cast("double"))
    if balanced:  # n / (k * n_c): a weight a class, a literal map of N_CLASSES entries at most
        counts = {r["cls"]: r["count"] for r in rows.groupBy("cls").count().collect() if r["cls"] is not None}
        n = sum(counts.values())
        weight = F.lit(1.0)
        for c, m in counts.items():
            weight = F.when(F.col("cls") == c, F.lit(n / (len(counts) * m))).otherwise(weight)
        out = out.withColumn("weight", weight)
    return out


def estimator(kind: str | Estimator, dim: int, n_rows: int = 1000, **params) -> Estimator:
    """A classifier over N_CLASSES classes; ``boosted`` is one boosted tree model a class. An estimator of the caller's is taken as it is."""
    if isinstance(kind, Estimator):
        return kind.copy()
    if kind not in KINDS:
        raise ValueError(f"unknown classifier {kind!r}; one of {', '.join(KINDS)}")
    kind = KINDS[kind]
    if kind == "random_forest":
        return RandomForestClassifier(numTrees=params.get("trees", 200), maxDepth=params.get("depth", 25), seed=42, weightCol="weight")
    if kind == "logistic":
        return LogisticRegression(regParam=1.0 / (params.get("c", 1.0) * n_rows), maxIter=params.get("iterations", 1000), standardization=False)
    if kind == "mlp":
        return MultilayerPerceptronClassifier(layers=[dim, *params.get("hidden", (512, 256)), N_CLASSES], maxIter=params.get("iterations", 100), seed=42)
    return OneVsRest(classifier=GBTClassifier(maxIter=params.get("rounds", 500), maxDepth=params.get("depth", 8), stepSize=0.1, subsamplingRate=0.8, seed=42))


def train(rows: DataFrame, kind: str | Estimator, **params):
    rows = features(rows, balanced=kind == "random_forest").persist()
    try:
        first = rows.first()
        if first is None:
            raise ValueError("nothing to train on")
        return estimator(kind, len(first["embedding"]), rows.count(), **params).fit(rows)
    finally:
        rows.unpersist()


def predict(model, rows: DataFrame) -> DataFrame:
    """(tile_id, cls, probs, confidence): seven probabilities by class index, whatever classes the model has seen."""
    at = rows.withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))
    out = model.transform(at)
    if "probability" in out.columns:
        p = vector_to_array("probability")
    else:  # one score a class: their logistic values, scaled to one
        raw = F.transform(vector_to_array("rawPrediction"), lambda v: 1 / (1 + F.exp(-2 * v)))
        total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
        p = F.transform(raw, lambda v: v / total)
    probs = F.slice(F.concat(p, F.array_repeat(F.lit(0.0), N_CLASSES)), 1, N_CLASSES)
    return out.select("tile_id", probs.alias("probs")).select("tile_id", argmax(F.col("probs")).alias("cls"), "probs", F.array_max("probs").alias("confidence"))


def evaluate(predicted: DataFrame, labelled: DataFrame) -> DataFrame:
    pairs = labelled.select("tile_id", F.col("cls").alias("t")).join(predicted.select("tile_id", F.col("cls").alias("p")), "tile_id")
    return metrics.overall(metrics.confusion(pairs))


def cross_validate(rows: DataFrame, kind: str, k: int = 5, fold_col: str | None = None, **params) -> DataFrame:
    """(fold, n, accuracy, kappa, f1_macro, f1_weighted, mean_iou) per fold. Rows of a fold that are listed as excluded train no model."""
    rows = (rows if fold_col else label_ops.folds(rows, k, by="cls").withColumnRenamed("fold", "fold_")).persist()
    col = fold_col or "fold_"
    out = None
    for f in range(k):  # k models
        test, rest = rows.where(F.col(col) == f), rows.where(F.col(col) != f)
        if "excluded" in rows.columns:
            rest = rest.where(~F.array_contains("excluded", f))
        one = evaluate(predict(train(rest, kind, **params), test), test).select(F.lit(f).alias("fold"), "n", "accuracy", "kappa", "f1_macro", "f1_weighted", "mean_iou")
        out = one if out is None else out.unionAll(one)
    return out


def spatial_folds(rows: DataFrame, k: int = 5, buffer: float = 0.0, seed: int = 42, id_col: str = "tile_id") -> DataFrame:
    """Rows (id, x, y, ...) with a spatial fold, and ``excluded``: folds for which a row stands too near to be trained on.

    If the buffer leaves a fold without training rows, all buffers are dropped.
    """
    vec = rows.withColumn("xy", array_to_vector(F.array(F.col("x").cast("double"), F.col("y").cast("double"))))
    placed = KMeans(k=k, seed=seed, featuresCol="xy", predictionCol="fold").fit(vec).transform(vec).drop("xy").persist()
    none = F.array().cast("array<int>")
    if buffer <= 0:
        return placed.withColumn("excluded", none)
    near = None
    for f in range(k):
        train_rows, test_rows = placed.where(F.col("fold") != f), placed.where(F.col("fold") == f)
        hit = label_ops.near_any(train_rows.select(F.col(id_col).alias("point_id"), "x", "y"), test_rows.select("x", "y"), buffer).select(F.col("point_id").alias(id_col), F.lit(f).alias("f"))
        near = hit if near is None else near.unionAll(hit)
    lists = near.groupBy(id_col).agg(F.sort_array(F.collect_set("f")).alias("excluded"))  # at most k folds
    out = placed.join(lists, id_col, "left").withColumn("excluded", F.coalesce("excluded", none)).persist()
    left = out.agg(*[F.count_if((F.col("fold") != f) & ~F.array_contains("excluded", f)).alias(str(f)) for f in range(k)]).first()
    return out.withColumn("excluded", none) if min(left) == 0 else out


def distribution(predicted: DataFrame) -> DataFrame:
    """(cls, n, mean_confidence) of predictions."""
    return predicted.groupBy("cls").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))
