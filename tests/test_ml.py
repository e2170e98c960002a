import pytest
from pyspark.sql import functions as F

from geofold.operators import ml
from geofold.streaming import status


def tiles(spark, n=120):
    import random

    rng = random.Random(1)
    rows = [(str(i), [rng.gauss(3.0 if i % 3 == k else 0.0, 0.5) for k in range(4)], i % 3, float(i % 12), float(i // 12)) for i in range(n)]
    return spark.createDataFrame(rows, "tile_id string, embedding array<double>, cls int, x double, y double")


@pytest.mark.parametrize("kind,params", [("random_forest", {"trees": 5, "depth": 4}), ("logistic", {"iterations": 20}), ("mlp", {"hidden": (8,), "iterations": 30}), ("boosted", {"rounds": 2, "depth": 2})])
def test_classifiers(spark, tmp_path, kind, params):
    rows = tiles(spark)
    model = ml.train(rows, kind, **params)
    out = ml.predict(model, rows)
    r = out.first()
    assert len(r["probs"]) == 7 and sum(r["probs"]) == pytest.approx(1, abs=1e-6) and r["confidence"] == max(r["probs"])
    assert ml.evaluate(out, rows).first()["accuracy"] > 0.9
    model.write().overwrite().save(f"{tmp_path}/m")
    again = type(model).load(f"{tmp_path}/m")
    assert {x["tile_id"]: x["cls"] for x in ml.predict(again, rows).collect()} == {x["tile_id"]: x["cls"] for x in out.collect()}


def test_matching_and_empty(spark):
    rows = tiles(spark)
    assert ml.matched(rows, rows.where("cls = 1").select("tile_id", "cls")).count() == 40
    with pytest.raises(ValueError):
        ml.matched(rows.limit(0), rows.select("tile_id", "cls"))
    with pytest.raises(ValueError):
        ml.estimator("svm", 4)


def test_cross_validation(spark):
    rows = tiles(spark)
    folds = ml.cross_validate(rows.drop("x", "y"), "logistic", k=3, iterations=10).collect()
    assert sorted(r["fold"] for r in folds) == [0, 1, 2] and sum(r["n"] for r in folds) == 120
    placed = ml.spatial_folds(rows, k=3, buffer=1.5)
    near = placed.where(F.size("excluded") > 0)
    assert 0 < near.count() < 120 and near.where("array_contains(excluded, fold)").count() == 0
    assert ml.spatial_folds(rows, k=3, buffer=1e6).where(F.size("excluded") > 0).count() == 0  # a buffer that leaves nothing is dropped


def test_status_stream(spark, tmp_path):
    log = spark.createDataFrame([(i, str(i % 4), s, f"2024-01-01 0{i}:10:00") for i, s in enumerate(["pending", "pending", "exported", "failed", "exported", "embedded"])], "event_id long, tile_id string, status string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    for i in range(3):
        log.where(F.col("event_id") % 3 == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    stream = status.read_log(spark, f"{tmp_path}/log", log.schema)
    query = status.start(status.latest(stream), f"{tmp_path}/c1", "latest_status")
    query.awaitTermination(120)
    assert {r["tile_id"]: r["status"] for r in spark.table("latest_status").collect()} == {"0": "exported", "1": "embedded", "2": "exported", "3": "failed"}
    query = status.start(status.windowed(stream), f"{tmp_path}/c2", "by_window", "append")
    query.awaitTermination(120)
    assert spark.table("by_window").where("n <> 1").count() == 0
