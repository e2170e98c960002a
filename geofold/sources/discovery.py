"""Experiments of an earlier project: folders with YAML files and a CSV log."""

from __future__ import annotations

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geofold.functions.geo import parent_name, safe_double, safe_int

EXPERIMENT = "experiment_id string, path string, model_name string, encoder_name string, data_source string, num_classes int, has_metrics boolean, metrics map<string,double>"
LOG = ["experiment_id", "model_name", "dataset_name", "duration_minutes", "num_epochs", "val_loss", "val_iou", "val_f1", "machine_name"]


def _yaml(raw) -> dict | None:
    try:
        out = yaml.safe_load(bytes(raw)) if raw is not None else None
    except yaml.YAMLError:
        return None
    return out if isinstance(out, dict) else None


def experiments(spark: SparkSession, folder: str, config: str = "config.yaml", metrics: str = "final_metrics.yaml") -> DataFrame:
    """A row per folder with a readable configuration, with checkpoints and the last of them by name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{yaml,ckpt}").load(folder)
    parts = F.split("path", "/")
    at = files.select("path", F.get(parts, F.size(parts) - 1).alias("name"), F.regexp_replace("path", "/(checkpoints/)?[^/]+$", "").alias("dir"), "content")
    held = at.groupBy("dir").agg(
        F.max(F.when(F.col("name") == config, F.col("content"))).alias("config"), F.max(F.when(F.col("name") == metrics, F.col("content"))).alias("metrics"),
        F.sort_array(F.collect_list(F.when(F.col("name").endswith(".ckpt"), F.col("path")))).alias("checkpoints"),
    ).where("config IS NOT NULL")

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for d, c, m, ck in zip(pdf["dir"], pdf["config"], pdf["metrics"], pdf["checkpoints"]):
                c, m = _yaml(c), _yaml(m)
                if c is None:
                    continue
                model, data = c.get("model") or {}, c.get("data") or {}
                nums = {k: float(v) for k, v in (m or {}).items() if isinstance(v, (int, float))}
                rows.append((d.rsplit("/", 1)[-1], d, model.get("name", "unknown"), model.get("encoder_name", "unknown"), data.get("data_csv"), int(data.get("num_classes", 8)), m is not None, nums, list(ck)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in EXPERIMENT.split(", ")] + ["checkpoints"])

    out = held.mapInPandas(run, EXPERIMENT + ", checkpoints array<string>")
    return out.withColumn("dataset", F.when(F.col("data_source").isNotNull(), parent_name("data_source")).otherwise("unknown")).withColumn("best_checkpoint", F.try_element_at("checkpoints", F.lit(-1)))


def log(spark: SparkSession, path: str) -> DataFrame:
    """The experiment log with numbers read safely: 0 for what is none."""
    raw = spark.read.option("header", True).csv(path)
    raw = raw.select(*[F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in LOG])
    num = {"duration_minutes": safe_double, "num_epochs": safe_int, "val_loss": safe_double, "val_iou": safe_double, "val_f1": safe_double}
    return raw.where("experiment_id <> ''").select(*[(num[c](c) if c in num else F.coalesce(F.col(c), F.lit(""))).alias(c) for c in LOG])


def catalogue(found: DataFrame, entries: DataFrame) -> DataFrame:
    """Experiments with their log entry, where there is one."""
    summary = entries.select("experiment_id", F.struct(*LOG[1:]).alias("log"))
    return found.join(summary, "experiment_id", "left")


def complete(found: DataFrame) -> DataFrame:
    """Experiments with metrics, metrics rounded to four places: what is saved."""
    return found.where("has_metrics").withColumn("metrics", F.transform_values("metrics", lambda k, v: F.round(v, 4)))


def to_yaml(found: DataFrame, path: str) -> int:
    """Complete experiments as one YAML file, by name; how many there are. A row a training run, streamed."""
    rows = {r["experiment_id"]: r.asDict(recursive=True) for r in complete(found).orderBy("experiment_id").toLocalIterator()}
    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump({"experiments": rows}, f, sort_keys=True)
    return len(rows)
