"""Tile status as a stream: the latest state of each tile, and counts by event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_log(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A status log as a stream of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def latest(log: DataFrame) -> DataFrame:
    """(tile_id, status, ts) kept up to date; state is one row a tile."""
    last = F.max(F.struct("ts", "event_id", "status"))
    return log.groupBy("tile_id").agg(last.alias("s")).select("tile_id", "s.status", "s.ts")


def windowed(log: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, status, n) of closed windows; events later than ``late`` are dropped, and state ends with the watermark."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", size), "status").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "status", "n")


def start(out: DataFrame, checkpoint: str, name: str, mode: str = "complete"):
    """A memory sink for tests and small monitors; a real one is ``writeStream`` on the same frame."""
    return out.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
