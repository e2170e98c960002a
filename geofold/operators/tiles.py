"""Tile index, status and resumable batch work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATUSES = ["pending", "exporting", "exported", "embedding", "embedded", "predicting", "predicted", "failed"]


def latest(log: DataFrame) -> DataFrame:
    """(tile_id, status, ts, n_updates): the last event of each tile by time, then id; unknown states are refused by ``checked``."""
    last = F.max(F.struct("ts", "event_id", "status"))
    return log.groupBy("tile_id").agg(last.alias("s"), F.count("*").alias("n_updates")).select("tile_id", "s.status", "s.ts", "n_updates")


def checked(log: DataFrame) -> DataFrame:
    """Events whose status is not one of the lifecycle's."""
    return log.where(~F.col("status").isin(STATUSES) | F.col("status").isNull())


def merge(index: DataFrame, log: DataFrame) -> DataFrame:
    """The index with the latest status; tiles without events keep theirs."""
    now = latest(log).select("tile_id", F.col("status").alias("s"))
    return index.join(now, "tile_id", "left").withColumn("status", F.coalesce("s", "status")).drop("s")


def progress(index: DataFrame) -> DataFrame:
    """(status, n) of every status, zeros included, and the total."""
    dim = index.sparkSession.createDataFrame([(i, s) for i, s in enumerate(STATUSES)], "pos int, status string")
    counts = index.groupBy("status").agg(F.count("*").alias("n"))
    per = F.broadcast(dim).join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))
    return per.unionAll(index.agg(F.count("*").alias("n")).select(F.lit("total").alias("status"), "n"))


def pending(tiles: DataFrame, done: DataFrame) -> DataFrame:
    """Tiles that are not completed; failed ones are tried again."""
    return tiles.join(done.where("status = 'completed'"), "tile_id", "left_anti") if "status" in done.columns else tiles.join(done, "tile_id", "left_anti")


def run_batches(spark: SparkSession, tiles: DataFrame, progress_path: str, work, out_path: str) -> DataFrame:
    """Works on what is pending and appends results and progress; (status, n) of this run.

    ``work`` maps tiles to (tile_id, embedding, error). Results are written before progress, so a lost run repeats tiles but loses none.
    """
    try:
        done = spark.read.parquet(progress_path)
        todo = pending(tiles, done)
    except Exception as e:  # no progress yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        todo = tiles
    made = work(todo).persist()
    made.where("error IS NULL").drop("error").write.mode("append").parquet(out_path)
    state = made.select("tile_id", F.when(F.col("error").isNull(), "completed").otherwise("failed").alias("status"), "error")
    state.write.mode("append").parquet(progress_path)
    out = state.groupBy("status").agg(F.count("*").alias("n"))
    rows = out.collect()  # two rows at most
    made.unpersist()
    return spark.createDataFrame(rows, "status string, n long")


def clear(spark: SparkSession, path: str) -> bool:
    """Deletes a cache, wherever Spark keeps it; whether there was one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cached(tiles: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of the cache for the tiles, tiles that it lacks)."""
    return cache.join(tiles.select("tile_id"), "tile_id", "left_semi"), tiles.join(cache, "tile_id", "left_anti")
