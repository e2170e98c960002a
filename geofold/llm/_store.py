"""Scratch tables and files in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_cleared: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder: ``spark.checkpoint.dir``, or a temporary one where it is unset and one machine does all."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or None
    if base is None:
        held = sc._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if base is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='geofold-')}"
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder; the application's scratch goes when Python ends."""
    top = f"{shared_dir(spark)}/geofold-{spark.sparkContext.applicationId}"
    if top not in _cleared:
        _cleared.add(top)
        atexit.register(_remove, spark, top)
    return f"{top}/{what}-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the JVM has gone: the folder stays for the operator of the cluster to clear
        pass


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of what is written and let go of: it goes by the driver's garbage."""
    for _ in range(2):  # the JVM's side of Python objects goes first, then what only those held
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def forget(df: DataFrame) -> None:
    """Deletes the files of a table made by ``written`` once nothing reads it any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/geofold-" in path:
            _remove(spark, path)


TEXTS = 1500


@contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """At most so many rows in an Arrow batch of the jobs that run inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, was)


def text_batches(spark: SparkSession, rows: int = TEXTS) -> None:
    """Smaller Arrow batches for the session: ten thousand texts at once are tens of megabytes in each process that holds them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def local_or_fs(uri: str):
    """(filesystem, path) for a shared URI, for use inside executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))
