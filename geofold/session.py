"""Sessions and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "geofold", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the engine's results rest on; sizes are left to the cluster."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors where their Python would not find it; once an application."""
    import os
    import tempfile
    import zipfile
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    app = spark.sparkContext.applicationId
    known = [os.path.realpath(p or ".") for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if app in _shipped or str(root) in known:
        return
    _shipped.add(app)
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="geofold-")), "geofold-src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((root / "geofold").rglob("*.py")):
            z.write(f, str(f.relative_to(root)))
    spark.sparkContext.addPyFile(path)
