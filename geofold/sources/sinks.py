"""Where results go: Parquet, CSV and JSON folders written by the executors, rasters by chunk."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geofold.functions.classes import NODATA, class_name
from geofold.sources import geotiff


def raster(pixels: DataFrame, folder: str, product: str, cls: str | None = None) -> None:
    """A product of a raster; class columns get 255 for nodata."""
    out = pixels.withColumn(cls, F.coalesce(F.col(cls), F.lit(NODATA)).cast("short")) if cls else pixels
    out.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/product={product}")


def read_raster(spark: SparkSession, folder: str, product: str, cls: str | None = None) -> DataFrame:
    out = spark.read.parquet(f"{folder}/product={product}")
    return out.withColumn(cls, F.when(F.col(cls) != NODATA, F.col(cls).cast("int"))) if cls else out


def ensemble(products: dict[str, DataFrame], folder: str, info: dict) -> None:
    """All products of an ensemble and what they were made of."""
    spark = next(iter(products.values())).sparkSession
    for name, df in products.items():
        raster(df, folder, name, "cls" if "cls" in df.columns else None)
    meta = spark.createDataFrame([(k, str(v)) for k, v in sorted(info.items())], "key string, value string")
    meta.coalesce(1).write.mode("overwrite").json(f"{folder}/metadata")


def products(mosaic: DataFrame, folder: str, west: float, north: float, res: float, info: dict, epsg: int | None = None) -> None:
    """Classification, confidence and probability mosaics, the first two also as GeoTIFF squares, and what they were made of."""
    ensemble({"classification": mosaic.select("row", "col", "cls"), "confidence": mosaic.select("row", "col", "confidence"), "probability": mosaic.select("row", "col", "probs")}, folder, info | {"west": west, "north": north, "res": res})
    for name, value, nodata in (("classification", "cls", NODATA), ("confidence", "confidence", -1.0)):
        squares(mosaic, f"{folder}/geotiff/{name}", value, west, north, res, nodata, epsg)


def squares(pixels: DataFrame, folder: str, value: str, west: float, north: float, res: float, nodata: float = NODATA, epsg: int | None = None, size: int = 256) -> int:
    """GeoTIFF files of size x size cells, each written by the task that holds its pixels; how many there are.

    Classes are bytes, other values 32-bit floats. Names tell the places, so a task that runs again writes the same files.
    """
    uri = folder if "://" in folder else "file://" + str(Path(folder).absolute())
    kind = np.uint8 if value == "cls" else np.float32

    def write(key, table: pa.Table) -> pa.Table:
        i, j = (k.as_py() for k in key)
        data = np.full((size, size), nodata, kind)
        v = table["v"].to_numpy()
        data[table["row"].to_numpy() - i * size, table["col"].to_numpy() - j * size] = np.where(np.isnan(v), nodata, v)
        raw = geotiff.encode(data, west + j * size * res, north - i * size * res, res, epsg, nodata)
        at, path = fs.FileSystem.from_uri(uri)
        at.create_dir(path, recursive=True)
        with at.open_output_stream(f"{path}/{i:06d}_{j:06d}.tif", compression=None) as out:
            out.write(raw)
        return pa.table({"n": pa.array([1], pa.int64())})

    cells = pixels.select(F.floor(F.col("row") / size).alias("i"), F.floor(F.col("col") / size).alias("j"), F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.coalesce(F.col(value).cast("double"), F.lit(float("nan"))).alias("v"))
    return cells.groupBy("i", "j").applyInArrow(lambda key, t: write(key, t), "n long").agg(F.sum("n")).first()[0] or 0  # size * size cells at most


def labels(points: DataFrame, folder: str) -> None:
    """Labels by source, names made safe for paths."""
    safe = F.regexp_replace("source", "[^A-Za-z0-9]", "_")
    points.withColumn("source_name", safe).write.mode("overwrite").partitionBy("source_name").parquet(folder)


def splits(parts: DataFrame, folder: str) -> DataFrame:
    """Train and val below each other, and the counts of a summary."""
    parts.write.mode("overwrite").partitionBy("part").parquet(f"{folder}/splits")
    out = parts.groupBy("part", "lc_class").agg(F.count("*").alias("n"))
    out.coalesce(1).write.mode("overwrite").json(f"{folder}/summary")
    return out


def accuracy(metrics: DataFrame, per_class: DataFrame, confusion: DataFrame, points: DataFrame, folder: str) -> None:
    """Metrics as JSON, class and confusion tables as CSV (ratios to four places), points with what was predicted."""
    metrics.coalesce(1).write.mode("overwrite").json(f"{folder}/metrics")
    rounded = per_class.select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in per_class.dtypes])
    rounded.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/per_class")
    wide = confusion.groupBy("t").pivot("p").agg(F.first("n")).na.fill(0).orderBy("t")  # at most a row a class
    wide.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/confusion")
    points.withColumn("predicted_name", class_name("predicted")).write.mode("overwrite").parquet(f"{folder}/points")


def table_csv(df: DataFrame, folder: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(folder)
