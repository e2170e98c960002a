"""The corpus pipeline: toxic texts go, one of each near-duplicate class stays, repeated
passages are cut, contaminated documents go, and what is left is encoded.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and
returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geofold.llm import _store, decontam, pieces, simhash, suffix_array, toxicity


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the cut; learned from the labels outside the held-out third."""
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each class of texts that share 0.8 of their five-word shingles: fingerprints propose, shingles decide."""
    return simhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less every byte of a 200-byte string that stands elsewhere too; whole characters stay."""
    return suffix_array.cut_text(docs).withColumn("n_chars", F.length("text").cast("long"))


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of the benchmark."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their piece ids."""
    return pieces.encode(docs).withColumn("n_pieces", F.size("piece_ids"))


STAGES = [
    ("toxicity", toxic),
    ("simhash", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("decontaminate", contaminated),
    ("sentencepiece", encoded),
]

#: Learning, hashing with a seed, suffix order and segmentation have no SQL form: tests/llm/test_pipeline.py compares with plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = _store.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
