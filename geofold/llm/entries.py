"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geofold.llm import ann

    out = ann.search(_read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
    return out.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geofold.llm import pieces

    out = pieces.encode(_read(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", F.size("piece_ids").alias("n_pieces"), "exact", "piece_ids")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geofold.llm import licenses

    return licenses.summary(_read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geofold.llm import suffix_array

    out = suffix_array.remove_repeats(_read(spark, sf_dir, "documents"), keep_text=False)
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geofold.llm import toxicity

    docs = _read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels"), ~toxicity.held_out())
    out = toxicity.score(docs, model, ["doc_id"])
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geofold.llm import sharding

    out = sharding.shard_by_bytes(_read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geofold.llm import warc

    out, _ = warc.deduplicate(_read(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geofold.llm import suffix_tree

    docs = _read(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    out = suffix_tree.score(docs, ~held)
    return out.select(F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geofold.llm import simhash

    out = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geofold.llm import decontam

    out = decontam.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_ann, op2_sentencepiece, op3_licenses, op4_suffix_dedup, op5_toxicity, op6_sharding, op7_warc, op8_suffix_tree, op9_simhash, op10_decontaminate, pipeline)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_BITS = "sha1(coalesce(html, ''))"
for _i, _c in enumerate("0123456789abcdef"):  # bits are written as x and y, so that no digit is replaced twice
    _BITS = f"replace({_BITS}, '{_c}', '{format(_i, '04b').translate({48: 'x', 49: 'y'})}')"

def _templates() -> str:
    from geofold.llm.licenses import TEMPLATES

    quoted = [f"({i}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for i, (name, text) in enumerate(TEMPLATES)]
    return ", ".join(quoted)


_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

ORACLE = {
    "op3_licenses": f"""
WITH tpl(template, license, text) AS (VALUES {_templates()}),
tw AS (SELECT template, license, regexp_extract_all(lower(text), {_WORDS}) AS w FROM tpl),
ts AS (SELECT DISTINCT template, license, array_to_string(w[i:i + 4], ' ') AS sh FROM (SELECT *, unnest(range(1, CAST(len(w) - 3 AS BIGINT))) AS i FROM tw)),
tm AS (SELECT template, license, count(*) AS m, CAST(pow(2, ceil(log2(count(*)) - 1e-9)) AS BIGINT) AS c FROM ts GROUP BY template, license),
t AS (SELECT template, license, sh, m, c FROM ts JOIN tm USING (template, license)),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(lower(coalesce(text, '')), {_WORDS}) AS w FROM documents),
g AS (SELECT rid, i - 1 AS pos, array_to_string(w[i:i + 4], ' ') AS sh FROM (SELECT rid, w, unnest(range(1, CAST(len(w) - 3 AS BIGINT))) AS i FROM d WHERE len(w) >= 5)),
h AS (SELECT rid, template, license, m, g.sh, unnest([pos // c, pos // c - 1]) AS k FROM g JOIN t ON g.sh = t.sh),
x AS (SELECT rid, license, count(DISTINCT sh) / m AS share FROM h WHERE k >= 0 GROUP BY rid, template, license, m, k HAVING count(DISTINCT sh) >= 0.8 * m),
y AS (SELECT rid, count(DISTINCT license) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS names, max(share) AS best FROM x GROUP BY rid)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_licenses, coalesce(names, '') AS licenses, CAST(coalesce(best, 0) AS DOUBLE) AS best FROM d LEFT JOIN y USING (rid)
""",
    "op7_warc": f"""
WITH b AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, translate({_BITS}, 'xy', '01') AS bits FROM pages),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
        + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT)
        + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT), 1)), '') AS payload_digest FROM b),
t AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to FROM t
""",
    "op10_decontaminate": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bs AS (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT item_id, n, w, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM bs)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT rid, n, w, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM d CROSS JOIN sizes WHERE len(w) >= n)),
hits AS (SELECT dw.rid, dw.n, dw.i, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM hits WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
""",
}
