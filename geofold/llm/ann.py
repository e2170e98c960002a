"""Nearest neighbours by cross-polytope hashing.

Vectors are turned by pseudo-rotations (three rounds of random signs and a fast Hadamard
transform) and assigned to the nearest signed axis, one bucket in each of ``TABLES``
tables. A query probes the best ``PROBES`` (a share) of the axes in every table; the vectors in those
buckets are its candidates, and their inner products on the original vectors, in double
precision, give the order. A query that finds fewer than K goes on with twice the share of
axes, and so on up to all of them, so it gets K or all there are.

Largest inner products are nearest angles if norms are equal; where they differ, vectors
get one more component that makes them equal, and queries a zero.

Vectors are dealt once, into blocks of about 16 times the root of their number; a task holds the tables
of one block, and queries stream past it, a copy for each block: what is shuffled grows with the power
1.5 of the rows, and memory with the block. Of equal vectors only the K + 1 smallest ids can
be in any answer, so only those enter the blocks; equal queries are searched once. A task
merges what its blocks found before it sends K + 1 rows a query on.

Vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part. Ties go to smaller ids. Every row is a candidate of its own, rows
that repeat an id or are equal in all included; a query leaves out its own row only. Rows equal in id and vector
ask once; rows of one id with several vectors ask once for each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from geofold.llm import _store

K, TABLES, PROBES, SEED = 20, 6, 0.16, 7
BLOCKS = (512, 1 << 17)  # least and most vectors of a block
ASKS = 256
SLACK = 20  # candidates beyond K whose order is settled by exact sums


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal Walsh-Hadamard transform of each row; the length is a power of two."""
    n = x.shape[1]
    x, h = x / np.sqrt(n), 1
    while h < n:
        v = x.reshape(len(x), -1, 2, h)
        x = np.concatenate((v[:, :, :1] + v[:, :, 1:], v[:, :, :1] - v[:, :, 1:]), axis=2).reshape(len(x), n)
        h *= 2
    return x


class Rotations:
    def __init__(self, dim: int, tables: int = TABLES, seed: int = SEED):
        self.width = 1 << max(0, (dim - 1).bit_length())
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, 3, self.width))

    def turned(self, x: np.ndarray, table: int) -> np.ndarray:
        out = np.zeros((len(x), self.width))
        out[:, : x.shape[1]] = x
        for s in self.signs[table]:
            out = hadamard(out * s)
        return out

    def bucket(self, x: np.ndarray, table: int) -> np.ndarray:
        """The nearest signed axis."""
        y = self.turned(x, table)
        at = np.argmax(np.abs(y), axis=1)
        return at + self.width * (y[np.arange(len(y)), at] < 0)

    def probes(self, x: np.ndarray, table: int, count: int) -> np.ndarray:
        """The nearest signed axes, best first."""
        y = self.turned(x, table)
        return np.argsort(-np.concatenate((y, -y), axis=1), axis=1, kind="stable")[:, :count]


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the vectors that take part."""
    v = F.col(vec_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(v.isNotNull() & F.col(id_col).isNotNull()).where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (common["n"] if common else 0))


def _matrix(col, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _best(found: list[tuple], k: int) -> tuple:
    """The k best (largest score, smallest id) of each query among (query, id, row, copies, score), without repeats of a row."""
    q, i, r, m, s = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((r, i, -s, q))
    q, i, r, m, s = (x[order] for x in (q, i, r, m, s))
    if len(q):
        new = np.concatenate(([True], (q[1:] != q[:-1]) | (r[1:] != r[:-1])))
        q, i, r, m, s = (x[new] for x in (q, i, r, m, s))
        head = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
        near = np.arange(len(q)) - np.repeat(head, np.diff(np.append(head, len(q)))) < k
        q, i, r, m, s = (x[near] for x in (q, i, r, m, s))
    return q, i, r, m, s


class Block:
    """The tables of some vectors."""

    def __init__(self, turn: Rotations, tables: int, ids, rows, copies, x: np.ndarray, turned: np.ndarray):
        self.turn, self.ids, self.rows, self.copies, self.x = turn, ids, rows, copies, x
        self.buckets = [turn.bucket(turned, t) for t in range(tables)]

    def search(self, asks, x: np.ndarray, turned: np.ndarray, share: float, few: int) -> tuple:
        """(query, id, row, copies, score) of the best ``few`` candidates of each query."""
        axes = 2 * self.turn.width
        met = np.zeros((len(asks), len(self.ids)), bool)
        for t, bucket in enumerate(self.buckets):
            probed = np.zeros((len(asks), axes), bool)
            np.put_along_axis(probed, self.turn.probes(turned, t, max(1, round(share * axes))), True, axis=1)
            met |= probed[:, bucket]
        rough = np.where(met, x @ self.x.T, -np.inf)
        few = min(few, rough.shape[1])
        pick = np.argpartition(-rough, few - 1, axis=1)[:, :few]
        left, right = np.repeat(np.arange(len(asks)), few), pick.ravel()
        ok = met[left, right]
        left, right = left[ok], right[ok]
        exact = (x[left] * self.x[right]).sum(axis=1)  # summed in one order, so equal vectors have equal scores
        return asks[left], self.ids[right], self.rows[right], self.copies[right], exact


def search(vectors: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, tables: int = TABLES, probes: float = PROBES) -> DataFrame:
    """(query, rank, id, score): the k nearest found of each row for which ``is_query`` (a column over id) holds."""
    spark = vectors.sparkSession
    if isinstance(vectors.schema[vec_col].dataType.elementType, T.FloatType):
        rows = usable(vectors, id_col, vec_col)
    else:
        rows = usable(vectors.withColumn(vec_col, F.transform(vec_col, lambda x: x.cast("double"))), id_col, vec_col)
    rows = rows.groupBy("id", "v").agg(F.count("*").cast("int").alias("m")).withColumn("r", F.xxhash64("id", "v"))
    copies = Window.partitionBy("v").orderBy("id")
    base = _store.written(rows.withColumn("nth", F.row_number().over(copies)).where(F.col("nth") <= k + 1).select("id", "r", "m", "v"), "ann-base")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    facts = base.agg(F.count("*").alias("n"), F.max(norm).alias("most"), F.min(norm).alias("least"), F.first(F.size("v")).alias("dim")).first()
    n, dim, most = facts["n"], facts["dim"] or 1, facts["most"] or 1.0
    wider = bool(n) and (most - facts["least"]) > 1e-3 * most
    turn = spark.sparkContext.broadcast(Rotations(dim + wider, tables))
    blocks = max(1, -(-n // min(BLOCKS[1], max(BLOCKS[0], int(16 * n**0.5)))))
    asked = rows.where(is_query).select("id", "r", "v")
    classes = _store.written(asked.groupBy("v").agg(F.min("r").alias("query")), "ann-query")

    def prepared(x: np.ndarray, query: bool) -> np.ndarray:
        if not wider:
            return x
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, most * most - (x * x).sum(axis=1)))
        return np.column_stack((x, extra))

    def nearest(classes: DataFrame, share: float, tables: int) -> DataFrame:
        """(query, id, r, m, score) of the classes (query, v), by the probed share of axes."""

        def run(batches):
            now, parts, block, held, size = None, [], None, [], 0
            for b in batches:
                s, ask = b.column("s").to_numpy(), b.column("q").to_numpy(zero_copy_only=False)
                cut = np.flatnonzero(np.concatenate(([True], (s[1:] != s[:-1]) | (ask[1:] != ask[:-1]), [True]))) if len(s) else [0]
                for lo, hi in zip(cut[:-1], cut[1:]):
                    if not ask[lo]:  # a block's vectors come before its queries
                        if s[lo] != now:
                            now, parts, block = s[lo], [], None
                        parts.append(b.slice(lo, hi - lo))
                    elif s[lo] == now:
                        if block is None:
                            t, parts = pa.Table.from_batches(parts).combine_chunks(), []
                            x = _matrix(t.column("v").chunk(0), dim).astype(np.float64)
                            block = Block(turn.value, tables, *(t.column(c).to_numpy() for c in ("id", "r", "m")), x, prepared(x, False))
                        for at in range(lo, hi, ASKS):
                            some = b.slice(at, min(ASKS, hi - at))
                            x = _matrix(some.column("v"), dim).astype(np.float64)
                            held.append(_best([block.search(some.column("r").to_numpy(), x, prepared(x, True), share, k + 1 + SLACK)], k + 1))
                            size += len(held[-1][0])
                            if size > 500_000:
                                held = [_best(held, k + 1)]
                                size = len(held[0][0]) // 2  # merged again once as much has come
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in _best(held, k + 1)], ["query", "id", "r", "m", "score"])

        placed = base.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("s"), F.lit(False).alias("q"), "id", "r", "m", "v")
        asks = classes.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("s"), F.lit(True).alias("q"), F.lit(0).cast("long").alias("id"), F.col("query").alias("r"), F.lit(0).alias("m"), "v")
        return placed.unionAll(asks).repartition("s").sortWithinPartitions("s", "q").mapInArrow(run, "query long, id long, r long, m int, score double")

    near = Window.partitionBy("query").orderBy(F.desc("score"), "id", "r")
    found, short, share = None, classes, min(1.0, probes)
    while True:
        more = nearest(short, share, tables if share < 1 else 1)
        more = more if found is None else found.unionAll(more)
        found = _store.written(more.dropDuplicates(["query", "r"]).withColumn("nth", F.row_number().over(near)).where(F.col("nth") <= k + 1).drop("nth"), "ann-found")
        if share >= 1:
            break
        full = found.groupBy("query").count().where(F.col("count") >= min(k + 1, n)).select("query")
        short, share = classes.join(full, "query", "left_anti"), min(1.0, 2 * share)
        if short.isEmpty():
            break
    members = asked.join(classes, "v").select(F.col("id").alias("member"), F.col("r").alias("own"), "query")
    left = F.col("m") - (F.col("r") == F.col("own")).cast("int")
    each = members.join(found, "query").withColumn("left", left).where("left > 0").select("member", "own", "id", "r", "score", F.explode(F.sequence(F.lit(1), F.least("left", F.lit(k)))).alias("copy"))
    own = Window.partitionBy("member", "own").orderBy(F.desc("score"), "id", "r", "copy")
    return each.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).select(F.col("member").alias("query"), "rank", "id", "score")
