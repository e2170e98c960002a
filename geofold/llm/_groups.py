"""Streams of groups over sorted Arrow batches, and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geofold.llm import _store


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups: the rows of a partition sorted by ``keys``, cut only between groups.

    A group is held until its last batch has come; several small groups come together.
    """
    held: list[pa.RecordBatch] = []
    tail: list = []
    for b in batches:
        if b.num_rows == 0:
            continue
        values = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(b.num_rows, bool)
        for v in values:
            change[1:] |= v[1:] != v[:-1]
        at = np.flatnonzero(change)
        cut = int(at[-1]) if len(at) else 0
        if held and tail != [v[0] for v in values]:
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = []
        held.append(b.slice(cut))
        tail = [v[-1] for v in values]
    if held:
        yield pa.Table.from_batches(held)


def connected(edges: DataFrame, what: str) -> DataFrame:
    """(node, component) of every node of the edges (a, b): the smallest node reachable.

    Alternating stars: each round links the larger neighbours of a node to its smallest
    neighbour, then its smaller ones and itself. Every round is written to the shared
    folder, so a lost executor repeats one round at most; rounds grow with the
    logarithm of the longest chain. Nothing is collected but one sum.
    """
    old, e = None, _store.written(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), what
    )
    last = None
    while True:
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # minima are written by themselves: a join on u right above its sum could not be split where u is the centre of many
        low = _store.written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), what)
        large = _store.written(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), what)
        least = _store.written(large.groupBy("u").agg(F.min("v").alias("m")), what)
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
            .select("x.*")
            .where("u <> v")
            .distinct()
        )
        new = _store.written(small, what)
        now = new.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        for done in (low, large, least, *([old] if old is not None else [])):
            _store.forget(done)
        if now == last:
            break
        last, old, e = now, e, new
    return new.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(new.select("v", "v").distinct().toDF("node", "component"))
