"""Balanced sharding by Karmarkar-Karp differencing.

Law ``bytes``: rows with equal texts stay together, and the byte sizes of the shards come
out nearly equal. The differencing itself works on partial partitions, tuples of one load
per shard: the two of largest spread are combined, the heaviest load of one with the
lightest of the other, until one is left.

Only a bounded number of items reaches the driver, whatever the input: groups of at least
``1/(shards*FINE)`` of all bytes stand alone (at most shards*FINE of them); all others are
dealt by hash into ``GRAINS`` grains, summed before the shuffle's end. A group larger than
a fair share cannot be split under this law; its shard then holds it alone.

Null texts count as empty; repeated ids are rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geofold.llm import _store

SHARDS, FINE, GRAINS, SLICES = 24, 64, 4096, 256


def difference(sizes: list[int], shards: int) -> list[int]:
    """The shard of each item by multiway Karmarkar-Karp differencing.

    Ties go by item order; shards are numbered from the heaviest on.
    """
    heap = []
    for i, s in enumerate(sizes):
        heap.append((-s, i, [(s, [i])] + [(0, [])] * (shards - 1)))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i, heavy = heapq.heappop(heap)
        _, j, other = heapq.heappop(heap)
        loads = sorted(((a + b, p + q) for (a, p), (b, q) in zip(heavy, reversed(other))), key=lambda x: (-x[0], x[1][:1]))
        heapq.heappush(heap, (loads[-1][0] - loads[0][0], min(i, j), loads))
    out = [0] * len(sizes)
    if heap:
        for shard, (_, items) in enumerate(heap[0][2]):
            for i in items:
                out[i] = shard
    return out


def plan(rows: DataFrame, shards: int) -> DataFrame:
    """(unit, shard) for rows (group long, size long): a unit is a large group or a grain of small ones."""
    groups = _store.written(rows.groupBy("group").agg(F.sum("size").alias("bytes")), "shard-group")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    large = F.col("bytes") * (shards * FINE) >= total
    unit = F.when(large, F.concat(F.lit("g"), F.col("group").cast("string"))).otherwise(F.concat(F.lit("h"), F.pmod(F.hash("group"), F.lit(GRAINS)).cast("string")))
    units = groups.select("group", "bytes", unit.alias("unit"))
    # at most shards * FINE large groups and GRAINS grains: a bound that no input moves
    items = units.groupBy("unit").agg(F.sum("bytes").alias("bytes")).orderBy(F.desc("bytes"), "unit").collect()
    shard = difference([r["bytes"] for r in items], shards)
    table = rows.sparkSession.createDataFrame([(r["unit"], s) for r, s in zip(items, shard)], "unit string, shard int")
    return units.join(F.broadcast(table), "unit").select("group", "shard")


def shard_by_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """(id, size, text_crc32, shard, slot) per row; slots are gapless within a shard."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = _store.written(
        docs.select(F.col(id_col).cast("long").alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("group")),
        "shard-row",
    )
    placed = rows.join(plan(rows, shards), "group").withColumn("slice", F.pmod(F.xxhash64("id", "text_crc32"), F.lit(SLICES)).cast("int"))
    # slots: a count per shard and slice (bounded) gives where each slice begins
    counts = placed.groupBy("shard", "slice").count()
    begin = counts.select("shard", "slice", (F.sum("count").over(Window.partitionBy("shard").orderBy("slice")) - F.col("count")).alias("begin"))
    inside = F.row_number().over(Window.partitionBy("shard", "slice").orderBy("id", "text_crc32", "size"))
    return placed.withColumn("n", inside).join(F.broadcast(begin), ["shard", "slice"]).select("id", "size", "text_crc32", "shard", (F.col("begin") + F.col("n") - 1).cast("long").alias("slot"))
