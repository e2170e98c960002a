import zlib

import pytest

from geofold.llm import sharding


def test_differencing_beats_greedy_on_a_known_case():
    shard = sharding.difference([8, 7, 6, 5, 4], 2)
    loads = [sum(s for s, k in zip([8, 7, 6, 5, 4], shard) if k == j) for j in range(2)]
    assert sorted(loads) == [14, 16]


@pytest.mark.parametrize("shards", [3, 24])
def test_loads_are_nearly_equal(shards):
    sizes = [(i * 7919) % 1000 + 1 for i in range(3000)]
    shard = sharding.difference(sizes, shards)
    loads = [0] * shards
    for s, k in zip(sizes, shard):
        loads[k] += s
    assert max(loads) - min(loads) <= max(sizes) // 100


def test_groups_slots_and_edges(spark):
    texts = [f"text number {i} " * (i % 17 + 1) for i in range(2000)] + ["same copy"] * 200 + [None, "", "é" * 50_000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, shard string")
    rows = sharding.shard_by_bytes(df).collect()
    assert len(rows) == len(texts)
    by_text, slots, loads = {}, {}, [0] * 24
    for r in rows:
        raw = (texts[r["id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))
        by_text.setdefault(raw, set()).add(r["shard"])
        slots.setdefault(r["shard"], []).append(r["slot"])
        loads[r["shard"]] += r["size"]
    assert all(len(v) == 1 for v in by_text.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    rest = sorted(loads)[:-1]  # one text is larger than a fair share and stands alone
    assert max(loads) == 100_008 and max(rest) - min(rest) < 0.02 * max(rest)
    assert sharding.shard_by_bytes(df.limit(0)).count() == 0


def test_repeated_and_null_ids_against_differencing_of_every_group(spark):
    texts = [f"w{i} " * (i * 37 % 101 + 1) for i in range(3000)]
    rows = [(i % 1500 if i % 10 else None, t) for i, t in enumerate(texts)] + [(7, "twin"), (7, "twin"), (None, "twin"), (None, None), (None, "")]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    key = lambda i, t: (i is None, i or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))
    assert sorted((r["id"] is None, r["id"] or 0, r["size"], r["text_crc32"]) for r in got) == sorted(key(*r) for r in rows)
    sizes, loads, exact = {}, [0] * 24, [0] * 24
    for _, t in rows:
        sizes[t or ""] = sizes.get(t or "", 0) + len((t or "").encode()) + 8
    for r in got:
        loads[r["shard"]] += r["size"]
    for s, k in zip(sizes.values(), sharding.difference(list(sizes.values()), 24)):
        exact[k] += s
    assert sum(loads) == sum(exact)
    assert max(loads) - min(loads) <= max(exact) - min(exact) + 100  # grains of several groups cost 100 bytes at most here
    assert {len({r["shard"] for r in got if r["text_crc32"] == zlib.crc32(t)}) for t in (b"twin", b"")} == {1}
