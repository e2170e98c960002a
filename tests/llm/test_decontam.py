import hashlib
import random
import re

import pytest

from geofold.llm import decontam

RX = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def toks(text):
    return RX.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, bench):
    out = {}
    for i, text in docs:
        w, hit, items = toks(text), set(), set()
        for item, t in bench:
            b = toks(t)
            n = min(10, len(b))
            wins = {tuple(b[j : j + n]) for j in range(len(b) - n + 1)} if n else set()
            for j in range(len(w) - n + 1):
                if n and tuple(w[j : j + n]) in wins:
                    hit.update(range(j, j + n))
                    if item is not None:
                        items.add(str(item))
        out[i] = (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest())
    return out


def data():
    rng = random.Random(3)
    vocab = ["alpha", "Beta", "gamma", "été", "7", "三"]
    bench = [(i, " ".join(rng.choice(vocab) for _ in range(n))) for i, n in enumerate([40, 25, 10, 11, 30])]
    bench += [(100, "unique short item"), (101, "Solo!"), (102, None), (103, "..."), (None, "lost words of an item without id at all here"), (2, bench[2][1]), (9, bench[2][1])]
    docs = []
    for i in range(120):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 80))]
        if i % 3 == 0:
            b = toks(bench[i % 5][1])
            at = rng.randint(0, max(0, len(b) - 9))
            w[5:5] = b[at : at + rng.randint(8, 20)]
        docs.append((i, rng.choice([" ", "-", "\n"]).join(w)))
    docs += [(200, None), (201, ""), (202, "a unique SHORT item, solo solo"), (203, "lost words of an item without id at all here"), (204, bench[0][1] * 300)]
    return docs, bench


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_matches_brute_force_in_one_block_or_many(spark, block):
    docs, bench = data()
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, hits int")
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = {r["id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in decontam.contamination(d, b, block_bytes=block).collect()}
    assert got == brute(docs, bench)


def test_clean_keeps_columns_and_empty_tables(spark):
    docs, bench = data()
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, hits int")
    b = spark.createDataFrame(bench, "item_id long, text string")
    kept = decontam.clean(d, b)
    assert kept.columns == d.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, x in brute(docs, bench).items() if not x[1]}
    twice = spark.createDataFrame([(1, bench[0][1]), (1, "clean words"), (None, bench[0][1]), (None, "more")], "doc_id long, text string")
    assert sorted(r["text"] for r in decontam.clean(twice, b).collect()) == ["clean words", "more"]
    assert decontam.clean(d, b.limit(0)).count() == len(docs)
    assert decontam.contamination(d.limit(0), b).count() == 0
