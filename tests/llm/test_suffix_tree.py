import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from geofold.llm import suffix_tree as st


def toks(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def corpus():
    rng = random.Random(8)
    vocab = ["the", "The", "of", "a", "été", "stone", "Store", "st", "zebra", "x1"] + [f"w{i}" for i in range(300)]
    weights = [30, 10, 20, 10, 8, 6, 6, 4, 3, 2] + [0.2] * 300
    docs = [(i, " ".join(rng.choices(vocab, weights, k=rng.randint(0, 60)))) for i in range(150)]
    return docs + [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "never seen before"), (1004, "the of " * 3000), (None, "of the")]


def brute(docs, depth=st.DEPTH, least=st.LEAST, gain=st.GAIN):
    """Plain dictionaries: counts of every sequence, the states, and each text's probability."""
    train = [toks(t) for i, t in docs if i is None or i % 5 != 1]
    follow = collections.defaultdict(collections.Counter)
    for ws in train:
        ws = [*ws, None]
        for i, w in enumerate(ws):
            for k in range(min(i, depth) + 1):
                follow[tuple(ws[i - k : i])][w] += 1
    c = follow[()]
    n, v = sum(c.values()), len(c)
    sums = {s: sum(t.values()) for s, t in follow.items()}
    states = {s for s, t in follow.items() if s and sums[s] >= least and sum(m * math.log(m / sums[s] * sums[s[1:]] / follow[s[1:]][w]) for w, m in t.items()) >= gain}
    unknown = (sum(m == 1 for m in c.values()) + 0.5) / (n + 1)

    def prob(s, w):
        if not s:
            return (1 - unknown) * c[w] / n if c[w] else unknown
        if s not in states:
            return prob(s[1:], w)
        t = follow[s]
        return (t[w] + len(t) * prob(s[1:], w)) / (sums[s] + len(t))

    out = []
    for i, t in docs:
        ws = [*toks(t), None]
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        own = sum(math.log10(prob(tuple(ws[max(0, j - depth) : j]), w)) for j, w in enumerate(ws))
        out.append((str(i), len(ws), sum(c[w] > 0 for w in ws), n, base, own))
    return sorted(out), states, prob, c


@pytest.mark.parametrize(("block", "depth"), [(1 << 20, 2), (3000, 3), (3000, 1)])
def test_matches_brute_force(spark, block, depth):
    docs = [*corpus(), (1004, "the of " * 3000), (7, "of the"), (7, "a stone"), (None, "of the")]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, train int").repartition(3)
    held = F.coalesce(F.col("doc_id") % 5 == 1, F.lit(False))
    rows = st.score(df, ~held, block_bytes=block, depth=depth).collect()
    got = sorted((str(r["id"]), r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in rows)
    want, states, _, _ = brute(docs, depth)
    assert {len(s) for s in states} == set(range(1, depth + 1))
    assert [g[:4] for g in got] == [w[:4] for w in want]
    for g, w in zip(got, want):
        assert g[4:] == pytest.approx(w[4:], rel=1e-6, abs=1e-6), g


def test_probabilities_sum_to_one():
    _, states, prob, c = brute(corpus())
    for s in [(), *sorted(states, key=str)[:20]]:
        unknown = prob(s, "a word that was never seen")
        assert sum(prob(s, w) for w in c) + unknown == pytest.approx(1)


def test_packing_and_ranges():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    assert (st.unpacked(st.packed(keys)) == keys).all() and len(st.unpacked(st.packed(keys[:0]))) == 0
    few = rng.integers(0, 300, 50).astype(np.uint64)
    assert (st.spread(st.squeezed(few)) == few).all()
    at = st.range_of(keys, 7, 64)
    assert (np.diff(at.astype(int)) >= 0).all() and set(at.tolist()) == set(range(7))


def test_empty_tables_and_no_training_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert st.score(df.limit(0), F.lit(True)).count() == 0
    rows = {r["id"]: r for r in st.score(df, F.lit(False)).collect()}
    assert rows[1]["n_known"] == 0 and rows[1]["train_tokens"] == 0 and rows[1]["n_tokens"] == 3
    assert rows[2]["score"] == pytest.approx(math.log10(0.5))


def test_context_beats_single_words_on_held_out_text(spark):
    rng = random.Random(1)
    def text():
        a = rng.choice([["le", "la"], ["der", "die"]])
        return " ".join(w for _ in range(30) for w in (rng.choice(a), rng.choice(["ours", "eau", "ami"] if a[0] == "le" else ["bär", "uhr", "igel"])))

    df = spark.createDataFrame([(i, text()) for i in range(200)], "doc_id long, text string")
    out = st.score(df, F.col("doc_id") % 5 != 1).where("NOT train").agg(F.sum("base_score"), F.sum("score")).first()
    assert out[1] > 0.8 * out[0]  # both are below zero


def test_texts_that_occur_twice_score_apart(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("aeiou") for _ in range(100)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate([*texts, *texts[:10]])), "doc_id long, text string")
    score = {r["id"]: r["score"] for r in st.score(df, F.lit(True)).collect()}
    assert min(score[i] for i in range(10)) > max(score[i] for i in range(10, 300))
