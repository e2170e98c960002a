import numpy as np
import pytest
from pyspark.sql import functions as F

from geofold.llm import ann

SCHEMA = "vec_id long, embedding array<float>, score double, t int"


def brute(ids, x, queries, k=20):
    out = {}
    for q in queries:
        s = (x * x[ids.index(q)]).sum(axis=1)
        order = sorted((i for i in range(len(ids)) if ids[i] != q), key=lambda i: (-s[i], ids[i]))[:k]
        out[q] = [(ids[i], s[i]) for i in order]
    return out


def found(spark, rows, schema=SCHEMA, **kw):
    out = {}
    for r in sorted(ann.search(spark.createDataFrame(rows, schema), F.col("id") % 20 == 0, **kw).collect(), key=lambda r: (r["query"], r["rank"])):
        out.setdefault(r["query"], []).append((r["id"], r["score"]))
        assert r["rank"] == len(out[r["query"]])
    return out


@pytest.mark.parametrize("norms", [False, True])
def test_recall_and_exact_scores(spark, norms):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if norms:
        x *= rng.uniform(0.5, 2, (3000, 1))
    x = x.astype(np.float32).astype(float)
    ids = list(range(3000))
    got = found(spark, [(i, v.tolist(), 0.0, 0) for i, v in zip(ids, x)])
    want = brute(ids, x, range(0, 3000, 20))
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert got.keys() == want.keys() and hits >= 0.9 * 20 * len(want)
    for q, near in got.items():
        assert len(near) == 20 and all(s == pytest.approx(float(x[q] @ x[i]), abs=1e-12) for i, s in near)
        assert near == sorted(near, key=lambda p: (-p[1], p[0]))


def test_copies_ties_and_few_rows(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(i, a, 0.0, 0) for i in range(100)] + [(i, b, 0.0, 0) for i in range(100, 103)]
    got = found(spark, rows, probes=1)
    assert [i for i, _ in got[0]] == list(range(1, 21)) and [i for i, _ in got[40]] == list(range(20))
    few = found(spark, rows[:2] + rows[-1:], probes=1)
    assert few == {0: [(1, 1.0), (102, 0.0)]}


def test_unusable_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    bad = [None, [], [0.0] * 3, [1.0, None, 2.0], [nan, 1.0, 1.0], [inf, 0.0, 1.0], [1.0, 2.0]]
    rows = [(20 * i, v, 0.0, 0) for i, v in enumerate(bad)] + [(1, [1.0, 2.0, 3.0], 0.0, 0), (400, [3.0, 1.0, 1.0], 0.0, 0), (None, [1.0, 1.0, 1.0], 0.0, 0)]
    assert found(spark, rows, probes=1) == {400: [(1, 8.0)]}
    assert found(spark, []) == {} and found(spark, [(0, None, 0.0, 0)]) == {}
    double = found(spark, [(0, [1e-3, 1 / 3], 0.0, 0), (1, [0.1, 0.2], 0.0, 0)], SCHEMA.replace("float", "double"), probes=1)
    assert double[0][0] == (1, pytest.approx(1e-4 + 0.2 / 3, abs=1e-15))


@pytest.mark.parametrize("n", [1, 2, 12, 21])
def test_few_rows_come_back_whole_at_default_settings(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 64))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32).astype(float)
    want = brute(list(range(n)), x, range(0, n, 20))
    got = found(spark, [(i, v.tolist(), 0.0, 0) for i, v in enumerate(x)])
    assert {q: [i for i, _ in near] for q, near in got.items()} == {q: [i for i, _ in near] for q, near in want.items() if near}


def test_far_queries_go_on_to_all_axes(spark):
    """All vectors stand on the other side of the query: none in the axes that it probes."""
    rng = np.random.default_rng(9)
    x = rng.normal(scale=0.01, size=(400, 16)) + np.eye(16)[0]
    rows = [(i + 1, v.tolist(), 0.0, 0) for i, v in enumerate(x) if (i + 1) % 20] + [(0, (-np.eye(16)[0]).tolist(), 0.0, 0)]
    got = found(spark, rows, probes=0.05)
    real = np.array([r[1] for r in rows], np.float32).astype(float)
    assert [i for i, _ in got[0]] == [i for i, _ in brute([r[0] for r in rows], real, [0])[0]]


def test_repeated_rows_are_candidates_of_their_own(spark):
    a, b, c = [1.0, 0.0], [0.0, 1.0], [0.5, 0.5]
    rows = [(0, a, 0.0, 0), (1, b, 0.0, 0), (1, b, 0.0, 0), (1, c, 0.0, 0), (2, c, 0.0, 0)]
    assert found(spark, rows) == {0: [(1, 0.5), (2, 0.5), (1, 0.0), (1, 0.0)]}
    twice = found(spark, [(0, a, 0.0, 0), (0, a, 0.0, 0), (3, b, 0.0, 0)])
    assert twice == {0: [(0, 1.0), (3, 0.0)]}
