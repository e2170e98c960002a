import random
import re

import numpy as np
import xxhash

from geofold.llm import simhash

SCHEMA = "doc_id long, text string, k int, fp int"


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if bin(prints[a] ^ prints[b]).count("1") <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def corpus():
    rng = random.Random(5)
    base = [" ".join(rng.choice(["red", "Green", "été", "ÉTÉ", "one", "two", "三"]) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    texts = base + [b.upper() for b in base[:5]] + [b + " tail" for b in base[:20]] + ["", None, "  \n\t ", "one", "one two", "a b c\u0085d e", "x " * 5000] + [base[0]] * 30
    return [(i, t, 1, 2) for i, t in enumerate(texts)]


def test_matches_brute_force(spark):
    rows = corpus()
    out = {r["id"]: r for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    prints = {i: brute_print(t) for i, t, *_ in rows}
    assert {i: r["fp"] % (1 << 64) for i, r in out.items()} == prints
    assert {i: r["component"] for i, r in out.items()} == brute_components(prints)


def test_index_finds_every_pair_within_two_bits():
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = fp[:200] ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64))
    chain = near[:100] ^ (np.uint64(1) << rng.integers(0, 64, 100).astype(np.uint64))
    fp = np.unique(np.concatenate((fp, near, chain)))
    a, b = simhash.within(fp, np.zeros(len(fp), int))
    want = {(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp)) if int(fp[i] ^ fp[j]).bit_count() <= 2}
    assert set(zip(a.tolist(), b.tolist())) == want


def test_chains_null_ids_and_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "a b c", 0, 0), (7, "a b c", 0, 0), (3, None, 0, 0), (None, "zz yy xx", 0, 0)]
    got = sorted((str(r["id"]), str(r["component"])) for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [("3", "3"), ("7", "7"), ("None", "7"), ("None", "None")]
    kept = simhash.keep_one(spark.createDataFrame([*rows, (9, "A b C", 0, 0)], SCHEMA))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "7", "None"]
    assert kept.columns == ["doc_id", "text", "k", "fp"]


def test_long_chain_is_one_component(spark):
    from geofold.llm import _groups

    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (101, 100)], "a long, b long")
    got = {r["node"]: r["component"] for r in _groups.connected(edges, "t").collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100}


def jaccard_classes(rows):
    """Components of texts whose five-word shingle sets are 0.8 alike."""
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4)))
    ids = sorted(sets)
    root = {i: i for i in ids}
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = {k: x if v == y else v for k, v in root.items()}
    return root


def test_similar_texts_are_found_and_others_left(spark):
    rng = random.Random(21)
    words = [a + b for a in "ka le mi no pu ra se ti".split() for b in "tan bel dor fis gan hol".split()]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(80, 200))) for _ in range(150)]
    for i in range(60):
        w = texts[i].split()
        for _ in range(rng.randint(1, 3)):
            w[rng.randrange(len(w))] = "zzz"
        texts.append(" ".join(w))
    hot = " ".join(rng.choice(words) for _ in range(300))
    for i in range(400):  # one large group of near copies
        w = hot.split()
        w[rng.randrange(300)] = f"x{i}"
        texts.append(" ".join(w))
    texts += [hot] * 50 + ["", None, "   ", "a b", "a b", "a c"]
    rows = list(enumerate(texts))
    got = {r["id"]: r["component"] for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = jaccard_classes(rows)
    missed = [i for i in got if got[i] != want[i]]
    assert all(want[got[i]] == want[i] for i in got)  # nothing is linked that is not alike
    assert len(missed) <= 0.01 * len(rows)
    assert spark.createDataFrame([], "doc_id long, text string").transform(simhash.similar).count() == 0


def test_repeated_rows_and_ids_are_told_apart_by_their_texts(spark):
    a, b, c = "one two three four five six", "six seven eight nine ten one", "red green blue grey black white"
    rows = [(1, a), (1, a), (5, b), (5, a), (9, c), (None, c), (None, "lone row of a null id")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, id long").withColumnRenamed("id", "th")
    kept = simhash.keep_one(docs)
    assert kept.columns == ["doc_id", "text", "th"]
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(0, "lone row of a null id"), (1, a), (5, b), (9, c)]


def test_sketches_bound_the_difference_at_every_width():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (0, 5, 700, 900, 3000, 4000, 9000)]
    sets += [np.sort(np.concatenate((s[: len(s) * 9 // 10], rng.integers(0, 1 << 63, len(s) // 10, dtype=np.uint64)))) for s in sets]
    off = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    held = simhash.Sketches(simhash.sketches(np.concatenate(sets), off))
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    differ = held.differ(a, b)
    real = np.array([len(np.setxor1d(sets[i], sets[j])) for i, j in zip(a, b)])
    assert (differ <= real).all() and (differ[a == b] == 0).all()
    assert all(differ[(a == i) & (b == i + 7)][0] > 0.5 * len(sets[i]) * 0.2 for i in range(2, 7))


def test_nearest_proposals_and_blocks_lose_no_pair():
    rng = np.random.default_rng(7)
    base = [np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64)) for _ in range(3)]
    sets = [np.sort(np.concatenate((base[i % 3][rng.random(len(base[i % 3])) > 0.04], rng.integers(0, 1 << 63, 3, dtype=np.uint64)))) for i in range(90)]
    raw = simhash.sketches(np.concatenate(sets), np.concatenate(([0], np.cumsum([len(s) for s in sets]))))
    size, one, none = np.array([len(s) for s in sets]), np.zeros(90, int), np.full(90, -1)
    a, b = simhash.possible(one, np.arange(90), none, size, raw, 0.8, True)
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))}
    assert want <= set(zip(a.tolist(), b.tolist())) and len(a) < 1.1 * len(want) + 50
    x, y = simhash.possible(one, np.arange(90), none, size, raw, 0.8, False)
    assert len(x) <= 2 * 90 and len(set(simhash.roots(90, np.minimum(x, y), np.maximum(x, y)).tolist())) == 3
    half = np.arange(90) % 2
    x, y = simhash.possible(one, np.arange(90), half, size, raw, 0.8, True)
    assert {(i, j) for i, j in want if half[i] != half[j]} <= set(zip(x.tolist(), y.tolist())) and (half[x] != half[y]).all()


def test_large_buckets_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SPLIT", 16)
    test_copies_are_found_among_many_that_are_only_close(spark)


def test_copies_are_found_among_many_that_are_only_close(spark):
    """Texts of one form, each with one true copy: the nearest fingerprints are mostly others of the form."""
    rng = random.Random(3)
    form = [f"form{i}" for i in range(200)]
    texts = []
    for i in range(150):
        w = form.copy()
        for j in range(12):
            w[rng.randrange(200)] = f"own{i}x{j}"
        texts.append(" ".join(w))
        w[rng.randrange(200)] = f"copy{i}"
        w[rng.randrange(200)] = f"copy{i}"
        texts.append(" ".join(w))
    rows = list(enumerate(texts))
    want = jaccard_classes(rows)
    assert len(set(want.values())) > 100
    got = {r["id"]: r["component"] for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_every_pair_of_a_group_that_is_apart_is_compared_once():
    group = np.repeat([1, 2, 3], [1, 40, 3000])
    comp = np.concatenate(([9], np.arange(40) // 20, np.arange(3000) // 1000))
    pairs = [(i, j) for a, b in simhash.unlinked(group, comp) for i, j in zip(a.tolist(), b.tolist())]
    assert len(pairs) == len(set(pairs)) == 20 * 20 + 3 * 1000 * 1000
    assert all(i < j and group[i] == group[j] and comp[i] != comp[j] for i, j in pairs)


def test_alike_texts_are_found_whatever_their_differing_bits(spark):
    rng = random.Random(17)
    rows, far = [], 0
    for i in range(300):
        w = [f"w{rng.randrange(10**6)}" for _ in range(14)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([*w[:-1], "other"]))]
        far += (brute_print(rows[-1][1]) ^ brute_print(rows[-2][1])).bit_count() > simhash.BITS
    assert far > 0
    got = {r["id"]: r["component"] for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i in range(600)}


def test_share_of_pairs_without_a_band():
    """Sets of similarity 0.8: 7 in 100,000 pairs share no band by the formula."""
    rng = np.random.default_rng(4)
    h = rng.integers(0, 1 << 63, (4000, 100), dtype=np.uint64)
    n = len(h)
    left = simhash.bands(h[:, :90].reshape(-1), np.arange(n + 1) * 90)
    right = simhash.bands(h[:, 10:].reshape(-1), np.arange(n + 1) * 90)
    assert (1 - (1 - 0.8**simhash.DEEP) ** simhash.BANDS) > 0.9999
    assert np.mean(~(left == right).any(1)) < 0.001
