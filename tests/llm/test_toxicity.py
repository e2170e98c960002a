import random

import numpy as np
import pytest

from geofold.llm import _bytes, toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def brute(terms, word):
    core = word.strip(bytes(np.flatnonzero(_bytes.MARKS).astype(np.uint8)))
    best = 0.0
    for t in terms:
        raw, k = t.rstrip("*").encode(), toxicity.reach(t)
        if not core or core[:1] != raw[:1]:
            continue
        heads = [core[:n] for n in range(1, len(core) + 1)] if t.endswith("*") else [core]
        d = min(distance(h[1:], raw[1:]) for h in heads)
        best = max(best, 1.0 if d == 0 else 0.5 if d <= k else 0.0)
    return best


def test_automaton_agrees_with_edit_distances():
    terms = ["idiot", "idiots", "worthless", "scum", "lowei*", "abcdefg*", "bête", "disgusting"]
    rng = random.Random(6)
    words = ["", ",", "\"idiot,\"", "idiot", "idiott", "idot", "xidiot", "idiocy", "scum", "scums", "loweixyz", "lowey", "abcdxfgh", "abcdeg", "abcdef", "bête", "bete", "worhtless", "wrthles", "disgustin"]
    for _ in range(3000):
        t = list(rng.choice(terms).rstrip("*"))
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(t) + 1)
            op = rng.random()
            if op < 0.4 and t:
                t[min(i, len(t) - 1)] = rng.choice("abcdefgiotswé")
            elif op < 0.7:
                t.insert(i, rng.choice("abcdefgiotsé"))
            elif t:
                del t[min(i, len(t) - 1)]
        words.append("".join(t) + rng.choice(["", "", ".", "xyz", "!?"]))
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(r) for r in raw])
    low = np.frombuffer(b"".join(raw), np.uint8)
    auto = toxicity.Automaton(terms)
    got = auto.weigh(low, ends - [len(r) for r in raw], ends)
    assert [(w, g) for w, g in zip(words, got.tolist())] == [(w, brute(terms, r)) for w, r in zip(words, raw)]


def model():
    return toxicity.Model(toxicity.Automaton(["idiot", "worthless", "scum"]), frozenset([b"idiom"]), np.array([-4.0, 8.0, 0.0]))


def scores(*texts):
    raw = [t.encode() for t in texts]
    return model().score(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw])))).tolist()


def test_quotation_is_told_from_abuse():
    abuse, quote, fancy, clean, misspelt, ordinary, empty = scores(
        "you are an idiot and nothing else", 'the report quotes "you are an idiot" as said', "she wrote “idiot” in the margin", "a calm text of plain words", "what a worthlses wortless soul", "an idiom is a phrase", ""
    )
    assert abuse > 0.7 and quote < 0.1 and fancy < 0.1 and clean < 0.1 and misspelt > 0.2 and ordinary < 0.1 and empty == clean


def test_neighbours_add_up():
    one, many = scores("idiot " + "word " * 40, "idiot worthless scum " + "word " * 40)
    assert many > one


def frame(spark):
    rng = random.Random(2)
    words = [f"{a}{b}" for a in "ka le mi no pu ra se".split() for b in "tan bel dor fis".split()]
    docs, labels = [], []
    for i in range(900):
        w = [rng.choice(words) for _ in range(60)]
        bad = i % 9 == 0
        if bad:
            for t in rng.sample(["dunderhead", "wretch", "vermin", "grotta" + rng.choice(words), "grotta" + rng.choice(words)], 3):
                w.insert(rng.randrange(len(w)), t)
        docs.append((i, " ".join(w), "x", 0.5))
        if i % 2 == 0 or bad:
            labels.append((i, 1, int(bad)))
    docs += [(5000, None, "x", 0.1), (5001, "", "x", 0.1), (5002, "kabel dunderhaed dunderhed vermin wretch " * 2000, "x", 0.1), (None, "wretch vermin dunderhead", "x", 0.1)]
    return spark.createDataFrame(docs, "doc_id long, text string, label string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_learns_terms_and_prefixes_and_scores_held_out_rows(spark):
    docs, labels = frame(spark)
    m = toxicity.fit(docs, labels, ~toxicity.held_out())
    out = {r["doc_id"]: r["score"] for r in toxicity.score(docs, m, ["doc_id"]).collect()}
    assert len(out) == docs.count()
    wrong = [i for i in range(900) if (out[i] >= 0.7) != (i % 9 == 0)]
    assert len(wrong) <= 5
    assert out[5002] >= 0.7 and out[None] >= 0.7 and out[5000] == out[5001] < 0.7
    kept = toxicity.reject(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, s in out.items() if s < 0.7}


@pytest.mark.parametrize("rows", [[], [(0, 1, None)], [(0, 1, 0), (1, 1, 0)], [(0, 1, 1)]])
def test_without_usable_labels(spark, rows):
    docs, _ = frame(spark)
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    out = toxicity.score(docs, toxicity.fit(docs, labels, ~toxicity.held_out()), ["doc_id"]).select("score").distinct().collect()
    assert len(out) == 1 and 0 <= out[0]["score"] <= 1
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels, ~toxicity.held_out()), ["doc_id"]).count() == 0
