import random
import re

import pytest

from geofold.llm import licenses

RX = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text):
    w = RX.findall((text or "").lower())
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def brute(texts, templates):
    out = []
    for t in texts:
        g, names, best = grams(t), set(), 0.0
        for name, body in templates:
            want = set(grams(body))
            c = 1
            while c < len(want):
                c *= 2
            top = max((len(want & set(g[k : k + 2 * c])) / len(want) for k in range(0, len(g), c)), default=0)
            if top >= 0.8:
                names.add(name)
                best = max(best, top)
        out.append((len(names), ",".join(sorted(names)), best))
    return out


def corpus():
    rng = random.Random(4)
    vocab = "the of license under is été and this work version 2 0 mit".split()
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    texts = []
    for _, body in licenses.TEMPLATES[:20]:
        texts.append(prose(rng.randint(0, 50)) + "\n" + body + " " + prose(rng.randint(0, 50)))
        w = body.split()
        w[rng.randrange(len(w))] = "other"  # one word changed
        texts.append(prose(30) + " " + " ".join(w))
        texts.append(body.upper().replace(" ", " \n* "))
        texts.append(" ".join(body.split()[: len(body.split()) * 9 // 10]))
    texts += [None, "", "mit", "Released under the MIT", prose(300), "Released under the MIT License. " * 500]
    texts.append(" ".join(b for _, b in licenses.TEMPLATES))
    return texts


@pytest.mark.parametrize("limit", [licenses.LIBRARY, 10])
def test_matches_brute_force(spark, limit, monkeypatch):
    monkeypatch.setattr(licenses, "LIBRARY", limit)
    texts = corpus()
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], "doc_id long, text string, license string, hits int")
    got = {r["id"]: (r["n_licenses"], r["licenses"], r["best"]) for r in licenses.summary(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, licenses.TEMPLATES)


def test_rows_and_places(spark):
    df = spark.createDataFrame([(1, "a b c d Released under the MIT License."), (1, "a b c d Released under the MIT License."), (None, "Released under the MIT License"), (2, "plain")], "doc_id long, text string")
    assert sorted((str(r["id"]), r["first"]) for r in licenses.scan(df).where("template = 0").collect()) == [("1", 4), ("1", 4), ("None", 0)]
    assert sorted((str(r["id"]), r["licenses"]) for r in licenses.summary(df).collect()) == [("1", "MIT"), ("1", "MIT"), ("2", ""), ("None", "MIT")]
    assert licenses.summary(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        licenses.library(spark, [("x", "too short")])


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = licenses.summary(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_short_templates_among_others_are_found(spark):
    """Windows full of other templates' shingles: no containment of 8 in 9 is missed."""
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(10**6)}"
    notes = [[word() for _ in range(13)] for _ in range(300)]
    fill = [[word() for _ in range(200)] for _ in range(4)]
    templates = [(f"N{i}", " ".join(w)) for i, w in enumerate(notes)] + [(f"F{i}", " ".join(w)) for i, w in enumerate(fill)]
    docs = []
    for i in range(3000):
        lo = rng.randrange(100)
        docs.append((i, " ".join(fill[i % 4][lo : lo + 50] + notes[i % 300][:12] + fill[(i + 1) % 4][lo : lo + 50])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["id"], r["license"]) for r in licenses.scan(df, templates=templates).select("id", "license").collect()}
    assert {(i, f"N{i % 300}") for i in range(3000)} <= got
