"""The pipeline against plain Python over a small corpus."""

import random

import numpy as np
import pytest

import corpus_pipeline
from geofold.llm import pieces
from tests.llm.test_decontam import brute as windows
from tests.llm.test_pieces import brute as segment
from tests.llm.test_simhash import jaccard_classes

BAD = ["dunderhead", "wretch", "vermin"]


def corpus():
    rng = random.Random(12)
    words = [a + b + c for a in "ka le mi no pu ra".split() for b in "tan bel dor fis".split() for c in ["", "en", "é"]]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, bench = [text(60) for _ in range(3)], [text(25) for _ in range(5)]
    docs, labels = [], []
    for i in range(400):
        w = text(rng.randint(5, 90)).split()
        bad = i % 8 == 0
        if bad:
            for t in BAD[: 2 + i % 2]:
                w.insert(rng.randrange(len(w)), t)
        if i % 9 == 1:
            w.insert(0, passage[i % 3])
        if i % 11 == 3:
            w.insert(0, bench[i % 5])
        docs.append((i, " ".join(w), "en", f"s{i % 3}", 0))
        labels.append((i, 1, int(bad)))
    docs += [(1000 + i, docs[i + 1][1].upper() if i % 2 else docs[i + 1][1] + " tail", "en", "s", 0) for i in range(40)]
    docs += [(2000, None, "en", "s", 0), (2001, "", "en", "s", 0), (2002, text(3000), None, None, None)]
    return docs, labels, [(i, t) for i, t in enumerate(bench)]


def cut(docs):
    raw = [(t or "").encode() for _, t in docs]
    seen = {}
    for r in raw:
        for i in range(len(r) - 199):
            seen[r[i : i + 200]] = seen.get(r[i : i + 200], 0) + 1
    out = []
    for (i, t), r in zip(docs, raw):
        mask = np.zeros(len(r), bool)
        for j in range(len(r) - 199):
            if seen[r[j : j + 200]] > 1:
                mask[j : j + 200] = True
        out.append((i, t if not mask.any() else bytes(x for x, m in zip(r, mask) if not m).decode("utf-8", "ignore")))
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("tables")
    docs, labels, bench = corpus()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top)


def test_pipeline_matches_plain_code(spark, tables):
    docs, _, bench = corpus()
    out = corpus_pipeline.run(spark, tables).collect()
    left = [(i, t) for i, t, *_ in docs if not set((t or "").lower().split()) & set(BAD)]
    comp = jaccard_classes(left)
    left = cut([(i, t) for i, t in left if comp[i] == i])
    hit = windows(left, bench)
    left = {i: t for i, t in left if not hit[i][1]}
    assert {r["doc_id"]: r["text"] for r in out} == left
    v = pieces.Vocabulary.load()
    for r in out:
        assert r["exact"] and r["piece_ids"] == segment(v, r["text"] or "") and r["n_pieces"] == len(r["piece_ids"])
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))


def test_stages_keep_columns_and_take_empty_tables(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, tables)
        assert out.schema.names == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        assert out.count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "suffix_dedup", "decontaminate", "sentencepiece"]
