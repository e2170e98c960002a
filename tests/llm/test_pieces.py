import random

import numpy as np
import pytest

from geofold.llm import _bytes, pieces

MODEL = pieces.MODEL
ODD = ["", "a", " ", "  lead and  double   spaces  ", "tab\tnew\nline\r\n", "raw ▁ bar▁▁", "naïve café 三四 ゼ 벨 😀 \u0000 end", "x" * 3000, "Straßenbahn-" * 40, "\n\n\n", "é" * 50, "</s> <unk> <0x41>"]


@pytest.fixture(scope="module")
def coder():
    return pieces.Encoder(pieces.Vocabulary.load(MODEL))


def run(coder, texts):
    raw = [t.encode() for t in texts]
    return coder.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64))


def brute(v, text):
    """Plain best segmentation of a whole text; ties go to the longer last piece."""
    if not text:
        return []
    code = [pieces.BAR, *[pieces.RAW if c == "▁" else pieces.BAR if c == " " else ord(c) for c in text]]
    ids = {tuple(map(ord, v.pieces[i])): int(i) for i in np.flatnonzero(v.normal)}
    best, back = [0.0] + [-np.inf] * len(code), [None] * (len(code) + 1)
    for end in range(1, len(code) + 1):
        for size in range(min(16, end), 0, -1):
            p = ids.get(tuple(code[end - size : end]))
            s = best[end - size] + (v.scores[p] if p is not None else v.worst if size == 1 else -np.inf)
            if s > best[end]:
                best[end], back[end] = s, (size, p)
    out, at = [], len(code)
    while at:
        size, p = back[at]
        c = code[at - 1]
        out[:0] = [p] if p is not None else v.byte_ids[list(chr(pieces.BAR if c == pieces.RAW else c).encode())].tolist()
        at -= size
    return out


def test_matches_a_plain_viterbi_and_decodes_exactly(coder):
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice("abcdetion ßé三\n ▁") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    flat, at = run(coder, texts)
    for i, t in enumerate(texts):
        assert flat[at[i] : at[i + 1]].tolist() == brute(coder.v, t), t[:80]
    body, off = coder.decode(flat, at)
    assert [body[a:b].tobytes().decode() for a, b in zip(off[:-1], off[1:])] == texts


def test_never_scores_below_the_library_in_unigram_mode(coder):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    sp = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    rng = random.Random(4)
    words = "the of internationalisation und Übergangszeit que niño information three-fold, end l'été".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(200)]
    flat, at = run(coder, texts)

    def total(ids):
        return sum(coder.v.scores[i] for i in ids)

    for i, t in enumerate(texts):
        mine, theirs = flat[at[i] : at[i + 1]].tolist(), sp.encode(t)
        assert total(mine) >= total(theirs) and sp.decode(mine) == t


def test_a_hash_collision_is_caught(coder, monkeypatch):
    monkeypatch.setattr(_bytes, "range_hash", lambda s, a, b: np.full(len(a), 7, np.uint64))
    fresh = pieces.Encoder(coder.v)
    texts = ["one two three", "four", ""]
    flat, at = run(fresh, texts)
    assert [flat[at[i] : at[i + 1]].tolist() for i in range(3)] == [brute(coder.v, t) for t in texts]


def test_small_cache_gives_the_same(coder, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE", 3)
    fresh = pieces.Encoder(coder.v)
    for texts in (["a b c d e f"], ["g a b h"], ["a"]):
        flat, at = run(fresh, texts)
        assert flat.tolist() == brute(coder.v, texts[0])


def test_columns_nulls_and_round_trip(spark):
    rows = [(i, t, i) for i, t in enumerate([*ODD, None, *ODD[:3]])]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece_ids_old long")
    out = pieces.decode(pieces.encode(df)).collect()
    assert len(out) == len(rows) and all(r["exact"] for r in out)
    assert sorted((r["doc_id"], r["decoded"]) for r in out) == sorted((i, t or "") for i, t, _ in rows)
    assert pieces.encode(df.limit(0)).count() == 0
