import hashlib
import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from geofold.llm import _induced, suffix_array


def brute(texts):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for r in raw:
        for i in range(len(r) - 199):
            seen[r[i : i + 200]] = seen.get(r[i : i + 200], 0) + 1
    out = []
    for r in raw:
        mask = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - 199):
            if seen[r[i : i + 200]] > 1:
                mask[i : i + 200] = True
        runs = int((np.diff(np.concatenate(([0], mask.astype(int)))) == 1).sum())
        kept = bytes(x for x, m in zip(r, mask) if not m)
        out.append((len(r), int(mask.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(80) for _ in range(6)]
    texts = [text(rng.randint(0, 200)) for _ in range(40)]
    texts += [text(30) + rng.choice(shared) + text(40) for _ in range(40)]
    base = text(150)
    for _ in range(25):  # near copies that differ in a few bytes
        b = list(base)
        for _ in range(3):
            b[rng.randrange(len(b))] = "#"
        texts.append("".join(b))
    texts += [base, base, "a" * 1000, "a" * 199, "a" * 200, "ab" * 400, shared[0] * 3, None, "", "x" * 500 + "y" + "x" * 500, shared[1][:200], shared[1][:199]]
    texts.append(text(20_000) + shared[2])
    return texts


def test_matches_brute_force(spark, monkeypatch):
    texts = corpus()
    df = spark.createDataFrame([(i, t, 0, 1) for i, t in enumerate(texts)], "doc_id long, text string, start int, h int").repartition(5)
    for shard, hot in ((8 << 20, 2000), (2000, 2000), (8 << 20, 1), (8 << 20, 10)):
        monkeypatch.setattr(suffix_array, "SHARD", shard)
        monkeypatch.setattr(suffix_array, "HOT", hot)
        got = {r["id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_array.remove_repeats(df).collect()}
        assert [got[i] for i in range(len(texts))] == brute(texts)


def test_repeated_and_null_ids_and_empty_table(spark):
    t = "".join(random.Random(1).choice("abcdefgh") for _ in range(400))
    df = spark.createDataFrame([(1, t), (1, t), (1, "other " * 10), (None, t[100:]), (None, None)], "doc_id long, text string")
    got = sorted((r["n_bytes"], r["n_removed"]) for r in suffix_array.remove_repeats(df).collect())
    assert got == [(0, 0), (60, 0), (300, 300), (400, 400), (400, 400)]
    assert suffix_array.remove_repeats(df.limit(0)).count() == 0


def test_a_shard_of_several_times_the_memory_bound_goes_to_disk(tmp_path):
    rng = np.random.default_rng(8)
    words = [bytes(rng.integers(97, 105, rng.integers(2, 9)).astype(np.uint8)) + b" " for _ in range(500)]
    body = b"".join(words[i] for i in rng.integers(0, 500, 700_000))
    body += body[1000:1700] + body[50_000:50_199] + body[7:207]
    text = np.append(np.frombuffer(body, np.uint8).astype(np.int16) + 2, np.int16(0))
    spills, n, repeated, last = [], 0, np.zeros(len(text), bool), 0
    for run, prefix in _induced.suffix_runs(text, str(tmp_path), 200, spills):
        same = prefix >= 200
        repeated[run[same]] = repeated[np.append(last, run[:-1])[same]] = True
        last, n = run[-1], n + len(run)
    assert 8 * len(text) > 3 * _induced.MEMORY and min(spills[:2]) > 0 and n == len(text)
    seen = {}
    for i in range(len(body) - 199):
        seen.setdefault(hash(body[i : i + 200]), []).append(i)
    assert np.flatnonzero(repeated).tolist() == sorted(i for v in seen.values() if len(v) > 1 for i in v)
    assert not list(tmp_path.iterdir())


@pytest.mark.parametrize("memory", [96 << 20, 64])
@pytest.mark.parametrize("kinds", [2, 5, 200])
def test_suffix_order(tmp_path, monkeypatch, memory, kinds):
    monkeypatch.setattr(_induced, "MEMORY", memory)
    monkeypatch.setattr(_induced, "RUN", 7)
    rng = np.random.default_rng(kinds)
    for n in (1, 2, 3, 50, 400):
        text = np.append(rng.integers(1, kinds + 1, n), 0).astype(np.int16)
        if n > 10:
            text[5:30] = text[5]
            text[-20:-1] = text[:19]
        right = sorted(range(n + 1), key=lambda i: text[i:].tolist())
        shared = [0] + [next(k for k in range(n + 2) if text[a + k] != text[b + k]) for a, b in zip(right[:-1], right[1:])]
        got, prefix = (np.concatenate(x) for x in zip(*_induced.suffix_runs(text, str(tmp_path), 10**6)))
        assert got.tolist() == right and prefix.tolist() == shared
        for depth in (1, 4, 9, 300):  # up to a depth: the same classes, the same prefixes
            got, prefix = (np.concatenate(x) for x in zip(*_induced.suffix_runs(text, str(tmp_path), depth)))
            assert prefix.tolist() == [min(depth, x) for x in shared]
            assert [text[i : i + depth].tolist() for i in got] == [text[i : i + depth].tolist() for i in right]
    assert not list(tmp_path.iterdir())


def test_common_prefix():
    data = np.frombuffer(b"abcabcabdabcabcab" + bytes(40), np.uint8)
    got = _induced.common_prefix(data, np.array([0, 0, 1]), np.array([3, 9, 2]), 20)
    assert got.tolist() == [5, 8, 0]


def test_tasks_give_their_memory_back():
    def kept(wrap):
        """MB that a process holds after a task whose small arrays are all free but the last."""
        code = (
            "import re, numpy as np\nfrom geofold.llm import _bytes\n"
            "now = lambda: int(re.search(r'RssAnon:\\s+(\\d+)', open('/proc/self/status').read())[1]) // 1024\n"
            "last = []\n"
            "def run(batches):\n"
            "    many = [np.ones(50_000, np.uint8) for _ in range(4000)]\n"
            "    last.append(many.pop())\n"
            "    yield from batches\n"
            f"was = now()\nassert list({wrap}(run)([1, 2])) == [1, 2]\nprint(now() - was)"
        )
        return int(subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[2], capture_output=True, text=True, check=True).stdout)

    assert kept("") > 150 > 50 > kept("_bytes.lean")
