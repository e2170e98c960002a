"""Toxicity by a learned lexicon and Levenshtein automata.

Learning (labelled training rows only, a bounded sample of ``SAMPLE`` of them by hash
of their id): words and word prefixes that stand in toxic texts far more often than in
clean ones, by a likelihood-ratio test whose bar rises with the number of terms tried,
form the lexicon; of nested prefixes with the same evidence the longest is kept.

Matching: the lexicon's trie and the Levenshtein automata of its terms are intersected
into one deterministic table over bytes. All distinct words of a slice of text go through
it together, a byte a step, and leave it once no term is within reach. Words count as
misspelled terms within one edit from five bytes on, two from nine, never in the first
byte; prefixes within one edit from six bytes on. Near misses that clean training texts
use are ordinary words and don't count.

Scoring: a hit counts more with other hits in a window of words around it, and hits inside
quotation marks that open and close within the window are summed apart. Two sums, logs
of them, and a logistic model fitted on the sample give the score; a ridge holds what the sample
says nothing of at zero, so quotation alone is no abuse unless labels say so. Labels, language, source
and ids are never features.

Null and empty texts have no hits and get the score of such texts. Conflicting labels of
one id count as toxic. Without usable labels every score is the smoothed base rate.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geofold.llm import _bytes, _store

SAMPLE = 20_000  # labelled rows that the lexicon and the model are fitted on
PREFIXES = (4, 5, 6, 7, 8)
WINDOW = 12
CUT = 0.7
_STOP = ord("$")
#: Quotation marks of several scripts, as UTF-8: fixed values.
QUOTES = ["“", "”", "„", "‟", "«", "»", "‹", "›"]


def plain(data: np.ndarray) -> np.ndarray:
    """Lower-cased bytes; typographic quotation marks become ASCII ones of the same length."""
    low = _bytes.LOWER[data]
    for q in QUOTES:
        raw = q.encode()
        n = len(raw)
        if len(low) < n:
            continue
        hit = np.ones(len(low) - n + 1, bool)
        for t, b in enumerate(raw):
            hit &= low[t : len(low) - n + 1 + t] == b
        at = np.flatnonzero(hit)
        for t in range(n):
            low[at + t] = 0x22
    return low


# ---------------------------------------------------------------- automaton


def reach(term: str) -> int:
    """Edits allowed for a term; a trailing * marks a prefix."""
    size = len(term.rstrip("*").encode())
    if term.endswith("*"):
        return int(size >= 6)
    return 2 if size >= 9 else int(size >= 5)


class Automaton:
    """The deterministic intersection of Levenshtein automata with the lexicon's trie."""

    DEAD, EXACT = 0, 1

    def __init__(self, terms: list[str]):
        children: list[dict[int, int]] = [{}]
        depth, allowed, full, stem = [0], [0], [None], [None]
        for t in terms:
            node, k = 0, reach(t)
            allowed[0] = max(allowed[0], k)
            for b in t.rstrip("*").encode():
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                    depth.append(depth[node] + 1)
                    allowed.append(0)
                    full.append(None)
                    stem.append(None)
                node = children[node][b]
                allowed[node] = max(allowed[node], k)
            (stem if t.endswith("*") else full)[node] = k
        self.children, self.depth, self.allowed, self.full, self.stem = children, depth, allowed, full, stem
        used = sorted({b for c in children for b in c})
        self.classes = np.zeros(256, np.int64)
        for i, b in enumerate(used):
            self.classes[b] = i + 1
        punct = np.flatnonzero(_bytes.MARKS & ~_bytes.SPACE)
        self.end_class = len(used) + 1
        for b in punct:
            if self.classes[b] == 0:
                self.classes[b] = self.end_class
        symbols = [None, *used]
        start = self._close({(0, 0)})
        names = {"dead": 0, "exact": 1, "tail0": 2, "tail1": 3, "tailx": 4}
        todo = [(start, False)]
        names[todo[0]] = 5
        table: list[list[int]] = [[0] * (self.end_class + 1), [1] * (self.end_class + 1)]
        for own in (2, 3, 4):  # trailing punctuation: tail0 exact, tail1 near, tailx near by prefix
            table.append([0 if own < 4 else 4] * self.end_class + [own])
        score = [0.0, 1.0, 1.0, 0.5, 0.5]
        for state in todo:
            items, near = state
            row = []
            for s in symbols:
                row.append(self._name(self._step(items, s), near, names, todo))
            grade = self._grade(items)
            if state == todo[0]:
                row.append(5)  # leading punctuation
            else:
                row.append(2 if grade == 0 else 3 if grade else 4 if near else 0)
            table.append(row)
            score.append(1.0 if grade == 0 else 0.5 if grade or near else 0.0)
        self.table, self.score = np.array(table, np.int32), np.array(score)

    def _close(self, items):
        """Adds the terms' bytes that the text leaves out; the fewest edits per node count."""
        best = {}
        todo = list(items)
        while todo:
            node, e = todo.pop()
            if e > self.allowed[node] or best.get(node, 9) <= e:
                continue
            best[node] = e
            if self.depth[node]:
                todo += [(c, e + 1) for c in self.children[node].values()]
        return frozenset(best.items())

    def _step(self, items, symbol):
        out = set()
        for node, e in items:
            if symbol in self.children[node]:
                out.add((self.children[node][symbol], e))
            if self.depth[node]:
                out.add((node, e + 1))
                out |= {(c, e + 1) for c in self.children[node].values()}
        return self._close(out)

    def _grade(self, items):
        """0: a term in full; 1 or 2: so many edits away; None: neither."""
        ok = [e for node, e in items if self.full[node] is not None and e <= self.full[node]]
        return min(ok, default=None)

    def _name(self, items, near, names, todo) -> int:
        if any(self.stem[n] is not None and e == 0 for n, e in items):
            return self.EXACT
        near = near or any(self.stem[n] is not None and e <= self.stem[n] for n, e in items)
        if not items and not near:
            return self.DEAD
        key = (items, near)
        if key not in names:
            names[key] = len(todo) + 5
            todo.append(key)
        return names[key]

    def weigh(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """1 for words that are terms, 0.5 for near ones, else 0."""
        state = np.full(len(starts), 5, np.int32)
        live, at = np.arange(len(starts)), starts.copy()
        while len(live):
            more = at[live] < ends[live]
            live = live[more]
            state[live] = self.table[state[live], self.classes[low[at[live]]]]
            at[live] += 1
            live = live[state[live] > 1]
        return self.score[state]


# ---------------------------------------------------------------- features


def hits(auto: Automaton, data: np.ndarray, off: np.ndarray):
    """(row, word position in the row, weight, word bytes, quoted, sum of neighbours) per hit."""
    low = plain(data)
    starts, ends, row = _bytes.words(low, off, _bytes.SPACE)
    if not len(starts):
        return []
    word, keys = pd.factorize(_bytes.range_hash(_bytes.prefix_sums(low), starts, ends))
    first = np.zeros(len(keys), np.int64)
    first[word[::-1]] = np.arange(len(word))[::-1]
    weight = auto.weigh(low, starts[first], ends[first])[word]
    at = np.flatnonzero(weight > 0)
    if not len(at):
        return []
    rows = np.searchsorted(row, at, side="right") - 1
    out = []
    for i, r in zip(at.tolist(), rows.tolist()):
        lo, hi = max(int(row[r]), i - WINDOW), min(int(row[r + 1]), i + WINDOW + 1)
        around = float(weight[lo:hi].sum() - weight[i])
        marks = [bytes(low[starts[j] : ends[j]]) for j in (*range(lo, i + 1),)]
        opened = False
        for n, w in enumerate(marks):
            inner = w.strip(b".,;:!?()[]")
            last = n == len(marks) - 1
            if inner[:1] in (b'"', b"'"):
                opened = True
            if not last and inner[-1:] in (b'"', b"'") and (len(inner) > 1 or not inner[:1]):
                opened = False
        closes = any(bytes(low[starts[j] : ends[j]]).strip(b".,;:!?()[]")[-1:] in (b'"', b"'") for j in range(i, hi))
        core = bytes(low[starts[i] : ends[i]]).strip(bytes(np.flatnonzero(_bytes.MARKS).astype(np.uint8)))
        out.append((r, i - int(row[r]), float(weight[i]), core, opened and closes, around))
    return out


@dataclass
class Model:
    auto: Automaton
    ordinary: frozenset
    weights: np.ndarray

    def features(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        out = np.zeros((len(off) - 1, 2))
        for r, _, w, core, quoted, around in hits(self.auto, data, off):
            if w < 1 and core in self.ordinary:
                continue
            out[r, int(quoted)] += w * (1 + 0.25 * min(3.0, around))
        return np.log1p(out)

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        z = self.weights[0] + self.features(data, off) @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    """Intercept and weights, never negative for the first feature; Newton steps with a small ridge."""
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.0
        return np.array([math.log((rate + 1e-6) / (1 - rate + 1e-6)), 0.0, 0.0])
    a = np.column_stack((np.ones(len(y)), x))
    w, lam = np.zeros(a.shape[1]), np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + lam
        step = np.linalg.solve(h, a.T @ (y - p) - lam @ w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


# ---------------------------------------------------------------- learning


def training(labels: DataFrame, id_col: str, label_col: str, keep) -> DataFrame:
    """At most SAMPLE rows (id, y): the smallest by hash of the id of those kept."""
    rows = labels.where(F.col(label_col).isNotNull() & keep).groupBy(F.col(id_col).cast("long").alias("id")).agg((F.max(label_col) > 0).cast("int").alias("y"))
    return rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE)


def unlike(texts: DataFrame) -> DataFrame:
    """(text, y) with one text for each smallest three-word hash and label: copies are no further evidence."""

    def run(batches):
        for b in batches:
            out = []
            for _, _, data, off in _bytes.pieces(b.column("text")):
                low = _bytes.LOWER[data]
                starts, ends, row = _bytes.words(low, off, _bytes.SPACE)
                g = _bytes.ngrams(_bytes.range_hash(_bytes.prefix_sums(low), starts, ends), 3)
                for r in range(len(off) - 1):
                    mine = g[row[r] : max(row[r], row[r + 1] - 2)]
                    out.append(int(mine.min().view(np.int64)) if len(mine) else int(row[r + 1] - row[r]))
            yield pa.RecordBatch.from_arrays([b.column("text"), b.column("y"), pa.array(out, pa.int64())], ["text", "y", "sig"])

    signed = texts.select("text", "y").mapInArrow(_bytes.lean(run), "text string, y int, sig long")
    return signed.groupBy("sig", "y").agg(F.min("text").alias("text")).select("text", "y")


def lexicon(texts: DataFrame) -> list[str]:
    """Terms from (text, y)."""
    word = F.regexp_replace(F.col("w"), r"^[\x00-/:-@\[-`{-\x7F]+|[\x00-/:-@\[-`{-\x7F]+$", "")
    words = (
        texts.select("y", F.explode(F.array_distinct(F.split(F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[ \t\n\x0B\f\r]+"))).alias("w"))
        .select("y", word.alias("w"))
        .where("length(w) >= 3 AND length(w) <= 40")
        .groupBy("w")
        .agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good"))
    )
    total = words.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count("*").alias("n")).first()
    if not total["bad"] or not total["good"]:
        return []
    options = F.array(F.col("w"), *[F.when(F.length("w") >= n, F.concat(F.substring("w", 1, n), F.lit("*"))) for n in PREFIXES])
    terms = words.select(F.explode(options).alias("t"), "bad", "good").where("t IS NOT NULL").groupBy("t").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    share = total["bad"] / (total["bad"] + total["good"])
    n = F.col("bad") + F.col("good")
    good_part = F.when(F.col("good") > 0, F.col("good") * F.log(F.col("good") / (n * F.lit(1 - share)))).otherwise(0.0)
    ratio = 2 * (F.col("bad") * F.log(F.col("bad") / (n * F.lit(share))) + good_part)
    bar = 2 * math.log(max(2, total["n"])) + 4
    found = (
        terms.where("bad >= 3 AND good * 9 <= bad")
        .withColumn("g", ratio)
        .where(F.col("g") >= bar)
        .orderBy(F.desc("g"), F.desc(F.length("t")), "t")
        .collect()  # no more than the words of the sample that stand in three toxic texts
    )
    return closed([(r["t"], int(r["bad"])) for r in found])


def closed(found: list[tuple[str, int]]) -> list[str]:
    """The longest of nested terms with nearly the same evidence; terms below a kept prefix go."""
    bad = dict(found)
    kept: list[str] = []
    for t, b in sorted(found, key=lambda x: (len(x[0].rstrip("*")), x[0].endswith("*") is False, x[0])):
        stem = t.rstrip("*")
        if any(k.endswith("*") and stem.startswith(k[:-1]) for k in kept):
            continue
        longer = [u for u in bad if u != t and t.endswith("*") and u.rstrip("*").startswith(stem) and (len(u.rstrip("*")) > len(stem) or not u.endswith("*"))]
        if any(bad[u] >= 0.9 * b for u in longer):
            continue
        kept.append(t)
    order = {t: i for i, (t, _) in enumerate(found)}
    return sorted(kept, key=order.get)


def fit(docs: DataFrame, labels: DataFrame, keep, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic") -> Model:
    """Learns from the labelled rows for which ``keep`` (a column over the labels) holds."""
    _store.text_batches(docs.sparkSession)
    sample = F.broadcast(training(labels, label_id, label_col, keep))  # SAMPLE rows of two numbers at most
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(sample, "id").select("text", "y")
    auto = Automaton(lexicon(unlike(texts)))
    shared = docs.sparkSession.sparkContext.broadcast(auto)

    def run(batches):
        for b in batches:
            y = b.column("y").to_numpy()
            for lo, hi, data, off in _bytes.pieces(b.column("text")):
                found = hits(shared.value, data, off)
                words = [[] for _ in range(lo, hi)]
                for r, _, w, core, quoted, around in found:
                    words[r].append({"w": w, "core": core, "quoted": quoted, "around": around})
                kind = pa.list_(pa.struct([("w", pa.float64()), ("core", pa.binary()), ("quoted", pa.bool_()), ("around", pa.float64())]))
                yield pa.RecordBatch.from_arrays([pa.array(y[lo:hi], pa.int32()), pa.array(words, kind)], ["y", "hits"])

    seen = texts.mapInArrow(_bytes.lean(run), "y int, hits array<struct<w:double,core:binary,quoted:boolean,around:double>>")
    # one small row for each combination: rows without hits are only counted
    rows = seen.groupBy("y", "hits").count().limit(SAMPLE).collect()
    ordinary = frozenset(bytes(h["core"]) for r in rows if r["y"] == 0 for h in r["hits"] if h["w"] < 1)
    x, y, n = [], [], []
    for r in rows:
        f = [0.0, 0.0]
        for h in r["hits"]:
            if h["w"] == 1 or bytes(h["core"]) not in ordinary:
                f[int(h["quoted"])] += h["w"] * (1 + 0.25 * min(3.0, h["around"]))
        x.append(np.log1p(f))
        y.append(r["y"])
        n.append(r["count"])
    x, y = np.array(x).reshape(-1, 2), np.array(y, float)
    return Model(auto, ordinary, logistic(np.repeat(x, n, axis=0), np.repeat(y, n)))


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The kept columns with ``score``."""
    _store.text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    picked = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.col(text_col).alias("t"))
    out = picked.drop("t").schema.add("score", "double")

    def run(batches):
        for b in batches:
            s = [shared.value.score(data, off) for _, _, data, off in _bytes.pieces(b.column("t"))]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], pa.array(np.concatenate([*s, np.zeros(0)]))], names=out.names)

    return picked.mapInArrow(_bytes.lean(run), out).toDF(*keep, "score")


def held_out(id_col: str = "doc_id"):
    """Rows that are never learned from; a null id is not held out, and never labelled."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def reject(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The documents that score below ``cut``, all columns as they are."""
    model = fit(docs, labels, ~held_out())
    kept = score(docs, model, docs.columns)
    last = len(docs.columns)
    names = [f"c{i}" for i in range(last)]
    return kept.toDF(*names, "__score").where(F.col("__score") < cut).drop("__score").toDF(*docs.columns)
