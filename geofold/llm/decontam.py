"""Benchmark decontamination by winnowing.

Every ten-word window of a test item contains six 5-grams; the one of smallest hash
(leftmost on ties) is its fingerprint, and the same words give the same fingerprint
wherever they stand. Training fingerprints that are also test fingerprints are extended
to the whole windows around them, and a window counts once its words are compared in
full. So every shared span of ten words is found, and nothing else. Items of fewer words
are one window each, fingerprinted by all their words.

A benchmark of at most ``BLOCK`` bytes of text, summed before it is read, is broadcast, and the
documents are read once. A larger one is joined: the fingerprints of the documents with those of the
test items, then the windows around the fingerprints that both have with the items' windows, word by word; two
passes and a copy of the documents at any size of the benchmark. Both ways find the same. Memory is bounded by a
block, an Arrow batch and a document's own windows. Null texts have no words; null item ids are not reported but
their words still count as hits; repeated items are reported once; repeated rows are kept apart.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geofold.llm import _bytes, _store

WINDOW, GRAM = 10, 5
BLOCK = 8 << 20


def _prepare(data: np.ndarray, off: np.ndarray):
    low = _bytes.LOWER[data]
    starts, ends, row = _bytes.words(low, off, _bytes.MARKS)
    h = _bytes.range_hash(_bytes.prefix_sums(low), starts, ends)
    return low, starts, ends, row, h


def _selected(h: np.ndarray, row: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Gram hashes, and the starts of the grams that winnowing keeps."""
    g = _bytes.ngrams(h, gram)
    w = window - gram + 1
    if len(g) < w:
        return g, np.zeros(0, np.int64)
    # position in the low bits breaks ties to the left within any window
    span = np.arange(len(g), dtype=np.uint64)
    key = (g & ~np.uint64(0xFFFFFF)) | (span & np.uint64(0xFFFFFF))
    low = _bytes.sliding_min(key, w)
    ends = np.concatenate(([True], low[1:] != low[:-1]))
    pick = low[ends]
    start = np.flatnonzero(ends)
    at = start + ((pick - start.astype(np.uint64)) & np.uint64(0xFFFFFF)).astype(np.int64)
    return g, np.unique(at)


class Index:
    """Windows and fingerprints of a block of test items (item ids as strings, in order)."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram = window, gram
        self.windows: dict[bytes, list[str]] = {}
        hashes: dict[int, set[int]] = {}
        prints: dict[int, set[int]] = {}
        for item, text in items:
            data = np.frombuffer((text or "").encode(), np.uint8)
            low, starts, ends, row, h = _prepare(data, np.array([0, len(data)]))
            n = len(h)
            if not n:
                continue
            size = min(n, window)
            raw = low.tobytes()
            toks = [raw[a:b] for a, b in zip(starts, ends)]
            for i in range(n - size + 1):
                held = self.windows.setdefault(b" ".join(toks[i : i + size]), [])
                if item is not None and str(item) not in held:
                    held.append(str(item))
            k = gram if size == window else size
            hashes.setdefault(size, set()).update(_bytes.ngrams(h, size)[: n - size + 1].tolist())
            g, at = _selected(h, row, size, k)
            prints.setdefault(size, set()).update(g[at].tolist())
        self.hashes = {k: np.array(sorted(v), np.uint64) for k, v in hashes.items()}
        self.prints = {k: np.array(sorted(v), np.uint64) for k, v in prints.items()}


def _member(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = np.searchsorted(table, x)
    at[at == len(table)] = 0
    return table[at] == x if len(table) else np.zeros(len(x), bool)


def _small(table: np.ndarray) -> np.ndarray:
    """A bit per 20-bit prefix of the hashes: a first sieve that fits the cache."""
    out = np.zeros(1 << 20, bool)
    out[(table >> np.uint64(44)).astype(np.int64)] = True
    return out


def _around(at: np.ndarray, row: np.ndarray, n: int, size: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and rows of all windows of ``size`` words in one row that hold a gram of k words that starts in ``at``."""
    first = np.unique((at[:, None] - np.arange(size - k + 1)[None, :]).ravel())
    first = first[(first >= 0) & (first + size <= n)]
    r = np.searchsorted(row, first, side="right") - 1
    inside = first + size <= row[r + 1]
    return first[inside], r[inside]


def scan(index: Index, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """(word offsets of rows, mask of hit words, [(row, first word, size)] of the windows found)."""
    low, starts, ends, row, h = _prepare(data, off)
    hit = np.zeros(len(h) + 1, np.int64)
    found = []
    raw = None
    for size, table in index.hashes.items():
        k = index.gram if size == index.window else size
        g, at = _selected(h, row, size, k)
        sieve = index.__dict__.setdefault("_sieve", {}).setdefault(size, _small(index.prints[size]))
        at = at[sieve[(g[at] >> np.uint64(44)).astype(np.int64)]]
        at = at[_member(index.prints[size], g[at])]
        if not len(at):
            continue
        first, r = _around(at, row, len(h), size, k)
        full = _bytes.ngrams(h, size) if size > 1 else _bytes.ngrams(h, 1)
        ok = _member(table, full[first])
        raw = raw if raw is not None else low.tobytes()
        for i, rr in zip(first[ok].tolist(), r[ok].tolist()):
            if b" ".join([raw[a:b] for a, b in zip(starts[i : i + size], ends[i : i + size])]) in index.windows:
                hit[i] += 1
                hit[i + size] -= 1
                found.append((rr, i, size, raw, starts, ends))
    mask = np.cumsum(hit)[:-1] > 0
    out = [(rr, i, b" ".join([raw[a:b] for a, b in zip(s[i : i + n], e[i : i + n])])) for rr, i, n, raw, s, e in found]
    return row, mask, out


FOUND = "n_words long, n_hit long, n_items long, items_sha256 string, spans array<struct<first:int,end:int>>"


def scanned(docs: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str = "text", block_bytes: int = BLOCK) -> DataFrame:
    """The kept columns with what was found in each row; no row is moved for it."""
    _store.text_batches(docs.sparkSession)
    spark = docs.sparkSession
    names = [f"c{i}" for i in range(len(keep))]
    state = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col(text_col).cast("string").alias("text"))
    ended = state.drop("text").schema
    for f in T._parse_datatype_string(FOUND).fields:
        ended = ended.add(f)
    tests = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    size = tests.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    if size > block_bytes:
        out = _joined(state, tests, names, ended)
    else:
        index = spark.sparkContext.broadcast(Index([(r["item"], r["text"]) for r in tests.collect()]))  # block_bytes at most

        def run(batches):
            for b in batches:
                for lo, hi, data, off in _bytes.pieces(b.column("text")):
                    row, mask, found = scan(index.value, data, off)
                    hit_items: dict[int, set] = {}
                    for rr, _, window in found:
                        hit_items.setdefault(rr, set()).update(index.value.windows[window])
                    yield finish(b.slice(lo, hi - lo), names, row, mask, hit_items)

        out = state.mapInArrow(_bytes.lean(run), ended)
    return out.toDF(*keep, *[c.split()[0] for c in FOUND.replace(">>", "").split(", ")])


def _joined(state: DataFrame, tests: DataFrame, names: list[str], ended) -> DataFrame:
    """What ``scan`` finds, by joins of fingerprints and of windows."""

    def of_items(batches):
        for b in batches:
            out = []
            for item, text in zip(b.column("item").to_pylist(), b.column("text").to_pylist()):
                index = Index([(item, text)])
                out += [(item, w.count(b" ") + 1, w, None) for w in index.windows]
                out += [(None, size, None, int(x)) for size, table in index.prints.items() for x in table.view(np.int64)]
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.binary(), pa.int64()))], ["item", "size", "win", "fp"])

    known = _store.written(tests.mapInArrow(of_items, "item string, size int, win binary, fp long"), "decontam-test")
    prints = _store.written(known.where("fp IS NOT NULL").select("size", "fp").distinct(), "decontam-print")
    windows = known.where("win IS NOT NULL").select("size", "win", "item").distinct()
    sizes = sorted(r["size"] for r in prints.select("size").distinct().collect())  # WINDOW at most
    rows = _store.written(state.withColumn("rid", F.monotonically_increasing_id()), "decontam-row")
    gram = {size: GRAM if size == WINDOW else size for size in sizes}

    def of_rows(batches):
        for b in batches:
            for lo, _, data, off in _bytes.pieces(b.column("text")):
                _, _, _, row, h = _prepare(data, off)
                rid = b.column("rid").to_numpy()[lo:]
                for size in sizes:
                    g, at = _selected(h, row, size, gram[size])
                    both = np.unique(np.column_stack((rid[np.searchsorted(row, at, side="right") - 1], g[at].view(np.int64))), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(np.full(len(both), size, np.int32)), pa.array(both[:, 1])], ["rid", "size", "fp"])

    met = rows.select("rid", "text").mapInArrow(of_rows, "rid long, size int, fp long").join(prints, ["size", "fp"], "left_semi")
    met = met.groupBy(F.col("rid").alias("of")).agg(F.collect_list(F.struct("size", "fp")).alias("met"))  # a row's own

    def extend(batches):
        for b in batches:
            for lo, hi, data, off in _bytes.pieces(b.column("text")):
                low, starts, ends, row, h = _prepare(data, off)
                raw, rid, both = low.tobytes(), b.column("rid").to_numpy()[lo:], b.column("met").slice(lo, hi - lo).flatten()
                kind, fp = both.field("size").to_numpy(), both.field("fp").to_numpy().view(np.uint64)
                for size in sizes:
                    g, at = _selected(h, row, size, gram[size])
                    at = at[_member(np.unique(fp[kind == size]), g[at])]
                    first, r = _around(at, row, len(h), size, gram[size])
                    wins = [b" ".join([raw[x:y] for x, y in zip(starts[i : i + size], ends[i : i + size])]) for i in first.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(rid[r]), pa.array((first - row[r]).astype(np.int32)), pa.array(np.full(len(r), size, np.int32)), pa.array(wins, pa.binary())], ["rid", "first", "size", "win"])

    near = rows.select("rid", "text").join(met, F.col("rid") == F.col("of")).select("rid", "text", "met").mapInArrow(extend, "rid long, first int, size int, win binary")
    hits = near.join(windows, ["size", "win"]).groupBy(F.col("rid").alias("of")).agg(F.collect_set(F.struct("first", "size")).alias("places"), F.collect_set("item").alias("items"))  # a row's own

    def run(batches):
        for b in batches:
            for lo, hi, data, off in _bytes.pieces(b.column("text")):
                _, _, _, row, _ = _prepare(data, off)
                some, items = b.slice(lo, hi - lo), {}
                edge = np.zeros(int(row[-1]) + 1, np.int64)
                for i, (places, mine) in enumerate(zip(some.column("places").to_pylist(), some.column("items").to_pylist())):
                    for x in places or []:
                        edge[row[i] + x["first"]] += 1
                        edge[row[i] + x["first"] + x["size"]] -= 1
                    if mine:
                        items[i] = set(mine)
                yield finish(some, names, row, np.cumsum(edge)[:-1] > 0, items)

    return rows.join(hits, F.col("rid") == F.col("of"), "left").select(*names, "text", "places", "items").mapInArrow(_bytes.lean(run), ended)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, spans) per row; spans are [first, end) word runs."""
    return scanned(docs, benchmark, [id_col], text_col, block_bytes).withColumnRenamed(id_col, "id")


def finish(b: pa.RecordBatch, keep: list[str], row: np.ndarray, mask: np.ndarray, names: dict[int, set]) -> pa.RecordBatch:
    """Result rows of a slice: its words' offsets, the words that are hit, and the items found in each row."""
    n = np.diff(row)
    total = np.concatenate(([0], np.cumsum(mask)))
    hit = total[row[1:]] - total[row[:-1]]
    listed = [sorted(names.get(i, ())) for i in range(len(n))]
    empty = hashlib.sha256(b"").hexdigest()
    runs = []
    for i in range(len(n)):
        if hit[i]:
            a, z = _bytes.spans(mask[row[i] : row[i + 1]])
            runs.append([{"first": int(p), "end": int(q)} for p, q in zip(a, z)])
        else:
            runs.append([])
    kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
    return pa.RecordBatch.from_arrays(
        [*[b.column(c) for c in keep], pa.array(n.astype(np.int64)), pa.array(hit.astype(np.int64)), pa.array([len(x) for x in listed], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() if x else empty for x in listed]), pa.array(runs, kind)],
        [*keep, "n_words", "n_hit", "n_items", "items_sha256", "spans"],
    )


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", block_bytes: int = BLOCK) -> DataFrame:
    """The documents without any window of the benchmark, all columns as they are."""
    names = [f"d{i}" for i in range(len(docs.columns))]
    found = scanned(docs.toDF(*names), benchmark, names, names[docs.columns.index(text_col)], block_bytes)
    return found.where("n_hit = 0").select(*names).toDF(*docs.columns)
