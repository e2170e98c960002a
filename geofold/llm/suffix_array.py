"""Removal of repeated passages by external suffix sorting.

A byte goes if it is covered by a string of ``SPAN`` bytes that starts anywhere else too.

1. Units. Every SPAN-byte window has an anchor: the ``GRAM``-byte string of smallest hash
   in it (leftmost on ties). Equal windows have equal anchors at equal places, so windows
   can only repeat within an anchor's hash. Consecutive windows of one anchor are a unit;
   its context is the bytes that they cover. About one row for 85 bytes of text is
   shuffled: hash of the anchor, digest of the context, place. Copies within one task are
   settled before the shuffle, so a hot passage sends a row for each task.
2. Units whose whole context stands elsewhere are repeated as a whole. Units whose anchor
   stands nowhere else cannot repeat. Only what is left, anchors with differing
   contexts, goes on: its bytes are fetched by a join with the documents and dealt into
   shards by anchor.
3. Each shard is a text of contexts whose suffixes are sorted by induced sorting; the queues,
   on disk beyond a few megabytes, carry each suffix with its common prefix. Neighbours
   in suffix order with a common prefix of SPAN bytes or more are repeats.
   An anchor with more than HOT differing contexts is not gathered in one task: its windows are
   compared by two 64-bit digests instead, spread over all tasks.
4. Repeated runs come back to their document, which is cut and hashed.

Null and empty texts have nothing to remove, and neither have texts shorter than SPAN
bytes. Rows that repeat an id are told apart by their text; rows equal in both repeat
each other. Matches never cross documents.
"""

from __future__ import annotations

import hashlib
import shutil
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from geofold.llm import _bytes, _groups, _induced, _store

SPAN, GRAM = 200, 32
REACH = SPAN - GRAM + 1
SHARD = 4 << 20
HOT = 2000
PIECE = 1 << 20
SEEN = 1 << 20
ONE, LOCAL, DONE = 0, 1, 2
_OTHER = np.random.default_rng(5).integers(0, 1 << 63, 256, dtype=np.uint64)  # bytes as other numbers: a second digest
UNIT = "kind tinyint, h long, c long, id long, t long, start int, n int"


def unit_rows(data: np.ndarray, off: np.ndarray, span: int = SPAN, gram: int = GRAM):
    """(row, first window, windows, anchor hash, context digest) of the units of the rows."""
    reach = span - gram + 1
    size = np.diff(off)
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    if size.max(initial=0) < span:
        return none
    s = _bytes.prefix_sums(data)
    _, inv = _bytes.powers(len(s))
    n = len(data) - gram + 1
    g = _bytes.mix((s[gram:] - s[:n]) * inv[:n])
    place = np.arange(n, dtype=np.uint64)
    low24 = np.uint64(0xFFFFFF)
    key = (g & ~low24) | (place & low24)
    least = _bytes.sliding_min(key, reach)  # by first byte of the window
    many = np.maximum(size - span + 1, 0)
    win = _bytes.ranges(off[:-1], many)  # windows inside one row
    row = np.repeat(np.arange(len(size)), many)
    pick = least[win]
    new = np.concatenate(([True], (pick[1:] != pick[:-1]) | (row[1:] != row[:-1])))
    at = np.flatnonzero(new)
    first, count = win[at], np.diff(np.append(at, len(win)))
    anchor = first + ((pick[at] - first.astype(np.uint64)) & low24).astype(np.int64)
    context = _bytes.range_hash(s, first, first + count + span - 1)
    return row[at], first - off[row[at]], count, g[anchor], context


def merge_runs(row, start, n):
    """Joins runs of windows that follow on each other in a row (sorted by row and start)."""
    if not len(row):
        return row, start, n
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + n[:-1])))
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(row)) - 1
    return row[at], start[at], start[last] + n[last] - start[at]


def units(docs: DataFrame) -> DataFrame:
    """Units of (id, t, text): ONE stands alone in its task, LOCAL for several equal ones there, DONE is a run of those."""

    def run(batches):
        held: list[tuple] = []
        size = 0
        for b in batches:
            ids, ts = b.column("id").to_numpy(zero_copy_only=False), b.column("t").to_numpy()
            nulls = np.asarray(b.column("id").is_null())
            ids = np.where(nulls, 0, ids).astype(np.int64)
            for lo, hi, data, off in _bytes.pieces(b.column("text"), PIECE):
                row, start, n, h, c = unit_rows(data, off)
                row = row + lo
                held.append((h, c, ids[row], nulls[row], ts[row], start, n))
                size += len(h)
                if size > SEEN:
                    yield from settle(held)
                    held, size = [], 0
        yield from settle(held)

    return docs.mapInArrow(_bytes.lean(run), UNIT)


def settle(held):
    """Units of one task: equal ones are marked, one of each kind is sent on with its hash."""
    if not held:
        return
    h, c, ids, nulls, ts, start, n = (np.concatenate(x) for x in zip(*held))
    order = np.lexsort((c, h))
    same = (h[order][1:] == h[order][:-1]) & (c[order][1:] == c[order][:-1])
    first = np.ones(len(h), bool)
    first[order[1:]] = ~same
    again = np.zeros(len(h), bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    key = np.cumsum(np.concatenate(([True], (ids[1:] != ids[:-1]) | (ts[1:] != ts[:-1]) | (nulls[1:] != nulls[:-1]) | (start[1:] <= start[:-1])))) if len(h) else np.zeros(0, int)
    done = np.flatnonzero(again)
    r, s, m = merge_runs(key[done], start[done], n[done])
    at = done[np.flatnonzero(np.concatenate(([True], (key[done][1:] != key[done][:-1]) | (start[done][1:] != start[done][:-1] + n[done][:-1]))))] if len(done) else done
    sent = np.flatnonzero(first)

    def batch(kind, i, hh, cc, s, m):
        return pa.RecordBatch.from_arrays(
            [pa.array(kind.astype(np.int8)), pa.array(hh.view(np.int64)), pa.array(cc.view(np.int64)), pa.array(ids[i], mask=nulls[i]), pa.array(ts[i], pa.int64()), pa.array(s.astype(np.int32)), pa.array(m.astype(np.int32))],
            ["kind", "h", "c", "id", "t", "start", "n"],
        )

    yield batch(np.where(again[sent], LOCAL, ONE), sent, h[sent], c[sent], start[sent], n[sent])
    if len(at):
        zero = np.zeros(len(at), np.uint64)
        yield batch(np.full(len(at), DONE), at, zero, zero, s, m)


def classify(found: DataFrame) -> DataFrame:
    """Units with ``rep`` (the whole context stands elsewhere) and ``other`` (their anchor has another context too)."""
    w = Window.partitionBy("h").orderBy("c")
    near = found.where(F.col("kind") < DONE).select("*", F.lag("c").over(w).alias("p"), F.lead("c").over(w).alias("q"))
    no = F.lit(False)
    return near.select(
        "h", "id", "t", "start", "n",
        ((F.col("kind") == LOCAL) | F.coalesce(F.col("p") == F.col("c"), no) | F.coalesce(F.col("q") == F.col("c"), no)).alias("rep"),
        (F.coalesce(F.col("p") != F.col("c"), no) | F.coalesce(F.col("q") != F.col("c"), no)).alias("other"),
    ).where("rep OR other")


def contexts(keyed: DataFrame, probes: DataFrame) -> DataFrame:
    """(h, id, t, start, need, hot, context) of the units to be compared; ``hot`` where their anchor has more than HOT of them."""
    # written by itself: a join on h right above its sum could not be split where h is hot
    crowd = _store.written(probes.groupBy("h").count().where(F.col("count") > HOT).select("h", F.lit(True).alias("hot")), "suffix-crowd")
    probes = probes.join(crowd, "h", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    wanted = probes.groupBy("id", "t").agg(F.collect_list(F.struct("h", "start", "n", "rep", "hot")).alias("units"))  # at most a document's units

    def run(batches):
        for b in batches:
            data, off = _bytes.column(b.column("text"))
            lists = b.column("units")
            row = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(lists.offsets)))
            flat = lists.flatten()
            start, n = flat.field("start").to_numpy(), flat.field("n").to_numpy()
            size = (n + (SPAN - 1)).astype(np.int64)
            for lo in range(0, len(row), 20_000):
                part = slice(lo, lo + 20_000)
                body = data[_bytes.ranges(off[row[part]] + start[part], size[part])]
                at = np.concatenate(([0], np.cumsum(size[part]))).astype(np.int32)
                ctx = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(body)])
                take = pa.array(row[part])
                need = pa.array(~flat.field("rep").to_numpy(zero_copy_only=False)[part])
                yield pa.RecordBatch.from_arrays(
                    [flat.field("h").slice(lo, len(at) - 1), b.column("id").take(take), b.column("t").take(take), pa.array(start[part], pa.int32()), need, flat.field("hot").slice(lo, len(at) - 1), ctx],
                    ["h", "id", "t", "start", "need", "hot", "context"],
                )

    joined = keyed.join(wanted.withColumnsRenamed({"id": "i2", "t": "t2"}), F.col("id").eqNullSafe(F.col("i2")) & (F.col("t") == F.col("t2")))
    return joined.select("id", "t", "text", "units").mapInArrow(_bytes.lean(run), "h long, id long, t long, start int, need boolean, hot boolean, context binary")


def crowded_windows(ctx: DataFrame) -> DataFrame:
    """Units of one window each (as ``units`` makes them) of contexts whose anchor is hot: named by two digests of the window.

    A group of any size then spreads over all tasks: windows that differ part, equal ones are one row a task.
    """

    def run(batches):
        held, size = [], 0
        for b in batches:
            nulls = np.asarray(b.column("id").is_null())
            ids = b.column("id").fill_null(0).to_numpy()
            ts, start = b.column("t").to_numpy(), b.column("start").to_numpy()
            for lo, hi, data, off in _bytes.pieces(b.column("context"), PIECE):
                many = np.diff(off) - SPAN + 1
                win, row = _bytes.ranges(off[:-1], many), np.repeat(np.arange(lo, hi), many)
                first = start[row] + win - np.repeat(off[:-1], many)
                one, two = (_bytes.range_hash(_bytes.prefix_sums(v), win, win + SPAN) for v in (data, _OTHER[data]))
                held.append((one, two, ids[row], nulls[row], ts[row], first, np.ones(len(win), np.int64)))
                size += len(win)
            if size > SEEN:
                yield from settle(held)
                held, size = [], 0
        yield from settle(held)

    return ctx.select("id", "t", "start", "context").mapInArrow(_bytes.lean(run), UNIT)


def repeated_windows(data: np.ndarray, off: np.ndarray, span: int = SPAN) -> np.ndarray:
    """True at each position of the contexts where a string of ``span`` bytes starts that starts elsewhere too."""
    size = np.diff(off)
    text = np.ones(len(data) + len(size) + 1, np.int16)
    at = off[:-1] + np.arange(len(size))  # a separator after each context
    text[_bytes.ranges(at, size)] = data.astype(np.int16) + 2
    text[-1] = 0
    window = np.zeros(len(text), bool)
    window[_bytes.ranges(at, np.maximum(size - span + 1, 0))] = True
    out = np.zeros(len(text), bool)
    folder = tempfile.mkdtemp(prefix="suffix-")
    try:
        last = 0
        for run, prefix in _induced.suffix_runs(text, folder, span):
            same = prefix >= span
            out[run[same]] = True
            out[np.append(last, run[:-1])[same]] = True
            last = run[-1]
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    return (out & window)[_bytes.ranges(at, size)]  # what matches over a separator is no window


def repeats(ctx: DataFrame) -> DataFrame:
    """Runs (id, t, start, n) of repeated windows; all contexts of an anchor are sorted together."""

    def solve(parts):
        t = pa.Table.from_batches(parts).combine_chunks()
        data, off = _bytes.column(t.column("context"))
        hit = repeated_windows(data, off)
        need = t.column("need").to_numpy()
        hit &= np.repeat(need, np.diff(off))
        begin, end = _bytes.spans(hit)
        # a run may not cross contexts: windows end before a context does
        row = np.searchsorted(off, begin, side="right") - 1
        take = pa.array(row)
        return pa.RecordBatch.from_arrays([t.column("id").combine_chunks().take(take), t.column("t").combine_chunks().take(take), pa.array((t.column("start").to_numpy()[row] + begin - off[row]).astype(np.int32)), pa.array((end - begin).astype(np.int32))], ["id", "t", "start", "n"])

    def run(batches):
        held, size = [], 0
        for table in _groups.runs(batches, ["h"]):  # whole anchors only
            held += table.to_batches()
            size += table.column("context").nbytes
            if size >= SHARD:
                yield solve(held)
                held, size = [], 0
        if held:
            yield solve(held)

    return ctx.repartition("h").sortWithinPartitions("h").mapInArrow(_bytes.lean(run), "id long, t long, start int, n int")


CUT = "n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"


def one_cut(raw: np.ndarray, marked, keep_text: bool):
    """(bytes, bytes removed, runs removed, what is left, its digest) of a text and its repeated windows."""
    size, gone, n_spans = len(raw), 0, 0
    if marked:
        edge = np.zeros(size + 1, np.int64)
        for x in marked:
            edge[x["start"]] += 1
            edge[x["start"] + x["n"] + SPAN - 1] -= 1
        mask = np.cumsum(edge)[:-1] > 0
        n_spans, gone = len(_bytes.spans(mask)[0]), int(mask.sum())
        raw = raw[~mask]
    body = raw.tobytes()
    return size, gone, n_spans, body if keep_text else None, hashlib.sha256(body).hexdigest()


def cut_rows(docs: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """The kept columns with n_bytes, n_removed, n_spans, kept and kept_sha256; ``kept`` is null unless asked for."""
    _store.text_batches(docs.sparkSession)
    names = [f"c{i}" for i in range(len(keep))]
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), *[F.col(c).alias(n) for c, n in zip(keep, names)]).withColumn("t", F.xxhash64("text"))
    bare = keyed.select("id", "t", "text")
    found = _store.written(units(bare), "suffix-unit")
    some = _store.written(classify(found), "suffix-some")
    probes = some.where("other").select("h", "id", "t", "start", "n", "rep")
    ctx = _store.written(contexts(bare, probes), "suffix-context")
    runs = _store.written(repeats(ctx.where("NOT hot")), "suffix-run")
    crowd = _store.written(crowded_windows(ctx.where("hot")), "suffix-crowd")
    again = classify(crowd).where("rep").unionByName(crowd.where(F.col("kind") == DONE), allowMissingColumns=True).select("id", "t", "start", "n")
    whole = found.where(F.col("kind") == DONE).select("id", "t", "start", "n").unionAll(some.where("rep").select("id", "t", "start", "n"))
    marks = whole.unionAll(runs).unionAll(again).groupBy("id", "t").agg(F.collect_list(F.struct("start", "n")).alias("runs"))  # at most a document's units

    def cut(batches):
        for whole in batches:
            for lo, hi, data, off in _bytes.pieces(whole.column("text"), PIECE):
                b = whole.slice(lo, hi - lo)
                rows = [one_cut(data[off[r] : off[r + 1]], marked, keep_text) for r, marked in enumerate(b.column("runs").to_pylist())]
                cols = list(zip(*rows)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], *[pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()))]], [*names, "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    of = marks.withColumnsRenamed({"id": "i2", "t": "t2"})
    joined = keyed.join(of, F.col("id").eqNullSafe(F.col("i2")) & (F.col("t") == F.col("t2")), "left").select("text", "runs", *names)
    out = joined.drop("text", "runs").schema
    for f in T._parse_datatype_string(CUT).fields:
        out = out.add(f)
    return joined.mapInArrow(_bytes.lean(cut), out).toDF(*keep, *[c.split()[0] for c in CUT.split(", ")])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept, kept_sha256) per row."""
    return cut_rows(docs, [id_col], id_col, text_col, keep_text).withColumnRenamed(id_col, "id")


def cut_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with their remaining text, all columns in place; a null text stays null.

    Where a cut splits a character, what is left of it goes too.
    """

    @F.pandas_udf("string")
    def whole(raw):
        return raw.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))

    names = [f"d{i}" for i in range(len(docs.columns))]
    text, key = names[docs.columns.index(text_col)], names[docs.columns.index(id_col)]
    out = cut_rows(docs.toDF(*names), names, key, text)
    left = F.when(F.col("n_removed") > 0, whole(F.when(F.col("n_removed") > 0, F.col("kept")))).otherwise(F.col(text))
    return out.select(*[left.alias(c) if c == text else F.col(c) for c in names]).toDF(*docs.columns)
