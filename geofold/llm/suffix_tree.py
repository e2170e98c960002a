"""Language-model scoring by a probabilistic suffix tree.

Tokens are lower-cased words and one end. The states of the tree are the last 0 to ``DEPTH``
words before a token, whole words of any length, within a text:

* a context of one word or more is a state if it was seen ``LEAST`` times in training and what follows it
  diverges from what follows its suffix: the sum over the following tokens of n * ln(p / p at the suffix), the
  log-likelihood that the longer context gains, is ``GAIN`` nats at least. These are absolute
  numbers, so the tree grows with the training texts, and rare contexts are held to the same test;
* a state's counts are smoothed with its suffix's distribution, weighted by the number of
  different tokens seen after it (Witten-Bell), down to the single words;
* one unknown token, as in the base score, takes the share that words seen once have in
  training (Good-Turing).

A token is scored at the longest state that its text so far ends in. All tokens' probabilities
sum to one after any text, so the score is a proper log probability.

Nothing of the tree is collected or broadcast. Texts are packed into blocks of about ``BLOCK``
bytes, a row each. Every block posts its distinct words and word sequences, sorted and packed, to ranges of
their hashes; a range sums each over all blocks and returns to each block the counts of just its own
(``exchanged``). A second exchange sums, over the sequences that a block was
named the owner of, the gain and the number of followers of every context. A hot word is one entry
a block, and ranges are of hashes, so none is hot. Blocks and ranges grow with the texts; raise
BLOCK with the executors' memory, as postings are one for each of a block and a range.

Words are told apart by 64-bit hashes, sequences by as many bits as leave one in 16,000 that meets another at most. Null and empty texts are one
end token. With no training rows every token is unknown. Rows are kept one by one, whatever
ids or texts they repeat. A text of any size is one block with others or alone.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geofold.llm import _bytes, _store

DEPTH = 2
LEAST = 2
GAIN = 3.0
BLOCK = 4 << 20
SLICE = 1 << 20
RANGES = 2  # blocks to a range
SPARE = 14  # bits of a sequence's hash beyond the logarithm of the corpus's bytes: one in 2**SPARE at most meets another
END = np.uint64(0x5851F42D4C957F2D)
_U = np.uint64


def packed(values: np.ndarray) -> bytes:
    """Ascending whole numbers as their steps, in as few bytes a step as the largest needs; first bytes first."""
    return squeezed(np.diff(values, prepend=_U(0)).astype(np.uint64))


def squeezed(values: np.ndarray) -> bytes:
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return len(values).to_bytes(4, "little") + bytes([width]) + pa.Codec("zstd", 1).compress(planes.T.tobytes(), asbytes=True)


def spread(raw: bytes) -> np.ndarray:
    """What ``squeezed`` has packed."""
    n, width = int.from_bytes(raw[:4], "little"), raw[4]
    planes = np.frombuffer(pa.Codec("zstd", 1).decompress(raw[5:], n * width), np.uint8).reshape(width, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").reshape(-1)


def unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(spread(raw), dtype=np.uint64)


def range_of(keys: np.ndarray, ranges: int, bits: int) -> np.ndarray:
    """Which of the ranges of equal width each key of ``bits`` bits is in; ascending with the key."""
    return ((keys >> _U(bits - 32)) * _U(ranges)) >> _U(32)


class Sequences:
    """The distinct words and word sequences of a block of texts, and which of them each token ends.

    ``keys[0]``: words, by hash; ``keys[1]``: sequences of 2 to DEPTH + 1 tokens. ``at[k]``: the
    place in those of the sequence of k + 1 tokens that ends in a token, -1 where the text is too short.
    """

    def __init__(self, texts: pa.Array, depth: int, bits: int = 64):
        hashes, counts = [], []
        for _, _, data, off in _bytes.pieces(texts, SLICE):
            low = _bytes.LOWER[data]
            starts, ends, row = _bytes.words(low, off, _bytes.SPACE)
            hashes.append(_bytes.range_hash(_bytes.prefix_sums(low), starts, ends))
            counts.append(np.diff(row))
        count = np.concatenate([*counts, np.zeros(0, np.int64)])
        self.size = count + 1  # tokens of each text
        self.off = np.concatenate(([0], np.cumsum(self.size)))
        h = np.full(int(self.off[-1]), END)
        self.word = np.ones(len(h), bool)
        self.word[self.off[1:] - 1] = False
        h[self.word] = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        self.row = np.repeat(np.arange(len(count)), self.size)
        place = np.arange(len(h)) - self.off[self.row]
        words, first, back = np.unique(h, return_index=True, return_inverse=True)
        self.keys, self.first, self.at = [words], [first], [back]
        acc, longer, valid = h, [], []
        for k in range(1, depth + 1):
            before = np.concatenate((np.zeros(min(k, len(h)), np.uint64), h[: max(0, len(h) - k)]))
            acc = _bytes.mix(acc * _U(0x9E3779B97F4A7C15) + before + _U(k))
            valid.append(np.flatnonzero(place >= k))
            longer.append(acc[valid[-1]] >> _U(64 - bits))
        keys, first, back = np.unique(np.concatenate([*longer, np.zeros(0, np.uint64)]), return_index=True, return_inverse=True)
        order = np.concatenate([*[np.full(len(v), k) for k, v in enumerate(valid, 1)], np.zeros(0, np.int64)])
        self.keys.append(keys)
        self.first.append(np.concatenate([*valid, np.zeros(0, np.int64)])[first])
        self.order = order[first]  # tokens before the last one
        lo = 0
        for v in valid:
            at = np.full(len(h), -1)
            at[v] = back[lo : lo + len(v)]
            lo += len(v)
            self.at.append(at)

    def sums(self, weight: np.ndarray) -> list[np.ndarray]:
        """Of words and of sequences: the sum of the weights of the tokens that end them."""
        out = [np.bincount(self.at[0], weights=weight, minlength=len(self.keys[0]))]
        more = np.zeros(len(self.keys[1]))
        for at in self.at[1:]:
            ok = at >= 0
            more += np.bincount(at[ok], weights=weight[ok], minlength=len(more))
        return [*out, more]

    def of_tokens(self, values: list[np.ndarray], k: int) -> np.ndarray:
        """The value of the sequence of k + 1 tokens that ends in each token; 0 where there is none."""
        at = self.at[k]
        held = values[min(k, 1)]
        return np.where(at >= 0, held[np.maximum(at, 0)], 0) if len(held) else np.zeros(len(at), held.dtype)

    def shifted(self, values: np.ndarray) -> np.ndarray:
        """The value at the token before; 0 at a text's first."""
        out = np.concatenate((np.zeros(1, values.dtype), values[:-1])) if len(values) else values
        out[self.off[:-1]] = 0
        return out


POST = "range int, block long, kind tinyint, keys binary, a binary, b binary"


def posted(block: int, ranges: int, bits: int, kind: int, keys: np.ndarray, a: np.ndarray, b: np.ndarray | None = None) -> pa.RecordBatch:
    """Ascending keys with one or two whole numbers each, cut at the ranges; kind 0 are words, 1 sequences."""
    at = range_of(keys, ranges, 64 if kind == 0 else bits)
    cut = np.flatnonzero(np.concatenate((np.ones(min(1, len(at)), bool), at[1:] != at[:-1])))
    ends = np.append(cut[1:], len(at))
    rows = [(int(at[x]), packed(keys[x:y]), squeezed(a[x:y]), None if b is None else squeezed(b[x:y])) for x, y in zip(cut, ends)]
    n = len(rows)
    cols = list(zip(*rows)) or [[]] * 4
    return pa.RecordBatch.from_arrays(
        [pa.array(cols[0], pa.int32()), pa.array([block] * n, pa.int64()), pa.array([kind] * n, pa.int8()), *[pa.array(c, pa.binary()) for c in cols[1:]]],
        ["range", "block", "kind", "keys", "a", "b"],
    )


def _met(table: pa.Table):
    """(numbers of keys of each post, order of all keys, first of each distinct key in that order, distinct key of each place in it)."""
    keys = [unpacked(x.as_py()) for x in table["keys"]]
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    every = every[order]
    new = np.concatenate(([True], every[1:] != every[:-1]))
    return [len(x) for x in keys], order, np.flatnonzero(new), np.cumsum(new, dtype=np.int32) - 1


def _cut(values: np.ndarray, size: list[int]) -> pa.Array:
    ends = np.cumsum(size)
    return pa.array([squeezed(values[e - n : e]) for n, e in zip(size, ends)], pa.binary())


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return np.concatenate([spread(x.as_py()) for x in table[name]])


BACK = "range int, block long, kind tinyint, a binary"


def exchanged(posts: DataFrame) -> DataFrame:
    """(range, block, kind, a, n, distinct, once): for each of a block's keys its sum over all blocks, shifted left by one; the last bit is set for one block that has some.

    The last three columns are of a range's words, in its first row: sum, number and number of ones.
    """

    def merge(key, table):
        size, order, head, of = _met(table)
        mine = _numbers(table, "a")[order]
        sums = np.add.reduceat(mine, head)
        some = np.flatnonzero(mine)
        owner = np.zeros(len(mine), np.uint64)
        owner[some[np.concatenate((np.ones(min(1, len(some)), bool), of[some][1:] != of[some][:-1]))]] = 1
        out = np.empty(len(mine), np.uint64)
        out[order] = sums[of] << _U(1) | owner
        totals = sums if key[1].as_py() == 0 else sums[:0]
        stat = lambda x: pa.array([int(x), *[0] * (len(size) - 1)], pa.int64())
        return pa.table({"range": table["range"], "block": table["block"], "kind": table["kind"], "a": _cut(out, size), "n": stat(totals.sum()), "distinct": stat((totals > 0).sum()), "once": stat((totals == 1).sum())})

    return posts.groupBy("range", "kind").applyInArrow(merge, BACK + ", n long, distinct long, once long")


def states_of(posts: DataFrame, gain: float) -> DataFrame:
    """(range, block, kind, a): the followers of each of a block's contexts that are states, 0 for the others."""

    def merge(key, table):
        size, order, head, of = _met(table)
        follow = np.add.reduceat(_numbers(table, "a")[order], head)
        won = _numbers(table, "b")[order]
        won = np.add.reduceat((won >> _U(1)).astype(np.int64) ^ -(won & _U(1)).astype(np.int64), head)
        out = np.empty(len(of), np.uint64)
        out[order] = np.where(won >= gain * SCALE, follow, _U(0))[of]
        return pa.table({"range": table["range"], "block": table["block"], "kind": table["kind"], "a": _cut(out, size)})

    return posts.groupBy("range", "kind").applyInArrow(merge, BACK)


def returned(parts: pa.ListScalar) -> list[np.ndarray]:
    """The numbers of words and of sequences, in the order of the block's keys."""
    out = [np.zeros(0, np.uint64)] * 2
    if parts.values is not None:
        at, kind = (parts.values.field(c).to_numpy() for c in ("range", "kind"))
        raw = parts.values.field("a")
        for k in (0, 1):
            mine = np.flatnonzero(kind == k)
            out[k] = np.concatenate([*[spread(raw[int(i)].as_py()) for i in mine[np.argsort(at[mine])]], out[k]])
    return out


SCALE = 1 << 20  # gains are summed as whole millionths of a nat, so their sums don't depend on any order


def gains(s: Sequences, back: list, total: int, depth: int, least: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, followers, gain) of the words and sequences that are contexts seen ``least`` times, from the sequences that the block owns."""
    counts = [(x >> _U(1)).astype(np.int64) for x in back]
    follow = [np.zeros(len(k), np.int64) for k in s.keys]
    gain = [np.zeros(len(k)) for k in s.keys]
    n = [s.of_tokens(counts, k) for k in range(depth + 1)]
    for k in range(1, depth + 1):
        mine = np.flatnonzero(((back[1] & _U(1)) > 0) & (s.order == k))
        token = s.first[1][mine]
        seen = n[k][token].astype(float)
        here = n[k - 1][token - 1].astype(float)  # the context's own count
        shorter = n[k - 1][token].astype(float)
        there = n[k - 2][token - 1].astype(float) if k > 1 else float(total)
        context = s.at[k - 1][token - 1]
        kind = min(k - 1, 1)
        follow[kind] += np.bincount(context, minlength=len(follow[kind]))
        gain[kind] += np.bincount(context, weights=np.rint(seen * np.log(seen / here * there / shorter) * SCALE), minlength=len(gain[kind]))
    out = []
    for kind in (0, 1):
        inner = s.word[s.first[kind]] & (counts[kind] >= least)  # an end has nothing after it
        if kind == 1:
            inner &= s.order < depth
        places = np.flatnonzero(inner)
        out.append((places, follow[kind][places], gain[kind][places]))
    return out


def scores(s: Sequences, back: list, states: list, of: dict, depth: int) -> tuple:
    """(n_tokens, n_known, base, score) of the block's texts. states: followers of words and sequences that are states, else 0."""
    counts = [(x >> _U(1)).astype(np.int64) for x in back]
    c = s.of_tokens(counts, 0)
    known = c > 0
    unit = of["n"] + 0.5 * (of["distinct"] + 1)
    unknown = (of["once"] + 0.5) / (of["n"] + 1)
    p = np.where(known, (1 - unknown) * c / max(1, of["n"]), unknown)
    for k in range(1, depth + 1):
        seen, here = s.of_tokens(counts, k), s.shifted(s.of_tokens(counts, k - 1))
        kinds = s.shifted(s.of_tokens(states, k - 1))
        p = np.where(kinds > 0, (seen + kinds * p) / np.maximum(here + kinds, 1), p)
    by_row = lambda x: np.add.reduceat(x, s.off[:-1]) if len(s.size) else x  # noqa: E731  each text summed by itself
    return s.size, by_row(known.astype(np.int64)), by_row(np.log10((c + 0.5) / unit)), by_row(np.log10(p))


def blocks_of(docs: DataFrame, train, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """(block, size, body): rows (id, train, text) packed into compressed Arrow streams of about ``block_bytes`` of text."""

    def pack(batches):
        task, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def row():
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_table(pa.Table.from_batches(held).combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([(task << 32) + n], pa.int64()), pa.array([size], pa.int64()), pa.array([out.getvalue().to_pybytes()], pa.binary())], ["block", "size", "body"])

        for b in batches:
            for lo, hi, data, _ in _bytes.pieces(b.column("text"), block_bytes // 8):
                if held and size + len(data) > block_bytes:
                    yield row()
                    n, held, size = n + 1, [], 0
                held.append(b.slice(lo, hi - lo))
                size += len(data)
        if held:
            yield row()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(train.cast("boolean"), F.lit(False)).alias("train"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(pack, "block long, size long, body binary")


def _rows(body: pa.BinaryScalar) -> pa.Table:
    return pa.ipc.open_stream(body.as_buffer()).read_all().combine_chunks()


def score(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK, depth: int = DEPTH, least: int = LEAST, gain: float = GAIN) -> DataFrame:
    """(id, train, n_tokens, n_known, train_tokens, base_score, score) per row; ``train`` is a column over docs."""
    spark = docs.sparkSession
    with _store.batch_rows(spark, _store.TEXTS):
        blocks = _store.written(blocks_of(docs, train, id_col, text_col, block_bytes), "lm-block")
    size = blocks.agg(F.count("*"), F.sum("size")).first()
    ranges, bits = max(1, -(-size[0] // RANGES)), min(64, max(32, int(size[1] or 0).bit_length() + SPARE))

    def first(batches):
        for b in batches:
            for i in range(b.num_rows):
                rows = _rows(b.column("body")[i])
                s = Sequences(rows["text"], depth, bits)
                weight = np.repeat(rows["train"].to_numpy().astype(float), s.size)
                for kind, n in enumerate(s.sums(weight)):
                    yield posted(b.column("block")[i].as_py(), ranges, bits, kind, s.keys[kind], n.astype(np.uint64))

    # a block is a row: one at a time in each process
    with _store.batch_rows(spark, 1):
        back = _store.written(exchanged(blocks.mapInArrow(first, POST)), "lm-count")
    _store.tidy(spark)
    totals = {k: v or 0 for k, v in back.agg(F.sum("n").alias("n"), F.sum("distinct").alias("distinct"), F.sum("once").alias("once")).first().asDict().items()}

    def lists(back: DataFrame, name: str) -> DataFrame:
        return back.groupBy(F.col("block").alias(f"{name}_of")).agg(F.collect_list(F.struct("range", "kind", "a")).alias(name))  # a block's own, RANGES blocks to one

    counted = blocks.join(lists(back, "counts"), F.col("block") == F.col("counts_of"), "left").select("block", "body", "counts")

    def second(batches):
        for b in batches:
            for i in range(b.num_rows):
                s = Sequences(_rows(b.column("body")[i])["text"], depth, bits)
                for kind, (places, follow, g) in enumerate(gains(s, returned(b.column("counts")[i]), totals["n"], depth, least)):
                    g = g.astype(np.int64)  # signs last, so that small numbers stay short
                    yield posted(b.column("block")[i].as_py(), ranges, bits, kind, s.keys[kind][places], follow.astype(np.uint64), ((g << 1) ^ (g >> 63)).astype(np.uint64))

    with _store.batch_rows(spark, 1):
        told = _store.written(states_of(counted.mapInArrow(second, POST), gain), "lm-state")
    _store.tidy(spark)
    ready = counted.join(lists(told, "states"), F.col("block") == F.col("states_of"), "left").select("body", "counts", "states")

    def third(batches):
        for b in batches:
            for i in range(b.num_rows):
                rows = _rows(b.column("body")[i])
                s = Sequences(rows["text"], depth, bits)
                back = returned(b.column("counts")[i])
                states = []
                for kind, kinds in enumerate(returned(b.column("states")[i])):
                    inner = s.word[s.first[kind]] & (back[kind] >> _U(1) >= least)
                    if kind == 1:
                        inner &= s.order < depth
                    held = np.zeros(len(s.keys[kind]), np.int64)
                    held[inner] = kinds
                    states.append(held)
                n, k, base, own = scores(s, back, states, totals, depth)
                yield pa.RecordBatch.from_arrays([rows["id"].combine_chunks(), rows["train"].combine_chunks(), pa.array(n), pa.array(k), pa.array(base), pa.array(own)], ["id", "train", "n_tokens", "n_known", "base_score", "score"])

    with _store.batch_rows(spark, 1):
        out = _store.written(ready.mapInArrow(third, "id long, train boolean, n_tokens long, n_known long, base_score double, score double"), "lm-score")
    return out.withColumn("train_tokens", F.lit(int(totals["n"])).cast("long"))
