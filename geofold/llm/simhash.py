"""SimHash near-duplicates by a Gray-ordered hierarchical index.

Fingerprints that differ in at most ``BITS`` bits are linked; a document's class is
the connected component of its fingerprint, named by its smallest doc_id.

* Five bit blocks: two fingerprints within two bits agree on at least three of them, so
  they meet under one of ten masked patterns of about 38 bits. Those patterns are the
  upper nodes of the index and its shuffle keys: no bucket can outgrow 2**26 entries,
  and equal fingerprints are one entry however many documents hold them.
* Below a pattern, entries are sorted by Gray rank (neighbours in that order share most
  bits). Each run of eight is a node holding the bits its members agree on, eight nodes
  are a node again, and so on; a search drops a node, and all below it, once the
  differences accumulated on its agreed bits pass the limit.
* Only star edges of the classes found in a bucket leave it, never all pairs.

Nulls, empty texts and texts without words have fingerprint zero. A null doc_id gets a
fingerprint but never names a component; a component of null ids only has component null.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geofold.llm import _bytes, _groups, _store

BITS = 2
SHINGLE = 3
BLOCKS = ((0, 13), (13, 26), (26, 39), (39, 52), (52, 64))
FAN = 8


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


MASKS = [sum(((1 << b) - 1) ^ ((1 << a) - 1) for a, b in kept) for kept in combinations(BLOCKS, 3)]


def shingle_hashes(data: np.ndarray, off: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of every n-word shingle of the rows, and the shingle offsets of the rows."""
    low = _bytes.LOWER[data]
    starts, ends, row = _bytes.words(low, off, _bytes.SPACE)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    size = ends - starts
    at = np.concatenate(([0], np.cumsum(size + 1)))
    buf = np.full(int(at[-1]), 0x20, np.uint8)
    buf[_bytes.ranges(at[:-1], size)] = low[_bytes.ranges(starts, size)]
    joined = buf.tobytes()
    count = np.diff(row)
    many = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    first = _bytes.ranges(row[:-1], many)
    final = np.minimum(first + n - 1, np.repeat(row[1:], many) - 1)
    lo, hi = at[first].tolist(), (at[final] + size[final]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(lo, hi)], dtype=np.uint64), np.concatenate(([0], np.cumsum(many)))


def fold(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A bit is set where over half of a row's hashes have it."""
    out = np.zeros(len(off) - 1, np.uint64)
    rows = np.flatnonzero(np.diff(off))
    if len(rows):
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, off[rows], axis=0, dtype=np.int32)
        over = ones * 2 > np.diff(off)[rows][:, None]
        out[rows] = np.packbits(over, axis=1, bitorder="little").reshape(-1).view(np.uint64)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) of every row."""
    _store.text_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fp = [fold(*shingle_hashes(data, off)) for _, _, data, off in _bytes.pieces(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(fp or [np.zeros(0, np.uint64)]).view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(_bytes.lean(run), "id long, fp long")


def gray_rank(col):
    """Position of a bit pattern in the reflected Gray order."""
    for s in (1, 2, 4, 8, 16, 32):
        col = col.bitwiseXOR(F.shiftrightunsigned(col, s))
    return col


def within(fp: np.ndarray, group: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) within ``bits`` in the same group; rows sorted by group, then Gray rank."""
    n = len(fp)
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(np.concatenate((first, [n])))
    gid = np.repeat(np.arange(len(first)), size)
    # levels[l]: nodes as (AND, OR, first child, number of children); level 0 nodes hold entries
    levels, low, high, beg, cnt = [], fp, fp, first, size
    while True:
        many = -(-cnt // FAN)
        child = np.repeat(beg, many) + FAN * _bytes.ranges(np.zeros(len(many), np.int64), many)
        kids = np.minimum(FAN, np.repeat(beg + cnt, many) - child)
        low, high = np.bitwise_and.reduceat(low, child), np.bitwise_or.reduceat(high, child)
        levels.append((low, high, child, kids))
        beg, cnt = np.concatenate(([0], np.cumsum(many)[:-1])), many
        if many.max(initial=1) == 1:
            break
    left, right = [], []
    for lo in range(0, n, 1 << 15):
        q = np.arange(lo, min(n, lo + (1 << 15)))
        q = q[size[gid[q]] > 1]
        node = gid[q]  # one root per group
        for low, high, child, kids in reversed(levels):
            agreed = ~(low[node] ^ high[node])
            near = np.bitwise_count((fp[q] ^ low[node]) & agreed) <= bits
            q, node = q[near], node[near]
            many = kids[node]
            q, node = np.repeat(q, many), _bytes.ranges(child[node], many)
        ok = (node > q) & (np.bitwise_count(fp[q] ^ fp[node]) <= bits)
        left.append(q[ok])
        right.append(node[ok])
    return np.concatenate(left or [np.zeros(0, np.int64)]), np.concatenate(right or [np.zeros(0, np.int64)])


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each element's class under the pairs (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if np.array_equal(root, before):
            return root


def links(classes: DataFrame, bits: int = BITS) -> DataFrame:
    """Star edges (a, b) over ids for classes (fp, rep): enough to connect all within ``bits`` <= 2."""
    if bits > 2:
        raise ValueError("five blocks guarantee a shared pattern of three up to two differing bits")
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(MASKS)]))

    def search(batches):
        for t in _groups.runs(batches, ["mask", "key"]):
            t = t.combine_chunks()
            mask, key, fp, rep = (t.column(c).to_numpy() for c in ("mask", "key", "fp", "rep"))
            new = np.concatenate(([True], (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])))
            group = np.cumsum(new)
            alone = new & np.concatenate((new[1:], [True]))
            fp, group, rep = fp[~alone].view(np.uint64), group[~alone], rep[~alone]
            if not len(fp):
                continue
            a, b = within(fp, group, bits)
            root = roots(len(fp), a, b)
            own = np.flatnonzero(root != np.arange(len(fp)))
            yield pa.RecordBatch.from_arrays([pa.array(rep[root[own]]), pa.array(rep[own])], ["a", "b"])

    return (
        classes.select("fp", "rep", keys.alias("k"))
        .select("k.mask", "k.key", "fp", "rep")
        .repartition("mask", "key")
        .sortWithinPartitions("mask", "key", gray_rank(F.col("fp")))
        .mapInArrow(_bytes.lean(search), "a long, b long")
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """(id, fp, component) per row; component is the smallest id of the linked class."""
    fps = _store.written(fingerprints(docs, id_col, text_col), "simhash-fp")
    classes = _store.written(fps.groupBy("fp").agg(F.min("id").alias("rep")), "simhash-class")
    named = classes.where("rep IS NOT NULL")
    parts = _groups.connected(links(named, bits), "simhash-star")
    of = classes.join(parts, classes.rep == parts.node, "left").select("fp", F.coalesce("component", "rep").alias("component"))
    return fps.join(of, "fp")


# ---------------------------------------------------------------- near copies by similarity

WORDS, SIMILAR = 5, 0.8
BANDS, DEEP = 24, 5  # two texts of similarity s share no band with probability (1 - s**5)**24: 7e-5 at 0.8, whatever their number
WIDTHS = (1 << 10, 1 << 12, 1 << 14)  # bits of a sketch, by the number of shingles
WIDER = (800, 3200)
CHUNK = 1 << 17
SPLIT = 4096
_RNG = np.random.default_rng(5)
_ODD = _RNG.integers(0, 1 << 63, (BANDS, DEEP), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bands(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A key for each row and band: the band's DEEP smallest hashes under different multipliers, mixed; rows without hashes have zeros."""
    out = np.zeros((len(off) - 1, BANDS), np.uint64)
    rows = np.flatnonzero(np.diff(off))
    if len(rows):
        for i in range(BANDS):
            key = np.zeros(len(rows), np.uint64)
            for m in _ODD[i]:
                key = (key ^ np.minimum.reduceat(h * m, off[rows])) * np.uint64(0x9FB21C651E98DF25)
                key ^= key >> np.uint64(29)
            out[rows, i] = key
    return out


def distinct(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each row, sorted, and their offsets."""
    sets = [np.unique(h[x:y]) for x, y in zip(off[:-1], off[1:])]
    return np.concatenate([*sets, np.zeros(0, np.uint64)]), np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int64)


def sketches(h: np.ndarray, off: np.ndarray) -> list[bytes]:
    """A sketch of each row of distinct hashes: bit i is the parity of the hashes that are i modulo the width.

    Sketches of two sets differ in no more bits than the sets do in elements.
    """
    size = np.diff(off)
    level = np.searchsorted(WIDER, size, side="left")
    out: list[bytes] = [b""] * len(size)
    for i, width in enumerate(WIDTHS):
        rows = np.flatnonzero(level == i)
        if len(rows):
            pick = _bytes.ranges(off[rows], size[rows])
            at = np.repeat(np.arange(len(rows)), size[rows]) * width + (h[pick] & np.uint64(width - 1)).astype(np.int64)
            odd = (np.bincount(at, minlength=len(rows) * width) & 1).astype(np.uint8).reshape(len(rows), width)
            for r, bits in zip(rows, np.packbits(odd, axis=1, bitorder="little")):
                out[r] = bits.tobytes()
    return out


class Sketches:
    """Sketches of several rows at every width that they have; wider ones fold."""

    def __init__(self, raw: list[bytes]):
        self.level = np.array([WIDTHS.index(8 * len(x)) for x in raw], np.int64)
        self.at, self.bits = [], []
        for i, width in enumerate(WIDTHS):
            rows = np.flatnonzero(self.level >= i)
            bits = np.zeros((len(rows), width // 64), np.uint64)
            for j in range(i, len(WIDTHS)):
                own = np.flatnonzero(self.level[rows] == j)
                if len(own):
                    wide = np.frombuffer(b"".join(raw[r] for r in rows[own]), np.uint64).reshape(len(own), -1, width // 64)
                    bits[own] = np.bitwise_xor.reduce(wide, axis=1)
            at = np.zeros(len(raw), np.int64)
            at[rows] = np.arange(len(rows))
            self.at.append(at)
            self.bits.append(bits)

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Differing bits of the pairs (a, b): no more than their sets differ in elements."""
        level = np.minimum(self.level[a], self.level[b])
        out = np.zeros(len(a), np.int64)
        for i in range(len(WIDTHS)):
            own = np.flatnonzero(level == i)
            for lo in range(0, len(own), CHUNK >> (2 * i)):
                o = own[lo : lo + (CHUNK >> (2 * i))]
                out[o] = np.bitwise_count(self.bits[i][self.at[i][a[o]]] ^ self.bits[i][self.at[i][b[o]]]).sum(axis=1, dtype=np.int64)
        return out


def unlinked(group: np.ndarray, comp: np.ndarray):
    """Chunks of all index pairs (i < j) of the same group and different components; rows sorted by group, then component."""
    n = len(group)
    new = group[1:] != group[:-1]

    def ends(new):
        head = np.flatnonzero(np.concatenate(([True], new)))
        return np.repeat(np.append(head[1:], n), np.diff(np.append(head, n)))

    own = ends(new | (comp[1:] != comp[:-1]))
    after = ends(new) - own
    done, lo = np.concatenate(([0], np.cumsum(after))), 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(done, done[lo] + CHUNK, side="right")) - 1)
        yield np.repeat(np.arange(lo, hi), after[lo:hi]), _bytes.ranges(own[lo:hi], after[lo:hi])
        lo = hi


def possible(group, comp, block, size, raw, similarity: float, every: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a group and different components whose sizes and sketches allow the similarity.

    ``block`` is -1, or tells the two halves of a unit apart, of which only pairs across count.
    Without ``every``, each entry's nearest earlier one and nearest later one only.
    """
    held = Sketches(raw)
    n = len(group)
    best = [np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).max)]
    left, right = [], []
    for a, b in unlinked(group, comp):
        ok = ((block[a] != block[b]) | (block[a] < 0)) & (np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b]) - 1e-6)
        a, b = a[ok], b[ok]
        bits = held.differ(a, b)
        ok = bits <= (1 - similarity) / (1 + similarity) * (size[a] + size[b]) + 1e-6
        a, b, bits = a[ok], b[ok], bits[ok]
        if every:
            left.append(a)
            right.append(b)
        elif len(a):
            np.minimum.at(best[0], b, bits << 40 | a)
            np.minimum.at(best[1], a, bits << 40 | b)
    if not every:
        for x in best:
            own = np.flatnonzero(x < np.iinfo(np.int64).max)
            left.append(own)
            right.append(x[own] & ((1 << 40) - 1))
    return np.concatenate([*left, np.zeros(0, np.int64)]), np.concatenate([*right, np.zeros(0, np.int64)])


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, n: int = WORDS) -> DataFrame:
    """(id, sh): the distinct n-word shingles of each text, as hashes."""

    def run(batches):
        for b in batches:
            for lo, hi, data, off in _bytes.pieces(b.column(1)):
                h, at = distinct(*shingle_hashes(data, off, n))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(h.view(np.int64)))], ["id", "sh"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(_bytes.lean(run), "id long, sh array<long>")


def _text(text_col: str):
    """The text; blank and null ones are empty."""
    return F.when(F.trim(F.col(text_col)) == "", F.lit("")).otherwise(F.coalesce(F.col(text_col), F.lit("")))


def _key(text_col: str):
    """The hash that stands for a text."""
    return F.xxhash64(_text(text_col))


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILAR, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """(id, th, component, kept) per row: classes of texts linked by a Jaccard similarity of word shingles of ``similarity`` or more.

    ``component`` is the class's smallest id (null if it has none), ``kept`` the text hash of the row
    that stands for it: of the smallest id, then of the smallest hash.

    1. Equal texts are one entry (by a 64-bit hash). The Gray-ordered index proposes: entries of one fingerprint, and the
       star edges of fingerprints within ``bits``. Shingle sets, compared exactly, decide, and what is
       linked is one component from there on.
    2. Entries of different components that share one of BANDS MinHash bands are compared by size and by sketch, which rule a pair
       out only if it can't reach the similarity. Each entry proposes its nearest ones on both sides, sets decide, components
       grow; once half of the proposals fail, all pairs that are left go to the sets.

    So what is found depends on the similarity alone, not on differing bits, the size of groups or the
    number of texts, and a group of thousands of near copies costs a few pairs a member. A band's
    bucket of over SPLIT entries is dealt in blocks, a unit for each two of them.

    Texts under five words are one shingle; texts without words are copies of each other. Rows that repeat an id
    are told apart by their texts; null ids rank last.
    """
    spark = docs.sparkSession
    _store.text_batches(spark)

    def run(batches):
        for b in batches:
            for lo, hi, data, off in _bytes.pieces(b.column("t")):
                fp = fold(*shingle_hashes(data, off))
                h, at = shingle_hashes(data, off, words)
                keys = bands(h, at)
                h, at = distinct(h, at)
                ends = np.arange(len(fp) + 1, dtype=np.int32) * BANDS
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").slice(lo, hi - lo), b.column("th").slice(lo, hi - lo), pa.array(fp.view(np.int64)), pa.array(np.diff(at).astype(np.int32)), pa.array(sketches(h, at), pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1).view(np.int64)))],
                    ["id", "th", "fp", "size", "bits", "bands"],
                )

    texts = docs.select(F.col(id_col).cast("long").alias("id"), _key(text_col).alias("th"), _text(text_col).alias("t"))
    fps = _store.written(texts.mapInArrow(_bytes.lean(run), "id long, th long, fp long, size int, bits binary, bands array<long>"), "simhash-fp")
    low = _store.written(fps.groupBy("th").agg(F.min("id").alias("low"), F.first("fp").alias("fp")), "simhash-class")
    shared = fps.select("th", F.posexplode("bands").alias("band", "key"))
    several = shared.groupBy("band", "key").agg(F.min("th").alias("lo"), F.max("th").alias("hi")).where("lo < hi").select("band", "key")
    member = shared.join(several, ["band", "key"], "left_semi").dropDuplicates(["th", "band"])
    traits = fps.select("th", "size", "bits").dropDuplicates(["th"])
    member = _store.written(member.join(traits, "th"), "simhash-band")

    prints = low.groupBy("fp").agg(F.min("th").alias("rep"))
    same = low.join(prints, "fp").where("th <> rep").select(F.col("rep").alias("a"), F.col("th").alias("b"))
    pairs = _store.written(same.unionAll(links(prints, bits)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "simhash-pair")
    nodes = member.select("th").unionAll(pairs.select("a")).unionAll(pairs.select("b")).distinct()
    wanted = low.join(nodes, "th", "left_semi").withColumnsRenamed({"th": "th2"})
    chosen = texts.join(wanted, (F.col("th") == F.col("th2")) & F.col("id").eqNullSafe(F.col("low"))).select("th", "t")
    sets = _store.written(shingle_sets(chosen, "th", "t", words).groupBy("id").agg(F.first("sh").alias("sh")), "simhash-set")

    def alike(pairs: DataFrame) -> DataFrame:
        """The pairs that reach the similarity."""
        both = pairs.join(sets.select(F.col("id").alias("a"), F.col("sh").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("sh").alias("sb")), "b")
        common = F.size(F.array_intersect("sa", "sb"))
        every = F.size("sa") + F.size("sb") - common
        return _store.written(both.where(common >= F.lit(similarity) * every).select("a", "b"), "simhash-link")

    def proposals(parts: DataFrame, every: bool) -> DataFrame:
        """Pairs (a, b) that share a band and are in different components."""

        def search(batches):
            for t in _groups.runs(batches, ["band", "key", "i", "j"]):
                t = t.combine_chunks()
                band, key, i, j, th, comp, size, block = (t.column(c).to_numpy() for c in ("band", "key", "i", "j", "th", "component", "size", "block"))
                group = np.cumsum(np.concatenate(([True], (band[1:] != band[:-1]) | (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
                cut = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
                cut = cut[np.concatenate(([True], np.diff(cut // SPLIT) > 0))].tolist() + [len(group)]  # several small units at once
                for x, y in zip(cut[:-1], cut[1:]):
                    a, b = possible(group[x:y], comp[x:y], np.where(i == j, -1, block)[x:y], size[x:y].astype(np.int64), t.column("bits").slice(x, y - x).to_pylist(), similarity, every)
                    if len(a):
                        u, v = th[x:y][a], th[x:y][b]
                        found = np.unique(np.column_stack((np.minimum(u, v), np.maximum(u, v))), axis=0)
                        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

        at = parts.select(F.col("node").alias("th"), "component")
        open_ = member.join(at, "th", "left").withColumn("component", F.coalesce("component", "th"))
        open_ = _store.written(open_, "simhash-open")
        units = _store.written(open_.groupBy("band", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("band", "key", F.ceil(F.col("n") / SPLIT).cast("int").alias("blocks")), "simhash-unit")
        dealt = open_.join(units, ["band", "key"]).withColumn("block", F.pmod(F.xxhash64("th"), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("block", "o"), "j": F.greatest("block", "o")})
        out = dealt.select("band", "key", "i", "j", "component", "th", "size", "block", "bits").repartition("band", "key", "i", "j").sortWithinPartitions("band", "key", "i", "j", "component")
        out = _store.written(out.mapInArrow(_bytes.lean(search), "a long, b long").distinct(), "simhash-rest")
        _store.forget(open_)
        return out

    found = alike(pairs)
    parts = _groups.connected(found, "simhash-star")
    every = False
    while True:
        pairs = proposals(parts, every)
        more = alike(pairs)
        asked, got = pairs.count(), more.count()
        found = found.unionAll(more)
        if got:
            parts = _groups.connected(found, "simhash-star")
        if every:
            break
        every = 2 * got < asked or not asked
    _store.forget(sets)
    _store.forget(member)
    of = low.join(parts, low.th == parts.node, "left").select("th", "low", F.coalesce("component", "th").alias("class"))
    first = of.groupBy("class").agg(F.min(F.struct(F.col("low").isNull().alias("none"), "low", "th")).alias("first"))
    named = of.select("th", "class").join(first, "class").select("th", F.col("first.low").alias("component"), F.col("first.th").alias("kept"))
    return fps.select("id", "th").join(named, "th").select("id", "th", "component", "kept")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILAR) -> DataFrame:
    """One row of each class of similar texts: that of the smallest id (null ids last), then of the smallest text hash; of rows equal in both any one."""
    keyed = docs.withColumns({"__th": _key(text_col), "__id": F.col(id_col).cast("long")})
    chosen = similar(docs, id_col, text_col, similarity).where("th = kept AND id <=> component").groupBy("id", "th").agg(F.count("*").alias("rows"))
    chosen = _store.written(chosen.withColumnsRenamed({"id": "__keep", "th": "__text", "rows": "__rows"}), "simhash-kept")
    kept = keyed.join(chosen, (F.col("__th") == F.col("__text")) & F.col("__id").eqNullSafe(F.col("__keep")))
    one = kept.where("__rows = 1").unionAll(kept.where("__rows > 1").dropDuplicates(["__id", "__th"]))
    return one.select(*docs.columns)
