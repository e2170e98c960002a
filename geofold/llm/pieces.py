"""SentencePiece encoding and decoding by batched Viterbi in numpy.

The best segmentation is the one of largest total piece score (ties: the longer last
piece). Texts are cut where no piece can reach across: before a run of spaces and around
characters that no piece holds. Distinct words of equal length then advance together, one
character a step: rolling hashes of all substrings probe the sorted hashes of the pieces,
and running maxima keep backpointers. Words met before come from a bounded cache.

Spaces become U+2581 and a text starts with one; characters without a piece are written as
byte pieces, and so is a raw U+2581, so decoding gives back the text exactly. Every
encoding is decoded and compared: a row whose comparison fails (a hash collision) is
encoded again without hashes of words. Null and empty texts have no pieces. No text is cut short.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geofold.llm import _bytes, _store

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BAR, RAW = 0x2581, 0x110000
CACHE = 1 << 20
_B = np.uint64(0x9E3779B97F4A7C15 | 1)


@dataclass
class Vocabulary:
    """Piece strings with scores; ``byte_ids`` are the ids of the 256 byte pieces."""

    pieces: list[str]
    scores: np.ndarray
    normal: np.ndarray
    byte_ids: np.ndarray
    tables: list = field(default_factory=list)

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        odd = np.array([sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)])
        names = [sp.id_to_piece(i) for i in range(n)]
        byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        return cls(names, np.array([sp.get_score(i) for i in range(n)]), ~odd, byte_ids)

    def __post_init__(self):
        self.held = np.zeros(RAW + 1, bool)  # characters that pieces hold
        by_len: dict[int, list[int]] = {}
        self.cut_spaces = True
        for i in np.flatnonzero(self.normal):
            p = self.pieces[i]
            by_len.setdefault(len(p), []).append(int(i))
            self.held[[ord(c) for c in p]] = True
            self.cut_spaces &= chr(BAR) not in p.lstrip(chr(BAR))
        self.longest = max(by_len)
        for size in range(1, self.longest + 1):
            ids = np.array(by_len.get(size, []), np.int32)
            code = np.array([[ord(c) for c in self.pieces[i]] for i in ids], np.uint64).reshape(len(ids), size)
            h = np.zeros(len(ids), np.uint64)
            for t in range(size):
                h = h * _B + code[:, t] + np.uint64(1)
            order = np.argsort(h)
            self.tables.append((h[order], ids[order]))
        self.worst = float(self.scores[self.normal].min()) - 10.0
        raw = [bytes([int(p[3:5], 16)]) if not self.normal[i] and p.startswith("<0x") else (p.replace(chr(BAR), " ").encode() if self.normal[i] else b"") for i, p in enumerate(self.pieces)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_len = np.array([len(r) for r in raw], np.int64)
        self.raw_at = np.concatenate(([0], np.cumsum(self.raw_len)))

    def lattice(self, code: np.ndarray):
        """For each size, the id of the piece at every start of each row, or -1."""
        h = np.zeros(code.shape, np.uint64)
        out = []
        for size in range(1, min(self.longest, code.shape[1]) + 1):
            m = code.shape[1] - size + 1
            h = h[:, :m] * _B + code[:, size - 1 :].astype(np.uint64) + np.uint64(1)
            keys, ids = self.tables[size - 1]
            if not len(keys):
                out.append(np.full(h.shape, -1, np.int32))
                continue
            at = np.searchsorted(keys, h.ravel())
            at[at == len(keys)] = 0
            out.append(np.where(keys[at] == h.ravel(), ids[at], -1).astype(np.int32).reshape(h.shape))
        return out

    def viterbi(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids per row) of words of equal length; -1 stands for a character without a piece."""
        rows, n = code.shape
        found = self.lattice(code)
        score = np.append(self.scores, -np.inf)
        if rows < 4 and n > 64:
            return self._narrow(found, score, rows, n)
        best = np.full((n + 1, rows), -np.inf)
        back = np.zeros((n + 1, rows), np.int32)
        best[0] = 0
        for end in range(1, n + 1):
            for size in range(min(len(found), end), 0, -1):
                p = found[size - 1][:, end - size]
                s = best[end - size] + (score[p] if size > 1 else np.where(p < 0, self.worst, score[p]))
                win = s > best[end]
                best[end][win] = s[win]
                back[end][win] = size
        at, out = np.full(rows, n), []
        row = np.arange(rows)
        while len(row):
            size = back[at[row], row]
            start = at[row] - size
            ids = np.full(len(row), -1, np.int32)
            for k in np.unique(size):
                pick = size == k
                ids[pick] = found[k - 1][row[pick], start[pick]]
            out.append((row, ids))
            at[row] = start
            row = row[start > 0]
        count = np.zeros(rows, np.int64)
        for r, _ in out:
            count[r] += 1
        flat, last = np.empty(int(count.sum()), np.int32), np.cumsum(count) - 1
        for step, (r, ids) in enumerate(out):
            flat[last[r] - step] = ids
        return flat, count

    def _narrow(self, found, score, rows: int, n: int):
        """The same for a few long words: plain lists are faster than arrays of one column."""
        flats, counts = [], []
        for r in range(rows):
            ids = [f[r].tolist() for f in found]
            val = [score[f[r]].tolist() for f in found]
            val[0] = [self.worst if p < 0 else v for p, v in zip(ids[0], val[0])]
            best, back = [0.0] + [-np.inf] * n, [0] * (n + 1)
            for end in range(1, n + 1):
                top, arg = -np.inf, 0
                for size in range(min(len(found), end), 0, -1):
                    s = best[end - size] + val[size - 1][end - size]
                    if s > top:
                        top, arg = s, size
                best[end], back[end] = top, arg
            out, at = [], n
            while at:
                out.append(ids[back[at] - 1][at - back[at]])
                at -= back[at]
            flats += out[::-1]
            counts.append(len(out))
        return np.array(flats, np.int32), np.array(counts, np.int64)


class Encoder:
    """Encodes runs of texts; holds the cache of words of one Python worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self._forget()

    def _forget(self):
        self.keys, self.at, self.count, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _segment(self, code: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids per word) of the given words, by groups of equal length."""
        order = np.argsort(sizes, kind="stable")
        parts, counts = [], np.zeros(len(sizes), np.int64)
        edges = np.flatnonzero(np.concatenate(([True], np.diff(sizes[order]) != 0, [True]))) if len(order) else [0]
        for a, b in zip(edges[:-1], edges[1:]):
            n = int(sizes[order[a]])
            step = max(1, 400_000 // n)
            for lo in range(a, b, step):
                mine = order[lo : min(b, lo + step)]
                words = code[starts[mine][:, None] + np.arange(n)]
                flat, count = self.v.viterbi(words)
                if (flat < 0).any():
                    flat, count = self._bytes_for(words, flat, count)
                parts.append(flat)
                counts[mine] = count
        flat = np.concatenate(parts or [np.zeros(0, np.int32)])
        begin = np.zeros(len(sizes), np.int64)
        if len(order):
            begin[order] = np.concatenate(([0], np.cumsum(counts[order])[:-1]))
        return flat[_bytes.ranges(begin, counts)], counts

    def _bytes_for(self, words, flat, count):
        """Writes characters without a piece as byte pieces."""
        covers = np.array([len(self.v.pieces[i]) if i >= 0 else 1 for i in flat], np.int64)
        row = np.repeat(np.arange(len(count)), count)
        first = np.concatenate(([0], np.cumsum(covers)[:-1])) - np.repeat(np.arange(len(count)) * words.shape[1], count)
        out, counts = [], np.zeros(len(count), np.int64)
        for p, r, at in zip(flat.tolist(), row.tolist(), first.tolist()):
            if p < 0:
                c = int(words[r, at])
                new = self.v.byte_ids[list(chr(BAR if c == RAW else c).encode())].tolist()
            else:
                new = [p]
            out += new
            counts[r] += len(new)
        return np.array(out, np.int32), counts

    def _codes(self, data: np.ndarray, off: np.ndarray):
        """Code points with each text's leading bar, and the offsets of the texts."""
        chars = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[off]
        filled = np.diff(lead) > 0
        at = lead + np.concatenate(([0], np.cumsum(filled)))
        code = np.full(int(at[-1]), BAR, np.int32)
        body = np.ones(len(code), bool)
        body[at[:-1][filled]] = False
        code[body] = np.where(chars == BAR, RAW, np.where(chars == 0x20, BAR, chars)).astype(np.int32)
        return code, at

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, offsets of the texts)."""
        code, at = self._codes(data, off)
        if not len(code):
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        solo, bar = ~self.v.held[code], code == BAR
        cut = solo.copy()
        cut[1:] |= solo[:-1]
        if self.v.cut_spaces:
            cut[1:] |= bar[1:] & ~bar[:-1]
        cut[at[:-1][np.diff(at) > 0]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(code))
        word, keys = pd.factorize(_bytes.range_hash(_bytes.prefix_sums(code), starts, ends))
        self._learn(keys, word, code, starts, ends)
        slot = np.searchsorted(self.keys, keys)[word]
        count = self.count[slot]
        flat = self.flat[_bytes.ranges(self.at[slot], count)]
        ids_at = np.concatenate(([0], np.cumsum(count)))[np.searchsorted(starts, at)]
        bad = ~self._exact(data, off, flat, ids_at)
        for r in np.flatnonzero(bad):  # two words of one hash: without the cache
            s = np.arange(np.searchsorted(starts, at[r]), np.searchsorted(starts, at[r + 1]))
            new, _ = self._segment(code, starts[s], (ends - starts)[s])
            flat = np.concatenate((flat[: ids_at[r]], new, flat[ids_at[r + 1] :]))
            ids_at[r + 1 :] += len(new) - (ids_at[r + 1] - ids_at[r])
        return flat, ids_at

    def _learn(self, keys, word, code, starts, ends):
        """Adds the words that the cache lacks."""
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != keys[inside]
        if not new.any():
            return
        if len(self.keys) + new.sum() > CACHE and len(self.keys):
            self._forget()
            new[:] = True
        first = np.zeros(len(keys), np.int64)
        first[word[::-1]] = np.arange(len(word))[::-1]
        first = first[new]
        flat, count = self._segment(code, starts[first], (ends - starts)[first])
        begin = len(self.flat) + np.concatenate(([0], np.cumsum(count)[:-1]))
        keys = np.concatenate((self.keys, keys[new]))
        order = np.argsort(keys)
        self.keys, self.at, self.count = keys[order], np.concatenate((self.at, begin))[order], np.concatenate((self.count, count))[order]
        self.flat = np.concatenate((self.flat, flat))

    def decode(self, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of the texts that ids stand for."""
        size = self.v.raw_len[flat]
        body = self.v.raw[_bytes.ranges(self.v.raw_at[flat], size)]
        off = np.concatenate(([0], np.cumsum(size)))[at]
        lead = off[:-1][np.diff(off) > 0]
        lead = lead[body[lead] == 0x20]
        keep = np.ones(len(body), bool)
        keep[lead] = False
        return body[keep], off - np.searchsorted(lead, off)

    def _exact(self, data, off, flat, ids_at) -> np.ndarray:
        body, back = self.decode(flat, ids_at)
        same = np.diff(back) == np.diff(off)
        if same.all() and np.array_equal(body, data):
            return same
        return np.array([same[i] and np.array_equal(body[back[i] : back[i + 1]], data[off[i] : off[i + 1]]) for i in range(len(same))], bool)


def encode(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, model: str = MODEL) -> DataFrame:
    """The kept columns with ``piece_ids`` (list of int) and ``exact`` (decoding gave the text back)."""
    _store.text_batches(docs.sparkSession)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Vocabulary.load(model))  # as large as the model file, whatever the input
    keep = docs.columns if keep is None else keep
    picked = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.col(text_col).alias("t"))
    out = picked.drop("t").schema.add("piece_ids", T.ArrayType(T.IntegerType())).add("exact", "boolean")

    def run(batches):
        coder = Encoder(shared.value)
        for b in batches:
            for lo, hi, data, off in _bytes.pieces(b.column("t")):
                flat, at = coder.encode(data, off)
                ids = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat))
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(keep))], ids, pa.array(coder._exact(data, off, flat, at))], names=out.names)

    return picked.mapInArrow(_bytes.lean(run), out).toDF(*keep, "piece_ids", "exact")


def decode(df: DataFrame, ids_col: str = "piece_ids", to: str = "decoded", model: str = MODEL) -> DataFrame:
    """Adds the text that a list of piece ids stands for; a null list gives null."""
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary.load(model))

    @F.pandas_udf("string")
    def texts(ids: pd.Series) -> pd.Series:
        coder = Encoder(shared.value)
        given = [np.asarray([] if x is None else x, np.int32) for x in ids]
        at = np.concatenate(([0], np.cumsum([len(x) for x in given])))
        body, off = coder.decode(np.concatenate([*given, np.zeros(0, np.int32)]), at)
        return pd.Series([None if x is None else body[a:b].tobytes().decode("utf-8", "replace") for x, a, b in zip(ids, off[:-1], off[1:])])

    return df.withColumn(to, texts(ids_col))
