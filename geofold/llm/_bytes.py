"""Vectorised work on text columns: byte buffers, words, rolling hashes, sliding minima."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words of the scoring and fingerprint contracts: anything but white space.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Words of the decontamination contract: digits, lower-case letters, every byte of a non-ASCII character.
MARKS = np.zeros(256, dtype=bool)
MARKS[:0x80] = True
MARKS[0x30:0x3A] = False
MARKS[0x61:0x7B] = False

_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_MAX = U(0xFFFFFFFFFFFFFFFF)
_tables: dict[str, np.ndarray] = {}


def give_back() -> None:
    """Returns this process's free memory to the system; the C library and Arrow keep it for later use otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(run):
    """A function over batches that gives free memory back where it ends: workers outlive their tasks, and idle ones count too."""

    def whole(batches):
        yield from run(batches)
        give_back()

    return whole


def column(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks() if arr.num_chunks != 1 else arr.chunk(0)
        if isinstance(arr, pa.ChunkedArray):  # no chunk at all
            return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = arr.buffers()
    off = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(arr, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows of about ``limit`` bytes; a longer text stands alone."""
    data, off = column(arr)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def words(low: np.ndarray, off: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in lower-cased bytes, and the word offsets of the rows."""
    n = len(low)
    inside = ~sep[low]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    at = off[1:-1]
    at = at[(at > 0) & (at < n)]
    first[at] = inside[at]
    last[at - 1] = inside[at - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse, modulo 2^64, up to n at least."""
    if len(_tables.get("p", ())) <= n:
        size = max(1 << 16, 1 << int(n).bit_length())
        for name, base in (("p", _BASE), ("i", _INV)):
            t = np.full(size, U(base))
            t[0] = 1
            _tables[name] = np.multiply.accumulate(t)
    return _tables["p"], _tables["i"]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all 64."""
    h = h ^ (h >> U(31))
    h = h * U(0x7FB5D329728EA185)
    h ^= h >> U(27)
    h = h * U(0x81DADEF4BC2DD44D)
    return h ^ (h >> U(33))


def prefix_sums(values: np.ndarray, salt: int = 1) -> np.ndarray:
    """S such that a range's hash is (S[end] - S[start]) times the inverse power of start."""
    p, _ = powers(len(values))
    s = np.zeros(len(values) + 1, dtype=U)
    np.cumsum((values.astype(U) + U(salt)) * p[: len(values)], out=s[1:])
    return s


def range_hash(s: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, inv = powers(len(s))
    return mix((s[ends] - s[starts]) * inv[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def ngrams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive elements (max where fewer are left in the array)."""
    out = np.full(len(h), _MAX)
    m = len(h) - k + 1
    if m > 0:
        acc = h[:m].copy()
        for t in range(1, k):
            acc = acc * U(_BASE) + h[t : t + m]
        out[:m] = mix(acc)
    return out


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive elements, by doubling."""
    span, out = 1, x
    while span * 2 <= w:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = w - span
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of arange(start, start + count)."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = counts > 0
    starts, counts = starts[keep], counts[keep]
    step = np.ones(total, np.int64)
    step[0] = starts[0]
    ends = np.cumsum(counts)[:-1]
    step[ends] = starts[1:] - (starts[:-1] + counts[:-1] - 1)
    return np.cumsum(step)


def spans(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edge[::2], edge[1::2]
