"""Suffix order and common prefixes of integer texts by induced sorting with queues on disk.

A queue holds, by first symbol, tuples of a suffix and its common prefix with the one
before it in that queue, packed in 64 bits. Suffixes are induced in ascending (or
descending) order of what follows, so a first-in first-out queue per symbol is the
priority queue by (symbol, rank). The prefix of two suffixes that one symbol puts into one
queue is one more than the least prefix among those scanned between them, so only the
sorted seeds are ever compared, and of the others none. Queues beyond ``MEMORY`` bytes go
to a file and come back a run at a time; the text and its types are arrays in memory.

The order of the seeds is not found by recursion but by doubling over their pieces: the
alphabet of a recursion is as large as the number of pieces, a queue for each of them.
"""

from __future__ import annotations

import os

import numpy as np

MEMORY = 8 << 20
RUN = 1 << 18


class Queues:
    """First-in first-out queues of packed tuples by symbol, on disk beyond MEMORY bytes."""

    def __init__(self, folder: str, name: str, kinds: int):
        self.parts: list[list] = [[] for _ in range(kinds)]
        self.path, self.file, self.held, self.end, self.spills = os.path.join(folder, name), None, 0, 0, 0

    def push(self, symbols: np.ndarray, tuples: np.ndarray) -> None:
        """Adds tuples by ascending symbol."""
        if not len(tuples):
            return
        cut = [0, *(np.flatnonzero(symbols[1:] != symbols[:-1]) + 1).tolist(), len(symbols)]
        for a, b in zip(cut[:-1], cut[1:]):
            self.parts[int(symbols[a])].append(tuples[a:b])
        self.held += tuples.nbytes
        if self.held > MEMORY:
            self._spill()

    def append(self, symbol: int, tuples: np.ndarray) -> None:
        self.parts[symbol].append(tuples)
        self.held += tuples.nbytes
        if self.held > MEMORY:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or open(self.path, "w+b")  # noqa: SIM115
        self.file.seek(self.end)
        for parts in self.parts:
            live = [p for p in parts if isinstance(p, np.ndarray)]
            if live:
                done = [p for p in parts if not isinstance(p, np.ndarray)]
                block = np.concatenate(live)
                self.file.write(block.tobytes())
                parts[:] = [*done, (self.end, len(block))]
                self.end += block.nbytes
        self.held = 0
        self.spills += 1

    def take(self, symbol: int, keep: bool = False, back: bool = False):
        """Runs of a queue's tuples, at most RUN at once; ``back`` from the end. What is pushed meanwhile is left for the next call."""
        parts = self.parts[symbol]
        if not keep:
            self.parts[symbol] = []
        done = [p for p in parts if not isinstance(p, np.ndarray)]  # files come before what is in memory
        live = [p for p in parts if isinstance(p, np.ndarray)]
        if live:
            live = [live[0] if len(live) == 1 else np.concatenate(live)]
            if keep:
                self.parts[symbol] = done + live
            else:
                self.held -= live[0].nbytes
        for p in (live + done[::-1]) if back else (done + live):
            steps = range(0, len(p) if isinstance(p, np.ndarray) else p[1], RUN)
            for lo in reversed(steps) if back else steps:
                if isinstance(p, np.ndarray):
                    run = p[lo : lo + RUN]
                else:
                    self.file.seek(p[0] + lo * 8)
                    run = np.frombuffer(self.file.read(min(RUN, p[1] - lo) * 8), np.int64)
                yield run[::-1] if back else run

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            os.unlink(self.path)


def small_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last symbol is smaller than all others and unique."""
    n = len(text)
    up = np.empty(n, bool)
    up[-1] = True
    differ = text[:-1] != text[1:]
    less = text[:-1] < text[1:]
    # the answer at the next place where neighbours differ
    at = np.where(differ, np.arange(n - 1), n)
    nxt = np.minimum.accumulate(at[::-1])[::-1]
    up[:-1] = less[np.minimum(nxt, n - 2)]
    return up


def _names(text, up, lms) -> np.ndarray:
    """Rank of each piece between marked positions by its (symbol, type) string; refined seven symbols at a time."""
    m = len(lms)
    end = np.append(lms[1:], len(text) - 1)
    rank = np.zeros(m, np.int64)
    todo, at = np.arange(m), 0
    wide = text.max() >= 255
    step, bits = (3, 21) if wide else (7, 9)
    while len(todo):
        key = np.zeros(len(todo), np.uint64)
        for t in range(step):
            p = lms[todo] + at + t
            ok = p <= end[todo]
            q = np.minimum(p, len(text) - 1)
            sym = np.where(ok, (text[q].astype(np.int64) + 1) * 2 + up[q], 0)
            key = key << np.uint64(bits) | sym.astype(np.uint64)
        # classes keep room for their members: a class of rank r and size k owns r .. r+k-1
        order = np.lexsort((key, rank[todo])) if at else np.argsort(key)
        r, k = rank[todo][order], key[order]
        new = np.concatenate(([True], (r[1:] != r[:-1]) | (k[1:] != k[:-1])))
        head = np.concatenate(([True], r[1:] != r[:-1]))
        start = np.maximum.accumulate(np.where(head, np.arange(len(r)), 0))
        first = np.maximum.accumulate(np.where(new, np.arange(len(r)), 0))
        rank[todo[order]] = r + (first - start)
        size = np.diff(np.append(np.flatnonzero(new), len(r)))
        tied = np.repeat(size, size) > 1
        more = lms[todo[order]] + at + step <= end[todo[order]]
        todo = todo[order][tied & more]
        at += step
    return rank


def _sorted_marked(text, up, lms, depth: int) -> np.ndarray:
    """The marked suffixes in order, to ``depth`` symbols: doubling over the pieces between them."""
    m = len(lms)
    rank = _names(text, up, lms)
    span, todo = 1, np.arange(m)
    size = np.bincount(rank, minlength=m)
    todo = todo[size[rank] > 1]
    while len(todo) and span * 2 < depth + 4:  # each piece has two symbols at least
        nxt = todo + span
        second = np.where(nxt < m, rank[np.minimum(nxt, m - 1)] + 1, 0)
        pair = rank[todo].astype(np.uint64) << np.uint64(32) | second.astype(np.uint64)  # ranks are below 2^32
        order = np.argsort(pair)
        pair = pair[order]
        r = (pair >> np.uint64(32)).astype(np.int64)
        head = np.concatenate(([True], r[1:] != r[:-1]))
        new = np.concatenate(([True], pair[1:] != pair[:-1]))
        at = np.arange(len(r))
        start = np.maximum.accumulate(np.where(head, at, 0))
        first = np.maximum.accumulate(np.where(new, at, 0))
        fresh = r + (first - start)
        size = np.diff(np.append(np.flatnonzero(new), len(r)))
        tied = np.repeat(size, size) > 1
        rank[todo[order]] = fresh
        todo = np.sort(todo[order][tied])
        span *= 2
    return lms[np.argsort(rank, kind="stable")]


def range_min(h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least of h[lo .. hi], both included: minima of spans of doubling length, two spans a range."""
    level = (np.frexp(hi - lo + 1)[1] - 1).astype(np.int8)
    out, minima = np.empty(len(lo), h.dtype), h
    for k in range(int(level.max(initial=-1)) + 1):
        pick = np.flatnonzero(level == k)
        out[pick] = np.minimum(minima[lo[pick]], minima[hi[pick] - (1 << k) + 1])
        minima = np.minimum(minima[: -(1 << k)], minima[1 << k :])
    return out


def first_run(text: np.ndarray, at: int, cap: int) -> int:
    """How often the symbol at a position follows there without a break, up to ``cap``."""
    other = text[at : at + cap] != text[at]
    return int(other.argmax()) if other.any() else len(other)


class Induction:
    """Scans suffixes in order and queues what stands before each, with its common prefix."""

    def __init__(self, text: np.ndarray, up: np.ndarray, depth: int, queue: Queues):
        self.text, self.up, self.depth, self.queue = text, up, depth, queue
        self.bits = int(depth).bit_length()
        self.kind = np.uint8 if self.bits <= 8 else np.int32
        self.since = np.full(len(queue.parts), depth, self.kind)  # the least prefix scanned since a symbol was queued last

    def pack(self, positions, prefix):
        return positions.astype(np.int64) << self.bits | prefix

    def unpack(self, run):
        return run >> self.bits, (run & ((1 << self.bits) - 1)).astype(self.kind)

    def seam(self, a: int, b: int) -> int:
        """The common prefix of a larger and a smaller suffix of one symbol: the shorter run of it."""
        return min(first_run(self.text, a, self.depth), first_run(self.text, b, self.depth))

    def scan(self, positions: np.ndarray, prefix: np.ndarray, want_up: bool) -> None:
        """``prefix`` is what a suffix shares with the one scanned before it."""
        at = np.flatnonzero(positions > 0)
        before = positions[at] - 1
        fits = self.up[before] == want_up
        at, before = at[fits], before[fits]
        symbol = self.text[before]
        order = np.argsort(symbol, kind="stable")
        at, before, symbol = at[order], before[order], symbol[order]
        head = np.ones(len(at), bool)
        head[1:] = symbol[1:] != symbol[:-1]
        first = np.flatnonzero(head)
        lo = np.zeros(len(at), np.int64)
        lo[1:] = at[:-1] + 1
        lo[first] = 0
        least = range_min(prefix, lo, at)
        kinds = symbol[first]
        least[first] = np.minimum(least[first], self.since[kinds])
        self.since = np.minimum(self.since, prefix.min())
        rest = np.append(np.minimum.accumulate(prefix[::-1])[::-1], self.kind(self.depth))
        self.since[kinds] = rest[at[np.append(first[1:], len(at)) - 1] + 1] if len(at) else 0
        self.queue.push(symbol, self.pack(before, np.minimum(least, self.depth - 1) + 1))


def shifted(prefix: np.ndarray, first: int) -> np.ndarray:
    """Prefixes with the neighbour on one side as those with the neighbour on the other."""
    out = np.empty_like(prefix)
    out[0], out[1:] = first, prefix[:-1]
    return out


def suffix_runs(text: np.ndarray, folder: str, depth: int, spills: list | None = None):
    """Yields runs of (suffixes in order, symbols that each shares with the one before it, up to ``depth``).

    The last symbol must be smaller than all others and stand once. Suffixes with ``depth``
    equal symbols stand together, in any order among themselves. ``spills`` takes how often queues went to disk.
    """
    kinds = int(text.max()) + 1
    up = small_types(text)
    marked = np.flatnonzero(up[1:] & ~up[:-1]) + 1
    seeds = _sorted_marked(text, up, marked, depth)
    larger, smaller, queue, seeded = (Queues(folder, name, kinds) for name in ("large", "small", "queue", "seed"))
    go = Induction(text, up, depth, queue)
    shared = np.zeros(len(seeds), np.int64)
    shared[1:] = common_prefix(np.append(text, np.zeros(8, text.dtype)), seeds[:-1], seeds[1:], depth)
    seeded.push(text[seeds], go.pack(seeds, shared))
    del seeds, marked, shared

    for c in range(kinds):  # larger suffixes, ascending
        last = None
        while queue.parts[c]:
            for run in queue.take(c):
                at, prefix = go.unpack(run)
                if last is None:
                    prefix[0] = 0
                larger.append(c, go.pack(at, prefix))
                go.scan(at, prefix, False)
                last = int(at[-1])
        for i, run in enumerate(seeded.take(c)):
            at, prefix = go.unpack(run)
            if i == 0:
                prefix[0] = 0 if last is None else go.seam(last, int(at[0]))
            go.scan(at, prefix, False)
    seeded.close()
    go = Induction(text, up, depth, queue)
    for c in range(kinds - 1, -1, -1):  # smaller ones, descending
        last = None
        if c == int(text[-1]):
            queue.push(text[-1:], go.pack(np.array([len(text) - 1]), 0))
        while queue.parts[c]:
            for run in queue.take(c):
                at, prefix = go.unpack(run)
                if last is None:
                    prefix[0] = 0
                smaller.append(c, run)
                go.scan(at, prefix, True)
                last = int(at[-1])
        first = None
        for run in larger.take(c, keep=True, back=True):
            at, prefix = go.unpack(run)
            if first is None:
                first = 0 if last is None else go.seam(int(at[0]), last)
            go.scan(at, shifted(prefix, first), True)
            first = int(prefix[-1])
    queue.close()
    held, size = [], 0
    for c in range(kinds):
        last, first = None, None
        for run in larger.take(c):
            held.append(go.unpack(run))
            last = int(held[-1][0][-1])
            size += len(run)
        for run in smaller.take(c, back=True):
            at, prefix = go.unpack(run)
            if first is None:
                first = 0 if last is None else go.seam(last, int(at[0]))
            held.append((at, shifted(prefix, first)))
            first = int(prefix[-1])
            size += len(run)
        if size >= RUN:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, size = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))
    if spills is not None:
        spills += [q.spills for q in (larger, smaller, queue, seeded)]
    larger.close()
    smaller.close()


def common_prefix(data: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Equal symbols from a and b on, up to ``cap``; ``data`` goes on for 8 symbols at least after the first that differ, or after ``cap``."""
    wide = data.itemsize
    words = np.ndarray((len(data) - 8 // wide + 1,), "<u8", data, strides=(wide,))
    out = np.full(len(a), cap, np.int64)
    live = np.arange(len(a))
    for at in range(0, cap, 8 // wide):
        x = words[a[live] + at] ^ words[b[live] + at]
        bad = x != 0
        if bad.any():
            low = x[bad] & (~x[bad] + np.uint64(1))
            out[live[bad]] = np.minimum(cap, at + np.bitwise_count(low - np.uint64(1)).astype(np.int64) // (8 * wide))
            live = live[~bad]
            if not len(live):
                break
    return out
