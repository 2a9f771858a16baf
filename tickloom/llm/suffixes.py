"""Suffix order and common prefixes of texts larger than memory, by induced sorting on disk-backed queues.

The suffix types and the order of the left-most S suffixes (LMS) determine all others: scanning suffixes in
ascending order yields the L suffixes, scanning those in descending order the S suffixes. Here the scan takes
one first symbol at a time. What it finds goes as tuples (position, common prefix with its predecessor) to a
queue per first symbol, in order; the queues are a radix priority queue whose full blocks lie in files. The text
and the results are memory-mapped files once they exceed ``IN_MEMORY``. Common prefixes are carried along: the
prefix of two neighbours in a queue is one more than the smallest prefix between their sources.

LMS substrings are named by a first induction over unsorted LMS suffixes; ties between names are refined by
doubling on the reduced text up to ``length`` symbols, which is all that callers compare.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

from tickloom.llm.words import mix

#: Texts of more symbols are worked on in files; tuples of one queue that stay in memory.
IN_MEMORY, QUEUE_MEMORY = 48 << 20, 1 << 16
BLOCK = 1 << 17
NONE = np.uint8(255)


class Space:
    """Arrays and queues of one sort: in memory, or in a folder of their own that goes with them."""

    def __init__(self, n: int, in_memory: int):
        #: Positions take 4 bytes where they fit.
        self.position = np.int32 if n < 2**31 else np.int64
        self.folder = tempfile.TemporaryDirectory(prefix="suffixes-") if n > in_memory else None
        self.made = 0

    def array(self, n: int, dtype) -> np.ndarray:
        if self.folder is None or not n:
            return np.zeros(n, dtype)
        self.made += 1
        return np.memmap(os.path.join(self.folder.name, f"a{self.made}"), dtype, "w+", shape=(n,))

    def queue(self) -> Queue:
        self.made += 1
        return Queue(None if self.folder is None else os.path.join(self.folder.name, f"q{self.made}"), self.position)

    def close(self):
        if self.folder is not None:
            self.folder.cleanup()


class Queue:
    """Blocks of (position, common prefix) in order; beyond QUEUE_MEMORY tuples they are appended to a file."""

    RECORD = np.dtype([("p", "<i8"), ("c", "u1")])

    def __init__(self, path: str | None, position=np.int64):
        self.path, self.blocks, self.held, self.position = path, [], 0, position
        self.written = 0

    def push(self, p: np.ndarray, c: np.ndarray):
        if not len(p):
            return
        self.blocks.append((p.astype(self.position), c.copy()))
        self.held += len(p)
        if self.path is not None and self.held > QUEUE_MEMORY:
            out = np.empty(self.held, self.RECORD)
            out["p"], out["c"] = (np.concatenate(x) for x in zip(*self.blocks))
            with open(self.path, "ab") as f:
                out.tofile(f)
            self.written, self.blocks, self.held = self.written + self.held, [], 0

    def drain(self):
        """Blocks in order, also those pushed meanwhile."""
        at = 0
        while at < self.written or self.blocks:
            if at < self.written:
                r = np.fromfile(self.path, self.RECORD, min(BLOCK, self.written - at), offset=at * self.RECORD.itemsize)
                at += len(r)
                yield r["p"].astype(np.int64), r["c"].copy()
            else:
                p, c = (np.concatenate(x) for x in zip(*self.blocks))
                self.blocks, self.held = [], 0
                for i in range(0, len(p), BLOCK):
                    yield p[i: i + BLOCK].astype(np.int64), c[i: i + BLOCK]


class Prefixes:
    """The common prefix of what a scan pushes to a symbol with what it pushed there before."""

    def __init__(self, symbols: int, cap: int):
        self.since = np.full(symbols, NONE, np.uint8)  # smallest prefix since the last push; NONE before the first
        self.cap = cap

    def push(self, c: np.ndarray, j: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """``c``: prefixes of the block's sources with their predecessors; ``j``: sources that push, ordered by
        (symbol, source). Returns one prefix per push."""
        def least(lo, hi):
            k = np.frexp((hi - lo).astype(np.float32))[1] - 1
            return np.minimum(table[k, lo], table[k, hi - (1 << k)])

        if len(j):
            table = np.empty((len(c).bit_length(), len(c)), np.uint8)
            table[0] = c
            for level in range(1, len(table)):
                half = 1 << (level - 1)
                table[level, : len(c) - 2 * half + 1] = np.minimum(table[level - 1, : len(c) - 2 * half + 1], table[level - 1, half: len(c) - half + 1])
        out = np.zeros(len(j), np.uint8)
        if len(j):
            first = np.append(True, symbol[1:] != symbol[:-1])
            lo = np.append(0, j[:-1] + 1)
            lo[first] = 0
            out = least(lo, j + 1)
            began = symbol[first]
            before = self.since[began]
            out[first] = np.where(before == NONE, 0, np.minimum(out[first], before))
            out = np.where((self.since[symbol] == NONE) & first, 0, np.minimum(out + 1, self.cap)).astype(np.uint8)
        known = self.since != NONE
        self.since[known] = np.minimum(self.since[known], c.min())
        if len(j):
            last = np.append(first[1:], True)
            end, at = symbol[last], j[last] + 1
            rest = np.full(len(end), self.cap, np.uint8)
            some = at < len(c)
            rest[some] = least(at[some], np.full(some.sum(), len(c)))
            self.since[end] = rest
        return out


class Text:
    """Symbols with what induction needs: types, runs of equal symbols, bucket sizes."""

    def __init__(self, symbols: np.ndarray, space: Space, cap: int):
        n = len(symbols)
        self.t, self.n, self.space, self.cap = symbols, n, space, cap
        self.s = space.array(n, bool)  # S type: smaller than the next suffix
        self.run = space.array(n, np.uint8)  # equal symbols from here on, capped
        self.size = np.zeros(int(symbols.max()) + 1 if n else 1, np.int64)
        end, below = n, False  # start of the next run and whether this run's end is S
        for hi in range(n, 0, -BLOCK):
            lo = max(hi - BLOCK, 0)
            part = np.asarray(symbols[lo: hi + 1], np.int64)
            if hi == n:
                part = np.append(part, -1)
            change = np.flatnonzero(part[:-1] != part[1:])
            where = np.searchsorted(change, np.arange(hi - lo))
            inside = where < len(change)
            stop = np.full(hi - lo, end - lo)
            grows = np.full(hi - lo, below)
            stop[inside] = change[where[inside]] + 1
            grows[inside] = part[change[where[inside]]] < part[change[where[inside]] + 1]
            self.s[lo:hi] = grows
            self.run[lo:hi] = np.minimum(stop - np.arange(hi - lo), cap)
            self.size += np.bincount(part[:-1], minlength=len(self.size))
            end, below = lo + int(stop[0]), bool(grows[0])
        self.start = np.cumsum(self.size) - self.size

    def lms(self) -> np.ndarray:
        out = [lo + np.flatnonzero(self.s[lo: lo + BLOCK] & ~np.append(True if lo == 0 else self.s[lo - 1], self.s[lo: lo + BLOCK][:-1])) for lo in range(0, self.n, BLOCK)]
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def induce(x: Text, seeds: np.ndarray, prefix: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order and common prefixes from LMS suffixes in order, with their prefixes within a symbol;
    without ``prefix`` the order alone."""
    order, common = x.space.array(x.n, x.space.position), x.space.array(x.n, np.uint8)
    symbols, counts = len(x.size), np.zeros(len(x.size), np.int64)
    seed_symbol = x.t[seeds] if len(seeds) else np.zeros(0, np.int64)
    seed_at = np.searchsorted(seed_symbol, np.arange(symbols + 1))

    def spread(p, c, prefixes, queues, kind):
        """Predecessors of the block's suffixes of one type go to the queues of their symbols."""
        j = np.flatnonzero(p > 0)
        q = p[j] - 1
        fits = x.s[q] == kind
        # An S source is passed on only to an equal or smaller symbol, an L source to an equal or larger one.
        j, q = j[fits], q[fits]
        symbol = x.t[q].astype(np.uint16)
        o = np.argsort(symbol, kind="stable")
        j, q, symbol = j[o], q[o], symbol[o]
        got = c[:1].repeat(len(j)) if prefix is None else prefixes.push(c, j, symbol)
        first = np.flatnonzero(np.append(True, symbol[1:] != symbol[:-1])) if len(symbol) else []
        for a, b in zip(first, np.append(first[1:], len(symbol))):
            queues[symbol[a]].push(q[a:b], got[a:b])

    queues, prefixes = [x.space.queue() for _ in range(symbols)], Prefixes(symbols, x.cap)
    if x.n:
        queues[x.t[x.n - 1]].push(np.array([x.n - 1]), np.zeros(1, np.uint8))
        prefixes.since[x.t[x.n - 1]] = 0  # what follows there shares at most this symbol with the last suffix
    for v in range(symbols):
        at = x.start[v]
        for p, c in queues[v].drain():
            order[at: at + len(p)], common[at: at + len(p)] = p, c
            at += len(p)
            spread(p, c, prefixes, queues, False)
        counts[v] = at - x.start[v]
        p = seeds[seed_at[v]: seed_at[v + 1]]
        c = np.zeros(len(p), np.uint8) if prefix is None else prefix[seed_at[v]: seed_at[v + 1]].copy()
        if len(p):
            c[0] = min(x.run[order[at - 1]], x.run[p[0]]) if counts[v] else 0
            for i in range(0, len(p), BLOCK):
                spread(p[i: i + BLOCK], c[i: i + BLOCK], prefixes, queues, False)

    queues, prefixes = [x.space.queue() for _ in range(symbols)], Prefixes(symbols, x.cap)
    for v in range(symbols - 1, -1, -1):
        at, last = x.start[v] + x.size[v], None
        for p, c in queues[v].drain():
            order[at - len(p): at] = p[::-1]
            # c holds the prefix with the next larger suffix: it belongs to that one.
            if last is not None:
                common[at] = c[0]
            common[at - len(p) + 1: at] = c[:0:-1]
            at -= len(p)
            last = p[-1]
            spread(p, c, prefixes, queues, True)
        lo, hi = x.start[v], x.start[v] + counts[v]
        edge = 0
        if last is not None:
            edge = min(x.run[order[hi - 1]], x.run[last]) if hi > lo else 0
            common[at] = edge
        for b in range(hi, lo, -BLOCK):
            a = max(b - BLOCK, lo)
            c = np.append(common[a + 1: b], edge if b == hi else common[b])
            spread(order[a:b][::-1].astype(np.int64), c[::-1].astype(np.uint8), prefixes, queues, True)
    return order, common


def _hashes(x: Text, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    h = lengths.astype(np.uint64)
    for k in range(int(lengths.max()) if len(lengths) else 0):
        m = np.flatnonzero(lengths > k)
        h[m] = mix(h[m] * np.uint64(31) + x.t[starts[m] + k].astype(np.uint64))
    return h


def _sorted_lms(x: Text, length: int) -> np.ndarray:
    """LMS suffixes in the order of their first ``length`` symbols at least."""
    lms = x.lms()
    if len(lms) < 2:
        return lms
    by_symbol = lms[np.argsort(x.t[lms], kind="stable")]
    order, _ = induce(x, by_symbol, None)
    place = x.space.array(x.n, x.space.position)
    place[lms] = np.arange(1, len(lms) + 1)
    seen = (place[order[i: i + BLOCK]] for i in range(0, x.n, BLOCK))
    found = np.concatenate([p[p > 0] for p in seen]).astype(np.int64) - 1
    del order, place
    # Equal LMS substrings (up to and with the next LMS symbol) share a name; long ones differ by their start.
    width = np.minimum(np.append(lms[1:] + 1, x.n) - lms, length + 1)
    h = _hashes(x, lms, width)
    # A name is the place of its group's first member, so refining a group touches no other; 0 is past the end.
    m = len(lms)
    name = np.zeros(m + 1, np.int64)
    head = np.append(True, h[found[1:]] != h[found[:-1]])
    name[found] = 1 + np.maximum.accumulate(np.where(head, np.arange(m), 0))
    step = 1
    while step <= length:
        tied = np.bincount(name[:-1], minlength=m + 1) > 1
        rows = np.flatnonzero(tied[name[:-1]])
        if not len(rows):
            break
        follow = name[np.minimum(rows + step, m)]
        o = np.lexsort((follow, name[rows]))
        rows, follow, group = rows[o], follow[o], name[rows[o]]
        new = np.append(True, group[1:] != group[:-1])
        split = new | np.append(True, follow[1:] != follow[:-1])
        at = np.arange(len(rows))
        begin = np.maximum.accumulate(np.where(new, at, 0))
        name[rows] = group + np.maximum.accumulate(np.where(split, at, 0)) - begin
        step *= 2
    return lms[np.argsort(name[:-1], kind="stable")]


def _prefixes(x: Text, sorted_lms: np.ndarray) -> np.ndarray:
    """Common prefix of each LMS suffix with the one before, up to the cap."""
    out = np.zeros(len(sorted_lms), np.uint8)
    alive = np.arange(1, len(sorted_lms))
    for k in range(x.cap):
        a, b = sorted_lms[alive] + k, sorted_lms[alive - 1] + k
        inside = np.maximum(a, b) < x.n
        alive, a, b = alive[inside], a[inside], b[inside]
        alive = alive[x.t[a] == x.t[b]]
        out[alive] = k + 1
        if not len(alive):
            break
    return out


def suffix_order(symbols: np.ndarray, length: int, in_memory: int = IN_MEMORY):
    """Yields blocks (positions, prefixes): all suffixes of ``symbols`` (uint16) in the order of their first
    ``length`` symbols, each with the length of its common prefix with the suffix before, capped at ``length``."""
    space = Space(len(symbols), in_memory)
    try:
        x = Text(symbols, space, length)
        lms = _sorted_lms(x, length)
        order, common = induce(x, lms, _prefixes(x, lms))
        for i in range(0, x.n, BLOCK):
            yield np.array(order[i: i + BLOCK], np.int64), np.array(common[i: i + BLOCK])
    finally:
        space.close()
