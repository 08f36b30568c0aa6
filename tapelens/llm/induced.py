"""External induced sorting of suffixes, with their common prefixes.

Suffixes smaller than the next one are of type S, the others of type L; an S suffix after an L one
is a star. The substrings between stars are sorted by induction, named, and the string of names is
sorted by the same procedure; then the order of the stars induces that of all suffixes: in an
ascending scan every suffix hands its predecessor, if that is of type L, to a priority queue, in a
descending scan every suffix hands on predecessors of type S. A queue is keyed by (symbol, order of
arrival). As the scan is in suffix order, tuples of one symbol leave in the order they came, so a
queue is one run per symbol, kept in memory up to a limit and on disk beyond it; all tuples of the
least symbol are taken together and worked on as arrays.

A tuple carries the suffix's position and the length of the prefix that it shares with the tuple
before it: one more than the least such length that the scan met since the symbol's last tuple.
Where a bucket's L suffixes meet its S suffixes, the shared prefix is the shorter of the two runs
of the symbol. Lengths are kept up to ``cap``; suffixes that agree so far may stand in any order.

The recursion ends where a string of names has at most ``base`` symbols and is sorted in memory by
doubling. Memory is bounded by ``MEMORY`` for a queue and ``CHUNK`` entries at a time; arrays as
long as the text are on disk unless they are small. The disk is the task's own spill folder:
nothing in it is read by another task, and a task that starts again makes it anew.
"""
from __future__ import annotations

import heapq
import os
import tempfile
from collections.abc import Iterator

import numpy as np

CHUNK, MEMORY, BASE = 1 << 18, 48 << 20, 1 << 21
#: Bytes of a growing array that stay in memory.
SMALL = 32 << 20


def spill_folder() -> str | None:
    """Where Spark itself spills on this machine."""
    return next((d for d in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if os.path.isdir(d)), None)


class Spool:
    """A growing array, on disk once it is large."""

    def __init__(self, dtype):
        self.dtype, self.parts, self.held, self.n, self.file = np.dtype(dtype), [], 0, 0, None

    def append(self, values: np.ndarray):
        values = np.ascontiguousarray(values, self.dtype)
        self.n += len(values)
        self.parts.append(values)
        self.held += values.nbytes
        if self.held > SMALL:
            if self.file is None:
                self.file = tempfile.TemporaryFile(dir=spill_folder())
            for part in self.parts:
                self.file.write(part.tobytes())
            self.parts, self.held = [], 0

    def array(self) -> np.ndarray:
        """All of it, as a map of the file where there is one."""
        if self.file is None:
            self.parts = [np.concatenate(self.parts) if self.parts else np.zeros(0, self.dtype)]
            return self.parts[0]
        for part in self.parts:
            self.file.write(part.tobytes())
        self.parts, self.held = [], 0
        self.file.flush()
        return np.memmap(self.file, self.dtype, "r", shape=(self.n,))


def room(n: int, dtype, fill=None) -> np.ndarray:
    """An array of ``n`` entries to write into, on disk if large."""
    dtype = np.dtype(dtype)
    if n * dtype.itemsize <= SMALL:
        out = np.empty(n, dtype)
    else:
        file = tempfile.TemporaryFile(dir=spill_folder())
        file.truncate(n * dtype.itemsize)
        out = np.memmap(file, dtype, "r+", shape=(n,))
    if fill is not None:
        for k in range(0, n, CHUNK):
            out[k : k + CHUNK] = fill
    return out


class SymbolQueue:
    """Priority queue of tuples by symbol, first come first served within a symbol; disk-backed."""

    def __init__(self, entry: np.dtype, sign: int = 1, memory: int | None = None):
        self.sign, self.memory = sign, MEMORY if memory is None else memory
        self.spill, self.held = Spool(entry), 0
        self.young: dict[int, list] = {}
        self.runs: dict[int, list] = {}
        self.heap: list[int] = []

    def push(self, symbol: int, entries: np.ndarray):
        if symbol not in self.young:
            self.young[symbol] = []
            if symbol not in self.runs:
                heapq.heappush(self.heap, self.sign * symbol)
        self.young[symbol].append(entries)
        self.held += entries.nbytes
        if self.held > self.memory:
            for s, parts in self.young.items():
                self.runs.setdefault(s, []).append((self.spill.n, sum(map(len, parts))))
                for part in parts:
                    self.spill.append(part)
            self.young, self.held = {}, 0

    def least(self) -> int | None:
        return self.sign * self.heap[0] if self.heap else None

    def drain(self, symbol: int) -> Iterator[np.ndarray]:
        """All tuples of the least symbol, those that arrive meanwhile included."""
        while symbol in self.runs or symbol in self.young:
            if symbol in self.runs:
                start, count = self.runs[symbol].pop(0)
                if not self.runs[symbol]:
                    del self.runs[symbol]
                    if symbol not in self.young:
                        self.young[symbol] = []  # still in the heap
                stored = self.spill.array()
                for k in range(start, start + count, CHUNK):
                    yield np.array(stored[k : min(k + CHUNK, start + count)])
            else:
                parts = self.young[symbol]
                self.young[symbol] = []
                if not parts:
                    del self.young[symbol]
                    break
                entries = np.concatenate(parts)
                self.held -= entries.nbytes
                for k in range(0, len(entries), CHUNK):
                    yield entries[k : k + CHUNK]
        heapq.heappop(self.heap)


def range_min(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least value of each range a..b (both included), by a table of doubled spans."""
    span = b - a + 1
    level = np.frexp(span.astype(np.float64))[1] - 1
    out, row, k = np.empty(len(a), values.dtype), values, 0
    for k in range(int(level.max()) + 1 if len(a) else 0):
        at = level == k
        if at.any():
            out[at] = np.minimum(row[a[at]], row[b[at] - (1 << k) + 1])
        row = np.minimum(row[: -(1 << k)], row[1 << k :])
    return out


class Common:
    """Shared prefixes of handed-on tuples: least along the scan since the symbol's last tuple, plus one."""

    def __init__(self, cap: int):
        self.cap, self.seen, self.least = cap, set(), {}

    def bucket(self):
        """A new bucket begins: nothing is shared across it."""
        self.least = {}

    def batch(self, lcp: np.ndarray, symbols: np.ndarray, where: np.ndarray, first: np.ndarray) -> np.ndarray:
        """``symbols`` and ``where`` (places in the scan) by symbol, ``first``: where a symbol begins."""
        before = np.r_[0, where[:-1] + 1]
        before[first] = 0
        found = range_min(lcp, before, where).astype(np.int64) + 1
        rest = np.r_[np.minimum.accumulate(lcp[::-1])[::-1], np.array([255], lcp.dtype)]
        ends = np.r_[first[1:], len(where)] - 1
        now = {}
        for s, f, e in zip(symbols[first].tolist(), first.tolist(), ends.tolist()):
            if s not in self.seen:
                self.seen.add(s)
                found[f] = 0
            else:
                found[f] = min(found[f], self.least[s] + 1) if s in self.least else 1
            now[s] = int(rest[where[e] + 1])
        low = int(rest[0])
        for s, v in self.least.items():
            if s not in now:
                self.least[s] = min(v, low)
        self.least.update(now)
        return np.minimum(found, self.cap).astype(np.uint8)

    def skip(self, lcp: np.ndarray):
        """A batch that hands nothing on."""
        low = int(lcp.min())
        for s, v in self.least.items():
            self.least[s] = min(v, low)


def run_length(text: np.ndarray, at: int, cap: int) -> int:
    part = np.asarray(text[at : at + cap])
    if not len(part):
        return 0
    other = np.flatnonzero(part != part[0])
    return int(other[0]) if len(other) else len(part)


def stars_of(text: np.ndarray) -> np.ndarray:
    """Positions of star suffixes, ascending."""
    found, after, after_type = [], -1, True
    for hi in range(len(text), 0, -4 * CHUNK):
        lo = max(0, hi - 4 * CHUNK)
        t = np.asarray(text[lo:hi]).astype(np.int64)
        follow = np.r_[t[1:], after]
        turn = np.where(t != follow, np.arange(len(t)), len(t))
        turn = np.minimum.accumulate(turn[::-1])[::-1]
        smaller = np.r_[t < follow, after_type][turn]
        before = np.r_[int(text[lo - 1]) if lo else -1, t[:-1]]
        part = Spool(np.int64)
        part.append(np.flatnonzero(smaller & (before > t)) + lo)
        found.append(part)
        after, after_type = int(t[0]), bool(smaller[0])
    out = Spool(np.int64)
    for part in reversed(found):
        out.append(part.array())
    return out.array()


class Inducer:
    """Both scans over one text."""

    def __init__(self, text: np.ndarray, cap: int, with_common: bool = True):
        self.text, self.cap, self.with_common = text, cap, with_common
        self.entry = np.dtype([("pos", "<u4" if len(text) < 1 << 32 else "<i8"), ("lcp", "u1")])

    def hand_on(self, queue: SymbolQueue, common: Common, pos: np.ndarray, lcp: np.ndarray, wanted):
        """Queue the predecessors for which ``wanted(symbol)`` holds."""
        before = pos.astype(np.int64) - 1
        symbols = self.text[np.maximum(before, 0)]
        where = np.flatnonzero((before >= 0) & wanted(symbols))
        if not len(where):
            if self.with_common:
                common.skip(lcp)
            return
        symbols = symbols[where]
        order = np.argsort(symbols, kind="stable")
        symbols, where = symbols[order], where[order]
        first = np.flatnonzero(np.r_[True, symbols[1:] != symbols[:-1]])
        entries = np.zeros(len(where), self.entry)
        entries["pos"] = before[where]
        if self.with_common:
            entries["lcp"] = common.batch(lcp, symbols, where, first)
        for s, a, b in zip(symbols[first].tolist(), first.tolist(), [*first[1:].tolist(), len(where)]):
            queue.push(s, entries[a:b])

    def ascend(self, seeds: np.ndarray, shared: np.ndarray | None) -> tuple[Spool, list]:
        """L suffixes in order, and where each symbol's begin and end."""
        text, n = self.text, len(self.text)
        out, bounds, common = Spool(self.entry), [], Common(self.cap)
        queue = SymbolQueue(self.entry)
        end = np.zeros(1, self.entry)
        end["pos"] = n - 1
        queue.push(int(text[n - 1]), end)  # the end of the text is smaller than any suffix
        common.seen.add(int(text[n - 1]))
        at = 0
        while at < len(seeds) or queue.heap:
            c = queue.least()
            if at < len(seeds) and (c is None or int(text[seeds[at]]) < c):
                c = int(text[seeds[at]])
            common.bucket()
            start, last = out.n, None
            if queue.least() == c:
                for chunk in queue.drain(c):
                    out.append(chunk)
                    last = int(chunk["pos"][-1])
                    self.hand_on(queue, common, chunk["pos"], chunk["lcp"], lambda s: s >= c)
            bounds.append((c, start, out.n))
            opening = True
            while at < len(seeds) and int(text[seeds[at]]) == c:
                pos = np.asarray(seeds[at : at + CHUNK])
                pos = pos[: int(np.searchsorted(text[pos], c, "right"))]
                lcp = np.zeros(len(pos), np.uint8) if shared is None else np.array(shared[at : at + len(pos)], np.uint8)
                if opening:
                    lcp[0] = 0 if last is None else min(run_length(text, last, self.cap), run_length(text, int(pos[0]), self.cap))
                    opening = False
                self.hand_on(queue, common, pos, lcp, lambda s: s > c)
                at += len(pos)
        return out, bounds

    def descend(self, large: Spool, bounds: list) -> Iterator[tuple[np.ndarray, np.ndarray, bool, int]]:
        """All suffixes from the greatest down: positions, prefix shared with the one before, type S, symbol."""
        text, common, stored = self.text, Common(self.cap), large.array()
        queue = SymbolQueue(self.entry, sign=-1)
        left = list(bounds)
        while left or queue.heap:
            c = queue.least()
            if left and (c is None or left[-1][0] > c):
                c = left[-1][0]
            common.bucket()
            last = None
            if queue.least() == c:
                for chunk in queue.drain(c):
                    last = int(chunk["pos"][-1])
                    yield chunk["pos"], chunk["lcp"], True, c
                    self.hand_on(queue, common, chunk["pos"], chunk["lcp"], lambda s: s <= c)
            if left and left[-1][0] == c:
                _, start, end = left.pop()
                carry = None
                while end > start:
                    chunk = np.asarray(stored[max(start, end - CHUNK) : end])[::-1]
                    if carry is None:
                        carry = 0 if last is None else min(run_length(text, last, self.cap), run_length(text, int(chunk["pos"][0]), self.cap))
                    lcp = np.r_[np.array([carry], np.uint8), chunk["lcp"][:-1]]
                    carry = int(chunk["lcp"][-1])
                    yield chunk["pos"], lcp, False, c
                    self.hand_on(queue, common, chunk["pos"], lcp, lambda s: s < c)
                    end -= len(chunk)


def by_first_symbol(text: np.ndarray, stars: np.ndarray) -> np.ndarray:
    queue, out = SymbolQueue(np.dtype(np.int64)), Spool(np.int64)
    for k in range(0, len(stars), CHUNK):
        part = np.asarray(stars[k : k + CHUNK])
        symbols = text[part]
        order = np.argsort(symbols, kind="stable")
        part, symbols = part[order], symbols[order]
        first = np.flatnonzero(np.r_[True, symbols[1:] != symbols[:-1]])
        for s, a, b in zip(symbols[first].tolist(), first.tolist(), [*first[1:].tolist(), len(part)]):
            queue.push(s, part[a:b])
    while queue.heap:
        for part in queue.drain(queue.least()):
            out.append(part)
    return out.array()


def sorted_substrings(text: np.ndarray, stars: np.ndarray) -> np.ndarray:
    """Stars in the order of the substrings up to the next star."""
    scan = Inducer(text, 0, with_common=False)
    found = []
    for pos, _, small, c in scan.descend(*scan.ascend(by_first_symbol(text, stars), None)):
        if small:
            part = Spool(np.int64)
            before = pos.astype(np.int64) - 1
            part.append(pos[(before >= 0) & (text[np.maximum(before, 0)] > c)])
            if part.n:
                found.append(part)
    out = Spool(np.int64)
    for part in reversed(found):
        out.append(part.array()[::-1])
    return out.array()


def names_of(text: np.ndarray, stars: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """The string of names, in text order, and the number of names."""
    m = len(stars)
    names, last, name = room(m, np.int64), None, 0
    for k in range(0, m, CHUNK):
        pos = np.asarray(order[k : k + CHUNK])
        at = np.searchsorted(stars, pos)
        closed = at + 1 < m
        size = np.where(closed, stars[np.minimum(at + 1, m - 1)] - pos, -1)
        x, xs = np.r_[pos[0] if last is None else last[0], pos[:-1]], np.r_[-2 if last is None else last[1], size[:-1]]
        differs = (size < 0) | (size != xs)
        open_ = np.flatnonzero(~differs)
        t = 0
        while len(open_):
            same = text[x[open_] + t] == text[pos[open_] + t]
            differs[open_[~same]] = True
            open_ = open_[same]
            open_ = open_[size[open_] > t]
            t += 1
        which = name + np.cumsum(differs)
        names[at] = which
        name, last = int(which[-1]), (pos[-1], size[-1])
    return names, name


def doubling(text: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of a short string, sorted in memory as far as ``cap`` symbols."""
    n = len(text)
    text = np.asarray(text).astype(np.int64)
    order = np.argsort(text, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.r_[0, text[order][1:] != text[order][:-1]])
    h = 1
    while h < cap and n and rank[order[-1]] < n - 1:
        key = rank * (n + 1)
        key[: n - h] += rank[h:] + 1
        order = np.argsort(key, kind="stable")
        rank[order] = np.cumsum(np.r_[0, key[order][1:] != key[order][:-1]])
        h *= 2
    lcp = np.zeros(n, np.uint8)
    extend(text, order[:-1], order[1:], lcp[1:], cap)
    return order, lcp


def extend(text: np.ndarray, a: np.ndarray, b: np.ndarray, lcp: np.ndarray, cap: int):
    """Raise ``lcp``, a shared prefix of the suffixes at a and b, to the whole one (up to ``cap``)."""
    n, open_ = len(text), np.flatnonzero(lcp < cap)
    while len(open_):
        x, y = a[open_] + lcp[open_], b[open_] + lcp[open_]
        inside = (x < n) & (y < n)
        open_, x, y = open_[inside], x[inside], y[inside]
        open_ = open_[text[x] == text[y]]
        lcp[open_] += 1
        open_ = open_[lcp[open_] < cap]


def star_order(text: np.ndarray, cap: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Star suffixes in order, and the prefix each shares with the one before."""
    stars = stars_of(text)
    m = len(stars)
    if not m:
        return stars, np.zeros(0, np.uint8)
    order = sorted_substrings(text, stars)
    names, most = names_of(text, stars, order)
    if most == m:
        ranked, shared = None, None
    elif m <= base:
        ranked, shared = doubling(names, cap)
    else:
        ranked, shared = suffix_sort(names, cap, base)
    out, prefixes, last = Spool(np.int64), Spool(np.uint8), None
    for k in range(0, m, CHUNK):
        pos = np.asarray(order[k : k + CHUNK]) if ranked is None else stars[ranked[k : k + CHUNK]]
        before = np.r_[pos[0] if last is None else last, pos[:-1]]
        lcp = np.zeros(len(pos), np.uint8)
        if ranked is not None:
            x = np.r_[ranked[k - 1] if k else ranked[0], ranked[k : k + len(pos) - 1]].astype(np.int64) + shared[k : k + len(pos)]
            lcp = np.minimum(np.where(x < m, stars[np.minimum(x, m - 1)], len(text)) - before, cap).astype(np.uint8)
        extend(text, before, pos, lcp, cap)
        if last is None:
            lcp[0] = 0
        out.append(pos)
        prefixes.append(lcp)
        last = pos[-1]
    return out.array(), prefixes.array()


def suffix_sort(text: np.ndarray, cap: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of ``text`` (non-negative integers) and the prefixes shared with the suffix before, up to ``cap`` (below 255)."""
    n = len(text)
    order, shared = room(n, np.uint32 if n < 1 << 32 else np.int64), room(n + 1, np.uint8)
    if not n:
        return order, shared[:0]
    scan = Inducer(text, cap)
    end = n
    for pos, lcp, _, _ in scan.descend(*scan.ascend(*star_order(text, cap, base))):
        order[end - len(pos) : end] = pos[::-1]
        shared[end - len(pos) + 1 : end + 1] = lcp[::-1]
        end -= len(pos)
    shared[0] = 0
    return order, shared[:n]
