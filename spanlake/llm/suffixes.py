"""External induced sorting of suffixes with common-prefix values.

Suffixes are L (larger than the next suffix) or S; an S after an L is a seed. Seeds' substrings are
named in order, and the text of names is sorted by recursion; names beyond DIGIT are written as
two symbols each, so that tables of an alphabet stay in memory. From the sorted seeds the L suffixes are
induced by ascending first symbol, from those the S suffixes by descending one; neighbouring symbols whose
suffixes have all been queued are visited in one step. The queues between symbols
(``Queue``) hold tuples of a suffix's place and its common prefix with the tuple before it. That
is one more than the least common prefix between their next suffixes, so these values ride along
the induction; those of the seeds come out of the recursion, as equal names are equally long.

Whatever grows with the text (text, types, seeds, names, queues, the visited order) goes through
``Space.array``: beyond a bound it is a file in the task's scratch folder, read and written in
pieces. The recursion ends at texts of at most BASE symbols, which are sorted in memory (``in_memory``).
"""

from __future__ import annotations

import os
import shutil
import tempfile

import numpy as np

from .common import spots

MEMORY = 2 << 20  # bytes that an array holds in memory before it goes to disk
BASE = 4096  # symbols that are sorted in memory, at the end of the recursion
DIGIT = MEMORY // 8  # names up to this many are symbols by themselves: a table of them is held in memory
AHEAD = 4096  # symbols that are looked at for one step


class Space:
    """A scratch folder of one task for arrays larger than memory, among Spark's own spill files, removed at the end; nothing else reads it."""

    def __init__(self, memory: int = MEMORY):
        self.memory, self.path, self.n = memory, None, 0
        self.step = max(64, memory // 64)  # rows that one step works on
        self.base = max(16, min(BASE, memory // 64))

    def __enter__(self):
        return self

    def __exit__(self, *_):
        if self.path:
            shutil.rmtree(self.path, ignore_errors=True)

    def file(self) -> str:
        spill = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]  # which Spark tells its workers
        self.path = self.path or tempfile.mkdtemp(prefix="suffix-", dir=spill or None)
        self.n += 1
        return os.path.join(self.path, str(self.n))

    def array(self, n: int, kind) -> np.ndarray:
        if n * np.dtype(kind).itemsize <= self.memory:
            return np.empty(n, kind)
        return np.asarray(np.memmap(self.file(), kind, "w+", shape=(n,)))

    def steps(self, n: int):
        """Ranges that cover 0 .. n."""
        return ((a, min(n, a + self.step)) for a in range(0, n, self.step))


class Rows:
    """An array that grows at its end: in memory first, in a file beyond the bound."""

    def __init__(self, space: Space, kind):
        self.space, self.kind, self.held, self.n, self.path = space, np.dtype(kind), [], 0, None

    def add(self, x: np.ndarray) -> None:
        self.held.append(np.asarray(x, self.kind))
        self.n += len(x)
        if sum(len(h) for h in self.held) * self.kind.itemsize > self.space.memory:
            self.flush()

    def flush(self) -> None:
        self.path = self.path or self.space.file()
        with open(self.path, "ab") as f:
            for h in self.held:
                h.tofile(f)
        self.held = []

    def whole(self) -> np.ndarray:
        if not self.path:
            return np.concatenate(self.held) if self.held else np.zeros(0, self.kind)
        self.flush()
        return np.asarray(np.memmap(self.path, self.kind, "r+", shape=(self.n,)))


def _width(cap: int):
    """Numbers that hold common prefixes up to cap."""
    return np.int16 if cap < 1 << 15 else np.int32


def _ranges(table: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least of table[first .. last] for each pair."""
    size = last - first + 1
    if int(size.sum()) <= 20_000 + 8 * len(table):
        at = np.empty(2 * len(first), np.int64)
        at[::2], at[1::2] = first, last + 1
        return np.minimum.reduceat(np.append(table, table[-1]), at)[::2]
    out, width = np.empty(len(first), table.dtype), 1
    while True:
        mine = np.flatnonzero((size >= width) & (size < 2 * width))
        out[mine] = np.minimum(table[first[mine]], table[last[mine] + 1 - width])
        if int(size.max()) < 2 * width:
            return out
        table = np.minimum(table[:-width], table[width:])
        width *= 2


class Queue:
    """Tuples (place, common prefix with the tuple before) by symbol. Each symbol's come and go in the suffixes' order.

    ``counts`` tells the tuples of each symbol, so each has its own run in one array, on disk if large.
    """

    def __init__(self, counts: np.ndarray, cap: int, space: Space, kind):
        self.ends = np.cumsum(counts)
        self.begins = self.ends - counts
        self.into, self.out, self.cap = self.begins.copy(), self.begins.copy(), cap
        self.place, self.prefix = space.array(int(counts.sum()), kind), space.array(int(counts.sum()), _width(cap))
        self.low = np.full(len(counts), -1, np.int32)  # least prefix visited since a symbol's last tuple; -1: it has none

    def push(self, symbol: np.ndarray, at: np.ndarray, place: np.ndarray, visited: np.ndarray) -> None:
        """Tuples for the places before some of the suffixes that were just visited: those at ``at``; ``visited`` are the prefixes of them all."""
        if len(symbol):
            order = np.argsort(symbol, kind="stable")
            symbol, at = symbol[order].astype(np.int64), at[order]
            new = np.concatenate([[True], symbol[1:] != symbol[:-1]])
            heads = np.flatnonzero(new)
            own = symbol[heads]
            low = np.empty(len(at), np.int32)
            low[heads] = np.minimum(self.low[own], np.minimum.accumulate(visited)[at[heads]])
            rest = np.flatnonzero(~new)
            if len(rest):
                low[rest] = _ranges(visited, at[rest - 1] + 1, at[rest])
            sizes = np.diff(np.append(heads, len(symbol)))
            slot = np.repeat(self.into[own] - heads, sizes) + np.arange(len(symbol))
            self.place[slot], self.prefix[slot] = place[order], np.minimum(low + 1, self.cap)
            self.into[own] += sizes
        np.minimum(self.low, int(visited.min()), out=self.low)
        if len(symbol):
            ahead = np.append(np.minimum.accumulate(visited[::-1])[::-1], np.int32(self.cap))
            self.low[own] = ahead[at[heads + sizes - 1] + 1]

    def pop(self, symbol: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The symbol's next tuples, ``most`` at most."""
        a = int(self.out[symbol])
        b = min(int(self.into[symbol]), a + most)
        self.out[symbol] = b
        return np.array(self.place[a:b]), np.array(self.prefix[a:b])

    def complete(self, first: int, last: int) -> int:
        """How many symbols from first on, towards last, have all of their tuples."""
        if first <= last:
            missing = np.flatnonzero(self.into[first : last + 1] != self.ends[first : last + 1])
        else:
            missing = np.flatnonzero((self.into[last : first + 1] != self.ends[last : first + 1])[::-1])
        return int(missing[0]) if len(missing) else abs(last - first) + 1


class _Visited:
    """The order visited so far: places, and the common prefix of each with the one before."""

    def __init__(self, n: int, cap: int, space: Space, kind):
        self.place, self.prefix, self.n = space.array(n, kind), space.array(n, _width(cap)), 0

    def add(self, place: np.ndarray, prefix: np.ndarray) -> None:
        self.place[self.n : self.n + len(place)] = place
        self.prefix[self.n : self.n + len(place)] = prefix
        self.n += len(place)


def types(text: np.ndarray, space: Space) -> np.ndarray:
    """True where a suffix is smaller than the next; the last one, the least symbol, is too."""
    n = len(text)
    out = space.array(n, bool)
    out[n - 1] = small = True
    for a, b in reversed(list(space.steps(n - 1))):
        part = np.array(text[a : b + 1], np.int64)
        step = np.sign(part[1:] - part[:-1])
        at = np.where(step != 0, np.arange(b - a), b - a)
        at = np.minimum.accumulate(at[::-1])[::-1]
        out[a:b] = np.append(step > 0, small)[at]
        small = bool(out[a])
    return out


def _seeds(small: np.ndarray, space: Space, kind) -> np.ndarray:
    """Places of the seeds."""
    rows = Rows(space, kind)
    for a, b in space.steps(len(small) - 1):
        rows.add(np.flatnonzero(small[a + 1 : b + 1] & ~small[a:b]) + a + 1)
    return rows.whole()


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap) -> np.ndarray:
    """Common prefix of the suffixes at a and b, up to cap, by comparing symbols."""
    n, out, live = len(text), np.zeros(len(a), np.int64), np.arange(len(a))
    cap = np.broadcast_to(np.asarray(cap, np.int64), len(a))
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        good = (out[live] < cap[live]) & (x < n) & (y < n)
        good[good] = text[x[good]] == text[y[good]]
        live = live[good]
        out[live] += 1
    return out


def _pair(text: np.ndarray, a: int, b: int, cap: int) -> int:
    x, y = text[a : a + cap], text[b : b + cap]
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    return int(differ[0]) if len(differ) else n


def in_memory(text: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order by prefix doubling, and common prefixes."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    n, k = len(text), 1
    order = np.argsort(rank, kind="stable")
    while int(rank[order[-1]]) < n - 1:
        nxt = np.zeros(n, np.int64)
        nxt[: max(n - k, 0)] = rank[k:] + 1
        key = rank * (n + 1) + nxt
        order = np.argsort(key)
        key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        k *= 2
    prefix = np.zeros(n, np.int64)
    prefix[1:] = common(text, order[:-1], order[1:], cap)
    return order, prefix


def _named(text: np.ndarray, seeds: np.ndarray, which: np.ndarray, at: int, first: int, out: np.ndarray, space: Space, end: int) -> int:
    """Write names from ``first`` on to the seeds ``which``, alike in their first ``at`` symbols, all below ``end``; return the next name.

    A name is the order of the seed's substring, which ends at the next seed. One that ends where another
    goes on is the larger: its last symbol is of an S suffix, the other's of an L.
    """
    last = len(seeds) - 1
    bits = 8 * text.dtype.itemsize
    beyond = np.uint64((1 << bits) - 1)  # beyond every symbol

    def columns(own: np.ndarray, at: int, n: int):
        own = np.asarray(own, np.int64)
        where = seeds[own].astype(np.int64) + at
        left = seeds[np.minimum(own + 1, last)] - where
        for k in range(n):
            yield np.where(left >= k, text[np.minimum(where + k, len(text) - 1)], beyond)

    def symbols(own: np.ndarray, at: int) -> np.ndarray:
        return np.minimum(next(columns(own, at, 1)), np.uint64(end)).astype(np.int64)

    n = len(which)
    if n > space.step:
        # Too many for one step: deal them out by their next symbol, the small groups together.
        counts = np.zeros(end + 1, np.int64)
        for a, b in space.steps(n):
            counts += np.bincount(symbols(which[a:b], at), minlength=end + 1)
        present = np.flatnonzero(counts)
        bucket, sizes, alone = np.zeros(end + 1, np.int64), [], []
        for s in present.tolist():
            if sizes and not alone[-1] and sizes[-1] + counts[s] <= space.step:
                sizes[-1] += int(counts[s])
            else:
                sizes.append(int(counts[s]))
                alone.append(sizes[-1] > space.step)
            bucket[s] = len(sizes) - 1
        stops = np.cumsum(sizes)
        dealt, into = space.array(n, out.dtype), stops - sizes
        for a, b in space.steps(n):
            own = np.array(which[a:b])
            mine = bucket[symbols(own, at)]
            order = np.argsort(mine, kind="stable")
            many = np.bincount(mine, minlength=len(sizes))
            dealt[np.repeat(into - (np.cumsum(many) - many), many) + np.arange(len(own))] = own[order]
            into = into + many
        for k, (a, b) in enumerate(zip((stops - sizes).tolist(), stops.tolist(), strict=True)):
            if alone[k] and bucket[end] == k and counts[end]:
                for c, d in space.steps(b - a):  # ended: one name for all
                    out[dealt[a + c : a + d]] = first
                first += 1
            else:
                first = _named(text, seeds, dealt[a:b], at + alone[k], first, out, space, end)
        return first
    which = np.array(which)
    group, live = np.zeros(n, np.int64), np.arange(n)
    while len(live):
        key = np.zeros(len(live), np.uint64)
        for symbol in columns(which[live], at, 64 // bits):
            key = key << np.uint64(bits) | symbol
        order = np.argsort(key) if len(live) == n else np.lexsort((key, group[live]))
        live, key = live[order], key[order]
        g = group[live]
        head = np.concatenate([[True], g[1:] != g[:-1]])
        new = head | np.concatenate([[True], key[1:] != key[:-1]])
        k = np.arange(len(live))
        group[live] = g + np.maximum.accumulate(np.where(new, k, 0)) - np.maximum.accumulate(np.where(head, k, 0))
        sizes = np.diff(np.append(np.flatnonzero(new), len(live)))
        live = live[np.repeat(sizes > 1, sizes) & (key & beyond < beyond)]
        at += 64 // bits
    names = np.cumsum(np.bincount(group, minlength=n) > 0) - 1
    out[which] = names[group] + first
    return first + int(names[-1]) + 1


def _sorted_seeds(text: np.ndarray, seeds: np.ndarray, cap: int, space: Space, kind, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The seeds' places in the order of their suffixes, and the common prefix of each with the one before."""
    n = len(seeds)
    named = space.array(n, kind)
    every = space.array(n, kind)
    for a, b in space.steps(n):
        every[a:b] = np.arange(a, b)
    many = _named(text, seeds, every, 0, 0, named, space, end)
    del every
    order, shared = space.array(n, kind), None
    if many == n:
        for a, b in space.steps(n):
            order[named[a:b]] = np.arange(a, b)
    else:
        # Each name as one or two symbols from 1 on, and 0 at the end.
        digits, base = (1, many) if many <= DIGIT else (2, int(np.ceil(np.sqrt(many))))
        reduced, shared = space.array(digits * n + 1, np.uint16 if base + 2 < 1 << 16 else np.uint32), space.array(n, np.int32)
        for a, b in space.steps(n):
            part = np.asarray(named[a:b], np.int64)
            reduced[digits * a : digits * b] = (part if digits == 1 else np.stack([part // base, part % base], axis=1).ravel()) + 1
        reduced[digits * n] = 0
        place, prefix = sort(reduced, digits * (cap // 2 + 1), space)
        done, low = 0, 0
        for a, b in space.steps(len(place)):
            own, own_prefix = np.array(place[a:b], np.int64), np.array(prefix[a:b], np.int64)
            at = np.flatnonzero((own % digits == 0) & (own < digits * n))
            if not len(at):
                low = min(low, int(own_prefix.min()))
                continue
            between = np.minimum.reduceat(own_prefix[: at[-1] + 1], np.append(0, at[:-1] + 1))
            between[0] = min(low, between[0])
            order[done : done + len(at)], shared[done : done + len(at)] = own[at] // digits, between // digits
            done += len(at)
            low = int(own_prefix[at[-1] + 1 :].min()) if at[-1] + 1 < len(own) else cap + digits
    out, out_prefix = space.array(n, kind), space.array(n, np.int32)
    before = None
    for a, b in space.steps(n):
        own = np.array(order[a:b], np.int64)
        out[a:b] = seeds[own]
        left = np.append(own[0] if before is None else before, own[:-1])
        same = np.zeros(len(own), np.int64) if shared is None else np.array(shared[a:b], np.int64)
        same = np.minimum(same, n - 1 - np.maximum(own, left))  # of equal names, as far as there are any
        off = np.minimum(seeds[own + same].astype(np.int64) - seeds[own], cap)
        out_prefix[a:b] = off + common(text, seeds[left].astype(np.int64) + off, seeds[own].astype(np.int64) + off, cap - off)
        before = int(own[-1])
    out_prefix[0] = 0
    return out, out_prefix


def sort(text: np.ndarray, cap: int, space: Space) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of a text of symbols (unsigned, below the greatest of their kind) that ends with its least symbol, found nowhere else; each suffix's common prefix (up to cap) with the one before."""
    n = len(text)
    if n <= space.base:
        return in_memory(np.array(text), cap)
    kind = np.int32 if n < 1 << 31 else np.int64
    small = types(text, space)
    counts = np.zeros((2, 0), np.int64)
    for a, b in space.steps(n):
        part, own = np.array(text[a:b], np.int64), np.array(small[a:b], np.int64)
        size = max(counts.shape[1], int(part.max()) + 1)
        counts = np.pad(counts, ((0, 0), (0, size - counts.shape[1]))) + np.bincount(2 * part + own, minlength=2 * size).reshape(size, 2).T
    larges, smalls = counts
    end, least = len(larges), int(text[n - 1])
    seeds, seed_prefix = _sorted_seeds(text, _seeds(small, space, kind), cap, space, kind, end)
    seed_counts = np.zeros(end, np.int64)
    for a, b in space.steps(len(seeds)):
        seed_counts += np.bincount(text[np.array(seeds[a:b])], minlength=end)
    seed_ends = np.cumsum(seed_counts)

    def onward(visited: _Visited, queue: Queue, place: np.ndarray, prefix: np.ndarray, wanted: bool) -> None:
        """Note suffixes as visited and queue those before them that are of the wanted type."""
        if not len(place):
            return
        prefix = np.asarray(prefix, np.int32)
        visited.add(place, prefix)
        at = np.flatnonzero(place > 0)
        left = place[at].astype(np.int64) - 1
        good = small[left] == wanted
        at, left = at[good], left[good]
        queue.push(text[left], at, left, prefix)

    def joined(ones, one_counts: np.ndarray, others, other_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and prefixes of several symbols: of each its ``ones``, then its ``others``, which meet them by what they have in common."""
        at_ones = np.arange(len(ones[0])) + np.repeat(np.cumsum(other_counts) - other_counts, one_counts)
        at_others = np.arange(len(others[0])) + np.repeat(np.cumsum(one_counts), other_counts)
        place, prefix = (np.empty(len(at_ones) + len(at_others), k) for k in (kind, np.int32))
        place[at_ones], prefix[at_ones] = ones
        place[at_others], prefix[at_others] = others
        heads = at_others[(np.cumsum(other_counts) - other_counts)[other_counts > 0]]
        prefix[heads] = 0
        heads = heads[one_counts[other_counts > 0] > 0]
        prefix[heads] = common(text, place[heads - 1].astype(np.int64), place[heads].astype(np.int64), cap)
        return place, prefix

    # Ascending: L suffixes, and behind those of a symbol its seeds.
    first, queue = _Visited(int(larges.sum()) + len(seeds), cap, space, kind), Queue(larges, cap, space, kind)
    stops = np.cumsum(larges + seed_counts)  # where each symbol's end among the visited
    c = 0
    while c < end:
        d = c + queue.complete(c, min(end, c + AHEAD) - 1)
        d = min(d, int(np.searchsorted(stops, first.n + space.step, "right")))
        if d > c:
            a, b = int(queue.begins[c]), int(queue.ends[d - 1])
            i, j = int(seed_ends[c] - seed_counts[c]), int(seed_ends[d - 1])
            onward(first, queue, *joined((queue.place[a:b], queue.prefix[a:b]), larges[c:d], (seeds[i:j], seed_prefix[i:j]), seed_counts[c:d]), False)
            c = d
            continue
        begin = first.n
        while len((got := queue.pop(c, space.step))[0]):
            onward(first, queue, *got, False)
        a, b = int(seed_ends[c] - seed_counts[c]), int(seed_ends[c])
        for i in range(a, b, space.step):
            own, prefix = np.array(seeds[i : min(b, i + space.step)]), np.array(seed_prefix[i : min(b, i + space.step)])
            if i == a:
                prefix[0] = _pair(text, int(first.place[first.n - 1]), int(own[0]), cap) if first.n > begin else 0
            onward(first, queue, own, prefix, False)
        c += 1
    del seeds, seed_prefix, queue
    # Descending: S suffixes, and behind those of a symbol its L suffixes.
    second, queue = _Visited(n, cap, space, kind), Queue(smalls, cap, space, kind)
    starts = stops - larges - seed_counts
    before = np.cumsum(larges + smalls)  # suffixes up to each symbol
    c = end - 1
    while c > least:
        d = c - queue.complete(c, max(least + 1, c + 1 - AHEAD))
        d = max(d, int(np.searchsorted(before, n - second.n - space.step)))
        if d < c:
            own = np.arange(c, d, -1)
            ones, others = smalls[own], larges[own]
            at = spots(queue.begins[own], ones)
            back = np.repeat(starts[own] + np.cumsum(others) - 1, others) - np.arange(int(others.sum()))
            onward(second, queue, *joined((queue.place[at], queue.prefix[at]), ones, (first.place[back], first.prefix[np.minimum(back + 1, first.n - 1)]), others), True)
            c = d
            continue
        begin = second.n
        while len((got := queue.pop(c, space.step))[0]):
            onward(second, queue, *got, True)
        a, b = int(starts[c]), int(starts[c] + larges[c])
        for j in range(b, a, -space.step):
            i = max(a, j - space.step)
            own, prefix = np.array(first.place[i:j][::-1]), np.zeros(j - i, np.int64)
            prefix[1:] = first.prefix[i + 1 : j][::-1]
            if j < b:
                prefix[0] = first.prefix[j]
            elif second.n > begin:
                prefix[0] = _pair(text, int(second.place[second.n - 1]), int(own[0]), cap)
            onward(second, queue, own, prefix, True)
        c -= 1
    second.add(np.array([n - 1]), np.zeros(1, np.int64))
    del first, queue
    place, prefix = space.array(n, kind), space.array(n, _width(cap))
    for a, b in space.steps(n):
        place[n - b : n - a] = second.place[a:b][::-1]
        prefix[n - b + 1 : n - max(a, 1) + 1] = second.prefix[max(a, 1) : b][::-1]
    prefix[0] = 0
    return place, prefix
