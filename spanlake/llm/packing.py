"""Best-fit packing of documents into sequences, improved by swap-based local search.

Pieces of equal length are alike, so the plan is made over the number of pieces of each length:
at most ``capacity`` counts reach the driver whatever the input's size. Best fit fills kinds of
bins; local search then moves pieces between underfull kinds of bins, or exchanges one for one
or two for one, whenever that raises the sum of squared fills, until bins empty. Each piece then
finds its bin from its rank among the pieces of its length.

Null text is empty (the end id alone); texts of any length are packed whole, in pieces; a null id keeps its pieces;
repeated rows are packed one by one, and which of equally long pieces goes where is no matter; an empty table
gives no rows; extra columns don't pass through, so their names are no matter.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import Bpe
from .common import saved, text_blocks

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, pid int, nth long"


def pieces(df: DataFrame, path: str, end_id: int, capacity: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece of each document, with its partition and its place among that partition's pieces of its length."""

    def run(batches):
        bpe, pid = Bpe.at(path, by_library=True), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch, data, offs in text_blocks(batches, text):
            ids, at = bpe.encode(data, offs)
            flat = np.insert(ids, at[1:], end_id).astype("<u4")
            raw, bounds = memoryview(flat.tobytes()), at + np.arange(len(at))
            n = np.diff(bounds)
            count = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            head = n - (count - 1) * capacity
            length = np.where(piece == 0, head[row], capacity)
            start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
            begin = bounds[row] + start
            crc = [zlib.crc32(raw[4 * a : 4 * (a + m)]) for a, m in zip(begin.tolist(), length.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            got, first, many = np.unique(length[order], return_index=True, return_counts=True)
            nth = np.empty(len(length), np.int64)
            nth[order] = np.arange(len(order)) - np.repeat(first, many) + np.repeat(seen[got], many)
            seen[got] += many
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(row), pid, np.int32)), pa.array(nth)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "pid", "nth"],
            )

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias(text)).mapInArrow(run, PIECES)


def best_fit(counts: dict[int, int], capacity: int) -> Counter:
    """Kinds of bins (their lengths, descending) and how many of each: each bin takes the largest piece that still fits."""
    left = {s: n for s, n in counts.items() if n > 0}
    sizes, bins = sorted(left, reverse=True), Counter()
    while left:
        kind, room, used = [], capacity, Counter()
        for s in sizes:
            while s <= room and left[s] > used[s]:
                take = min(room // s, left[s] - used[s])
                used[s] += take
                kind += [s] * take
                room -= s * take
            if room < sizes[-1]:
                break
        times = min(left[s] // k for s, k in used.items())
        bins[tuple(kind)] += times
        for s, k in used.items():
            left[s] -= k * times
            if not left[s]:
                del left[s]
        sizes = [s for s in sizes if s in left]
    return bins


class _Bins:
    """Kinds of underfull bins, their pieces laid out flat, for a search of all exchanges with one kind at once."""

    def __init__(self, bins: Counter, capacity: int):
        self.capacity, self.many = capacity, Counter()
        self.kinds: list[tuple] = []
        self.seen: set[tuple] = set()
        self.fill, self.piece, self.own = (np.zeros(0, np.int64) for _ in range(3))
        self.add(bins)

    def add(self, bins: dict[tuple, int]) -> None:
        """More bins; a kind that was laid out before isn't again."""
        new = []
        for kind, n in bins.items():
            self.many[kind] += n
            if kind not in self.seen and 0 < sum(kind) < self.capacity:
                self.seen.add(kind)
                new.append(kind)
        give = [[0, *sorted(set(k))] for k in new]
        self.fill = np.concatenate([self.fill, np.array([sum(k) for k in new], np.int64)])
        self.piece = np.concatenate([self.piece, np.array([x for g in give for x in g], np.int64)])
        self.own = np.concatenate([self.own, np.repeat(np.arange(len(self.kinds), len(self.kinds) + len(new)), [len(g) for g in give]).astype(np.int64)])
        self.kinds += new

    def best(self, a: tuple) -> tuple | None:
        """The exchange that moves one or two pieces of a to another bin, for one piece back or none, with the greatest rise of the sum of squares: (b, out, back)."""
        ones, has = sorted(set(a)), Counter(a)
        outs = [(x,) for x in ones] + [(x, y) for i, x in enumerate(ones) for y in ones[i:] if x != y or has[x] > 1]
        present = np.array([self.many[k] - (k == a) > 0 for k in self.kinds], bool)
        columns = np.flatnonzero(present[self.own])
        fill = self.fill[self.own[columns]]
        moved = np.array([sum(o) for o in outs])[:, None] - self.piece[columns][None, :]
        rise = moved * (fill - sum(a) + moved)
        rise[(moved <= 0) | (fill + moved > self.capacity)] = 0
        k = int(rise.argmax()) if rise.size else 0
        if not rise.size or rise.flat[k] <= 0:
            return None
        out, at = divmod(k, len(columns))
        return self.kinds[self.own[columns[at]]], outs[out], int(self.piece[columns[at]])


def local_search(bins: Counter, capacity: int) -> Counter:
    """Exchange pieces between underfull bins, the emptiest first, until no exchange raises the sum of squared fills.

    Every exchange raises that sum, which is bounded, so the search ends by itself; whichever bin is emptied goes.
    """
    held = _Bins(bins, capacity)
    changed = True
    while changed:
        changed = False
        for a in sorted((k for k in held.kinds if held.many[k]), key=lambda k: (sum(k), k)):
            while held.many[a] and (found := held.best(a)):
                b, out, back = found
                times = held.many[a] // 2 if a == b else min(held.many[a], held.many[b])
                new_a, new_b = Counter(a) - Counter(out), Counter(b) + Counter(out)
                if back:
                    new_a[back] += 1
                    new_b[back] -= 1
                held.many[a] -= times
                held.many[b] -= times
                after: Counter = Counter()
                for new in (new_a, new_b):
                    after[tuple(sorted(new.elements(), reverse=True))] += times
                held.add({k: n for k, n in after.items() if k})
                changed = True
    return Counter({k: n for k, n in held.many.items() if n > 0})


def places(bins: Counter) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first ranks of runs of pieces, the sequence of each run's first piece, their place in it."""
    runs: dict[int, list] = {}
    used, seq = Counter(), 0
    for kind, n in sorted(bins.items(), reverse=True):
        at = 0
        for s in kind:
            runs.setdefault(s, []).append((used[s], seq, at))
            used[s] += n
            at += s
        seq += n
    return {s: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for s, r in runs.items()}


def pack(df: DataFrame, path: str, end_id: int, capacity: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    made, _ = saved(pieces(df, path, end_id, capacity, key, text), "pieces")
    counts = {s: n for s, n in made.groupBy("length").count().collect()}  # capacity rows at most
    plan = places(local_search(best_fit(counts, capacity), capacity))
    own = made.groupBy("pid", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    base = own.select("pid", "length", F.coalesce(before, F.lit(0)).alias("base"))

    def run(batches):
        for batch in batches:
            length = batch.column(3).to_numpy()
            rank = batch.column(5).to_numpy()
            seq, place = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for s in np.unique(length).tolist():
                first, begin, offset = plan[s]
                mine = np.flatnonzero(length == s)
                k = np.searchsorted(first, rank[mine], "right") - 1
                seq[mine], place[mine] = begin[k] + rank[mine] - first[k], offset[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(place)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = made.join(base, ["pid", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
