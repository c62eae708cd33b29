"""Chroma fingerprints of audio columns.

Frames of the power spectrum are folded into twelve pitch classes. Over the frames' integral
image, sixteen box filters are each quantised to two bits (Gray coded) and packed into one
32-bit integer a window. Two recordings align at the offset that most of their equal integers
share, the least of equals; the bit error over the overlap at that offset tells whether they match. An overlap of
under WINDOW integers tells nothing, as integers so near to each other share frames.

Query recordings are compared with all rows, in blocks of at most BLOCK integers: a block's
integers lie sorted with every task, a recording's integers find their equals there, and hits are
counted by (recording, query, offset), however common an integer is. Queries with equal integers are one, named by the least id.

A null, empty or too short recording has no integers and matches nothing; non-finite samples
count as silence; a recording of any length is one; repeated rows are recordings of their own; an empty table gives no rows;
other columns don't pass through. A null id is no query.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, saved, spots

RATE, FRAME, HOP, WINDOW = 4000, 512, 128, 16
BLOCK = 1 << 20  # integers of query recordings that are compared with all rows in one pass
HITS = 1 << 21  # equal integers that are counted at once
STRIDE = 8  # an overlap's bit errors are added up in so many rounds; pairs with too many leave early
# Fixed values of the fingerprint: filter kind, first pitch class, height, width; thresholds come from quartiles of unit normal noise.
FILTERS = [(k % 6, (5 * k) % 12, 1 + k % 4 * 2, WINDOW - k % 4 * 4) for k in range(16)]
CUTS = (-0.05, 0.0, 0.05)
GRAY = np.array([0, 1, 3, 2], np.uint32)


_FREQ = np.fft.rfftfreq(FRAME, 1 / RATE)
_USE = np.flatnonzero((_FREQ >= 60) & (_FREQ <= 1900))
_NOTE = np.round(12 * np.log2(_FREQ[_USE] / 440)).astype(int) % 12
_USE, _NOTE = _USE[np.argsort(_NOTE, kind="stable")], np.sort(_NOTE)
_NOTES, _HEADS = np.unique(_NOTE, return_index=True)
_HANN = np.hanning(FRAME).astype(np.float32)


def pitch_classes(pcm: np.ndarray) -> np.ndarray:
    """Of recordings of one length, frames by twelve pitch classes, each frame of unit length."""
    n = (pcm.shape[1] - FRAME) // HOP + 1
    if n < 1:
        return np.zeros((len(pcm), 0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(pcm, FRAME, axis=1)[:, ::HOP] * _HANN
    bins = np.fft.rfft(frames, axis=2)[:, :, _USE]
    power = bins.real**2 + bins.imag**2
    out = np.zeros((len(pcm), n, 12))
    out[:, :, _NOTES] = np.add.reduceat(power, _HEADS, axis=2)
    size = np.sqrt((out**2).sum(axis=2, keepdims=True))
    return np.where(size > 1e-9, out / np.maximum(size, 1e-9), 0)


def _codes(pcm: np.ndarray) -> np.ndarray:
    """Packed integers of recordings of one length, one for each window of frames."""
    c = pitch_classes(pcm)
    n = c.shape[1] - WINDOW + 1
    if n < 1:
        return np.zeros((len(c), 0), np.uint32)
    image = np.zeros((len(c), c.shape[1] + 1, 25))
    image[:, 1:, 1:] = np.concatenate([c, c], axis=2).cumsum(1).cumsum(2)  # pitch classes go round
    box = lambda t, y, w, h: image[:, t + w : t + w + n, y + h] - image[:, t : t + n, y + h] - image[:, t + w : t + w + n, y] + image[:, t : t + n, y]
    out = np.zeros((len(c), n), np.uint32)
    for kind, y, h, w in FILTERS:
        a, b = w // 2, max(1, h // 2)
        whole = box(0, y, w, h)
        if kind == 0:
            other = box(0, (y + 6) % 12, w, h)
        elif kind == 1:
            whole, other = box(0, y, a, h), box(a, y, w - a, h)
        elif kind == 2:
            whole, other = box(0, y, w, b), box(0, y + b, w, max(1, h - b))
        elif kind == 3:
            whole, other = box(0, y, a, b) + box(a, y + b, w - a, b), box(a, y, w - a, b) + box(0, y + b, a, b)
        elif kind == 4:
            third = max(1, w // 3)
            whole, other = box(third, y, third, h), (box(0, y, third, h) + box(2 * third, y, w - 2 * third, h)) / 2
        else:
            other = (box(0, (y + 3) % 12, w, h) + box(0, (y + 9) % 12, w, h)) / 2
        # log1p(whole) - log1p(other) against the cuts, without logarithms
        base = 1 + np.maximum(other, 0)
        level = sum((1 + whole > base * np.exp(cut)).view(np.uint8) for cut in CUTS)
        out = (out << np.uint32(2)) | GRAY[level]
    return out


def samples(pcm) -> np.ndarray:
    return np.nan_to_num(np.asarray(pcm, np.float32), nan=0.0, posinf=0.0, neginf=0.0)


def fingerprint(pcm: np.ndarray) -> np.ndarray:
    """Packed integers of one recording."""
    return _codes(samples(pcm)[None])[0]


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, float]:
    """(offset of b in a, integers that agree there, bit error over the overlap); error 1 without any."""
    order = np.argsort(a, kind="stable")
    low, high = np.searchsorted(a[order], b, "left"), np.searchsorted(a[order], b, "right")
    counts = high - low
    if not counts.sum():
        return 0, 0, 1.0
    place = np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    off = order[place] - np.repeat(np.arange(len(b)), counts)
    votes = np.bincount(off + len(b))
    best = int(votes.argmax()) - len(b)
    i, j = max(best, 0), max(-best, 0)
    n = min(len(a) - i, len(b) - j)
    errors = int(np.bitwise_count(a[i : i + n] ^ b[j : j + n]).sum())
    return best, int(votes.max()), errors / (32 * n)


def melody(vector) -> np.ndarray:
    """A recording made of a vector: a tone for each number, its pitch by the number's size. The test tables hold no audio."""
    if vector is None or not len(vector):
        return np.zeros(0)
    v = np.nan_to_num(np.array([0.0 if x is None else x for x in vector], float), nan=0.0, posinf=0.0, neginf=0.0)
    scale = np.sqrt((v * v).mean()) or 1.0
    freq = 440 * 2 ** (np.clip(np.round(12 * v / scale), -24, 24) / 12)
    t = np.arange(256, dtype=np.float32) / np.float32(RATE)
    return np.sin((2 * np.pi * freq).astype(np.float32)[:, None] * t[None]).ravel()


def fingerprints(df: DataFrame, key: str, column: str, decode=None) -> DataFrame:
    """(id, codes): codes as little-endian integers; decode turns a cell into samples."""

    def run(batches):
        for batch in batches:
            cells = batch.column(1)
            for i in range(0, len(cells), 32):
                pcm = [samples(decode(c) if decode else np.zeros(0) if c is None else c) for c in cells.slice(i, 32).to_pylist()]
                got: list = [b""] * len(pcm)
                for size in {len(x) for x in pcm}:
                    mine = [k for k, x in enumerate(pcm) if len(x) == size]
                    for k, codes in zip(mine, _codes(np.stack([pcm[k] for k in mine])).astype("<u4"), strict=True):
                        got[k] = codes.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(got)), pa.array(got, pa.binary())], ["id", "codes"])

    return df.select(F.col(key).cast("long").alias("id"), column).mapInArrow(run, "id long, codes binary")


class Block:
    """Query recordings (id, codes), no two with equal codes, to be aligned with others."""

    def __init__(self, ids: list[int], codes: list[np.ndarray]):
        self.ids, self.flat = np.array(ids, np.int64), np.concatenate([*codes, np.zeros(0, np.uint32)])
        self.sizes = np.array([len(c) for c in codes], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        order = np.argsort(self.flat, kind="stable")
        self.own = np.repeat(np.arange(len(codes)), self.sizes)[order]
        self.at = (np.arange(len(self.flat)) - np.repeat(self.begins, self.sizes))[order]
        self.kinds, self.heads, self.many = np.unique(self.flat[order], return_index=True, return_counts=True)

    def _votes(self, row: np.ndarray, place: np.ndarray, head: np.ndarray, many: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Equal integers counted by (row, query, offset), packed into one number; some hits at a time."""
        width = size + int(self.sizes.max(initial=0)) + 1
        keys, votes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        stops, i = np.cumsum(many), 0
        while i < len(many):
            j = max(i + 1, int(np.searchsorted(stops, (stops[i - 1] if i else 0) + HITS, "right")))
            hit = spots(head[i:j], many[i:j])
            key = (np.repeat(row[i:j] * len(self.ids), many[i:j]) + self.own[hit]) * width + self.at[hit] - np.repeat(place[i:j], many[i:j]) + size
            key.sort()
            heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            key, n = key[heads], np.diff(np.append(heads, len(key)))
            if len(keys):
                key, back = np.unique(np.concatenate([keys, key]), return_inverse=True)
                n = np.bincount(back, np.concatenate([votes, n])).astype(np.int64)
            keys, votes, i = key, n, j
        return keys, votes

    def align(self, rows: list[np.ndarray], most: float) -> tuple[np.ndarray, ...]:
        """(row, query, offset, votes, bit error) of each recording with each query that it matches, both by number."""
        sizes = np.array([len(c) for c in rows], np.int64)
        flat = np.concatenate([*rows, np.zeros(0, np.uint32)])
        begins, out = np.cumsum(sizes) - sizes, []
        if len(flat) and len(self.kinds):
            found = np.minimum(np.searchsorted(self.kinds, flat), len(self.kinds) - 1)
            hit = np.flatnonzero(self.kinds[found] == flat)
            row = np.repeat(np.arange(len(rows)), sizes)[hit]
            place, head, many = hit - begins[row], self.heads[found[hit]], self.many[found[hit]]
            total = np.concatenate([[0], np.cumsum(np.bincount(row, many, len(rows)))])
            ends = np.searchsorted(row, np.arange(len(rows) + 1))
            i = 0
            while i < len(rows):
                j = max(i + 1, int(np.searchsorted(total, total[i] + HITS, "right")) - 1)
                part = slice(ends[i], ends[j])
                if ends[j] > ends[i]:
                    out.append(self._best(self._votes(row[part], place[part], head[part], many[part], int(sizes.max())), int(sizes.max()), flat, begins, sizes, most))
                i = j
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, float))

    def _best(self, counted: tuple, size: int, flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray, most: float) -> tuple[np.ndarray, ...]:
        """Of each row and query the offset with most votes, the least of equals, where the bit error is small enough."""
        keys, votes = counted
        pair, offset = np.divmod(keys, size + int(self.sizes.max()) + 1)
        offset -= size
        heads = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        top = np.repeat(np.maximum.reduceat(votes, heads), np.diff(np.append(heads, len(pair))))
        best = np.flatnonzero(votes == top)
        best = best[np.concatenate([[True], pair[best][1:] != pair[best][:-1]])]
        (row, query), offset, votes = np.divmod(pair[best], len(self.ids)), offset[best], votes[best]
        i, j = np.maximum(offset, 0), np.maximum(-offset, 0)
        n = np.minimum(self.sizes[query] - i, sizes[row] - j)
        live = np.flatnonzero(n >= WINDOW)
        errors = np.zeros(len(n), np.int64)
        a, b, limit = self.begins[query] + i, begins[row] + j, most * 32 * n
        for k in range(STRIDE):
            for c in range(0, len(live), HITS // STRIDE):
                own = live[c : c + HITS // STRIDE]
                lens = (n[own] - k + STRIDE - 1) // STRIDE
                step = spots(np.zeros(len(own), np.int64), lens) * STRIDE + k
                bits = np.bitwise_count(self.flat[np.repeat(a[own], lens) + step] ^ flat[np.repeat(b[own], lens) + step])
                errors[own] += np.add.reduceat(bits, np.cumsum(lens) - lens, dtype=np.int64)
            live = live[errors[live] <= limit[live]]
        return row[live], query[live], offset[live], votes[live], errors[live] / (32 * n[live])


_MATCHES = "array<struct<query_id:bigint,offset:int,votes:int,bit_error:double>>"
_KIND = pa.list_(pa.struct([("query_id", pa.int64()), ("offset", pa.int32()), ("votes", pa.int32()), ("bit_error", pa.float64())]))


def matched(state: DataFrame, block: Block, most: float) -> DataFrame:
    """Rows (id, codes, query_class, matches) with the block's matches added, and the class of those that are its queries."""
    exact = {x.tobytes(): int(i) for i, x in zip(block.ids, np.split(block.flat, block.begins[1:]), strict=True)} if len(block.ids) else {}

    def run(batches):
        for batch in batches:
            ids, raw, before = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()
            kinds: dict[bytes, int] = {}
            of = [kinds.setdefault(x, len(kinds)) for x in raw]  # equal recordings are aligned once
            row, query, offset, votes, error = block.align([np.frombuffer(x, "<u4") for x in kinds], most)
            order = np.lexsort((block.ids[query], row))
            cuts = np.searchsorted(row[order], np.arange(len(kinds) + 1))
            lists = [list(x) for x in zip(block.ids[query][order].tolist(), offset[order].tolist(), votes[order].tolist(), error[order].tolist(), strict=True)]
            names, out, own = ("query_id", "offset", "votes", "bit_error"), [], []
            for node, cell, k, old, was in zip(ids, raw, of, before, batch.column(2).to_pylist(), strict=True):
                out.append(old + [dict(zip(names, x, strict=True)) for x in lists[cuts[k] : cuts[k + 1]] if x[0] != node])
                own.append(was if was is not None or not cell or node is None else exact.get(cell))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.int64()), pa.array(out, _KIND)], ["id", "codes", "query_class", "matches"])

    return state.mapInArrow(run, f"id long, codes binary, query_class long, matches {_MATCHES}")


def report(df: DataFrame, key: str, column: str, decode=None, step: int = 50, most: float = 0.1) -> DataFrame:
    """Per recording: its id, number of integers, their sha256, its class among the queries, and the query recordings (ids divisible by step) that match it, with offset and bit error."""
    spark = df.sparkSession
    asked = fingerprints(df.filter(F.col(key).cast("long") % step == 0), key, column, decode).filter(F.length("codes") > 0)
    asked, asked_path = saved(asked.groupBy("codes").agg(F.min("id").alias("id")), "queries")
    total = (asked.agg(F.sum(F.length("codes"))).first()[0] or 0) // 4
    blocks = -(-2 * total // BLOCK)  # half full on average
    state = fingerprints(df, key, column, decode).select("id", "codes", F.lit(None).cast("long").alias("query_class"), F.array().cast(_MATCHES).alias("matches"))
    path = None
    for k in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).orderBy("id").collect()
        new = matched(state, Block([r.id for r in rows], [np.frombuffer(r.codes, "<u4") for r in rows]), most)
        if k + 1 < blocks:
            new, new_path = saved(new, "matched")
            drop(spark, *([path] if path else []))
            path = new_path
        state = new
    drop(spark, asked_path)
    own = F.when(F.col("id") % step == 0, F.col("query_class"))
    return state.select(F.col("id").alias(key), (F.length("codes") / 4).cast("long").alias("n_codes"), F.sha2("codes", 256).alias("codes_sha256"), own.alias("query_class"), F.array_sort("matches").alias("matches"))


def digest(codes: np.ndarray) -> str:
    return hashlib.sha256(codes.astype("<u4").tobytes()).hexdigest()
