"""Removal of repeated byte strings by externally sorted suffixes.

A string of ``length`` bytes that starts at two places repeats. Each such window is owned by
its least ``GRAM``-byte gram (the first of equals), so equal windows lie alike around equal grams
and every repeat is found inside a group of equal grams. Of a group's stretches (all windows that
one gram owns), equal ones repeat outright; where stretches differ, which hold the ends of passages,
one of each kind goes on. Those are dealt out by their gram, windows are classed by where the gram lies in
them, and a class goes on if another stretch of the gram has the bytes that all its windows hold. Each shard's suffixes are put in order by
external induced sorting with common prefixes (``suffixes``): a window repeats if it shares
``length`` bytes with a neighbour among the windows. A gram with over SPLIT kinds of stretches is split:
its windows are dealt out by class and by those bytes.

Rows: null text is empty; texts shorter than the length lose nothing, and texts of any length are
read whole; a repeated row of at least that length is removed whole, as are its copies, whichever came first; an empty
table gives no rows; other columns pass through, but for those named as the outputs, which are replaced;
``__t1``, ``__t2`` and ``__spans`` are the operator's own names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import suffixes
from .common import SPACE, Ranges, drop, mix, parts, saved, spots, text_blocks, utf8, windows, words

GRAM = 160  # bytes of an anchor; shorter than the windows
BLOCK = 1 << 20  # bytes of text whose anchors are sought at once
SHARD_BYTES = 2 << 20  # stretches of whole groups that are sorted at once; a larger group is sorted alone
SALTS = 256  # shares that a common stretch is counted in
SPLIT = 4096  # kinds of stretches of one gram that go to one shard
_KEYS = ["__t1", "__t2"]


def _keyed(df: DataFrame, text: str) -> DataFrame:
    plain = F.coalesce(F.col(text), F.lit(""))
    return df.withColumns({"__t1": F.xxhash64(plain), "__t2": F.xxhash64(F.lit(7), plain)})


def owners(data: np.ndarray, offs: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Row, gram hash, place of the gram, first window and number of windows of each anchor of a block."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    sizes = np.diff(offs) - length + 1
    has = np.flatnonzero(sizes > 0)
    if not len(has):
        return none
    n, width = len(data) - gram + 1, length - gram + 1
    at = np.arange(n)
    hashes = windows(data, gram)
    key = (hashes & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    full = np.full(-(-n // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    full[:n] = key
    full = full.reshape(-1, width)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    counts = sizes[has]
    window = np.repeat(offs[has] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    anchor = (np.minimum(behind[window], ahead[window + width - 1]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    many = np.diff(np.append(first, len(anchor)))
    return np.searchsorted(offs, window[first], "right") - 1, hashes[anchor[first]], anchor[first], window[first], many


def _anchors(df: DataFrame, text: str, length: int, gram: int) -> DataFrame:
    """(t1, t2, h, s, salt, lo, n, g): of each text the stretches, by the hashes of their gram and of their bytes, with the gram's place in them; salts go round by rows."""

    def run(batches):
        done = TaskContext.get().partitionId() * 31
        for batch, data, offs in text_blocks(batches, text, BLOCK):
            row, h, g, lo, n = owners(data, offs, length, gram)
            salt, done = (done + row) % SALTS, done + len(offs) - 1
            if not len(row):
                continue
            s = Ranges(data).of(lo, lo + n - 1 + length)
            t1, t2 = (batch.column(batch.schema.get_field_index(k)).to_numpy()[row] for k in _KEYS)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (t1, t2, h.view(np.int64), s.view(np.int64), salt.astype(np.int32), (lo - offs[row]).astype(np.int32), n.astype(np.int32), (g - lo).astype(np.int32))], [*_KEYS, "h", "s", "salt", "lo", "n", "g"])

    return df.select(text, *_KEYS).mapInArrow(run, "__t1 long, __t2 long, h long, s long, salt int, lo int, n int, g int")


class Stretches:
    """Stretches of one shard: their bytes and where they come from, on disk beyond the space's bound."""

    def __init__(self, length: int, space: suffixes.Space):
        self.length, self.space = length, space
        self.text, self.sizes = suffixes.Rows(space, np.uint16), suffixes.Rows(space, np.int64)
        self.own = [suffixes.Rows(space, np.int64) for _ in range(3)]  # t1, t2, lo

    def add(self, t1, t2, lo, data: np.ndarray, offs: np.ndarray) -> None:
        sizes = np.diff(offs)
        text = np.ones(len(data) + len(sizes), np.uint16)  # 1 ends a stretch, bytes are from 2 on
        text[np.arange(len(data)) + np.repeat(np.arange(len(sizes)), sizes)] = data.astype(np.uint16) + 2
        self.text.add(text)
        self.sizes.add(sizes)
        for rows, x in zip(self.own, (t1, t2, lo), strict=True):
            rows.add(x)

    def repeated(self):
        """Runs (t1, t2, lo, n) of windows that equal another window's bytes, some stretches at a time."""
        self.text.add(np.zeros(1, np.uint16))
        text, sizes, own = self.text.whole(), self.sizes.whole(), [x.whole() for x in self.own]
        space, length = self.space, self.length
        hit = space.array(len(text), bool)  # places of windows, then of those that repeat
        begin, stops = 0, [0]
        for a, b in space.steps(len(sizes)):
            ends = begin + np.cumsum(sizes[a:b] + 1)
            depth = np.zeros(int(ends[-1]) - begin + 1, np.int8)
            depth[np.append(0, ends[:-1] - begin)] += 1
            depth[ends - length - begin] -= 1
            hit[begin : int(ends[-1])] = np.cumsum(depth[:-1], dtype=np.int8) > 0
            begin = int(ends[-1])
            stops.append(begin)
        hit[begin:] = False
        place, prefix = suffixes.sort(text, length, space)
        # A window repeats if the least prefix on the way to the window before, or after, reaches the length.
        twice, last, low = space.array(len(text), bool), None, 0
        for a, b in space.steps(len(text)):
            twice[a:b] = False
        for a, b in space.steps(len(place)):
            here, near = np.array(place[a:b], np.int64), np.array(prefix[a:b], np.int64)
            at = np.flatnonzero(hit[here])
            if not len(at):
                low = min(low, int(near.min()))
                continue
            between = np.minimum.reduceat(near[: at[-1] + 1], np.append(0, at[:-1] + 1))
            between[0] = min(low, between[0]) if last is not None else 0
            good = between >= length
            twice[here[at[good]]] = True
            if good[0]:
                twice[last] = True
            twice[here[at[np.flatnonzero(good[1:])]]] = True
            last, low = int(here[at[-1]]), int(near[at[-1] + 1 :].min()) if at[-1] + 1 < len(near) else length
        for k, (a, b) in enumerate(space.steps(len(sizes))):
            good = np.array(twice[stops[k] : stops[k + 1]])
            begins = np.cumsum(sizes[a:b] + 1) - sizes[a:b] - 1
            edge = np.diff(np.concatenate([[0], good.astype(np.int8), [0]]))
            first, count = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0) - np.flatnonzero(edge > 0)
            row = np.searchsorted(begins, first, "right") - 1
            t1, t2, lo = (np.array(x[a:b])[row] for x in own)
            yield t1, t2, lo + first - begins[row], count


def _classed(data: np.ndarray, offs: np.ndarray, h: np.ndarray, g: np.ndarray, n: np.ndarray, length: int, gram: int):
    """Parts of stretches by where the gram lies in their windows: (stretch, new key, first window, windows)."""
    step = (length - gram) // 6 + 1
    ranges, out = Ranges(data), []
    for j in range(-(-(length - gram + 1) // step)):
        first, last = np.maximum(g - step * (j + 1) + 1, 0), np.minimum(g - step * j, n - 1)
        mine = np.flatnonzero(first <= last)
        begin = offs[mine] + g[mine] - step * j
        key = mix(ranges.of(begin, begin + length - step + 1) ^ mix(h[mine].view(np.uint64) + np.uint64(j + 1)))
        out.append((mine, key.view(np.int64), first[mine], (last - first + 1)[mine]))
    return (np.concatenate(x) for x in zip(*out, strict=True))


def _shared(batch: pa.RecordBatch, wide: int | None, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(t1, t2, h, lo, bytes, offsets) of the parts of whole groups of stretches whose windows may repeat: another stretch has the same bytes in the same class. The group ``wide`` stays as it is."""
    t1, t2, h, lo, g = (batch.column(k).to_numpy() for k in range(5))
    data, offs = utf8(batch.column(5))
    n = np.diff(offs) - length + 1
    own, key, first, many = _classed(data, offs, h, g.astype(np.int64), n, length, gram)
    _, which, counts = np.unique(key, return_inverse=True, return_counts=True)
    keep = counts[which] > 1
    if wide is not None:
        keep |= h[own] == wide
    own, first, many = own[keep], first[keep], many[keep]
    order = np.lexsort((first, own))
    own, first, many = own[order], first[order], many[order]
    # Neighbouring classes of a stretch that stay are one part.
    heads = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (first[1:] != first[:-1] + many[:-1])])[: len(own)])
    sizes = (np.add.reduceat(many, heads) if len(heads) else many) - 1 + length
    own, first = own[heads], first[heads]
    return t1[own], t2[own], h[own], lo[own] + first, data[spots(offs[own] + first, sizes)], np.concatenate([[0], np.cumsum(sizes)])


def _whole_groups(batches):
    """(rows, a group that is cut) of batches in the order of their gram: some rows at a time, in whole groups, but for one beyond SHARD_BYTES."""
    rest, wide = None, None
    for whole in batches:
        for k in range(0, whole.num_rows, 2048):
            batch = whole.slice(k, 2048)
            if rest:
                batch = pa.concat_batches([rest, batch])
            h = batch.column(2).to_numpy()
            at = int(np.searchsorted(h, h[-1]))
            if at:
                yield batch.slice(0, at), wide
            rest = batch.slice(at)
            if h[-1] == wide or rest.nbytes > SHARD_BYTES:
                wide = int(h[-1])
                yield rest, wide
                rest = None
    if rest:
        yield rest, wide


def _sorted_shards(df: DataFrame, length: int, gram: int) -> DataFrame:
    """Runs of repeated windows (t1, t2, lo, n) of stretches (t1, t2, h, lo, g, bytes) that come in the order of their gram.

    A shard is closed between grams, once it has SHARD_BYTES; a larger group is a larger shard, sorted on disk.
    """

    def run(batches):
        held, size = None, 0

        def close():
            with held.space:
                for t1, t2, lo, n in held.repeated():
                    yield pa.RecordBatch.from_arrays([pa.array(t1), pa.array(t2), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32))], ["__t1", "__t2", "lo", "n"])

        last = None
        for batch, wide in _whole_groups(batches):
            t1, t2, h, lo, data, offs = _shared(batch, wide, length, gram)
            cuts = [0, *(np.flatnonzero(h[1:] != h[:-1]) + 1).tolist(), len(h)] if len(h) else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and size > SHARD_BYTES and h[a] != last:
                    yield from close()
                    held = None
                if not held:
                    held, size = Stretches(length, suffixes.Space()), 0
                held.add(t1[a:b], t2[a:b], lo[a:b], data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                size, last = size + int(offs[b] - offs[a]), h[a]
        if held:
            yield from close()

    return df.mapInArrow(run, "__t1 long, __t2 long, lo int, n int")


def _stretches(df: DataFrame, text: str, length: int, gram: int) -> DataFrame:
    """The bytes of the stretches listed beside each text; those of a split gram in parts."""

    def run(batches):
        for batch in batches:
            data, offs = utf8(batch.column(0))
            todo = batch.column(3)
            row = np.repeat(np.arange(len(batch)), np.diff(todo.offsets.to_numpy()))
            flat = todo.flatten()
            h, lo, n, g, hot = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("h", "lo", "n", "g", "hot"))
            t1, t2 = (batch.column(k).to_numpy()[row] for k in (1, 2))
            begin, lo, n, g = offs[row] + lo, lo.astype(np.int64), n.astype(np.int64), g.astype(np.int64)
            whole, split = np.flatnonzero(~hot), np.flatnonzero(hot)
            pieces = [(whole, h[whole], np.zeros(len(whole), np.int64), n[whole])]
            for k in range(0, len(split), 4096):
                part = split[k : k + 4096]
                sizes = n[part] - 1 + length
                held = data[spots(begin[part], sizes)]
                mine, key, first, many = _classed(held, np.cumsum(sizes) - sizes, h[part], g[part], n[part], length, gram)
                pieces.append((part[mine], key, first, many))
            for own, key, first, many in pieces:
                for k in range(0, len(own), 4096):
                    o, f, m = own[k : k + 4096], first[k : k + 4096], many[k : k + 4096]
                    sizes = m - 1 + length
                    cells = pa.Array.from_buffers(pa.binary(), len(o), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[spots(begin[o] + f, sizes)]))])
                    yield pa.RecordBatch.from_arrays([pa.array(t1[o]), pa.array(t2[o]), pa.array(key[k : k + 4096]), pa.array((lo[o] + f).astype(np.int32)), pa.array((g[o] - f).astype(np.int32)), cells], [*_KEYS, "h", "lo", "g", "bytes"])

    return df.select(text, *_KEYS, "todo").mapInArrow(run, "__t1 long, __t2 long, h long, lo int, g int, bytes binary")


def _cut(df: DataFrame, text: str, length: int, out: str, as_text: bool, least_words: int) -> DataFrame:
    """Drop the covered bytes of each text, but for runs of fewer words."""
    rest = [f for f in df.schema.fields if f.name not in (*_KEYS, "__spans", out, "n_bytes", "n_removed", "n_spans")]
    names = [f.name for f in rest]

    def run(batches):
        for batch, data, offs in text_blocks(batches, text):
            spans = batch.column(batch.schema.get_field_index("__spans"))
            n = len(offs) - 1
            counts = np.array([0 if x is None else x for x in spans.value_lengths().to_pylist()], np.int64)
            flat = spans.flatten()
            begin = flat.field(0).to_numpy().astype(np.int64) + np.repeat(offs[:-1], counts)
            ends = begin + flat.field(1).to_numpy() - 1 + length
            depth = np.bincount(begin, minlength=len(data) + 1) - np.bincount(ends, minlength=len(data) + 1)
            gone = np.cumsum(depth)[: len(data)] > 0
            head = gone.copy()
            head[1:] &= ~gone[:-1]
            starts = offs[:-1][np.diff(offs) > 0]
            head[starts] = gone[starts]
            if least_words and len(data):
                first = np.flatnonzero(head)
                size = np.add.reduceat(gone.astype(np.int64), first) if len(first) else first  # a run ends where the next row's or run's bytes begin
                before = np.zeros(len(data) + 1, np.int64)
                before[words(data, offs)[0] + 1] = 1
                inside = ~SPACE[data[first]] & (before[first + 1] == 0)
                before = np.cumsum(before)
                few = before[first + size] - before[first] + inside < least_words
                gone[spots(first[few], size[few])] = False
                head[first[few]] = False
            total, heads = np.concatenate([[0], np.cumsum(gone)]), np.concatenate([[0], np.cumsum(head)])
            removed = total[offs[1:]] - total[offs[:-1]]
            kept, bounds = data[~gone], offs - total[offs]
            if as_text:
                raw = kept.tobytes()
                cell = pa.array([raw[a:b].decode("utf-8", "ignore") for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.string())
            else:
                cell = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(kept)])
            columns = [batch.column(batch.schema.get_field_index(k)) for k in names]
            yield pa.RecordBatch.from_arrays([*columns, cell, pa.array(np.diff(offs)), pa.array(removed), pa.array(heads[offs[1:]] - heads[offs[:-1]])], [*names, out, "n_bytes", "n_removed", "n_spans"])

    kind = T.StringType() if as_text else T.BinaryType()
    return df.mapInArrow(run, T.StructType([*rest, T.StructField(out, kind), *(T.StructField(k, T.LongType()) for k in ("n_bytes", "n_removed", "n_spans"))]))


def remove(df: DataFrame, text: str = "text", length: int = 400, out: str = "kept", as_text: bool = False, gram: int = GRAM, least_words: int = 0) -> DataFrame:
    """Append what is left of each text (bytes, or text without broken characters), n_bytes, n_removed and n_spans (maximal removed runs).

    With ``least_words``, runs of fewer words stay.
    """
    spark, gram = df.sparkSession, min(gram, length)
    keyed = _keyed(df, text)
    anchors, anchors_path = saved(_anchors(keyed, text, length, gram), "anchors")
    # A stretch that stands there twice repeats; it is counted in shares first, then by one row of each share, so no share grows with a common stretch alone.
    share, kind = Window.partitionBy("h", "s", "salt"), Window.partitionBy("h", "s")
    counted = anchors.withColumns({"many": F.count("*").over(share) > 1, "first": F.row_number().over(share.orderBy("__t1")) == 1}).drop("salt")
    counted, counted_path = saved(counted, "counted")
    drop(spark, anchors_path)
    classes = counted.filter("first").drop("first").withColumns({"again": (F.count("*").over(kind) > 1) | F.col("many"), "one": F.row_number().over(kind.orderBy("__t1")) == 1})
    classes, classes_path = saved(classes, "classes")
    again = counted.filter("many").select(*_KEYS, "lo", "n").unionByName(classes.filter("again and not many").select(*_KEYS, "lo", "n"))
    ones = classes.filter("one")
    kinds = ones.groupBy("h").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    mixed = ones.join(kinds, "h").select(*_KEYS, "h", "lo", "n", "g", (F.col("kinds") > SPLIT).alias("hot"))
    todo, todo_path = saved(mixed.groupBy(*_KEYS).agg(F.collect_list(F.struct("h", "lo", "n", "g", "hot")).alias("todo")), "todo")
    # One row of each text that has any to do: copies fall together before they are dealt out.
    texts = keyed.select(text, *_KEYS).groupBy(*_KEYS).agg(F.first(text).alias(text))
    stretches = _stretches(texts.join(todo, _KEYS), text, length, gram)
    ends, ends_path = saved(_sorted_shards(stretches.repartition(parts(spark), "h").sortWithinPartitions("h"), length, gram), "ends")
    spans, _ = saved(again.unionByName(ends).groupBy(*_KEYS).agg(F.collect_set(F.struct("lo", "n")).alias("__spans")), "spans")
    drop(spark, counted_path, classes_path, todo_path, ends_path)
    return _cut(keyed.join(spans, _KEYS, "left"), text, length, out, as_text, least_words)
