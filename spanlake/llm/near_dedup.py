"""Near-duplicate groups by HyperMinHash sketches, confirmed on whole shingle sets.

A document's set: distinct shingles of ``size`` words (A-Z lower-cased, words are runs of bytes
other than 0x20 and 0x09-0x0D). The leading bits of a shingle's hash pick a bucket; a bucket's
register keeps the least of the rest in compressed form, a count of leading zeros and the next
mantissa bits. An empty register borrows from the first full one in an order of its own, so that few
shingles still give bands that differ.

Equal sets form one class at once. Classes whose registers agree on a band meet, and are tried
against each other there: sets of at most SHORT shingles whole, by half hashes (few shingles fill
few registers, and the estimate strays far), others by the collision-corrected estimate, whose
floor lies MARGIN below the threshold. Those that come near are candidates; a band of over MEET
classes is all candidates. Candidates that hang together form a cluster. A cluster's texts are
brought together once, and compared on whole sets of 64-bit hashes, but for pairs that are joined
already; a large cluster is dealt into parts, each with the cluster's head, and then the few that
the parts leave outside their cluster's main component meet every part. No list of pairs is made:
what leaves a comparison are links that join the same rows as all the links found there.

A pair that no band unites would be missed, as would a pair of over SHORT shingles whose estimate
falls below the floor: simulated at the threshold, none of 40,000 pairs with a union of 257, of
8,000 with 300 to 800.

Rows: null, empty or blank text has an empty set and links with nothing; fewer words than
``size`` are one shingle of all; a null id links with nothing, is in no component and is kept;
rows of equal id are one node; texts of any length are one set; an empty table gives no rows;
other columns don't pass through, so their names are no matter. Of ties the least id stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Ranges, drop, grouped, lower, mix, parts, saved, spots, text_blocks, utf8, words
from .components import components

BUCKETS, MANTISSA, BAND = 128, 11, 4
BLOCK = 1 << 20  # bytes of text whose shingles are hashed at once
CROWD = 256  # classes of one band in one batch
BROADCAST = 1 << 20  # ids that are broadcast at most
SHORT = 256  # shingles of sets that are compared whole, without the estimate
MARGIN = 0.15  # below the threshold, in the estimate of pairs with a longer set
MEET = 2048  # classes of a band that are tried against each other
PART, WEIGHT = 1024, 1 << 20  # texts, and shingles, of a cluster that are compared at once
_U = np.uint64
# Which register an empty one borrows from, by turns: every one has an order of its own, so neighbours borrow from different ones.
_PROBES = np.stack([np.random.Generator(np.random.PCG64(k)).permutation(BUCKETS) for k in range(BUCKETS)], axis=1)
_K = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9))


def shingles(data: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each row's distinct shingles, in ascending order."""
    data = lower(data)
    starts, ends, row = words(data, offs)
    if not len(row):
        return row, np.zeros(0, np.uint64)
    h = Ranges(data).of(starts, ends)
    counts = np.bincount(row, minlength=len(offs) - 1)
    first = np.cumsum(counts) - counts
    place = np.arange(len(row)) - first[row]
    left = counts[row] - place
    head = np.flatnonzero((left >= size) | (place == 0))
    out = np.zeros(len(head), np.uint64)
    for k in range(size):
        good = left[head] > k
        out[good] = mix(out[good] * _K[0] + h[head[good] + k] + _K[1])
    row = row[head]
    order = np.lexsort((out, row))
    row, out = row[order], out[order]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (out[1:] != out[:-1])])
    return row[new], out[new]


def registers(row: np.ndarray, sets: np.ndarray, n: int) -> np.ndarray:
    """HyperMinHash registers of each row; 0 throughout for an empty set."""
    shift = 64 - int(BUCKETS).bit_length() + 1
    bucket = (sets >> _U(shift)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (bucket[1:] != bucket[:-1])])) if len(row) else np.zeros(0, np.int64)
    rest = np.maximum(sets[first] << _U(64 - shift), _U(1))
    zeros = 63 - (np.frexp((rest >> _U(11)).astype(np.float64))[1] + 10)
    zeros = np.clip(zeros, 0, 30)
    mantissa = (rest << (zeros + 1).astype(np.uint64)) >> _U(64 - MANTISSA)
    out = np.zeros((n, BUCKETS), np.uint16)
    out[row[first], bucket[first]] = (zeros.astype(np.uint64) << _U(MANTISSA) | mantissa).astype(np.uint16) + 1
    some = np.flatnonzero((out == 0).any(axis=1) & out.any(axis=1))
    at, own = np.nonzero(out[some] == 0)
    full, at = out[some], some[at]
    back = np.zeros(n, np.int64)
    back[some] = np.arange(len(some))
    for probe in _PROBES:
        if not len(at):
            break
        got = full[back[at], probe[own]]
        good = got != 0
        out[at[good], own[good]] = got[good]
        at, own = at[~good], own[~good]
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each row."""
    packed = np.ascontiguousarray(regs).view(np.uint64).reshape(len(regs), BUCKETS // BAND)
    return mix(packed ^ mix(np.arange(1, BUCKETS // BAND + 1, dtype=np.uint64) * _K[2]))


_CHANCE: dict[tuple[int, int], float] = {}


def chance(a: int, b: int) -> float:
    """Probability that registers of unlike sets of 2^a and 2^b shingles collide: both least values in one cell."""
    if (a, b) not in _CHANCE:
        low = np.concatenate([2.0 ** -(z + 1) * (1 + np.arange(1 << MANTISSA) / (1 << MANTISSA)) for z in range(31)])
        width = np.concatenate([np.full(1 << MANTISSA, 2.0 ** -(z + 1 + MANTISSA)) for z in range(31)])
        cell = [np.exp(n * np.log1p(-low)) - np.exp(n * np.log1p(-np.minimum(low + width, 1 - 1e-16))) for n in (max(1.0, 2.0**a / BUCKETS), max(1.0, 2.0**b / BUCKETS))]
        _CHANCE[a, b] = float((cell[0] * cell[1]).sum())
    return _CHANCE[a, b]


def estimate(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates of all rows of x against all rows of y."""
    same = np.zeros((len(x), len(y)), np.float32)
    for k in range(BUCKETS):
        same += x[:, k, None] == y[None, :, k]
    ax, ay = (np.round(np.log2(np.maximum(v, 1))).astype(int) for v in (nx, ny))
    lost = np.array([[chance(a, b) for b in range(ay.max() + 1)] for a in range(ax.max() + 1)])[ax[:, None], ay[None, :]]
    return (same / BUCKETS - lost) / (1 - lost)


def sketches(df: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """(id, n_shingles, s1, s2, regs, short): s1 and s2 tell whether sets are equal; short holds half of each hash of a set of at most SHORT shingles."""

    def run(batches):
        for batch, data, offs in text_blocks(batches, text, BLOCK):
            n = len(offs) - 1
            row, sets = shingles(data, offs, size)
            count = np.bincount(row, minlength=n)
            ends = np.cumsum(count)
            sums = [np.concatenate([[0], np.cumsum(mix(sets ^ k))]).astype(np.uint64) for k in _K[:2]]
            marks = [(s[ends] - s[ends - count]).view(np.int64) for s in sums]
            raw = registers(row, sets, n).tobytes()
            w = 2 * BUCKETS
            half = sets.astype(np.uint32).tobytes()
            short = [half[4 * (b - c) : 4 * b] if 0 < c <= SHORT else None for b, c in zip(ends.tolist(), count.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count.astype(np.int64)), pa.array(marks[0]), pa.array(marks[1]), pa.array([raw[w * k : w * k + w] for k in range(n)], pa.binary()), pa.array(short, pa.binary())],
                ["id", "n_shingles", "s1", "s2", "regs", "short"],
            )

    return df.select(F.col(key).cast("long").alias("id"), text).mapInArrow(run, "id long, n_shingles long, s1 long, s2 long, regs binary, short binary")


def _bands(reps: DataFrame) -> DataFrame:
    """(band, id, long, v): a row for each band of each class. Of a band that CROWD classes of one batch share, the batch sends one, and links (id, v) to the others."""

    def run(batches):
        for batch in batches:
            ids, long = batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            keys = band_keys(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, BUCKETS))
            own = np.repeat(np.arange(len(ids)), keys.shape[1])
            kinds, at, many = np.unique(keys.ravel(), return_inverse=True, return_counts=True)
            sent = many[at] < CROWD
            for k in np.flatnonzero(many >= CROWD).tolist():
                rows = own[at == k]
                head = rows[np.argmin(ids[rows])]
                sent[np.flatnonzero((at == k) & (own == head))] = True
                yield pa.RecordBatch.from_arrays([pa.nulls(len(rows), pa.int64()), pa.array(np.full(len(rows), ids[head])), pa.nulls(len(rows), pa.bool_()), pa.array(ids[rows])], ["band", "id", "long", "v"])
            yield pa.RecordBatch.from_arrays([pa.array(kinds[at[sent]].view(np.int64)), pa.array(ids[own[sent]]), pa.array(long[own[sent]]), pa.nulls(int(sent.sum()), pa.int64())], ["band", "id", "long", "v"])

    return reps.select("id", "regs", F.col("short").isNull().alias("long")).mapInArrow(run, "band long, id long, long boolean, v long")


def _met(bands: DataFrame) -> DataFrame:
    """Of bands with several classes, rows (band, id, long, v) for up to MEET classes, long if one of them is; of larger ones links (id, v) of the least class and the others."""

    def run(batches):
        held: list[tuple] = []  # of the band that comes in: its rows while they are few, then its least class
        last, size = None, 0

        def few(long: bool):
            ids = np.concatenate([x[0] for x in held])
            n = len(ids)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, last)), pa.array(ids), pa.array(np.full(n, long)), pa.nulls(n, pa.int64())], ["band", "id", "long", "v"])

        def many(ids: np.ndarray):
            n = len(ids)
            return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(np.full(n, held[0][0][0])), pa.nulls(n, pa.bool_()), pa.array(ids)], ["band", "id", "long", "v"])

        for batch in batches:
            band, ids, long = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(band[1:] != band[:-1]) + 1).tolist(), len(band)]
            alone = np.flatnonzero(np.diff(cuts) == 1)
            skip = set(alone[(alone > 0) & (alone < len(cuts) - 2)].tolist())  # whole bands of one class
            for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if a == b:
                    continue
                if band[a] != last:
                    if 1 < size <= MEET:
                        yield few(any(x[1].any() for x in held))
                    last, held, size = band[a], [], 0
                    if k in skip:
                        continue
                size += b - a
                if size <= MEET:
                    held.append((ids[a:b], long[a:b]))
                else:
                    for before, _ in held[1:]:
                        yield many(before)
                    held[1:] = []
                    if not held:
                        held = [(ids[a : a + 1], long[a : a + 1])]
                    yield many(ids[a:b])
                    if len(held[0][0]) > 1:
                        yield many(held[0][0])
                        held[0] = (held[0][0][:1], held[0][1][:1])
        if 1 < size <= MEET:
            yield few(any(x[1].any() for x in held))

    dealt = bands.repartition(parts(bands.sparkSession), "band").sortWithinPartitions("band", "id")
    return dealt.select("band", "id", "long").mapInArrow(run, "band long, id long, long boolean, v long")


class Sets:
    """Sets of hashes, and the sizes of their intersections."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        self.sizes, self.begins = sizes, np.cumsum(sizes) - sizes
        kinds, self.codes = np.unique(flat, return_inverse=True)
        self.mark = np.zeros(len(kinds), bool)

    def both(self, one: int, others: np.ndarray) -> np.ndarray:
        own = self.codes[self.begins[one] : self.begins[one] + self.sizes[one]]
        self.mark[own] = True
        lens = self.sizes[others]
        hits = self.mark[self.codes[spots(self.begins[others], lens)]]
        self.mark[own] = False
        return np.add.reduceat(hits, np.cumsum(lens) - lens, dtype=np.int64)


def unite(counts: np.ndarray, labels: np.ndarray, alike, least: int, of: int, sides: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that join whatever all pairs that are ``alike`` (one row, others) join.

    Rows of one label are joined already and aren't tried; nor are sets too unlike in size, nor, with sides, rows of one side.
    """
    order = np.argsort(counts, kind="stable")
    size, label = counts[order], np.unique(labels[order], return_inverse=True)[1]
    stops = np.searchsorted(size, size * of // least, "right")
    us, vs = [], []
    for k in range(len(order)):
        far = label[k + 1 : stops[k]] != label[k]
        if sides is not None:
            far &= sides[order[k + 1 : stops[k]]] != sides[order[k]]
        y = np.flatnonzero(far) + k + 1
        if len(y):
            y = y[alike(order[k], order[y])]
        if len(y):
            new, first = np.unique(label[y], return_index=True)
            us.append(np.full(len(new), order[k]))
            vs.append(order[y[first]])
            label[np.isin(label, new)] = label[k]
    none = np.zeros(0, np.int64)
    return (np.concatenate(us), np.concatenate(vs)) if us else (none, none)


def _links(ids: np.ndarray, u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[u], ids[v])), pa.array(np.maximum(ids[u], ids[v]))], ["u", "v"])


def _candidates(members: DataFrame, least: int, of: int) -> DataFrame:
    """Links between the classes of each band (band, id, n_shingles, regs or null, short or null) that come near the threshold."""

    def run(batches):
        for rows in grouped(batches, 1):
            ids, counts = rows["id"].to_numpy(), rows["n_shingles"].to_numpy()
            raw = rows["short"].to_pylist()
            short = Sets(np.frombuffer(b"".join(x or b"" for x in raw), np.uint32), np.array([len(x or b"") // 4 for x in raw]))
            whole = short.sizes > 0
            regs = np.zeros((len(ids), 0), np.uint16) if whole.all() else np.frombuffer(b"".join(rows["regs"].to_pylist()), np.uint16).reshape(-1, BUCKETS)

            def alike(k, y):
                good = np.zeros(len(y), bool)
                by_set = whole[y] & whole[k]
                if by_set.any():
                    z = y[by_set]
                    both = short.both(k, z)
                    good[by_set] = of * both >= least * (counts[k] + counts[z] - both)
                if not by_set.all():
                    z = y[~by_set]
                    good[~by_set] = estimate(regs[k : k + 1], regs[z], counts[k : k + 1], counts[z])[0] >= least / of - MARGIN
                return good

            u, v = unite(counts, ids, alike, least, of)
            if len(u):
                yield _links(ids, u, v)

    return members.repartition(parts(members.sparkSession), "band").sortWithinPartitions("band").mapInArrow(run, "u long, v long")


def _verified(dealt: DataFrame, size: int, least: int, of: int) -> DataFrame:
    """Links, on whole sets, within the rows (cluster, part, seat, id, label, side, text) of each block; side is null where all rows meet."""

    def run(batches):
        for rows in grouped(batches, 3):
            data, offs = utf8(rows["text"])
            row, sets = shingles(data, offs, size)
            counts = np.bincount(row, minlength=len(offs) - 1)
            whole, ids = Sets(sets, counts), rows["id"].to_numpy()

            def alike(k, y):
                if not counts[k]:
                    return np.zeros(len(y), bool)
                both = whole.both(k, y)
                return of * both >= least * (counts[k] + counts[y] - both)

            sides = None if rows["side"].null_count else rows["side"].to_numpy()
            u, v = unite(counts, rows["label"].to_numpy(), alike, least, of, sides)
            if len(u):
                yield _links(ids, u, v)

    block = ["cluster", "part", "seat"]
    dealt = dealt.select(*block, "id", "label", "side", "text")
    return dealt.repartition(parts(dealt.sparkSession), *block).sortWithinPartitions(*block).mapInArrow(run, "u long, v long")


def _clusters(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, cluster, parts): classes with a candidate, dealt into parts by their number and their shingles."""
    nodes = components(edges).select(F.col("node").alias("id"), F.col("component").alias("cluster"))
    sized = nodes.join(classes.groupBy("id").agg(F.sum("n_shingles").alias("n")), "id")
    full = F.greatest(F.ceil(F.count("*") / PART), F.ceil(F.sum("n") / WEIGHT)).cast("int")
    return sized.join(sized.groupBy("cluster").agg(full.alias("parts")), "cluster").select("id", "cluster", "parts")


def _linked(texts: DataFrame, nodes: DataFrame, size: int, least: int, of: int) -> DataFrame:
    """Links that join the texts (id, text) of each cluster as all their links do."""
    spark = texts.sparkSession
    few = nodes.count() <= BROADCAST  # rows of two ids and a few numbers each; else texts are dealt by id
    none, every = F.lit(None).cast("int"), lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = lambda n, seed=0: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n)).cast("int")
    # A row that is listed again and again under one id and text is compared once.
    once = lambda rows: texts.join(F.broadcast(rows) if few else rows, "id").groupBy(*rows.columns, F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"))
    at = F.when(F.col("id") == F.col("cluster"), every("parts")).otherwise(F.array(own("parts")))
    first = once(nodes).withColumn("part", F.explode(at)).withColumns({"seat": F.lit(0), "label": F.col("id"), "side": none})
    links, first_path = saved(_verified(first, size, least, of), "links")
    large = nodes.filter("parts > 1")
    if not large.limit(1).count():
        return links
    # Those outside their cluster's main component meet every part of it.
    found, path = saved(components(links), "parts")
    known = large.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
    main = known.groupBy("cluster", "label").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    known = known.join(main, "cluster").withColumn("left", F.col("label") != F.col("main")).drop("main")
    seats = known.filter("left").groupBy("cluster").agg(F.ceil(F.count("*") / PART).cast("int").alias("seats"))
    known, known_path = saved(known.join(seats, "cluster"), "known")
    if known.limit(1).count():
        full = once(known)
        here = full.withColumns({"part": own("parts"), "side": F.lit(0)}).withColumn("seat", F.explode(every("seats")))
        there = full.filter("left").withColumns({"seat": own("seats", 1), "side": F.lit(1)}).withColumn("part", F.explode(every("parts")))
        more, _ = saved(_verified(here.unionByName(there), size, least, of), "links")
        links = links.unionByName(more)
    drop(spark, path, known_path)
    return links


def groups(df: DataFrame, size: int = 5, least: int = 80, of: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the id, n_shingles, component_id (least id reachable by links) and kept (id = component_id)."""
    spark = df.sparkSession
    made, _ = saved(sketches(df, size, key, text), "sketches")
    full = made.filter("n_shingles > 0 and id is not null")
    classes, classes_path = saved(full.groupBy("s1", "s2", "n_shingles").agg(F.min("id").alias("id"), F.first("regs").alias("regs"), F.first("short").alias("short")), "classes")
    bands, bands_path = saved(_bands(classes), "bands")
    met, met_path = saved(_met(bands.filter("v is null")).unionByName(bands.filter("v is not null")), "met")
    drop(spark, bands_path)
    hot = met.filter("v is not null and id != v").select(F.col("id").alias("u"), "v")
    near = met.filter("v is null").drop("v")
    wanted = near.select("id").distinct()
    few = wanted.count() <= BROADCAST  # ids of eight bytes each
    sketch = classes.select("id", "n_shingles", "regs", "short").join(F.broadcast(wanted) if few else wanted, "id", "left_semi")
    regs = F.when(F.col("long"), F.col("regs")).alias("regs")  # the estimate is for bands with a long set
    members = near.join(sketch, "id").select("band", "id", "n_shingles", regs, "short")
    edges, edges_path = saved(hot.unionByName(_candidates(members, least, of)).distinct(), "edges")
    nodes, nodes_path = saved(_clusters(edges, classes), "nodes")
    drop(spark, met_path, edges_path)
    texts = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).filter("id is not null")
    last, _ = saved(components(_linked(texts, nodes, size, least, of)), "parts")
    of_class, _ = saved(classes.select("s1", "s2", "n_shingles", F.col("id").alias("rep")).join(last.withColumnRenamed("node", "rep"), "rep", "left").select("s1", "s2", "n_shingles", F.coalesce("component", "rep").alias("of_class")), "of_class")
    drop(spark, nodes_path, classes_path)
    out = made.drop("regs", "short").join(of_class, ["s1", "s2", "n_shingles"], "left")
    component = F.when(F.col("id").isNull(), None).when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("of_class"))
    return out.select(F.col("id").alias(key), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
