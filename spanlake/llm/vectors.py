"""Near-duplicate vectors by an inverted multi-index.

Codebooks of the halves of unit vectors, fitted on a bounded sample, form a grid of cells, finer the
more vectors there are. Every vector is listed in its nearest cell and, as a query, visits cells by
multi-sequence traversal, nearest sum of half distances first, until the sum exceeds the nearest
one's by a gap. A pair is met if either of the two visits the other's cell; the gap is the least that
meets a share of TARGET of neighbours made by noise at the threshold, and of the linked pairs
that the sample holds. Cells of one row of the grid lie together, so that a vector
travels once for each row that it visits. Vectors that meet in a cell are compared in double
precision, in blocks; crowded rows are dealt into parts of at most PART vectors or so.

Equal vectors are one node with a count. Null, zero, non-finite or part-null vectors link with
nothing; vectors of unlike length don't link; a null id links with nothing, and rows of one id are vectors of their own;
the least id of a component stays; an empty table gives no rows; other columns don't pass through, so their names are no matter.
"""

from __future__ import annotations

import heapq
import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, grouped, mix, parts, saved
from .components import components

SAMPLE, TARGET, PART = 32_768, 0.999, 65_536
CODES = 1024  # codes of a half at most
NOISY = 4096  # neighbours made by noise


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    centres = x[np.random.default_rng(0).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        for c in range(len(centres)):
            if (own == c).any():
                centres[c] = x[own == c].mean(0)
    return centres


def distances(x: np.ndarray, books: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of both halves to their codes."""
    half = x.shape[1] // 2
    return tuple((part * part).sum(1)[:, None] - 2 * (part @ book.T) + (book * book).sum(1) for part, book in zip((x[:, :half], x[:, half:]), books, strict=True))


def traversal(a: np.ndarray, b: np.ndarray, n: int) -> list[int]:
    """The n nearest cells of one query, by the multi-sequence algorithm, with a heap. ``visits`` finds the same, for many queries at once."""
    i, j = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    heap, seen, out = [(a[i[0]] + b[j[0]], 0, 0)], {(0, 0)}, []
    while heap and len(out) < n:
        _, p, q = heapq.heappop(heap)
        out.append(int(i[p]) * len(b) + int(j[q]))
        for r, s in ((p + 1, q), (p, q + 1)):
            if r < len(a) and s < len(b) and (r, s) not in seen:
                seen.add((r, s))
                heapq.heappush(heap, (a[i[r]] + b[j[s]], r, s))
    return out


def visits(a: np.ndarray, b: np.ndarray, gap: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, column) of the cells that queries traverse until the sum of half distances exceeds the least by more than gap."""
    a, b = a - a.min(axis=1, keepdims=True), b - b.min(axis=1, keepdims=True)
    query, row = np.nonzero(a <= gap)
    at, column = np.nonzero(b[query] <= (gap - a[query, row])[:, None])
    return query[at], row[at], column


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit(x: np.ndarray, n: int, least: float, target: float = TARGET) -> tuple[tuple, float]:
    """Codebooks for n vectors like the sample x, and the gap that traversal may go beyond the nearest cell."""
    half, rng = x.shape[1] // 2, np.random.default_rng(1)
    codes = int(min(max(8, np.ceil(np.sqrt(n) / 8)), CODES, max(1, len(x) // 8)))
    books = kmeans(x[:, :half], codes), kmeans(x[:, half:], codes)
    a, b = distances(x, books)
    low = a.min(1) + b.min(1)
    rows, columns = a.argmin(1), b.argmin(1)
    own = np.resize(np.arange(len(x)), NOISY)
    noise = rng.normal(size=(NOISY, x.shape[1]))
    noise = _unit(noise - (noise * x[own]).sum(1, keepdims=True) * x[own]) if x.shape[1] > 1 else 0 * noise
    c, d = distances(least * x[own] + np.sqrt(1 - least**2) * noise, books)
    k = np.arange(NOISY)
    there = a[own, c.argmin(1)] + b[own, d.argmin(1)] - low[own]
    back = c[k, rows[own]] + d[k, columns[own]] - c.min(1) - d.min(1)
    gap = float(np.quantile(np.minimum(there, back), target))
    pairs = []
    for i in range(0, len(x), 512):
        p, q = np.nonzero(x[i : i + 512] @ x.T >= least)
        p += i
        p, q = p[p < q], q[p < q]
        pairs.append(np.minimum(a[p, rows[q]] + b[p, columns[q]] - low[p], a[q, rows[p]] + b[q, columns[p]] - low[q]))
    pairs = np.concatenate(pairs)
    if len(pairs):
        gap = max(gap, float(np.quantile(pairs, target)))
    logging.getLogger(__name__).info("%d codes a half, gap %.4f, %d linked pairs in the sample", codes, gap, len(pairs))
    return books, gap


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, least node reached) that join the same nodes as the links (u, v), fewer than there are nodes."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    head = np.arange(len(nodes))
    while True:
        low = np.minimum(head[a], head[b])
        new = head.copy()
        for end in (a, b):
            np.minimum.at(new, end, low)
            np.minimum.at(new, head[end], low)
        new = new[new]
        if (new == head).all():
            break
        head = new
    far = np.flatnonzero(head != np.arange(len(nodes)))
    return nodes[far], nodes[head[far]]


def _vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, dim, raw): a vector's numbers as bytes, single precision if the column is; raw is null where it links with nothing."""
    single = df.schema[vector].dataType.simpleString() == "array<float>"
    kind = np.float32 if single else np.float64
    column = F.col(vector) if single else F.transform(F.col(vector), lambda v: v.cast("double"))

    def run(batches):
        for batch in batches:
            cells = batch.column(1)
            flat = cells.flatten()
            n = np.array(cells.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            x = flat.to_numpy(zero_copy_only=False).astype(kind) + kind(0)  # a null is not a number; minus zero is zero
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            some = np.concatenate([[0], np.cumsum(x != 0)])
            ends = np.cumsum(n)
            good = (bad[ends] == bad[ends - n]) & (some[ends] > some[ends - n])
            raw, width = x.tobytes(), x.itemsize
            out = [raw[width * a : width * b] if g else None for a, b, g in zip((ends - n).tolist(), ends.tolist(), good.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int32)), pa.array(out, pa.binary())], ["id", "dim", "raw"])

    return df.select(F.col(key).cast("long").alias("id"), column.alias("x")).mapInArrow(run, "id long, dim int, raw binary")


def _matrix(raw: list, dim: int) -> np.ndarray:
    data = b"".join(raw)
    return np.frombuffer(data, np.float32 if len(data) == 4 * dim * len(raw) else np.float64).reshape(-1, dim).astype(np.float64)


def links(nodes: DataFrame, least: float) -> DataFrame:
    """What the nodes (id, dim, copies, raw) with cosine >= least of each other have: rows (u, v, others).

    With v, a link of a spanning forest of one block's links; without, a part of the number of
    vectors linked with u, copies included. Linked pairs are counted where they meet, never listed:
    a query counts whom it finds, and is counted by those who don't find it from their side.
    """
    spark = nodes.sparkSession
    dims = {r.dim: r.n for r in nodes.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(64).collect()}
    sample: dict[int, list] = {}
    for r in nodes.filter(F.col("dim").isin(*dims) if dims else F.lit(False)).orderBy(F.xxhash64("id")).limit(SAMPLE).select("dim", "raw").collect():
        sample.setdefault(r.dim, []).append(bytes(r.raw))
    plans = {d: fit(_unit(_matrix(v, d)), dims[d], least) for d, v in sample.items() if d > 1}
    shared = spark.sparkContext.broadcast(plans)  # codebooks of at most CODES codes, of 64 lengths at most

    def traversed(batches):
        """(dim, ids, copies, raw, query, row, column, home) some vectors at a time; lengths without codebooks have one cell."""
        for batch in batches:
            size = batch.column(1).to_numpy()
            for d in np.unique(size).tolist():
                mine = np.flatnonzero(size == d)
                for i in range(0, len(mine), 512):
                    part = batch.take(pa.array(mine[i : i + 512]))
                    ids, copies, raw, n = part.column(0).to_numpy(), part.column(2).to_numpy(), part.column(3).to_pylist(), part.num_rows
                    if d not in shared.value:
                        yield d, ids, copies, raw, np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros((n, 2), np.int64)
                        continue
                    books, gap = shared.value[d]
                    a, b = distances(_unit(_matrix(raw, d)), books)
                    yield d, ids, copies, raw, *visits(a, b, gap), np.stack([a.argmin(1), b.argmin(1)], axis=1)

    def sized(batches):
        seen: dict[tuple, np.ndarray] = {}
        for d, ids, _, _, query, row, _, home in traversed(batches):
            for r, n in zip(*np.unique(home[:, 0], return_counts=True), strict=True):
                seen.setdefault((d, int(r)), np.zeros(2, np.int64))[0] += n
            for r, n in zip(*np.unique(np.unique(np.stack([query, row], axis=1), axis=0)[:, 1], return_counts=True), strict=True):
                seen.setdefault((d, int(r)), np.zeros(2, np.int64))[1] += n
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.int32()), pa.array([k[1] for k in seen], pa.int32()), pa.array([int(v[0]) for v in seen.values()]), pa.array([int(v[1]) for v in seen.values()])], ["dim", "row", "homes", "visitors"])

    plain = nodes.select("id", "dim", "copies", "raw")
    sizes = plain.mapInArrow(sized, "dim int, row int, homes long, visitors long").groupBy("dim", "row").agg(F.sum("homes").alias("homes"), F.sum("visitors").alias("visitors"))
    # Rows of the grid with over PART vectors: a number of them per PART vectors at most.
    crowded = {(r.dim, r.row): (-(-r.homes // PART) or 1, -(-r.visitors // PART) or 1) for r in sizes.filter((F.col("homes") > PART) | (F.col("visitors") > PART)).collect()}
    names = ["dim", "row", "part", "seat", "id", "copies", "listed", "asks", "home", "columns", "cells", "raw"]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    schema = "dim int, row int, part int, seat int, id long, copies long, listed boolean, asks boolean, home long, columns binary, cells binary, raw binary"

    def sent(batches):
        out: list[tuple] = []
        for d, ids, copies, raw, query, row, column, home in traversed(batches):
            cell = (row << 16) | column
            homes = ((home[:, 0] << 16) | home[:, 1]).tolist()
            cuts = np.searchsorted(query, np.arange(len(ids) + 1))
            marks = mix(ids.view(np.uint64) + np.uint64(1))
            for k in range(len(ids)):
                mine = slice(cuts[k], cuts[k + 1])
                every = cell[mine].astype("<u4").tobytes()
                for r in np.unique(row[mine]).tolist():
                    p, s = crowded.get((d, r), (1, 1))
                    at_home = homes[k] >> 16 == r
                    own, seat = int(marks[k] % np.uint64(p)), int((marks[k] >> np.uint64(32)) % np.uint64(s))
                    wanted = column[mine][row[mine] == r].astype("<u2").tobytes()
                    places = {(i, seat) for i in range(p)} | ({(own, j) for j in range(s)} if at_home else set())
                    for i, j in places:
                        listed = at_home and i == own
                        out.append((d, r, i, j, int(ids[k]), int(copies[k]), listed, j == seat, homes[k], wanted, every if listed else b"", raw[k]))
            while len(out) > 2048:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[:2048], strict=True), kinds, strict=True)], names)
                out = out[2048:]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def meet(batches):
        for rows in grouped(batches, 4):
            d = rows["dim"][0].as_py()
            x = _unit(_matrix(rows["raw"].to_pylist(), d))
            ids, many, home = (rows[c].to_numpy() for c in ("id", "copies", "home"))
            listed, asks = (rows[c].to_numpy(zero_copy_only=False) for c in ("listed", "asks"))
            wanted = [np.frombuffer(c, "<u2") for c in rows["columns"].to_pylist()]
            asker = np.repeat(np.arange(len(ids)), [len(c) if ask else 0 for c, ask in zip(wanted, asks, strict=True)])
            column = np.concatenate([*(c for c, ask in zip(wanted, asks, strict=True) if ask), np.zeros(0, np.uint16)])
            order = np.argsort(column, kind="stable")
            asker, column = asker[order], column[order]
            cells = [np.frombuffer(c, "<u4") for c in rows["cells"].to_pylist()]
            seen = np.sort((np.repeat(np.arange(len(ids)), [len(c) for c in cells]).astype(np.uint64) << np.uint64(32)) | np.concatenate([*cells, np.zeros(0, np.uint32)]))
            sums, heads = np.zeros(len(ids), np.int64), [np.zeros(0, np.int64)] * 2
            own = np.flatnonzero(listed)
            own = own[np.argsort(home[own], kind="stable")]
            for c in np.unique(home[own] & 0xFFFF).tolist():
                there = own[(home[own] & 0xFFFF) == c]
                here = asker[np.searchsorted(column, c) : np.searchsorted(column, c, "right")]
                for i in range(0, len(here), 512):
                    part = here[i : i + 512]
                    for j in range(0, len(there), 8192):
                        p, q = np.nonzero(x[part] @ x[there[j : j + 8192]].T >= least)
                        p, q = part[p], there[j : j + 8192][q]
                        p, q = p[ids[p] != ids[q]], q[ids[p] != ids[q]]
                        if not len(p):
                            continue
                        np.add.at(sums, p, many[q])
                        back = (q.astype(np.uint64) << np.uint64(32)) | home[p].astype(np.uint64)  # does the listed one visit the asker's cell?
                        at = np.minimum(np.searchsorted(seen, back), len(seen) - 1)
                        blind = seen[at] != back
                        np.add.at(sums, q[blind], many[p[blind]])
                        heads = list(forest(np.concatenate([heads[0], ids[p]]), np.concatenate([heads[1], ids[q]])))
            some = np.flatnonzero(sums)
            if not len(some):
                continue
            node = np.concatenate([heads[0], ids[some]])
            bare = np.arange(len(node)) >= len(heads[0])
            ends = np.concatenate([heads[1], np.zeros(len(some), np.int64)])
            others = np.concatenate([np.zeros(len(heads[0]), np.int64), sums[some]])
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(ends, mask=bare), pa.array(others)], ["u", "v", "others"])

    block = ["dim", "row", "part", "seat"]
    dealt = plain.mapInArrow(sent, schema).repartition(parts(spark), *block).sortWithinPartitions(*block)
    return dealt.mapInArrow(meet, "u long, v long, others long")


def groups(df: DataFrame, least: float = 0.95, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per row: the id, n_links, component_id and kept."""
    spark = df.sparkSession
    rows = _vectors(df, key, vector).withColumns({"k1": F.xxhash64("raw"), "k2": F.xxhash64(F.lit(7), "raw")})
    rows = rows.withColumns({k: F.when(F.col("id").isNotNull() & F.col("raw").isNotNull(), F.col(k)) for k in ("k1", "k2")})
    nodes = rows.filter("k1 is not null").groupBy("k1", "k2").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("dim").alias("dim"), F.first("raw").alias("raw"))
    nodes, nodes_path = saved(nodes, "nodes")
    found, found_path = saved(links(nodes, least), "links")
    many = found.filter("v is null").groupBy(F.col("u").alias("id")).agg(F.sum("others").alias("others"))
    heads = components(found.filter("v is not null")).withColumnRenamed("node", "id")
    full = nodes.drop("raw", "dim").join(many, "id", "left").join(heads, "id", "left").select("k1", "k2", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.coalesce("component", "id").alias("c"))
    full, _ = saved(full, "full")
    drop(spark, nodes_path, found_path)
    out = rows.drop("raw", "dim").join(full, ["k1", "k2"], "left")
    component = F.coalesce("c", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
