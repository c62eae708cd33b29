"""Source divergence audit: how the sources of a language differ in their use of words.

Terms are counted once over all texts; those that stand in enough documents of a language are kept. A kept
term's counts by source form a sparse vector, and terms with the same vector are one row with a multiplicity:
each pair of sources is evaluated once per distinct vector, and only where one of the two has the term; what
all other terms add to a pair is one product. Single terms are ranked afterwards, as they are.

Texts are counted in blocks, each task adds up what it has seen, and one shuffle by (language, term) serves the
sums by source, the document counts and the vectors. Distinct vectors are dealt in slices, each with all sources
of its language, whose number bounds a vector and, squared, the result.

Odd rows: null text, lang and source are ''. A document counts once for each row, so repeated rows and ids count
again. Texts without a term leave their group, whose counts are zero. A language without kept terms has pairs of
value 0 and no terms. Ties are ranked by item, byte by byte. Long texts are read whole, one at a time. An empty
table gives no rows. Columns other than the three are ignored, so their names may clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, lower, parts, saved, text_blocks, words

LEAST_DOCS = 30
TOP = 50
SCALE, PRIOR = 1_000_000_000, 5
SLICE = 4096  # terms of a language by which its vectors are dealt in slices, or as many as it has sources
DENSE = 1 << 22  # cells of a slice that are held as a matrix at a time
HELD = 1 << 19  # rows of counts that a task adds up before it hands them on

_NO_TERM = np.ones_like(SPACE)
_NO_TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
COUNTS = "lang string, source string, term string, c long, d long"
_ARROW = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("c", pa.int64()), ("d", pa.int64())])


def terms_of(data: np.ndarray, offs: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All terms of some texts, A-Z lower-cased, and the text in which each stands."""
    starts, ends, row = words(data, offs, _NO_TERM)
    stops = np.concatenate([[0], np.cumsum(ends - starts)])
    flat = lower(data)[~_NO_TERM[data]]
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(stops.astype(np.int64)), pa.py_buffer(flat)]), row


def _block_counts(rows: pa.RecordBatch, data: np.ndarray, offs: np.ndarray) -> pa.Table:
    """(lang, source, term, occurrences, documents) of a block."""
    terms, row = terms_of(data, offs)
    coded = terms.dictionary_encode()
    many = max(1, len(coded.dictionary))
    per_row, times = np.unique(row * many + coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
    group = pa.StructArray.from_arrays([rows.column("lang"), rows.column("source")], ["lang", "source"])
    codes: dict = {}
    of_row = np.array([codes.setdefault((x["lang"], x["source"]), len(codes)) for x in group.to_pylist()], np.int64)
    key, back = np.unique(of_row[per_row // many] * many + per_row % many, return_inverse=True)
    c = np.zeros(len(key), np.int64)
    np.add.at(c, back, times)
    names = list(codes)
    lang, source = (pa.array([x[k] for x in names], pa.string()).take(pa.array(key // many)) for k in (0, 1))
    return pa.table([lang, source, coded.dictionary.take(pa.array(key % many)).cast(pa.string()), pa.array(c), pa.array(np.bincount(back, minlength=len(key)).astype(np.int64))], schema=_ARROW)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def summed() -> pa.Table:
        made = pa.concat_tables(held).group_by(["lang", "source", "term"], use_threads=False).aggregate([("c", "sum"), ("d", "sum")])
        return pa.table([made["lang"], made["source"], made["term"], made["c_sum"], made["d_sum"]], schema=_ARROW)

    for rows, data, offs in text_blocks(batches):
        held.append(_block_counts(rows, data, offs))
        n += held[-1].num_rows
        if n > 2 * HELD:
            held = [summed()]
            n = held[0].num_rows
            if n > HELD:
                yield from held[0].to_batches(max_chunksize=1 << 16)
                held, n = [], 0
    if held:
        yield from summed().to_batches(max_chunksize=1 << 16)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, term, source, c, d): occurrences and documents, dealt by (lang, term)."""
    texts = docs.select(*(F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in ("lang", "source", "text")))
    dealt = texts.mapInArrow(_count, COUNTS).repartition(parts(docs.sparkSession), "lang", "term")
    return dealt.groupBy("lang", "term", "source").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))


def vectors(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Kept terms: (lang, term, total, vec), vec its (source, count) pairs by source. Needs no further shuffle of ``term_counts``."""
    by_term = counts.groupBy("lang", "term").agg(F.sum("d").alias("docs"), F.sum("c").alias("total"), F.sort_array(F.collect_list(F.struct("source", "c"))).alias("vec"))
    return by_term.filter(F.col("docs") >= least_docs).drop("docs")


def share(count, total, terms) -> F.Column:
    """1 + floor(1e9 * (count + 5) / (total + 5 * terms)), exactly."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", wide(count + PRIOR) * F.lit(SCALE).cast("decimal(10,0)"), wide(total + PRIOR * terms)) + 1


def shares(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """As ``share``, of arrays; whole is the divisor."""
    if len(whole) and int(whole.max()) >= 1 << 48:
        return ((count.astype(object) + PRIOR) * SCALE // whole.astype(object) + 1).astype(np.int64)
    step = 32_000  # the product would overflow, so the division goes in two steps
    q, r = np.divmod((count + PRIOR) * step, whole)
    return q * (SCALE // step) + r * (SCALE // step) // whole + 1


def _pairs(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """(lang, a, b, value) of each pair of sources a < b: the sum over the slice's vectors, times their multiplicities."""
    right = right.sort_by("source")
    names = right["source"].combine_chunks()
    s = len(names)
    whole = right["n"].to_numpy() + PRIOR * right["v"].to_numpy()
    value = np.zeros((s, s), np.int64)
    if left.num_rows and s > 1:
        base = shares(np.zeros(s, np.int64), whole)
        many = left["m"].to_numpy()
        gap = np.abs(base[:, None] - base)
        value = gap * int(many.sum())
        vec = left["vec"].combine_chunks()
        offs = vec.offsets.to_numpy()
        entries = vec.flatten()
        offs = offs - offs[0]
        at = pc.index_in(entries.field("source"), value_set=names).to_numpy(zero_copy_only=False)
        p = shares(entries.field("c").to_numpy(zero_copy_only=False), whole[at])
        step = max(1, DENSE // s)
        for i in range(0, left.num_rows, step):
            j = min(i + step, left.num_rows)
            cut = slice(offs[i], offs[j])
            row = np.repeat(np.arange(j - i), np.diff(offs[i : j + 1]))
            dense, there = np.tile(base, (j - i, 1)), np.zeros((j - i, s), bool)
            dense[row, at[cut]], there[row, at[cut]] = p[cut], True
            for k in np.unique(at[cut]):
                own = np.flatnonzero(there[:, k])
                more = np.abs(dense[own, k, None] - dense[own]) - gap[k]
                more[there[own] & (np.arange(s) <= k)] = 0  # a pair that both have is told once
                value[k] += many[i:j][own] @ more
        a, b = np.triu_indices(s, 1)
        # A row holds what its source adds to a pair; the base stands in both halves, so it is taken off once.
        pair = value[a, b] + value[b, a] - gap[a, b] * int(many.sum())
    else:
        a, b = np.triu_indices(s, 1)
        pair = value[a, b]
    lang = pa.array([key[0].as_py()], pa.string()).take(pa.array(np.zeros(len(a), np.int64)))
    return pa.table({"lang": lang, "a": names.take(pa.array(a)).cast(pa.string()), "b": names.take(pa.array(b)).cast(pa.string()), "value": pa.array(pair)})


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): every other source of a language by distance, and the terms that a source has more of than its language."""
    terms, _ = saved(vectors(term_counts(docs), least_docs), "terms")
    entries = terms.select("lang", "term", "total", F.explode("vec").alias("e")).select("lang", "term", "total", F.col("e.source").alias("source"), F.col("e.c").alias("c"))
    sizes = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("n_lang"))
    found = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")).distinct()
    sums = entries.groupBy("lang", "source").agg(F.sum("c").alias("n"))
    many = found.groupBy("lang").agg(F.count("*").alias("sources"))
    slices = F.greatest(F.lit(1), F.ceil(F.col("v") / F.greatest(F.lit(SLICE), F.col("sources")))).cast("int")
    joined = found.join(sums, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["n", "v", "n_lang"]).join(many, "lang")
    groups, _ = saved(joined.withColumn("slices", slices), "groups")

    distinct = terms.groupBy("lang", "vec").agg(F.count("*").alias("m")).join(groups.select("lang", "slices").distinct(), "lang")
    left = distinct.select("lang", F.pmod(F.xxhash64("vec"), F.col("slices")).cast("int").alias("slice"), "vec", "m")
    right = groups.select("lang", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "source", "n", "v")
    near = left.groupBy("lang", "slice").cogroup(right.groupBy("lang", "slice")).applyInArrow(_pairs, "lang string, a string, b string, value long")
    pairs, _ = saved(near.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "pairs")
    sides = pairs.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value")
    sides = sides.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")

    p, q = share(F.col("c"), F.col("n"), F.col("v")), share(F.col("total"), F.col("n_lang"), F.col("v"))
    told = entries.join(groups, ["lang", "source"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (p - q).cast("long").alias("value")).filter("value > 0")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return sides.withColumn("rank", rank).unionByName(told.withColumn("rank", rank).filter(F.col("rank") <= top))
