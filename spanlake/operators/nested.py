"""Nested records: one a trace, with its spans, and their messages, documents and links.

``records`` is a DataFrame of nested arrays, for traces that fit a cell. ``fragments`` is the same as JSON text in
pieces, a row a span, which sorts and streams traces of any size. Where a trace holds a span id twice, each copy gets
all children of the id, in input order: only such ids are gathered, each once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.operators.tables import trace_rollup, with_turns
from spanlake.schema import SPANS, SPEC, SPEC_VERSION, TRACES, conform
from spanlake.sources.shared import saved

CHILDREN = {"messages": ["position", "direction", "role", "content", "tool_call_id"], "documents": ["position", "document_id", "content", "score"], "links": ["linked_trace_id", "linked_span_id"]}
KEY = ["trace_id", "span_id"]


def _child(name: str):
    """A span's children as structs of their columns; a message's position is its place."""

    def one(x, i):
        return F.struct(*(i.cast("int").alias(f) if name == "messages" and f == "position" else x[f].alias(f) for f in CHILDREN[name]))

    return F.transform(name, one).alias(name)


def with_children(wide: DataFrame) -> DataFrame:
    """Spans with their children as the records list them: those of all spans of the trace with the same id."""
    own = wide.select(*(c for c in wide.columns if c not in CHILDREN), *(_child(name) for name in CHILDREN))
    # Written, as they are few: then Spark knows their size before it plans, and the other spans aren't shuffled to meet them.
    again = saved(own.groupBy(*KEY).agg(F.count("*").alias("times")).filter("times > 1").select(*KEY), "again")
    of_id = lambda name: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct(name).alias("v")))), lambda x: x["v"][name])).alias(f"all_{name}")
    shared = saved(own.join(again, KEY, "left_semi").groupBy(*KEY).agg(*(of_id(name) for name in CHILDREN)), "shared")
    return own.join(shared, KEY, "left").withColumns({name: F.coalesce(f"all_{name}", name) for name in CHILDREN}).drop(*(f"all_{name}" for name in CHILDREN))


def _span():
    """A span of a record: its columns but its trace's id, its raw attributes as text, and its children."""
    fixed = {"spec": F.lit(SPEC).alias("spec"), "spec_version": F.lit(SPEC_VERSION).alias("spec_version")}
    own = [f.name for f in SPANS.fields if f.name not in ("trace_id", "raw_attributes_json")]
    return F.struct(*(fixed.get(c, F.col(c)) for c in own), "raw_attributes_json", *CHILDREN)


def _heads(kept: DataFrame) -> DataFrame:
    """Trace columns with their turns, and ``ord``, a trace's first place in the input."""
    return conform(with_turns(trace_rollup(kept, F.min("ord").alias("ord"))), TRACES, "ord")


def records(wide: DataFrame) -> DataFrame:
    """``ord``, trace columns and ``spans``, an array in input order. Spans are normalised once and written."""
    kept = saved(wide, "wide")
    gathered = with_children(kept).groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.struct(_span().alias("s")).alias("v")))).alias("spans"))
    return _heads(kept).join(gathered, "trace_id").select(*(f.name for f in TRACES.fields), "ord", F.transform("spans", lambda x: x["v"]["s"]).alias("spans"))


def fragments(wide: DataFrame, whole: bool = False) -> DataFrame:
    """Records as JSON in pieces, in order: (first, trace_id, part, value), part 0 the trace, 1 a span, 2 the end.

    A record is its values one after another; nulls are kept, and raw attributes stand as JSON, not as text. With
    ``whole``, no record is cut between partitions; else a long one is spread over several.
    """
    kept = saved(wide, "wide")
    heads = saved(_heads(kept).withColumnRenamed("ord", "first"), "heads")
    nulls = {"ignoreNullFields": "false"}
    trace = F.to_json(F.struct(*(f.name for f in TRACES.fields)), nulls)
    opened = heads.select("first", "trace_id", F.lit(0).alias("part"), F.col("first").alias("ord"), F.concat(trace.substr(F.lit(1), F.length(trace) - 1), F.lit(',"spans":[')).alias("value"))
    ended = heads.select("first", "trace_id", F.lit(2).alias("part"), F.col("first").alias("ord"), F.lit("]}").alias("value"))
    rows = with_children(kept).join(heads.select("trace_id", "first"), "trace_id")
    text = F.to_json(_span().dropFields("raw_attributes_json"), nulls)
    text = F.concat(text.substr(F.lit(1), F.length(text) - 1), F.lit(',"raw_attributes":'), F.coalesce("raw_attributes_json", F.lit("null")), F.lit("}"))
    listed = rows.select("first", "trace_id", F.lit(1).alias("part"), "ord", F.concat(F.when(F.col("ord") == F.col("first"), "").otherwise(","), text).alias("value"))
    order = ["first", "part", "ord"]
    dealt = opened.unionByName(listed).unionByName(ended).repartitionByRange(*(order[:1] if whole else order)).sortWithinPartitions(*order)
    return dealt.select("first", "trace_id", "part", "value")


def record_texts(pieces: DataFrame) -> Iterator[Iterator[str]]:
    """The texts of each record, streamed to the driver a partition at a time."""
    rows = iter(pieces.select("part", "value").toLocalIterator())

    def one(first: str) -> Iterator[str]:
        yield first
        for row in rows:
            yield row.value
            if row.part == 2:
                return

    for row in rows:
        yield one(row.value)


def dicts(pieces: DataFrame) -> Iterator[dict]:
    for texts in record_texts(pieces):
        yield json.loads("".join(texts))
