"""Side tables, rollups, turns, dimensions and profiles over wide spans."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.operators.ranking import ranked
from spanlake.schema import DIM, DOCUMENTS, LINKS, MESSAGES, SESSIONS, SPANS, SPEC, SPEC_VERSION, TRACES, conform
from spanlake.sources.shared import saved

LATE = 1 << 62  # where a trace without a start stands in its session


def spans(wide: DataFrame) -> DataFrame:
    return conform(wide, SPANS)


def messages(wide: DataFrame) -> DataFrame:
    """One row a message; positions count from 0 in each span."""
    return conform(wide.select("trace_id", "span_id", F.posexplode("messages").alias("position", "m")).select("trace_id", "span_id", "position", "m.*"), MESSAGES)


def documents(wide: DataFrame) -> DataFrame:
    return conform(wide.select("trace_id", "span_id", F.explode("documents").alias("d")).select("trace_id", "span_id", "d.*"), DOCUMENTS)


def links(wide: DataFrame) -> DataFrame:
    return conform(wide.select("trace_id", "span_id", F.explode("links").alias("x")).select("trace_id", "span_id", "x.*"), LINKS)


def first_by(value: Column, order: Column, where: Column) -> Column:
    """The value of the row that is first in order among those that match."""
    return F.min_by(value, F.when(where, order))


def root_of(order: Column) -> Column:
    """The order, start and (span_id, name, service_name) of the earliest parentless span; a null start is last, ties go to the first read."""
    start = F.col("start_time_unix_nano")
    return F.min(F.when(F.col("parent_span_id").isNull(), F.struct(start.isNull().alias("late"), start.alias("start"), order.alias("ord"), F.struct("span_id", "name", "service_name").alias("span"))))


def trace_partials(wide: DataFrame, *more: Column) -> DataFrame:
    """What a set of spans adds to each of its traces: minima, maxima and sums, which further sets can be merged into. ``more`` are further aggregates."""
    order, session = F.col("ord"), F.col("session_id")
    rank = F.when(F.col("status_code") == "ERROR", 2).when(F.col("status_code") == "OK", 1).otherwise(0)
    return wide.groupBy("trace_id").agg(
        F.min(F.when(F.coalesce(session, F.lit("")) != "", F.struct(order.alias("ord"), session.alias("id")))).alias("session"),
        root_of(order).alias("root"),
        F.min("start_time_unix_nano").alias("start_time_unix_nano"),
        F.max("end_time_unix_nano").alias("end_time_unix_nano"),
        F.count("*").alias("span_count"),
        F.count_if(F.col("status_code") == "ERROR").alias("error_count"),
        F.max(rank).alias("rank"),
        *(F.sum(f"{k}_tokens").alias(f"{k}_sum") for k in ("input", "output", "total")),
        *more,
    )


def merged_partials(partials: DataFrame) -> DataFrame:
    """Partials of several sets of spans as one."""
    least, most, sums = ("session", "root", "start_time_unix_nano"), ("end_time_unix_nano", "rank"), ("span_count", "error_count", "input_sum", "output_sum", "total_sum")
    return partials.groupBy("trace_id").agg(*(F.min(c).alias(c) for c in least), *(F.max(c).alias(c) for c in most), *(F.sum(c).alias(c) for c in sums))


def rolled_up(partials: DataFrame) -> DataFrame:
    """The columns of the traces table, but for turns, from partials."""
    names = F.array(F.lit("UNSET"), F.lit("OK"), F.lit("ERROR"))
    return partials.withColumns(
        {
            "session_id": F.col("session.id"),
            "root_span_id": F.col("root.span.span_id"),
            "root_span_name": F.col("root.span.name"),
            "service_name": F.col("root.span.service_name"),
            "duration_ns": F.col("end_time_unix_nano") - F.col("start_time_unix_nano"),
            "status": F.element_at(names, F.col("rank") + 1),
            **{f"total_{k}_tokens" if k != "total" else "total_tokens": F.col(f"{k}_sum") for k in ("input", "output", "total")},
        }
    ).drop("session", "root", "rank", "input_sum", "output_sum", "total_sum")


def trace_rollup(wide: DataFrame, *more: Column) -> DataFrame:
    """One row a trace, before turns: one aggregate, partial before the shuffle. ``more`` are further aggregates of its spans."""
    return rolled_up(trace_partials(wide, *more))


def with_turns(rolled: DataFrame) -> DataFrame:
    """session_turn: a trace's place in its session by start, then id; null without a session. Sessions of any size are spread (see ranking)."""
    keyed = rolled.withColumns({"__session": F.coalesce("session_id", F.lit("")), "__start": F.coalesce("start_time_unix_nano", F.lit(LATE))})
    placed = ranked(keyed, ["__session"], ["__start", "trace_id"], "__turn")
    return placed.withColumn("session_turn", F.when(F.col("session_id").isNotNull(), F.col("__turn").cast("int"))).drop("__session", "__start", "__turn")


OWN = tuple(f.name for f in SPANS.fields if f.name not in ("spec", "spec_version"))  # columns of the spans table that wide spans have
ROLLED = ("ord", "trace_id", "span_id", "parent_span_id", "name", "service_name", "session_id", "status_code", "start_time_unix_nano", "end_time_unix_nano", "input_tokens", "output_tokens", "total_tokens")


def traces(wide: DataFrame) -> DataFrame:
    """The traces table. The columns that it needs are written first: the turns' ranges are sampled, which would normalise all spans twice."""
    return conform(with_turns(trace_rollup(saved(wide.select(*ROLLED), "rollup"))), TRACES)


def sessions(rolled: DataFrame) -> DataFrame:
    """One row a session, over traces rather than spans; turns aren't needed."""
    sums = ("span_count", "error_count", "total_input_tokens", "total_output_tokens", "total_tokens")
    by_session = rolled.filter("session_id is not null").groupBy("session_id").agg(
        F.count("*").alias("trace_count"), F.min("start_time_unix_nano").alias("start_time_unix_nano"), F.max("end_time_unix_nano").alias("end_time_unix_nano"), *(F.sum(c).alias(c) for c in sums)
    )
    return conform(by_session.withColumn("duration_ns", F.col("end_time_unix_nano") - F.col("start_time_unix_nano")), SESSIONS)


class Tables(Mapping):
    """Tables by name, each made when it is first asked for: the turns of traces need a pass of their own."""

    def __init__(self, makers: dict[str, Callable[[Tables], DataFrame]]):
        self._makers, self._made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name](self)
        return self._made[name]

    def __iter__(self):
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)

    def made(self, name: str) -> bool:
        return name in self._made


def all_tables(wide: DataFrame) -> Tables:
    return Tables(
        {
            "spans": lambda _: spans(wide),
            "messages": lambda _: messages(wide),
            "documents": lambda _: documents(wide),
            "links": lambda _: links(wide),
            "traces": lambda _: traces(wide),
            "sessions": lambda t: sessions(t["traces"] if t.made("traces") else trace_rollup(wide)),
        }
    )


def ordered_tables(wide: DataFrame) -> Tables:
    """The tables in the order of the input: spans and their parts as read, traces and sessions as first seen."""
    listed = wide.orderBy("ord")

    def first(t: Tables) -> DataFrame:
        return trace_rollup(wide, F.min("ord").alias("ord"))

    def by_session(t: Tables) -> DataFrame:
        rolled = first(t)
        seen = rolled.filter("session_id is not null").groupBy("session_id").agg(F.min("ord").alias("ord"))
        return conform(sessions(rolled).join(seen, "session_id").orderBy("ord"), SESSIONS)

    return Tables(
        {
            "spans": lambda _: spans(listed),
            "messages": lambda _: messages(listed),
            "documents": lambda _: documents(listed),
            "links": lambda _: links(listed),
            "traces": lambda t: conform(with_turns(first(t)).orderBy("ord"), TRACES),
            "sessions": by_session,
        }
    )


DIMS = {"tools": "tool_name", "agents": "agent_name", "models": "model_name", "services": "service_name"}


def dim(span_table: DataFrame, column: str) -> DataFrame:
    """Spans and distinct traces of each value that isn't null."""
    rolled = span_table.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("name")).agg(F.count("span_id").alias("span_count"), F.count_distinct("trace_id").alias("trace_count"))
    return conform(rolled, DIM)


def dims(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {name: dim(tables["spans"], column) for name, column in DIMS.items()}


def all_dims(span_table: DataFrame) -> DataFrame:
    """All dimensions in one pass over the spans: (dim, then the columns of ``dim``)."""
    pairs = ", ".join(f"'{name}', {column}" for name, column in DIMS.items())
    stacked = span_table.select("trace_id", "span_id", F.expr(f"stack({len(DIMS)}, {pairs}) as (dim, name)")).filter("name is not null")
    rolled = stacked.groupBy("dim", "name").agg(F.count("span_id").alias("span_count"), F.count_distinct("trace_id").alias("trace_count"))
    return rolled.withColumns({"spec": F.lit(SPEC), "spec_version": F.lit(SPEC_VERSION)}).select("dim", *(f.name for f in DIM.fields))


def counts_of(wide: DataFrame) -> DataFrame:
    """Rows of each table, in one pass over the spans."""
    parts = ("messages", "documents", "links")
    session = F.col("session_id")
    by_trace = wide.groupBy("trace_id").agg(F.count("*").alias("spans"), *(F.sum(F.size(c)).alias(c) for c in parts), first_by(session, F.col("ord"), F.coalesce(session, F.lit("")) != "").alias("session_id"))
    once = by_trace.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("spans", *parts)), F.count("*").alias("traces"), F.count_distinct("session_id").alias("sessions"))
    names = ("spans", *parts, "traces", "sessions")
    return once.select(F.expr(f"stack({len(names)}, " + ", ".join(f"'{n}', {n}" for n in names) + ") as (table_name, n)"))


def histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).alias("value")).filter("value is not null").distinct().orderBy("value")


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def orphans(span_table: DataFrame) -> DataFrame:
    """Spans whose parent is not among the spans of their trace."""
    parents = span_table.select("trace_id", F.col("span_id").alias("parent_span_id")).distinct()
    return span_table.filter("parent_span_id is not null").join(parents, ["trace_id", "parent_span_id"], "left_anti")


def with_spans(side: DataFrame, span_table: DataFrame, columns: list[str]) -> DataFrame:
    """A side table joined to columns of its spans."""
    return side.join(span_table.select("trace_id", "span_id", *columns), ["trace_id", "span_id"], "left")
