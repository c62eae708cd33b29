"""The engine's entry points: paths to tables, records, arrays and files."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

from spanlake.operators import nested, tables
from spanlake.operators.normalize import normalize
from spanlake.schema import STREAMED, check_spec
from spanlake.sources import otlp, sinks
from spanlake.sources.shared import drop, new_dir, saved_at


def load(spark: SparkSession, path: otlp.Paths, *, spec: str = "at/v2", ordered: bool = False) -> Mapping[str, DataFrame]:
    """The six tables of OTLP/JSON files, each made when asked for; with ``ordered`` their rows come in the order of the input, which costs a sort."""
    check_spec(spec)
    made = tables.ordered_tables if ordered else tables.all_tables
    return made(normalize(otlp.read_spans(spark, path)))


def load_payloads(spark: SparkSession, payloads: Iterable[str] | DataFrame) -> Mapping[str, DataFrame]:
    """The tables of documents in memory: texts on the driver, or a DataFrame whose one column holds them, which stays with the tasks."""
    return tables.all_tables(normalize(otlp.flatten(otlp.payload_documents(spark, payloads))))


def to_arrow(spark: SparkSession, path: otlp.Paths, *, spec: str = "at/v2") -> dict:
    return {name: df.toArrow() for name, df in load(spark, path, spec=spec, ordered=True).items()}


def write_arrow(spark: SparkSession, path: otlp.Paths, folder: str, *, spec: str = "at/v2") -> dict[str, str]:
    """All tables as Arrow, for tables of any size: a folder a table, in the order of the input, which tasks write and ``sinks.read_arrow`` reads."""
    check_spec(spec)
    at = new_dir(spark, "wide")
    try:
        made = tables.ordered_tables(saved_at(normalize(otlp.read_spans(spark, path)), at))
        out = {name: f"{str(folder).rstrip('/')}/{name}" for name in made}
        for name, where in out.items():
            sinks.write_arrow(made[name], where)
        return out
    finally:
        drop(spark, at)


def to_dfs(spark: SparkSession, path: otlp.Paths, *, spec: str = "at/v2") -> dict:
    return sinks.to_pandas(load(spark, path, spec=spec, ordered=True))


def to_parquet(spark: SparkSession, path: otlp.Paths, folder: str, *, spec: str = "at/v2", batch_size: int = 10_000, compression: str = "zstd", row_group_size: int | None = None) -> dict[str, str]:
    """All tables as Parquet. JSON is parsed once: the tables read wide spans from the shared folder, each its own columns."""
    check_spec(spec)
    at = new_dir(spark, "wide")
    try:
        made = tables.all_tables(saved_at(normalize(otlp.read_spans(spark, path)), at))
        out = sinks.write_parquet({n: made[n] for n in STREAMED}, folder, compression, row_group_size or batch_size)
        return out | sinks.write_parquet({n: made[n] for n in made if n not in STREAMED}, folder, compression, row_group_size)
    finally:
        drop(spark, at)


def record_frame(spark: SparkSession, path: otlp.Paths, *, spec: str = "at/v2") -> DataFrame:
    """Nested records, distributed, a trace a row."""
    check_spec(spec)
    return nested.records(normalize(otlp.read_spans(spark, path))).drop("ord")


def record_pieces(spark: SparkSession, path: otlp.Paths, *, spec: str = "at/v2", whole: bool = False) -> DataFrame:
    """Nested records as JSON in pieces, for traces of any size."""
    check_spec(spec)
    return nested.fragments(normalize(otlp.read_spans(spark, path)), whole)


def to_dicts(spark: SparkSession, path: otlp.Paths, *, spec: str = "at/v2") -> list[dict]:
    """Nested records as Python dicts on the driver."""
    return list(nested.dicts(record_pieces(spark, path, spec=spec)))


def write_tables(spark: SparkSession, path: otlp.Paths, folder: str, fmt: str, *, spec: str = "at/v2", batch_size: int = 10_000, compression: str = "zstd") -> dict[str, str]:
    """Tables in a format; Parquet as a folder a table, the others as a file a table. The folder may be on any file system."""
    if fmt == "parquet":
        return to_parquet(spark, path, folder, spec=spec, batch_size=batch_size, compression=compression)
    out = {}
    for name, df in load(spark, path, spec=spec, ordered=True).items():
        out[name] = f"{str(folder).rstrip('/')}/{name}.{fmt}"
        sinks.write_local(df, out[name], fmt)
    return out


def write_records(spark: SparkSession, path: otlp.Paths, folder: str, fmt: str, *, spec: str = "at/v2") -> tuple[str, int]:
    """All records in one file, streamed through the driver; ``sinks.write_record_lines`` writes a folder without it."""
    out = f"{str(folder).rstrip('/')}/traces.{fmt}"
    return out, sinks.write_texts(spark, nested.record_texts(record_pieces(spark, path, spec=spec)), out, fmt == "jsonl")
