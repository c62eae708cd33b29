"""Sinks: Parquet, CSV, Arrow, JSON and JSON lines, pandas."""

from __future__ import annotations

import io
import os
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("parquet", "csv", "arrow", "json", "jsonl")


def write_parquet(tables: dict[str, DataFrame], folder: str, compression: str = "zstd", row_group_rows: int | None = None) -> dict[str, str]:
    """A folder a table, empty tables too; returns their paths."""
    out = {}
    for name, df in tables.items():
        out[name] = os.path.join(os.fspath(folder), name)
        writer = df.write.mode("overwrite").option("compression", compression)
        if row_group_rows:
            writer = writer.option("parquet.block.row.count.limit", row_group_rows)
        writer.parquet(out[name])
    return out


def write_csv(df: DataFrame, path: str) -> None:
    """With a header; null is empty and the empty text is quoted."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_csv(spark, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


PIECE = 16 << 20  # bytes of a piece of an Arrow table, more or less


def _arrow_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        rows = max(1, PIECE * batch.num_rows // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, rows):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as writer:
                writer.write_batch(batch.slice(at, rows))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["part", "n", "data"])
            n += 1


def write_arrow(df: DataFrame, path: str) -> None:
    """A folder of Arrow streams, written by tasks: (part, n, data), each a piece of the table, in df's order by (part, n)."""
    df.mapInArrow(_arrow_pieces, "part int, n int, data binary").write.mode("overwrite").parquet(path)


def _arrow_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(0):
            yield from pa.ipc.open_stream(data.as_buffer())


def read_arrow(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of what write_arrow wrote."""
    return spark.read.schema("part int, n int, data binary").parquet(path).select("data").mapInArrow(_arrow_rows, schema)


def json_rows(df: DataFrame) -> DataFrame:
    """A JSON text a row, nulls kept."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_jsonl(df: DataFrame, path: str) -> None:
    json_rows(df).write.mode("overwrite").text(path)


def write_record_lines(pieces: DataFrame, path: str) -> None:
    """A folder of JSON lines, a record a line, from ``nested.fragments`` with ``whole``. Pieces are set apart by a space, which JSON allows between tokens."""
    line = F.when(F.col("part") == 2, F.concat("value", F.lit("\n"))).otherwise(F.col("value"))
    pieces.select(line.alias("value")).write.mode("overwrite").option("lineSep", " ").text(path)


class _Stream(io.RawIOBase):
    """A new file on any file system that Spark reaches; its folders are made too."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(os.fspath(path))
        self._fs = jvm.org.apache.hadoop.fs.FileSystem.newInstance(p.toUri() if p.isAbsolute() or p.toUri().getScheme() else jvm.java.io.File(".").toURI(), spark._jsc.hadoopConfiguration())
        self._fs.setWriteChecksum(False)
        self._out = self._fs.create(p, True)

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self._out.write(bytearray(data))
        return len(data)

    def close(self) -> None:
        if not self.closed:
            self._out.close()
            self._fs.close()
        super().close()


def opened(spark: SparkSession, path: str) -> io.BufferedWriter:
    return io.BufferedWriter(_Stream(spark, path), 1 << 20)


def _batches(df: DataFrame, schema: pa.Schema, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Rows as they come from partition after partition."""
    rows = iter(df.toLocalIterator())
    while held := list(islice(rows, size)):
        yield pa.RecordBatch.from_pylist([r.asDict(recursive=True) for r in held], schema)


def write_local(df: DataFrame, path: str, fmt: str) -> None:
    """One file: arrow, csv, json or jsonl. Rows come to the driver a partition at a time and go on in batches."""
    if fmt in ("json", "jsonl"):
        write_texts(df.sparkSession, ((r.value,) for r in json_rows(df).toLocalIterator()), path, fmt == "jsonl")
        return
    if fmt not in ("arrow", "csv"):
        raise ValueError(f"unsupported format: {fmt}")
    import pyarrow.csv
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(df.schema)
    with opened(df.sparkSession, path) as f, pa.PythonFile(f, "w") as sink:
        with pa.ipc.new_file(sink, schema) if fmt == "arrow" else pyarrow.csv.CSVWriter(sink, schema) as writer:
            for batch in _batches(df, schema):
                writer.write_batch(batch) if fmt == "arrow" else writer.write(batch)


def write_texts(spark: SparkSession, records: Iterable[Iterable[str]], path: str, lines: bool) -> int:
    """JSON records, each in one or more texts, as lines or as one array; returns their number."""
    n = 0
    with opened(spark, path) as f:
        f.write(b"" if lines else b"[")
        for record in records:
            f.write(b"," if n and not lines else b"")
            for text in record:
                f.write(text.encode())
            f.write(b"\n" if lines else b"")
            n += 1
        f.write(b"" if lines else b"]")
    return n


def to_pandas(tables: dict[str, DataFrame]) -> dict:
    """Arrow-backed pandas frames, so integers with nulls stay integers."""
    import pandas as pd

    return {name: df.toArrow().to_pandas(types_mapper=pd.ArrowDtype) for name, df in tables.items()}
