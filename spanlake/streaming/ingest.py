"""Incremental mode: OTLP/JSON files that arrive in a folder.

The four span-level tables are appended, and what each batch adds to its traces (minima, maxima and sums) is kept
beside them. Rollups merge these partials and read no spans; ``compact`` merges those of all batches so far into one.
Turns belong to a load, so they are told when the rollups are read. Every batch overwrites its own sub-folder, so a
batch that is run again after a failure leaves no rows twice.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.operators import tables
from spanlake.operators.normalize import normalize
from spanlake.schema import STREAMED, TRACES, conform
from spanlake.sources import otlp
from spanlake.sources.shared import drop, new_dir, saved_at


def ingest(spark: SparkSession, source: str, sink: str, checkpoint: str, glob: str = "*.json"):
    """Start a query that takes all files that are there (availableNow) and then ends."""
    files = spark.readStream.schema(otlp.DOCUMENT).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).json(source)
    files = files.select(F.lit(0).alias("path_ord"), F.split(F.col("_metadata.file_path"), "/").alias("path"), "resourceSpans")
    return files.writeStream.foreachBatch(lambda batch, k: store(otlp.flatten(batch), sink, k)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def store(raw: DataFrame, sink: str, batch_id: int) -> None:
    """A batch of raw spans: its tables, and its traces' partials. Later batches come later in the order of the input."""
    spark = raw.sparkSession
    at = new_dir(spark, "batch")
    try:
        wide = saved_at(normalize(raw), at)
        made = tables.all_tables(wide)
        for name in STREAMED:
            made[name].write.mode("overwrite").parquet(f"{sink}/{name}/batch={batch_id}")
        placed = wide.withColumn("ord", F.struct(F.lit(batch_id).cast("bigint").alias("batch"), F.col("ord").alias("ord")))
        tables.trace_partials(placed).write.mode("overwrite").parquet(f"{sink}/partials/batch={batch_id}")
    finally:
        drop(spark, at)


def _numbered(spark: SparkSession, pattern: str) -> dict[int, str]:
    """Finished sub-folders by the number in their names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.globStatus(p) or []]
    return {int(x.getName().rpartition("=")[2]): x.toString() for x in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))}


def partials(spark: SparkSession, sink: str) -> DataFrame:
    """The partials that make up all batches: the last compaction's, and those of the batches since."""
    batches, compacted = _numbered(spark, f"{sink}/partials/batch=*"), _numbered(spark, f"{sink}/compacted/upto=*")
    last = max(compacted, default=-1)
    paths = [path for k, path in compacted.items() if k == last] + [path for k, path in sorted(batches.items()) if k > last]
    if not paths:
        raise FileNotFoundError(f"{sink}: no batch was stored")
    return spark.read.schema(spark.read.parquet(paths[0]).schema).parquet(*paths)


def compact(spark: SparkSession, sink: str) -> None:
    """Merge the partials of all batches so far, so that reading rollups doesn't slow down with their number. Safe to be cut off and run again."""
    last = max(_numbered(spark, f"{sink}/partials/batch=*"))
    tables.merged_partials(partials(spark, sink)).write.mode("overwrite").parquet(f"{sink}/compacted/upto={last}")


def rolled(spark: SparkSession, sink: str) -> DataFrame:
    """The traces of what was stored, before turns, which need passes of their own."""
    return tables.rolled_up(tables.merged_partials(partials(spark, sink)))


def rollups(spark: SparkSession, sink: str) -> Mapping[str, DataFrame]:
    """All six tables of what was stored; traces and sessions from the partials."""
    by_trace = rolled(spark, sink)
    stored = {name: (lambda _, name=name: spark.read.parquet(f"{sink}/{name}").drop("batch")) for name in STREAMED}
    traces = lambda _: conform(tables.with_turns(by_trace), TRACES)
    return tables.Tables(stored | {"traces": traces, "sessions": lambda t: tables.sessions(t["traces"] if t.made("traces") else by_trace)})
