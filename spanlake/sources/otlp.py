"""OTLP/JSON sources: files, folders and payloads, flattened to one row a span."""

from __future__ import annotations

import os
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.functions.wire import KV, configure
from spanlake.sources import large
from spanlake.sources.shared import saved

SPAN = (
    f"traceId string,spanId string,parentSpanId string,name string,startTimeUnixNano string,endTimeUnixNano string,status struct<code:string,message:string>,"
    f"attributes {KV},events array<struct<name:string,attributes:{KV}>>,links array<struct<traceId:string,spanId:string>>"
)
RESOURCE, SCOPE = f"attributes {KV}", "name string,version string"
DOCUMENT = f"resourceSpans array<struct<resource:struct<{RESOURCE}>,scopeSpans:array<struct<scope:struct<{SCOPE}>,spans:array<struct<{SPAN}>>>>>>"
LARGE = 128 << 20  # bytes of a file beyond which many tasks read it
Paths = str | os.PathLike | Iterable[str | os.PathLike]


def path_list(path: Paths) -> list[str]:
    return [os.fspath(path)] if isinstance(path, (str, os.PathLike)) else [os.fspath(p) for p in path]


def kind_of(spark: SparkSession, path: str) -> str | None:
    """"file" or "folder", by the file system that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return None if not fs.exists(p) else "folder" if fs.getFileStatus(p).isDirectory() else "file"


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of all that is at or below a path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def _documents(spark: SparkSession, k: int, path: str, kind: str, most: int | None = None) -> DataFrame:
    reader = spark.read.schema(DOCUMENT).option("multiLine", True).option("mode", "FAILFAST")
    if kind == "folder":
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
    df = reader.json(path)
    if most is not None:
        df = df.filter(F.col("_metadata.file_size") <= most)
    return df.select(F.lit(k).alias("path_ord"), F.split(F.col("_metadata.file_path"), "/").alias("path"), "resourceSpans")


def _kinds(spark: SparkSession, path: Paths) -> list[tuple[int, str, str]]:
    """(place in the list, path, kind) of each path; a missing one raises."""
    out = []
    for k, p in enumerate(path_list(path)):
        kind = kind_of(spark, p)
        if kind is None:
            raise FileNotFoundError(p)
        out.append((k, p, kind))
    return out


def read_documents(spark: SparkSession, path: Paths) -> DataFrame:
    """One row a document, with its path's place in the list and its own path; a path listed twice is read twice.

    A file is read whatever its name; of a folder, every *.json below it. A missing path raises.
    """
    parts = [_documents(spark, *found) for found in _kinds(spark, path)]
    return reduce(DataFrame.unionByName, parts) if parts else payload_documents(spark, [])


def payload_documents(spark: SparkSession, payloads: Iterable[str] | DataFrame) -> DataFrame:
    """Documents from JSON texts in memory, in their order; those of a DataFrame are written first, so that their places stay."""
    no_path = F.array().cast("array<string>")
    if isinstance(payloads, DataFrame):
        placed = F.array(F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0"))
        df = saved(payloads.select(F.lit(0).alias("path_ord"), placed.alias("path"), F.col(payloads.columns[0]).alias("text")), "payloads")
    else:
        df = spark.createDataFrame(list(enumerate(payloads)), "path_ord int, text string").withColumn("path", no_path)
    parsed = F.from_json("text", DOCUMENT, {"mode": "FAILFAST"})
    return df.select("path_ord", "path", parsed["resourceSpans"].alias("resourceSpans"))


def _columns(df: DataFrame) -> DataFrame:
    """A raw span of each row with path_ord, path, r, s, p, span, resource_attributes and scope."""
    return df.select(
        F.struct("path_ord", "path", *(F.col(c).cast("bigint").alias(c) for c in "rsp")).alias("ord"),
        F.coalesce("span.traceId", F.lit("")).alias("trace_id"),
        F.coalesce("span.spanId", F.lit("")).alias("span_id"),
        F.col("span.parentSpanId").alias("parent_raw"),
        F.col("span.name").alias("name"),
        F.col("span.startTimeUnixNano").alias("start_raw"),
        F.col("span.endTimeUnixNano").alias("end_raw"),
        F.col("span.status.code").alias("status_raw"),
        F.col("span.status.message").alias("status_message_raw"),
        F.col("span.attributes").alias("attributes"),
        "resource_attributes",
        F.col("scope.name").alias("scope_name"),
        F.col("scope.version").alias("scope_version"),
        F.col("span.events").alias("events"),
        F.col("span.links").alias("links"),
    )


def flatten(documents: DataFrame) -> DataFrame:
    """One row a span, with its resource and scope and its place in the input (``ord``); missing levels give none."""
    configure(documents.sparkSession)
    at = ["path_ord", "path"]
    # What a row keeps of its level is told apart from the list before that is unnested: no row carries the list that it comes from.
    df = documents.select(*at, F.posexplode("resourceSpans").alias("r", "rs"))
    df = df.select(*at, "r", F.col("rs.resource.attributes").alias("resource_attributes"), F.col("rs.scopeSpans").alias("list"))
    df = df.select(*at, "r", "resource_attributes", F.posexplode("list").alias("s", "ss"))
    df = df.select(*at, "r", "s", "resource_attributes", F.struct(F.col("ss.scope.name").alias("name"), F.col("ss.scope.version").alias("version")).alias("scope"), F.col("ss.spans").alias("list"))
    return _columns(df.select(*at, "r", "s", "resource_attributes", "scope", F.posexplode("list").alias("p", "span")))


def _large_spans(spark: SparkSession, k: int, path: str, kind: str, least: int) -> DataFrame:
    """As flatten, of the files over ``least`` bytes. Resources and scopes meet their spans in a join: they may stand behind them."""
    configure(spark)
    texts = saved(large.whole(large.found(spark, path, kind == "folder", least)), "large", "kind")
    of = lambda name, schema: (texts.filter(F.col("kind") == name), F.from_json("text", schema, {"mode": "FAILFAST"}))
    (spans, span), (resources, resource), (scopes, scope) = of("span", SPAN), of("resource", RESOURCE), of("scope", SCOPE)
    df = spans.select("path", "r", "s", "p", span.alias("span"))
    df = df.join(resources.select("path", "r", resource["attributes"].alias("resource_attributes")), ["path", "r"], "left")
    df = df.join(scopes.select("path", "r", "s", scope.alias("scope")), ["path", "r", "s"], "left")
    return _columns(df.withColumns({"path_ord": F.lit(k), "path": F.split("path", "/")}))


def read_spans(spark: SparkSession, path: Paths, least: int = LARGE) -> DataFrame:
    """Raw spans of all documents. A file is one task's, unless it has over ``least`` bytes: then many tasks read it, at once."""
    parts = []
    for k, p, kind in _kinds(spark, path):
        if size_of(spark, p) > least and not large.files(spark, p, kind == "folder", least).isEmpty():
            parts.append(_large_spans(spark, k, p, kind, least))
            if kind == "folder":
                parts.append(flatten(_documents(spark, k, p, kind, least)))
        else:
            parts.append(flatten(_documents(spark, k, p, kind)))
    return reduce(DataFrame.unionByName, parts) if parts else flatten(payload_documents(spark, []))


def documents_of(spans: DataFrame) -> DataFrame:
    """The inverse of flatten, for fixtures: a JSON text for each trace, spans in order under their resource and scope.

    Nulls are written; missing lists are empty.
    """
    lit = F.lit
    # Written by to_json as a whole, not entry by entry: its native writer takes variants as they are.
    json = lambda c: F.to_json(c, {"ignoreNullFields": "false"})
    listed = lambda texts: F.concat(lit("["), F.coalesce(F.array_join(texts, ","), lit("")), lit("]"))
    full = lambda c: F.coalesce(c, F.array().cast(spans.schema[c].dataType)).alias(c)
    names = {"traceId": "trace_id", "spanId": "span_id", "parentSpanId": "parent_raw", "name": "name", "startTimeUnixNano": "start_raw", "endTimeUnixNano": "end_raw"}
    status = F.struct(F.col("status_raw").alias("code"), F.col("status_message_raw").alias("message")).alias("status")
    span = json(F.struct(*(F.col(c).alias(k) for k, c in names.items()), status, *(full(c) for c in ("attributes", "events", "links"))))
    scope = json(F.struct(F.col("scope_name").alias("name"), F.col("scope_version").alias("version")))
    kv = lambda c: F.coalesce(json(c), lit("[]"))
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("ord", c.alias("text")))), lambda x: x["text"])
    one = spans.groupBy("trace_id", kv(F.col("resource_attributes")).alias("resource"), scope.alias("scope")).agg(F.min("ord").alias("ord"), in_order(span).alias("spans"))
    block = F.concat(lit('{"resource":{"attributes":'), F.col("resource"), lit('},"scopeSpans":[{"scope":'), F.col("scope"), lit(',"spans":'), listed(F.col("spans")), lit("}]}"))
    return one.groupBy("trace_id").agg(in_order(block).alias("blocks")).select("trace_id", F.concat(lit('{"resourceSpans":'), listed(F.col("blocks")), lit("}")).alias("value"))
