"""The six output tables: names, columns, types and nullability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPEC, SPEC_VERSION = "at", "v2"
STREAMED = ("spans", "messages", "documents", "links")
ROLLUPS = ("traces", "sessions")
TABLES = STREAMED + ROLLUPS

LONG_TEXT = {"long_text": True}  # metadata of columns that hold free text

# Names, order, types and nullability of the columns.
SPANS = T.StructType(
    [
        T.StructField("spec", T.StringType(), False),
        T.StructField("spec_version", T.StringType(), False),
        T.StructField("trace_id", T.StringType(), False),
        T.StructField("span_id", T.StringType(), False),
        T.StructField("parent_span_id", T.StringType(), True),
        T.StructField("name", T.StringType(), True),
        T.StructField("kind", T.StringType(), True),
        T.StructField("convention", T.StringType(), True),
        T.StructField("status_code", T.StringType(), True),
        T.StructField("status_message", T.StringType(), True),
        T.StructField("start_time_unix_nano", T.LongType(), True),
        T.StructField("end_time_unix_nano", T.LongType(), True),
        T.StructField("duration_ns", T.LongType(), True),
        T.StructField("service_name", T.StringType(), True),
        T.StructField("scope_name", T.StringType(), True),
        T.StructField("scope_version", T.StringType(), True),
        T.StructField("session_id", T.StringType(), True),
        T.StructField("model_name", T.StringType(), True),
        T.StructField("tool_name", T.StringType(), True),
        T.StructField("agent_name", T.StringType(), True),
        T.StructField("input_tokens", T.LongType(), True),
        T.StructField("output_tokens", T.LongType(), True),
        T.StructField("total_tokens", T.LongType(), True),
        T.StructField("io_format", T.StringType(), True),
        T.StructField("input_text", T.StringType(), True, LONG_TEXT),
        T.StructField("output_text", T.StringType(), True, LONG_TEXT),
        T.StructField("raw_attributes_json", T.StringType(), True, LONG_TEXT),
    ]
)
MESSAGES = T.StructType(
    [
        T.StructField("spec", T.StringType(), False),
        T.StructField("spec_version", T.StringType(), False),
        T.StructField("trace_id", T.StringType(), False),
        T.StructField("span_id", T.StringType(), False),
        T.StructField("position", T.IntegerType(), False),
        T.StructField("direction", T.StringType(), True),
        T.StructField("role", T.StringType(), True),
        T.StructField("content", T.StringType(), True, LONG_TEXT),
        T.StructField("tool_call_id", T.StringType(), True),
    ]
)
DOCUMENTS = T.StructType(
    [
        T.StructField("spec", T.StringType(), False),
        T.StructField("spec_version", T.StringType(), False),
        T.StructField("trace_id", T.StringType(), False),
        T.StructField("span_id", T.StringType(), False),
        T.StructField("position", T.IntegerType(), False),
        T.StructField("document_id", T.StringType(), True),
        T.StructField("content", T.StringType(), True, LONG_TEXT),
        T.StructField("score", T.DoubleType(), True),
    ]
)
LINKS = T.StructType(
    [
        T.StructField("spec", T.StringType(), False),
        T.StructField("spec_version", T.StringType(), False),
        T.StructField("trace_id", T.StringType(), False),
        T.StructField("span_id", T.StringType(), False),
        T.StructField("linked_trace_id", T.StringType(), True),
        T.StructField("linked_span_id", T.StringType(), True),
    ]
)
TRACES = T.StructType(
    [
        T.StructField("spec", T.StringType(), False),
        T.StructField("spec_version", T.StringType(), False),
        T.StructField("trace_id", T.StringType(), False),
        T.StructField("session_id", T.StringType(), True),
        T.StructField("session_turn", T.IntegerType(), True),
        T.StructField("root_span_id", T.StringType(), True),
        T.StructField("root_span_name", T.StringType(), True),
        T.StructField("service_name", T.StringType(), True),
        T.StructField("start_time_unix_nano", T.LongType(), True),
        T.StructField("end_time_unix_nano", T.LongType(), True),
        T.StructField("duration_ns", T.LongType(), True),
        T.StructField("span_count", T.LongType(), True),
        T.StructField("error_count", T.LongType(), True),
        T.StructField("status", T.StringType(), True),
        T.StructField("total_input_tokens", T.LongType(), True),
        T.StructField("total_output_tokens", T.LongType(), True),
        T.StructField("total_tokens", T.LongType(), True),
    ]
)
SESSIONS = T.StructType(
    [
        T.StructField("spec", T.StringType(), False),
        T.StructField("spec_version", T.StringType(), False),
        T.StructField("session_id", T.StringType(), False),
        T.StructField("trace_count", T.LongType(), True),
        T.StructField("span_count", T.LongType(), True),
        T.StructField("error_count", T.LongType(), True),
        T.StructField("start_time_unix_nano", T.LongType(), True),
        T.StructField("end_time_unix_nano", T.LongType(), True),
        T.StructField("duration_ns", T.LongType(), True),
        T.StructField("total_input_tokens", T.LongType(), True),
        T.StructField("total_output_tokens", T.LongType(), True),
        T.StructField("total_tokens", T.LongType(), True),
    ]
)
SCHEMAS = {"spans": SPANS, "messages": MESSAGES, "documents": DOCUMENTS, "links": LINKS, "traces": TRACES, "sessions": SESSIONS}
DIM = T.StructType(
    [
        T.StructField("spec", T.StringType(), False),
        T.StructField("spec_version", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("span_count", T.LongType(), False),
        T.StructField("trace_count", T.LongType(), False),
    ]
)


def conform(df: DataFrame, schema: T.StructType, *more: str) -> DataFrame:
    """The columns of a schema, cast, in order, with its nullability and metadata, and further columns as they are."""

    def one(f: T.StructField) -> Column:
        if f.name in ("spec", "spec_version") and f.name not in df.columns:
            return F.lit(SPEC if f.name == "spec" else SPEC_VERSION).alias(f.name, metadata=f.metadata)
        c = F.col(f.name).cast(f.dataType)
        return (c if f.nullable else F.coalesce(c, F.lit("" if f.dataType == T.StringType() else 0).cast(f.dataType))).alias(f.name, metadata=f.metadata)

    return df.select(*(one(f) for f in schema.fields), *more)


def check_spec(spec: str) -> None:
    if spec in ("at", "at/v2"):
        return
    if spec == "at/v1":
        raise ValueError("spec 'at/v1' is not supported any more; 'at/v2' adds session_id, session_turn and the sessions table: extract again from the raw OTLP/JSON")
    raise ValueError(f"unsupported spec: {spec}")
