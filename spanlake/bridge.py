"""The driver's tables as raw spans, so that every operator runs on them.

``events``: a span an event; session and trace by user and day; the event type picks the
convention. ``conversations``: a span a turn, with its message as an event. ``documents``: a
retriever span a document. The mapping is ours; the queries' SQL states the same from the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.functions.wire import KV

EVENTS = f"array<struct<name:string,attributes:{KV}>>"
LINKS = "array<struct<traceId:string,spanId:string>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    """Partitions of a shuffle that computes much: those of the session's shuffles, and four for each core at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """A table of few parts over all cores: decoding computes much on few bytes."""
    n = parts(df.sparkSession)
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def text(c) -> Column:
    """An AnyValue holding a text."""
    return F.to_variant_object(F.struct((c if isinstance(c, Column) else F.lit(c)).cast("string").alias("stringValue")))


def whole(c: Column) -> Column:
    """An AnyValue holding an integer, as exporters write it."""
    return F.to_variant_object(F.struct(c.cast("string").alias("intValue")))


def value(c) -> Column:
    """An AnyValue from its JSON."""
    return F.parse_json(c if isinstance(c, Column) else F.lit(c))


def attrs(*pairs) -> Column:
    return F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs))


def event_attributes() -> Column:
    """Attributes of an event, in the convention that its type stands for."""
    n, user = F.col("event_id"), F.col("user_id")
    said = lambda head: text(F.concat(F.lit(head), n.cast("string")))
    session = ("session.id", text(F.concat(F.lit("user-"), user.cast("string"))))
    own = (
        F.when(
            F.col("event_type") == "click",
            attrs(
                ("openinference.span.kind", text("llm")), ("llm.model_name", text(F.concat(F.lit("m"), (user % 3).cast("string")))), ("llm.token_count.prompt", whole(n % 100)), ("llm.token_count.completion", whole(F.lit(7))),
                ("llm.input_messages.0.message.role", text("user")), ("llm.input_messages.0.message.content", said("hi ")), ("llm.output_messages.10.message.content", said("yo ")), ("llm.output_messages.2.message.role", text("assistant")), ("extra", whole(n)),
            ),
        )
        .when(F.col("event_type") == "view", attrs(("gen_ai.operation.name", text("execute_tool")), ("gen_ai.tool.name", text(F.concat(F.lit("t"), (user % 4).cast("string")))), ("gen_ai.tool.call.arguments", text('{"a": 1}')), ("gen_ai.tool.call.id", said("c")), ("gen_ai.agent.name", text(F.concat(F.lit("a"), (user % 3).cast("string")))), ("gen_ai.usage.input_tokens", text("many")), ("gen_ai.usage.prompt_tokens", whole(n % 9))))
        .when(F.col("event_type") == "purchase", attrs(("ai.model.id", text("gpt-x")), ("ai.usage.promptTokens", whole(n % 50)), ("ai.usage.completionTokens", text("3.7")), ("ai.prompt", said("buy ")), ("ai.response.text", text("ok"))))
        .when(F.col("event_type") == "signup", attrs(("mlflow.spanType", text("Chain")), ("mlflow.spanInputs", said("in ")), ("mlflow.spanOutputs", text("")), ("output.value", text("done"))))
        .otherwise(attrs(("traceloop.span.kind", text("agent")), ("traceloop.entity.input", said("q ")), ("http.code", whole(F.lit(500))), ("ratio", value('{"doubleValue":2.50}')), ("deep", value('{"arrayValue":{"values":[{"stringValue":"a"},{"intValue":"1"}]}}'))))
    ).cast(KV)
    return F.when(n % 7 == 0, own).otherwise(F.concat(own, attrs(session)))


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw spans of ``events``; a trace's least event is the parent of its others, but for every eleventh, whose parent is nowhere."""
    df = table(spark, sf_dir, "events")
    n = F.col("event_id").cast("string")
    start = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    df = df.withColumns({"trace_id": F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyy-MM-dd")), "start": start, "end": start + F.floor(F.col("value") * 1000000).cast("bigint")})
    # The parent by one aggregate and a join on the trace, not by a window over whole rows; both read one shuffle, whose
    # parts stay apart: Spark would put them together by their bytes, and normalisation computes much on few bytes.
    df = df.repartition(parts(spark), "trace_id")
    least = df.groupBy("trace_id").agg(F.min("event_id").alias("least"))
    df = df.join(least, "trace_id")
    said = F.array(F.struct(F.lit("gen_ai.tool.message").alias("name"), attrs(("content", text(F.concat(F.lit("res "), n)))).alias("attributes"))).cast(EVENTS)
    linked = F.array(F.struct(F.col("trace_id").alias("traceId"), F.lit("").alias("spanId")), F.struct(F.lit(None).cast("string").alias("traceId"), F.col("least").cast("string").alias("spanId"))).cast(LINKS)
    return df.select(
        F.struct(F.lit(0).alias("path_ord"), F.array(F.lit("events")).alias("path"), F.lit(0).alias("r"), F.lit(0).alias("s"), F.col("event_id").alias("p")).alias("ord"),
        "trace_id", n.alias("span_id"), F.when(F.col("event_id") == F.col("least"), "").when(F.col("event_id") % 11 == 0, "gone").otherwise(F.col("least").cast("string")).alias("parent_raw"), F.col("event_type").alias("name"),
        F.col("start").cast("string").alias("start_raw"), F.col("end").cast("string").alias("end_raw"),
        F.when(F.col("event_type") == "error", "STATUS_CODE_ERROR").when(F.col("event_type") == "view", "2").when(F.col("event_type") != "signup", "OK").alias("status_raw"), F.when(F.col("event_type") == "error", "bad").otherwise("").alias("status_message_raw"),
        event_attributes().alias("attributes"), attrs(("service.name", text(F.concat(F.lit("svc"), (F.col("user_id") % 5).cast("string"))))).cast(KV).alias("resource_attributes"),
        F.lit("scope").alias("scope_name"), F.lit("1").alias("scope_version"), F.when(F.col("event_type") == "view", said).alias("events"), F.when(F.col("event_type") == "purchase", linked).alias("links"),
    )


def raw_conversations(spark: SparkSession, sf_dir: str, adk: bool = False) -> DataFrame:
    """Raw GenAI spans, one a turn; its message is an event or, with adk, a JSON request or response."""
    df = table(spark, sf_dir, "conversations")
    role, said = F.col("role"), F.coalesce("text", F.lit(""))
    name = F.when(role == "assistant", "gen_ai.assistant.message").when(role == "system", "gen_ai.system.message").otherwise("gen_ai.user.message")
    event = F.array(F.struct(name.alias("name"), attrs(("content", text(said))).alias("attributes"))).cast(EVENTS)
    content = lambda r: F.struct(F.lit(r).alias("role"), F.array(F.struct(said.alias("text"))).alias("parts"))
    system = F.struct(F.array().cast("array<struct<role:string,parts:array<struct<text:string>>>>").alias("contents"), F.struct(said.alias("system_instruction")).alias("config"))
    user = F.struct(F.array(content("user")).alias("contents"), F.struct(F.lit(None).cast("string").alias("system_instruction")).alias("config"))
    own = attrs(("gen_ai.operation.name", text("chat")), ("gen_ai.conversation.id", text(F.col("conv_id").cast("string"))))
    if adk:
        ask = F.when(role == "system", F.to_json(system)).otherwise(F.to_json(user))
        answer = F.to_json(F.struct(content("model").alias("content")))
        own = F.concat(own, F.when(role == "assistant", attrs(("gcp.vertex.agent.llm_response", text(answer)))).otherwise(attrs(("gcp.vertex.agent.llm_request", text(ask)))))
    none = F.lit(None).cast("string")
    return df.select(
        F.struct(F.lit(0).alias("path_ord"), F.array(F.lit("c")).alias("path"), F.lit(0).alias("r"), F.lit(0).alias("s"), F.col("turn").alias("p")).alias("ord"),
        F.col("conv_id").cast("string").alias("trace_id"), F.col("turn").cast("string").alias("span_id"), F.when(F.col("turn") > 0, (F.col("turn") - 1).cast("string")).alias("parent_raw"), F.lit("chat").alias("name"),
        F.col("turn").cast("string").alias("start_raw"), none.alias("end_raw"), none.alias("status_raw"), none.alias("status_message_raw"), own.cast(KV).alias("attributes"), F.array().cast(KV).alias("resource_attributes"),
        none.alias("scope_name"), none.alias("scope_version"), (F.array().cast(EVENTS) if adk else event).alias("events"), F.array().cast(LINKS).alias("links"),
    )


def raw_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of ``events`` that follow no vendor's convention: every other one has a generic input, the rest attributes that nothing knows."""
    n = F.col("event_id")
    raw = raw_events(spark, sf_dir).withColumn("event_id", F.col("ord.p"))
    generic = attrs(("input.value", text(F.concat(F.lit("in "), n.cast("string")))), ("user.flag", value('{"boolValue":true}')), ("left", whole(n)))
    unknown = attrs(("custom", text(F.concat(F.lit("x "), n.cast("string")))), ("list", value(F.concat(F.lit('{"arrayValue":{"values":[{"intValue":"'), n.cast("string"), F.lit('"},{"kvlistValue":{"values":[{"key":"k","value":{"doubleValue":0.5}}]}}]}}')))))
    return raw.withColumns({"attributes": F.when(n % 2 == 0, generic.cast(KV)).otherwise(unknown.cast(KV)), "events": F.array().cast(EVENTS), "links": F.array().cast(LINKS)}).drop("event_id")


def raw_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GenAI spans of ``conversations`` whose JSON request holds an instruction, a text, a call and its answer; assistants answer with a call."""
    turn = F.col("span_id")
    call = lambda name: F.concat(F.lit('{"function_call":{"id":"c'), turn, F.lit(f'","name":"{name}","args":{{"n":'), turn, F.lit("}}}"))
    answer = F.concat(F.lit('{"function_response":{"id":"c'), turn, F.lit('","name":"look","response":{"ok":true,"n":'), turn, F.lit("}}}"))
    ask = F.concat(F.lit('{"contents":[{"role":"user","parts":[{"text":"t '), turn, F.lit('"},'), call("look"), F.lit(']},{"parts":['), answer, F.lit(']}],"config":{"system_instruction":"be brief"}}'))
    told = F.concat(F.lit('{"content":{"role":"model","parts":['), call("act"), F.lit("]}}"))
    own = attrs(("gen_ai.operation.name", text("chat")), ("gcp.vertex.agent.llm_request", text(ask)), ("gcp.vertex.agent.llm_response", text(told)))
    return raw_conversations(spark, sf_dir, adk=True).withColumn("attributes", own.cast(KV))


def raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw OpenInference spans, a retriever of one document each, at its raw index."""
    df = table(spark, sf_dir, "documents")
    at = (F.col("doc_id") % 3).cast("string")
    key = lambda suffix: F.concat(F.lit("retrieval.documents."), at, F.lit(f".document.{suffix}"))
    entry = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    own = F.array(
        entry(F.lit("openinference.span.kind"), text("RETRIEVER")), entry(F.lit("retrieval.query"), text(F.col("lang"))), entry(key("id"), text(F.col("doc_id"))), entry(key("content"), text(F.coalesce("text", F.lit("")))),
        entry(key("score"), F.to_variant_object(F.struct((F.col("n_chars") / 4).alias("doubleValue")))),
    )
    none = F.lit(None).cast("string")
    return df.select(
        F.struct(F.lit(0).alias("path_ord"), F.array(F.lit("d")).alias("path"), F.lit(0).alias("r"), F.lit(0).alias("s"), F.col("doc_id").alias("p")).alias("ord"),
        F.col("source").alias("trace_id"), F.col("doc_id").cast("string").alias("span_id"), none.alias("parent_raw"), F.lit("retrieve").alias("name"), none.alias("start_raw"), none.alias("end_raw"), F.lit("OK").alias("status_raw"), none.alias("status_message_raw"),
        own.cast(KV).alias("attributes"), F.array().cast(KV).alias("resource_attributes"), none.alias("scope_name"), none.alias("scope_version"), F.array().cast(EVENTS).alias("events"), F.array().cast(LINKS).alias("links"),
    )
