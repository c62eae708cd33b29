"""Detection and extraction: raw spans to wide spans.

A wide span has the columns of the spans table, its place in the input, and its messages,
documents and links as arrays. Every rule is a column expression over two maps of decoded
attributes: ``t`` (text) and ``v`` (the values as they came). ``consumed`` collects the keys that a rule
took; the others are left in raw_attributes_json.
"""

from __future__ import annotations

from functools import lru_cache, reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.functions.wire import computed_once, configure, filled, json_of, keyed, literal_map, mapped, nano, quoted, status, text_of, texts_of, to_float, to_int

# Attribute keys and names of the conventions.
SESSION_KEYS = ("gen_ai.conversation.id", "session.id", "gcp.vertex.agent.session_id", "ai.telemetry.metadata.sessionId", "mlflow.trace.session", "traceloop.association.properties.session_id")
OPENINFERENCE_PREFIXES = ("llm.", "tool.", "retrieval.", "embedding.", "reranker.")
KINDS = ("AGENT", "LLM", "CHAIN", "TOOL", "RETRIEVER", "EMBEDDING", "RERANKER", "GUARDRAIL", "EVALUATOR")
GENAI_KINDS = {"chat": "LLM", "text_completion": "LLM", "generate_content": "LLM", "embeddings": "EMBEDDING", "execute_tool": "TOOL", "invoke_agent": "AGENT", "create_agent": "AGENT"}

MESSAGE = "struct<direction:string,role:string,content:string,tool_call_id:string>"
DOC = "struct<position:int,document_id:string,content:string,score:double>"


def _none(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def _any_prefix(names: Column, *prefixes: str) -> Column:
    return F.exists(names, lambda n: reduce(lambda a, b: a | b, (n.startswith(p) for p in prefixes)))


def convention(t: Column, events: Column) -> Column:
    """Which convention a span follows, most specific first."""
    keys = F.map_keys(t)
    genai = _any_prefix(keys, "gen_ai.")
    event = F.coalesce(F.exists(events, lambda e: F.coalesce(e["name"], F.lit("")).startswith("gen_ai.")), F.lit(False))
    return (
        F.when(F.map_contains_key(t, "openinference.span.kind") | (_any_prefix(keys, *OPENINFERENCE_PREFIXES) & ~genai), "openinference")
        .when(genai | event, "otel_genai")
        .when(_any_prefix(keys, "ai."), "vercel_ai")
        .when(_any_prefix(keys, "mlflow."), "mlflow")
        .when(_any_prefix(keys, "traceloop."), "traceloop")
        .when(F.map_contains_key(t, "input.value") | F.map_contains_key(t, "output.value"), "generic")
        .otherwise("unknown")
    )


def session_id(t: Column) -> Column:
    return F.coalesce(*(filled(t[k]) for k in SESSION_KEYS))


def _taken(*pairs) -> Column:
    """Keys whose condition holds; null for the others."""
    return F.array(*(F.when(c, F.lit(k)) for k, c in pairs))


def session_taken(t: Column) -> Column:
    """Session keys up to the one that won."""
    free, pairs = F.lit(True), []
    for k in SESSION_KEYS:
        pairs.append((k, free & F.map_contains_key(t, k)))
        free = free & filled(t[k]).isNull()
    return _taken(*pairs)


def openinference_kind(text: Column) -> Column:
    known = literal_map({k: k for k in KINDS})
    # Most kinds are ASCII; Spark's upper asks ICU, which is slow.
    return F.coalesce(known[text], known[F.translate(text, ascii_lowercase, ascii_uppercase)], known[F.upper(text)], F.lit("UNKNOWN"))


def genai_kind(text: Column) -> Column:
    return F.coalesce(literal_map(GENAI_KINDS)[text], F.lit("UNKNOWN"))


def event_role(name: Column) -> Column:
    part = F.split(name, r"\.")
    return F.when((F.size(part) >= 3) & (part[0] == "gen_ai") & (F.get(part, F.lit(2)) == "message"), F.get(part, F.lit(1))).when(name == "gen_ai.choice", "assistant")


def joined(messages: Column) -> Column:
    """"[role] content" lines; null without messages."""
    line = lambda m: F.concat(F.lit("["), F.coalesce(filled(m["role"]), F.lit("?")), F.lit("] "), F.coalesce(m["content"], F.lit("")))
    return F.when(F.size(messages) > 0, F.array_join(F.transform(messages, line), "\n"))


def indexed(t: Column, prefix: str) -> Column:
    """(key, index, rest, value) of keys prefix.N.rest, N as an integer."""
    n = len(prefix) + 2
    split = lambda e: F.struct(e["key"].alias("key"), F.substring_index(e["key"].substr(n, 1 << 20), ".", 1).alias("n"), F.regexp_replace(e["key"].substr(n, 1 << 20), r"^[^.]*\.?", "").alias("rest"), e["value"].alias("value"))
    got = F.transform(F.filter(F.map_entries(t), lambda e: e["key"].startswith(prefix + ".")), split)
    return F.transform(F.filter(got, lambda x: x["n"].rlike(r"^\s*[+-]?\d+(_\d+)*\s*$")), lambda x: F.struct(x["key"].alias("key"), F.regexp_replace(x["n"], r"[_\s]", "").cast("bigint").alias("i"), x["rest"].alias("rest"), x["value"].alias("value")))


def _value(found: Column, i: Column, rest: str) -> Column:
    """The last value of an index and suffix."""
    return F.try_element_at(F.filter(found, lambda x: (x["i"] == i) & (x["rest"] == rest)), F.lit(-1))["value"]


def said_at(t: Column, prefix: str) -> Column:
    """The entries that make indexed messages; a key of another suffix makes none."""
    return F.filter(indexed(t, prefix), lambda x: x["rest"].isin("message.role", "message.content"))


def indexed_messages(found: Column, direction: str) -> Column:
    """Messages by index."""
    at = F.array_sort(F.array_distinct(F.transform(found, lambda x: x["i"])))
    made = F.transform(at, lambda i: F.struct(F.lit(direction).alias("direction"), _value(found, i, "message.role").alias("role"), _value(found, i, "message.content").alias("content"), _none().alias("tool_call_id")))
    return made.cast(f"array<{MESSAGE}>")


def indexed_documents(found: Column) -> Column:
    """Documents by index, which is their position; any suffix under an index makes one."""
    at = F.array_sort(F.array_distinct(F.transform(found, lambda x: x["i"])))
    made = F.transform(at, lambda i: F.struct(i.cast("int").alias("position"), _value(found, i, "document.id").alias("document_id"), _value(found, i, "document.content").alias("content"), to_float(_value(found, i, "document.score")).alias("score")))
    return made.cast(f"array<{DOC}>")


def _first_int(t: Column, v: Column, *keys: str) -> tuple[Column, list]:
    free, pairs, values = F.lit(True), [], []
    for k in keys:
        value = to_int(t[k], v[k])
        pairs.append((k, free & F.map_contains_key(t, k)))
        values.append(value)
        free = free & value.isNull()
    return F.coalesce(*values), pairs


def first_int_of(t: Column, v: Column, *keys: str) -> Column:
    """The first of the keys' values that is an integer."""
    return _first_int(t, v, *keys)[0]


def _result(**own) -> dict[str, Column]:
    """All extracted columns; those not given are empty."""
    base = dict.fromkeys(("kind", "model_name", "tool_name", "agent_name", "io_format", "input_text", "output_text"), _none())
    base |= dict.fromkeys(("input_tokens", "output_tokens", "total_tokens"), _none("bigint"))
    base |= {"messages": F.array().cast(f"array<{MESSAGE}>"), "documents": F.array().cast(f"array<{DOC}>"), "taken": F.array().cast("array<string>")}
    return base | own


def _or(a: Column, b: Column) -> Column:
    """a unless it is null or empty."""
    return F.when(filled(a).isNull(), b).otherwise(a)


def openinference_found(t: Column) -> dict[str, Column]:
    """The entries under indexed prefixes, as columns: what is read more than once is computed once."""
    return {"oi_in": said_at(t, "llm.input_messages"), "oi_out": said_at(t, "llm.output_messages"), "oi_at": indexed(t, "retrieval.documents")}


def openinference_lists() -> dict[str, Column]:
    return {"oi_asked": indexed_messages(F.col("oi_in"), "input"), "oi_said": indexed_messages(F.col("oi_out"), "output"), "oi_docs": indexed_documents(F.col("oi_at"))}


def openinference(t: Column, v: Column) -> dict[str, Column]:
    has = lambda k: F.map_contains_key(t, k)
    kind = F.when(has("openinference.span.kind"), openinference_kind(F.coalesce(t["openinference.span.kind"], F.lit("None"))))
    model = F.when(has("llm.model_name"), t["llm.model_name"]).when(has("llm.model"), t["llm.model"])
    tokens = {c: to_int(t[k], v[k]) for c, k in (("input_tokens", "llm.token_count.prompt"), ("output_tokens", "llm.token_count.completion"), ("total_tokens", "llm.token_count.total"))}
    asked, said, docs = F.col("oi_asked"), F.col("oi_said"), F.col("oi_docs")
    keys = lambda found: F.transform(found, lambda x: x["key"])
    doc_keys = keys(F.filter("oi_at", lambda x: x["rest"].isin("document.id", "document.content", "document.score")))
    given = _or(t["tool.parameters"], F.when(has("retrieval.query"), t["retrieval.query"]).otherwise(t["tool.parameters"]))
    io = F.when(F.coalesce(kind == "RETRIEVER", F.lit(False)) | (F.size(docs) > 0), "retrieval").when(F.coalesce(kind == "TOOL", F.lit(False)) | filled(t["tool.name"]).isNotNull(), "tool_call").when((F.size(asked) > 0) | (F.size(said) > 0), "text")
    text = F.coalesce(io == "text", F.lit(False))
    single = ("openinference.span.kind", "tool.name", "agent.name", "llm.token_count.prompt", "llm.token_count.completion", "llm.token_count.total", "tool.parameters", "tool.output_value", "retrieval.query")
    taken = F.concat(_taken(*((k, has(k)) for k in single), ("llm.model_name", has("llm.model_name")), ("llm.model", has("llm.model") & ~has("llm.model_name"))), keys(F.col("oi_in")), keys(F.col("oi_out")), doc_keys)
    return _result(
        kind=kind, model_name=model, tool_name=t["tool.name"], agent_name=t["agent.name"], **tokens, io_format=io, messages=F.concat(asked, said), documents=docs, taken=taken,
        input_text=F.when(text & filled(given).isNull() & (F.size(asked) > 0), joined(asked)).otherwise(given),
        output_text=F.when(text & filled(t["tool.output_value"]).isNull() & (F.size(said) > 0), joined(said)).otherwise(t["tool.output_value"]),
    )


CONTENT = "struct<role:string,parts:array<string>>"
REQUEST = f"contents array<{CONTENT}>, config struct<system_instruction:string>"


def content_messages(content: Column, direction: str) -> Column:
    """Messages of one content block: a text, a call or a response for each part."""
    role = F.coalesce(filled(content["role"]), F.lit("user"))
    role = F.when(role == "model", "assistant").otherwise(role)

    def one(parsed: Column) -> Column:
        part, keys = parsed["part"], parsed["keys"]
        call = F.coalesce(part["function_call"], F.lit("{}"))
        answer = F.coalesce(part["function_response"], F.lit("{}"))
        inner = F.from_json(answer, "response string, id string")
        payload = F.when(F.array_contains(F.json_object_keys(answer), "response"), _json_compact(inner["response"])).otherwise(_json_compact(answer))
        made = lambda role, content, call_id: F.struct(F.lit(direction).alias("direction"), role.alias("role"), content.alias("content"), call_id.alias("tool_call_id"))
        return (
            F.when(F.array_contains(keys, "text") & part["text"].isNotNull(), made(role, part["text"], _none()))
            .when(F.array_contains(keys, "function_call"), made(role, _json_compact(call), F.get_json_object(call, "$.id")))
            .when(F.array_contains(keys, "function_response"), made(F.lit("tool"), payload, inner["id"]))
        )

    parse = lambda raw: F.struct(F.from_json(raw, "text string, function_call string, function_response string").alias("part"), F.json_object_keys(raw).alias("keys"))
    parts = F.filter(F.transform(F.coalesce(content["parts"], F.array().cast("array<string>")), parse), lambda x: x["keys"].isNotNull())
    return F.filter(F.transform(parts, one), lambda m: m.isNotNull()).cast(f"array<{MESSAGE}>")


def _json_compact(c: Column) -> Column:
    """JSON text without white space outside strings; a bare text comes back quoted."""
    tight = F.regexp_replace(c, r'("(?:[^"\\]|\\.)*")|\s+', "$1")
    bare = c.rlike(r"^\s*([\[{]|-?\d|true$|false$|null$)")
    return F.when(c.isNull(), "null").when(bare, tight).otherwise(quoted(c))


ASK, ANSWER = "gcp.vertex.agent.llm_request", "gcp.vertex.agent.llm_response"


def genai_found(t: Column, said_events: Column) -> dict[str, Column]:
    """Messages of the events, and the JSON request and response, parsed; said_events: (name, content) of the span's events whose name starts with gen_ai."""
    answers = ("gen_ai.choice", "gen_ai.assistant.message", "gen_ai.tool.message")
    made = F.transform(said_events, lambda e: F.struct(F.when(e["name"].isin(*answers), "output").otherwise("input").alias("direction"), event_role(e["name"]).alias("role"), e["content"].alias("content"), F.when(e["name"] == "gen_ai.tool.message", t["gen_ai.tool.call.id"]).alias("tool_call_id"))).cast(f"array<{MESSAGE}>")
    answer = F.from_json(t[ANSWER], "content string")["content"]
    return {
        "ga_made": made, "ga_request": F.from_json(t[ASK], REQUEST), "ga_ask_ok": F.coalesce(F.json_object_keys(t[ASK]).isNotNull(), F.lit(False)),
        "ga_answer": F.from_json(answer, "role string, parts array<string>"), "ga_answer_ok": F.coalesce(F.json_object_keys(answer).isNotNull(), F.lit(False)),
    }


def genai_lists() -> dict[str, Column]:
    """Messages asked and said: the events' or, without any, those of the JSON request and response."""
    none = F.array().cast(f"array<{MESSAGE}>")
    request = F.col("ga_request")
    system = filled(request["config"]["system_instruction"])
    first = F.when(system.isNotNull(), F.array(F.struct(F.lit("input").alias("direction"), F.lit("system").alias("role"), system.alias("content"), _none().alias("tool_call_id"))).cast(f"array<{MESSAGE}>")).otherwise(none)
    rest = F.flatten(F.transform(F.coalesce(request["contents"], F.array().cast(f"array<{CONTENT}>")), lambda c: content_messages(c, "input")))
    live = F.size("ga_made") > 0
    return {
        "ga_asked": F.when(live, F.filter("ga_made", lambda m: m["direction"] == "input")).otherwise(F.when(F.col("ga_ask_ok"), F.concat(first, rest)).otherwise(none)),
        "ga_said": F.when(live, F.filter("ga_made", lambda m: m["direction"] == "output")).otherwise(F.when(F.col("ga_answer_ok"), content_messages(F.col("ga_answer"), "output")).otherwise(none)),
    }


def genai(t: Column, v: Column) -> dict[str, Column]:
    has = lambda k: F.map_contains_key(t, k)
    op, asked_model, told_model = t["gen_ai.operation.name"], t["gen_ai.request.model"], t["gen_ai.response.model"]
    model = F.when(filled(asked_model).isNull() & has("gen_ai.response.model"), told_model).otherwise(asked_model)
    kind = F.when(op.isNotNull(), genai_kind(op)).when(filled(model).isNotNull() | _any_prefix(F.map_keys(t), "gen_ai.usage."), "LLM")
    tin, k1 = _first_int(t, v, "gen_ai.usage.input_tokens", "gen_ai.usage.prompt_tokens")
    tout, k2 = _first_int(t, v, "gen_ai.usage.output_tokens", "gen_ai.usage.completion_tokens")
    total, k3 = _first_int(t, v, "gen_ai.usage.total_tokens")
    asked, said = F.col("ga_asked"), F.col("ga_said")
    live = F.size("ga_made") > 0
    args, result = "gcp.vertex.agent.tool_call_args", "gcp.vertex.agent.tool_response"
    own = t["gen_ai.tool.call.arguments"]
    use_args = has(args) & filled(own).isNull()
    given, got = F.when(use_args, t[args]).otherwise(own), t[result]
    chatty, tool = F.coalesce(kind.isin("LLM", "AGENT"), F.lit(False)), F.coalesce(kind == "TOOL", F.lit(False))
    taken = _taken(
        ("gen_ai.operation.name", op.isNotNull()), ("gen_ai.request.model", has("gen_ai.request.model")), ("gen_ai.response.model", has("gen_ai.response.model") & filled(asked_model).isNull()),
        *((k, has(k)) for k in ("gen_ai.tool.name", "gen_ai.agent.name", "gen_ai.tool.call.arguments", "gen_ai.tool.call.id")), *k1, *k2, *k3,
        (ASK, ~live & F.col("ga_ask_ok")), (ANSWER, ~live & F.col("ga_answer_ok")), (args, use_args), (result, has(result)),
    )
    return _result(
        kind=kind, model_name=model, tool_name=t["gen_ai.tool.name"], agent_name=t["gen_ai.agent.name"], input_tokens=tin, output_tokens=tout, total_tokens=total,
        messages=F.concat(asked, said), taken=taken, io_format=F.when(tool, "tool_call").when(chatty | F.coalesce(kind == "EMBEDDING", F.lit(False)), "text"),
        input_text=F.when(chatty & filled(given).isNull() & (F.size(asked) > 0), joined(asked)).otherwise(given),
        output_text=F.when(tool & filled(got).isNull() & (F.size(said) > 0), F.get(said, F.lit(0))["content"]).when(chatty & filled(got).isNull() & (F.size(said) > 0), joined(said)).otherwise(got),
    )


def vercel(t: Column, v: Column) -> dict[str, Column]:
    has = lambda k: F.map_contains_key(t, k)
    given = F.when(has("ai.prompt"), _or(t["ai.toolCall.args"], t["ai.prompt"])).otherwise(t["ai.toolCall.args"])
    got = F.when(has("ai.response.text"), _or(t["ai.toolCall.result"], t["ai.response.text"])).otherwise(t["ai.toolCall.result"])
    some = F.coalesce(filled(t["ai.model.id"]), filled(given), filled(got)).isNotNull()
    kind = F.when(has("ai.toolCall.name"), "TOOL").when(some, "LLM")
    keys = ("ai.model.id", "ai.toolCall.name", "ai.toolCall.args", "ai.toolCall.result", "ai.usage.promptTokens", "ai.usage.completionTokens", "ai.prompt", "ai.response.text")
    return _result(
        kind=kind, model_name=t["ai.model.id"], tool_name=t["ai.toolCall.name"], input_text=given, output_text=got, taken=_taken(*((k, has(k)) for k in keys)),
        input_tokens=to_int(t["ai.usage.promptTokens"], v["ai.usage.promptTokens"]), output_tokens=to_int(t["ai.usage.completionTokens"], v["ai.usage.completionTokens"]),
        io_format=F.when(kind == "TOOL", "tool_call").when(kind == "LLM", "text"),
    )


def _typed(t: Column, kind: str, given: str, got: str) -> dict[str, Column]:
    """Conventions with a kind, an input and an output only."""
    has = lambda k: F.map_contains_key(t, k)
    return t[kind], _taken((given, has(given)), (got, has(got))), F.when(F.coalesce(filled(t[given]), filled(t[got])).isNotNull(), "text")


def mlflow(t: Column) -> dict[str, Column]:
    kind, taken, io = _typed(t, "mlflow.spanType", "mlflow.spanInputs", "mlflow.spanOutputs")
    return _result(kind=F.when(kind.isNotNull(), openinference_kind(kind)), input_text=t["mlflow.spanInputs"], output_text=t["mlflow.spanOutputs"], io_format=io, taken=F.concat(taken, _taken(("mlflow.spanType", kind.isNotNull()))))


def traceloop(t: Column) -> dict[str, Column]:
    key = "traceloop.span.kind"
    kind, taken, io = _typed(t, key, "traceloop.entity.input", "traceloop.entity.output")
    has = F.map_contains_key(t, key)
    return _result(kind=F.when(has, openinference_kind(F.coalesce(kind, F.lit("None")))), input_text=t["traceloop.entity.input"], output_text=t["traceloop.entity.output"], io_format=io, taken=F.concat(taken, _taken((key, has))))


def leftovers(v: Column, taken: Column) -> Column:
    """Attributes that no rule took, as one compact JSON object; null if none. Only these become JSON. ``taken`` may hold nulls; it should be a column, as each entry evaluates it."""
    rest = F.filter(F.map_entries(v), lambda e: ~F.coalesce(F.array_contains(taken, e["key"]), F.lit(False)))
    body = F.transform(rest, lambda e: F.concat(quoted(e["key"]), F.lit(":"), json_of(e["value"])))
    return F.when(F.size(F.array_except(F.map_keys(v), taken)) > 0, F.concat(F.lit("{"), F.array_join(body, ","), F.lit("}")))


def links_of(links: Column) -> Column:
    none = F.array().cast("array<struct<linked_trace_id:string,linked_span_id:string>>")
    return F.coalesce(F.transform(links, lambda x: F.struct(filled(x["traceId"]).alias("linked_trace_id"), filled(x["spanId"]).alias("linked_span_id"))), none)


def attributes(raw: DataFrame) -> DataFrame:
    """Raw spans with their attributes (t, v), service and gen_ai events."""
    configure(raw.sparkSession)
    last = lambda list_, key: F.try_element_at(F.filter(list_, lambda x: x["key"] == key), F.lit(-1))["value"]
    events = F.filter(F.coalesce("events", F.array().cast(raw.schema["events"].dataType)), lambda e: F.coalesce(e["name"], F.lit("")).startswith("gen_ai."))
    df = raw.withColumn("_own", keyed(F.col("attributes")))
    # The service is decoded apart: a query that reads it alone decodes no attributes.
    service = computed_once(text_of(last(F.col("resource_attributes"), "service.name")))
    said = F.transform(events, lambda e: F.struct(e["name"].alias("name"), text_of(last(e["attributes"], "content")).alias("content")))
    text, values = mapped(F.col("_own"), texts_of(F.col("_own")["value"])), mapped(F.col("_own"), F.col("_own")["value"])
    return df.select(*raw.columns, computed_once(text).alias("t"), computed_once(values).alias("v"), service.alias("service_name"), said.alias("said"))


def normalize(raw: DataFrame, *only: str) -> DataFrame:
    """Wide spans: the spans table's columns, ord, messages, documents and links; of the conventions ``only``, if any, which go on before anything is extracted."""
    df = attributes(raw).withColumn("convention", convention(F.col("t"), F.col("events")))
    if only:
        df = df.filter(F.col("convention").isin(*only))
    steps, final = _plan(SparkContext.getOrCreate().applicationId)
    for columns in steps:
        df = df.withColumns(columns)
    return df.select(*final)


@lru_cache(maxsize=2)
def _plan(_application: str) -> tuple[list[dict], list]:
    """The expressions of normalize, built once for a Spark application: they name columns, not a table."""
    t, v = F.col("t"), F.col("v")
    only = lambda name, columns: {c: F.when(F.col("convention") == name, e) for c, e in columns.items()}
    found = only("openinference", openinference_found(t)) | only("otel_genai", genai_found(t, F.col("said")))
    lists = only("openinference", openinference_lists()) | only("otel_genai", genai_lists())
    by = {"openinference": openinference(t, v), "otel_genai": genai(t, v), "vercel_ai": vercel(t, v), "mlflow": mlflow(t), "traceloop": traceloop(t)}
    other = _result()
    extracted = {f"x_{c}": computed_once(reduce(lambda w, k: w.when(F.col("convention") == k, by[k][c]), by, F).otherwise(other[c])) for c in other}
    need_in, need_out = filled(F.col("x_input_text")).isNull() & F.map_contains_key(t, "input.value"), filled(F.col("x_output_text")).isNull() & F.map_contains_key(t, "output.value")
    texts = {"input_text": F.when(need_in, t["input.value"]).otherwise(F.col("x_input_text")), "output_text": F.when(need_out, t["output.value"]).otherwise(F.col("x_output_text"))}
    some = F.coalesce(filled(F.col("input_text")), filled(F.col("output_text"))).isNotNull()
    io = F.coalesce(filled(F.col("x_io_format")), F.when(some, F.when(F.col("x_kind") == "RETRIEVER", "retrieval").when(F.col("x_kind") == "TOOL", "tool_call").otherwise("text")), F.lit("unknown"))
    texts["taken"] = computed_once(F.concat("x_taken", session_taken(t), _taken(("input.value", need_in), ("output.value", need_out))))
    start, end = nano(F.col("start_raw")), nano(F.col("end_raw"))
    kept = ("model_name", "tool_name", "agent_name", "input_tokens", "output_tokens", "total_tokens")
    final = [
        "ord", "trace_id", "span_id", filled(F.col("parent_raw")).alias("parent_span_id"), "name", F.coalesce(filled(F.col("x_kind")), F.lit("UNKNOWN")).alias("kind"), "convention",
        status(F.col("status_raw")).alias("status_code"), filled(F.col("status_message_raw")).alias("status_message"), start.alias("start_time_unix_nano"), end.alias("end_time_unix_nano"), (end - start).alias("duration_ns"),
        "service_name", "scope_name", "scope_version", session_id(t).alias("session_id"), *(F.col(f"x_{c}").alias(c) for c in kept), io.alias("io_format"), "input_text", "output_text",
        leftovers(v, F.col("taken")).alias("raw_attributes_json"), F.col("x_messages").alias("messages"), F.col("x_documents").alias("documents"), links_of(F.col("links")).alias("links"),
    ]
    return [found, lists, extracted, texts], final
