"""Column functions that decode OTLP/JSON values.

Attribute values arrive as variants, parsed with their document: an AnyValue, or a bare value.
``text_of`` and ``json_of`` give a value's text and its compact JSON: common forms are read off
first, and the rest is told in full. Maps by key have the last value and the first position of a
repeated key. All of it is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

KV = "array<struct<key:string,value:variant>>"
# Status names as they come and as they are kept.
STATUS = {"STATUS_CODE_UNSET": "UNSET", "STATUS_CODE_OK": "OK", "STATUS_CODE_ERROR": "ERROR", "UNSET": "UNSET", "OK": "OK", "ERROR": "ERROR", "": "UNSET"}


def configure(spark: SparkSession) -> None:
    """Repeated attribute keys: the last value wins. Stages whose methods the JVM wouldn't compile (over 8,000 bytes) run as expressions, which are split."""
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", 8000)


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def nano(c: Column) -> Column:
    """Unix nanoseconds; null if empty or not an integer."""
    return c.try_cast("bigint")


def status(c: Column) -> Column:
    return F.coalesce(literal_map(STATUS)[c], c, F.lit("UNSET"))


def filled(c: Column) -> Column:
    """Null for the empty text."""
    return F.nullif(c, F.lit(""))


def computed_once(c: Column) -> Column:
    """c, which the optimizer neither copies into later columns nor into filters that it moves down: long expressions would multiply there. The condition always holds."""
    return F.when(F.spark_partition_id() >= 0, c)


def quoted(c: Column) -> Column:
    """A text as JSON. The list's brackets are trimmed off: a text ends in quotes, so no bracket of its own goes."""
    return F.btrim(F.to_json(F.array(c)), F.lit("[]"))


def double_text(c: Column, python: bool = True) -> Column:
    """A double as Python's repr (1e+20, 5.0) or, else, as compact JSON (1e20, 5.0) writes it."""
    text, size = c.cast("string"), F.abs(c)
    plain = F.regexp_replace(text.try_cast("decimal(38,20)").cast("string"), r"(\.\d*?)0+$", "$1")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    mantissa = F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", "")
    power = F.substring_index(text, "E", -1).try_cast("int")
    tail = F.concat(F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), 2, "0")) if python else power.cast("string")
    tail = F.when(F.abs(power) > 99, F.concat(F.when(power < 0, "-").otherwise("+" if python else ""), F.abs(power).cast("string"))).otherwise(tail)
    odd = {"NaN": "nan", "Infinity": "inf", "-Infinity": "-inf"} if python else dict.fromkeys(("NaN", "Infinity", "-Infinity"), "null")
    return F.when(text.isin(*odd), literal_map(odd)[text]).when(~text.contains("E") | ((size >= 1e-4) & (size < 1e16)), F.when(text.contains("E"), plain).otherwise(text)).otherwise(F.concat(mantissa, F.lit("e"), tail))


# Marks that stand for brackets and braces in texts that are done: JSON holds control characters only as escapes.
_DONE = "\u0001\u0002\u0003\u0004"
_STRING = r'"(?:[^"\\]++|\\.)*+"'
_NO_MARKS = r'^(?:[^"]++|"(?:[^"\\\[\]{}]++|\\.)*+")*+$'  # JSON whose texts hold no brackets or braces
# Wrappers of doubles, of other plain values, and lists without values, each with what is left of it.
_DOUBLES = (
    (rf'\{{"doubleValue":(-?\d+)\}}', "$1.0"),
    (rf'\{{"doubleValue":(-?\d+)(?:\.0|(\.\d+))E(-?\d+)\}}', "$1$2e$3"),
)
_WRAPPED = (
    (rf'\{{"(?:stringValue|bytesValue|doubleValue|boolValue)":({_STRING}|[^"{{}}\[\],]+)\}}', "$1"),
    (r'\{"intValue":"?\s*\+?(-?\d+)\s*"?\}', "$1"),
)
_EMPTY = (
    (r'\{"arrayValue":(?:null|\{\}|\{"values":null\})\}', "\u0001\u0002"),
    (r'\{"kvlistValue":(?:null|\{\}|\{"values":null\})\}', "\u0003\u0004"),
    (r"\{\}", "null"),
)
# What one step unwraps: lists and entries in which nothing is left to unwrap. Entries without a key go.
_LISTS = ((r'\{"arrayValue":\{"values":\[([^\[\]{}]*)\]\}\}', "\u0001$1\u0002"),)
_ENTRIES = (
    (r'\{"key":""(?:,"value":[^\[\]{}]*)?\}', "\u0006"),
    ("\u0006,|,?\u0006", ""),
    (rf'\{{"key":({_STRING}),"value":([^\[\]{{}}]*)\}}', "$1:$2"),
    (rf'\{{"key":({_STRING})\}}', "$1:null"),
    (r'\{"kvlistValue":\{"values":\[([^\[\]{}]*)\]\}\}', "\u0003$1\u0004"),
)


def _replaced(text: Column, rules) -> Column:
    for pattern, by in rules:
        text = F.regexp_replace(text, pattern, by)
    return text


def _let(c: Column, made) -> Column:
    """made(c) with c computed once, as it is the value of a lambda."""
    return F.get(F.transform(F.array(c), made), F.lit(0))


def _unwrapped(raw: Column) -> Column:
    """The JSON of a list without its wrappers. Rules run where what they look for stands."""
    guard = lambda x: F.when(x.startswith('"'), F.translate(x, "[]{}", _DONE)).otherwise(x)
    guarded = F.when(raw.rlike(_NO_MARKS), raw).otherwise(F.array_join(F.transform(F.regexp_extract_all(raw, F.lit(_STRING + '|[^"]+'), F.lit(0)), guard), ""))
    plain = _replaced(_let(guarded, lambda x: F.when(x.contains('"doubleValue"'), _replaced(x, _DOUBLES)).otherwise(x)), _WRAPPED)
    plain = _let(plain, lambda x: F.when(x.contains("{}") | x.contains("null"), _replaced(x, _EMPTY)).otherwise(x))
    step = lambda x: F.when(x.contains('"key":') | x.contains('"kvlistValue"'), _replaced(x, _LISTS + _ENTRIES)).otherwise(_replaced(x, _LISTS))
    lists = F.size(F.regexp_extract_all(raw, F.lit('"(?:array|kvlist)Value":'), F.lit(0)))
    return F.aggregate(F.sequence(F.lit(1), lists), plain, lambda x, _: F.when(x.contains('Value":{'), step(x)).otherwise(x))


def nested_json(v: Column) -> Column:
    """Compact JSON of a list or key-value list, unwrapped from the inside out, as often as it holds lists: of any depth."""
    return F.translate(_let(F.to_json(v), _unwrapped), _DONE, "[]{}")


def _of(v: Column, kind: str, name: str | None = None) -> Column:
    """A variant, or a field of it, as a type; null if it isn't one."""
    return F.try_variant_get(v, f"$.{name}" if name else "$", kind)


# The fields of an AnyValue, as the first of them that it has tells its kind.
KINDS = ("stringValue", "intValue", "doubleValue", "boolValue", "bytesValue", "arrayValue", "kvlistValue")


def _kind(keys: Column) -> Column:
    """The field that tells what a value is; null for a bare value (it has no fields), empty if none does. A value nearly always has one field, which is then read off."""
    several = F.coalesce(*(F.when(F.array_contains(keys, k), k) for k in KINDS), F.lit(""))
    return F.when(F.size(keys) == 1, F.get(keys, F.lit(0))).when(keys.isNotNull(), several)


def _decode(p: Column) -> Column:
    """(text, json) of one value: v the variant, kind the field that holds it, said its stringValue, nested the JSON of a list."""
    v, kind, said, nested = p["v"], p["kind"], p["said"], p["nested"]
    text, number = lambda k: _of(v, "string", k), _of(v, "double", "doubleValue")
    whole = text("intValue").cast("decimal(38,0)").cast("string")
    bare = F.when(F.schema_of_variant(v) == "BOOLEAN", F.initcap(_of(v, "string"))).otherwise(_of(v, "string"))
    as_text = (
        F.when(kind == "stringValue", said)
        .when(kind == "intValue", whole)
        .when(kind == "doubleValue", double_text(number))
        .when(kind == "boolValue", F.initcap(text("boolValue")))
        .when(kind == "bytesValue", text("bytesValue"))
        .when(kind.isNull(), bare)
        .otherwise(nested)
    )
    as_json = (
        F.when(kind == "stringValue", quoted(said))
        .when(kind == "intValue", whole)
        .when(kind == "doubleValue", double_text(number, False))
        .when(kind == "boolValue", text("boolValue"))
        .when(kind == "bytesValue", quoted(text("bytesValue")))
        .when(kind.isNull(), F.to_json(v))
        .otherwise(nested)
    )
    return F.struct(as_text.alias("text"), F.coalesce(as_json, F.lit("null")).alias("json"))


def keyed(attributes: Column) -> Column:
    """The entries of an attribute list that have a key. Nearly always that is all of them, which is told without a lambda."""
    entries = F.coalesce(attributes, F.array().cast(KV))
    return F.when(~F.array_contains(entries["key"], F.lit("")), entries).otherwise(F.filter(entries, lambda x: F.coalesce(x["key"], F.lit("")) != ""))


def _decoded_fully(values: Column) -> Column:
    """(text, json) of variants of any form. Each lambda reads the fields of the one before, so a value's keys, kind and list are told once."""
    told = F.transform(values, lambda v: F.struct(v.alias("v"), _of(v, "string", "stringValue").alias("said"), F.map_keys(_of(v, "map<string,variant>")).alias("keys")))
    told = F.transform(told, lambda p: F.struct(p["v"].alias("v"), p["said"].alias("said"), F.when(p["said"].isNotNull(), "stringValue").otherwise(_kind(p["keys"])).alias("kind")))
    told = F.transform(told, lambda p: F.struct(p["v"].alias("v"), p["said"].alias("said"), p["kind"].alias("kind"), F.when(p["kind"].isin("arrayValue", "kvlistValue"), nested_json(p["v"])).alias("nested")))
    return F.transform(told, _decode)


# The fields of an AnyValue in one cast: null where a field isn't there, is null or of another type. Spark throws to leave a path that a variant doesn't have, which costs more than the whole cast.
_FIELDS = "struct<stringValue:string,intValue:string,doubleValue:double,boolValue:string,bytesValue:string,arrayValue:struct<values:boolean>,kvlistValue:struct<values:boolean>>"
_KEYS = "map<string,array<string>>"  # of an AnyValue: its keys, as no field of it is an array


def _read_off(v: Column, x: Column, said: Column, part: str) -> Column:
    """The text or json of a value, x its fields: of one field by that, of others in full. Each kind is asked for if none before it is there."""
    as_text, truth = part == "text", x["boolValue"]
    one = F.size(_of(v, _KEYS)) == 1
    return F.coalesce(
        said,
        F.when(x["intValue"].isNotNull() & one, x["intValue"].try_cast("bigint").cast("string")),
        F.when(x["doubleValue"].isNotNull() & one, double_text(x["doubleValue"], as_text)),
        F.when(truth.isNotNull() & one, F.initcap(truth) if as_text else truth),
        F.when((x["arrayValue"].isNotNull() | x["kvlistValue"].isNotNull()) & one, nested_json(v)),
        F.get(_decoded_fully(F.array(v)), F.lit(0))[part],
    )


def _text(v: Column, x: Column) -> Column:
    return _read_off(v, x, x["stringValue"], "text")


def _json(v: Column, x: Column) -> Column:
    return _read_off(v, x, F.when(x["stringValue"].isNotNull(), quoted(x["stringValue"])), "json")


def _with_fields(v: Column, made) -> Column:
    return _let(_of(v, _FIELDS), lambda x: made(v, x))


def text_of(v: Column) -> Column:
    """A value as text."""
    return _with_fields(v, _text)


def json_of(v: Column) -> Column:
    """A value as compact JSON."""
    return _with_fields(v, _json)


def texts_of(values: Column) -> Column:
    return F.zip_with(values, values.try_cast(f"array<{_FIELDS}>"), _text)


def mapped(own: Column, values: Column) -> Column:
    """Map of keyed entries to values in the same order."""
    return F.map_from_arrays(own["key"], values)


def decoded(own: Column) -> Column:
    """struct(text: map, json: map) of keyed entries."""
    return F.struct(mapped(own, texts_of(own["value"])).alias("text"), mapped(own, F.transform(own["value"], json_of)).alias("json"))


def to_int(text: Column, v: Column) -> Column:
    """An integer as Python's int() reads a value, given its text too: whole-number text, truncated number, or truth value. Digits alone are the same as text and as number."""
    clean = F.when(text.rlike(r"^\s*[+-]?\d+(_\d+)*\s*$"), F.regexp_replace(text, r"[_\s]", "").try_cast("bigint"))
    number = F.coalesce(text.try_cast("bigint"), F.when(text.rlike("[.eE]"), text.try_cast("double").try_cast("bigint")))
    keys = F.map_keys(_of(v, _KEYS))
    said = F.coalesce(_kind(keys).isin("stringValue", "bytesValue"), F.schema_of_variant(v) == "STRING")
    return F.when(text.rlike(r"^[+-]?\d{1,18}$"), text.try_cast("bigint")).when(text.isNotNull(), F.when(said, clean).when(text == "True", F.lit(1).cast("bigint")).when(text == "False", F.lit(0).cast("bigint")).otherwise(number))


def to_float(text: Column) -> Column:
    return F.when(text == "True", 1.0).when(text == "False", 0.0).otherwise(F.trim(text).try_cast("double"))
