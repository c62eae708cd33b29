"""Decoding of attribute values against a plain recursive reading."""

import json
import random

from pyspark.sql import functions as F

from spanlake.functions import wire


def plain(v):
    """An AnyValue as a plain one: the first field that is there, in this order."""
    if not isinstance(v, dict):
        return v
    for k in ("stringValue", "intValue", "doubleValue", "boolValue", "bytesValue"):
        if k in v:
            return int(v[k]) if k == "intValue" else v[k]
    if "arrayValue" in v:
        return [plain(x) for x in (v["arrayValue"] or {}).get("values") or []]
    if "kvlistValue" in v:
        return {x["key"]: plain(x.get("value")) for x in (v["kvlistValue"] or {}).get("values") or [] if x.get("key")}
    return None


def made(rnd, depth):
    text = "".join(rnd.choice(["a", "{", "}", "[", "]", '"', "\\", ",", ":", "é", "\n", "\u0001", '{"stringValue":"x"}', "$1"]) for _ in range(rnd.randrange(6)))
    scalars = [{"stringValue": text}, {"intValue": str(rnd.randrange(-(10**12), 10**12))}, {"intValue": 7}, {"doubleValue": 2.5}, {"doubleValue": 0.001}, {"boolValue": True}, {"bytesValue": "AAE="}, {}]
    if not depth or rnd.random() < 0.3:
        return rnd.choice(scalars)
    inner = [made(rnd, depth - 1) for _ in range(rnd.randrange(4))]
    if rnd.random() < 0.5:
        return {"arrayValue": rnd.choice([{"values": inner}, {"values": inner}, {}, None])}
    return {"kvlistValue": {"values": [{"key": rnd.choice(["", f"k{k}", f'q"{k}{{']), "value": x} if rnd.random() < 0.9 else {"key": f"only{k}"} for k, x in enumerate(inner)]}}


def test_nested_values(spark):
    rnd = random.Random(4)
    values = [made(rnd, d) for d in (0, 1, 2, 3, 6) for _ in range(120)]
    rows = [(k, json.dumps([{"key": "x", "value": v}])) for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, "k int, t string").repartition(4)
    got = df.select("k", wire.decoded(wire.keyed(F.from_json("t", wire.KV, {"mode": "FAILFAST"}))).alias("d")).select("k", F.col("d.json")["x"].alias("json"), F.col("d.text")["x"].alias("text")).collect()
    for r in got:
        want = plain(values[r.k])
        assert json.loads(r.json) == want, values[r.k]
        if isinstance(want, (list, dict)):
            assert r.text == r.json == json.dumps(want, ensure_ascii=False, separators=(",", ":")), values[r.k]


def test_bare_values_keep_their_type(spark):
    text = json.dumps([{"key": k, "value": v} for k, v in (("s", "5"), ("n", 5), ("b", True), ("f", 2.5), ("z", None))] + [{"key": "m"}, {"key": "", "value": 1}, {"key": "s", "value": {"stringValue": "last"}}])
    df = spark.createDataFrame([(text,)], "t string")
    wire.configure(spark)
    (r,) = df.select(wire.decoded(wire.keyed(F.from_json("t", wire.KV))).alias("d")).select("d.*").collect()
    assert r.json == {"s": '"last"', "n": "5", "b": "true", "f": "2.5", "z": "null", "m": "null"}
    assert r.text == {"s": "last", "n": "5", "b": "True", "f": "2.5", "z": None, "m": None}


def test_no_python_worker(spark):
    from spanlake import bridge
    from spanlake.operators import tables
    from spanlake.operators.normalize import normalize

    df = tables.spans(normalize(bridge.raw_events(spark, "/root/testdata/sf0.001")))
    assert not any(x in df._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Arrow", "Pandas"))


def test_long_texts_in_lists(spark):
    text = 'a\n"{b}' * 20000
    value = json.dumps({"arrayValue": {"values": [{"stringValue": text}, {"doubleValue": 2}]}})
    wire.configure(spark)
    (r,) = spark.createDataFrame([(value,)], "t string").select(wire.json_of(F.parse_json("t")).alias("json")).collect()
    assert json.loads(r.json) == [text, 2.0]


def test_several_fields_and_nulls_are_told_by_the_first_kind(spark):
    given = {'{"stringValue":null,"intValue":"5"}': (None, "null", None), '{"boolValue":null,"bytesValue":"12"}': (None, "null", None), '{"bytesValue":"12"}': ("12", '"12"', 12), '{"stringValue":"True"}': ("True", '"True"', None), '{"boolValue":true}': ("True", "true", 1), '{"intValue":" +5"}': ("5", "5", 5), '{"doubleValue":1e20}': ("1e+20", "1e20", None)}
    wire.configure(spark)
    df = spark.createDataFrame([(t,) for t in given], "t string").withColumn("v", F.parse_json("t"))
    for r in df.select("t", wire.text_of(F.col("v")).alias("text"), wire.json_of(F.col("v")).alias("json"), wire.to_int(wire.text_of(F.col("v")), F.col("v")).alias("n")).collect():
        assert (r.text, r.json, r.n) == given[r.t], r.t


def test_attributes_are_kept_as_they_came(spark):
    from spanlake import bridge
    from spanlake.operators.normalize import attributes

    assert dict(attributes(bridge.raw_events(spark, "/root/testdata/sf0.001")).dtypes)["v"] == "map<string,variant>"
