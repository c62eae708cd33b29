"""Large documents: read by many tasks, equal to the whole read."""

import json
import random

import pytest

from spanlake.operators.normalize import normalize
from spanlake.sources import large, otlp


def document(rnd, resources, late=False, odd=True):
    """A document with braces, brackets, quotes and backslashes in its strings and its keys."""
    text = lambda: "".join(rnd.choice(["a", "{", "}", "[", "]", '"', "\\", "é", " ", ",", ":", '"spans":[', "\\\\"]) for _ in range(rnd.randrange(12)))
    kv = lambda: [{"key": rnd.choice(["k", "spans", "x}y", text()]), "value": rnd.choice([{"stringValue": text()}, {"intValue": "5"}, {"arrayValue": {"values": [{"stringValue": text()}]}}])} for _ in range(rnd.randrange(4))]
    span = lambda k: {"traceId": f"t{k % 7}", "spanId": f"s{k}", "name": text(), "startTimeUnixNano": str(k), "status": {"code": rnd.choice([None, "OK", 2])}, "attributes": kv(), "events": [{"name": text(), "attributes": kv()}], "links": [], "unknown": {"resourceSpans": [{"scopeSpans": [{"spans": [{}]}]}]}}
    n, out = 0, []
    for r in range(resources):
        scopes = []
        for s in range(rnd.randrange(4)):
            spans = [span(n + k) for k in range(rnd.randrange(40))]
            n += len(spans)
            scope = {"scope": {"name": f"sc{r}.{s}", "version": text()}, "spans": spans}
            scopes.append(dict(reversed(scope.items())) if late else scope)
        one = {"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": f"svc{r}"}}, *kv()]}, "scopeSpans": scopes}
        out.append(dict(reversed(one.items())) if late else one)
    if odd:
        out += [{"scopeSpans": [{"spans": [span(n)]}]}, {"resource": None, "scopeSpans": None}, {"resource": {}, "scopeSpans": [{"scope": None, "spans": []}]}]
    return {"x}": 1, "other": [{"scopeSpans": []}], "resourceSpans": out, "tail": {"resourceSpans": []}}


def rows(df):
    """Rows in the order of the input, without their places, which are of another kind."""

    def parsed(x):
        if isinstance(x, dict):
            return {k: json.loads(v.toJson()) if k == "value" and v is not None else parsed(v) for k, v in x.items()}
        return [parsed(y) for y in x] if isinstance(x, list) else x

    return [parsed(r.asDict(recursive=True)) for r in df.orderBy("ord").drop("ord").collect()]


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize(("seed", "late", "indent", "end"), [(1, False, None, ""), (2, True, None, "\n"), (3, False, 1, " \n\n"), (4, True, "\t", "")])
def test_equal_to_the_whole_read(spark, small_ranges, tmp_path, seed, late, indent, end):
    path = tmp_path / "one.json"
    path.write_text(json.dumps(document(random.Random(seed), 10, late), ensure_ascii=seed % 2 == 0, indent=indent) + end)
    assert large.fragments(spark, str(path), False, 0).rdd.getNumPartitions() > 5
    want = rows(otlp.flatten(otlp.read_documents(spark, str(path))))
    got = rows(otlp.read_spans(spark, str(path), least=0))
    assert got == want and len(got) > 100


def test_normalised_spans_are_equal(spark, small_ranges, tmp_path):
    path = tmp_path / "one.json"
    path.write_text(json.dumps(document(random.Random(9), 6)))
    both = (otlp.read_spans(spark, str(path), least=0), otlp.flatten(otlp.read_documents(spark, str(path))))
    got, want = ([r.asDict(recursive=True) for r in normalize(df).orderBy("ord").drop("ord").collect()] for df in both)
    assert got == want and got


def test_a_span_longer_than_many_ranges(spark, small_ranges, tmp_path):
    doc = document(random.Random(5), 2)
    doc["resourceSpans"][0]["scopeSpans"] = [{"scope": {"name": "big"}, "spans": [{"traceId": "t", "spanId": "big", "attributes": [{"key": "k", "value": {"stringValue": '{"a}' * 30_000}}]}, {"traceId": "t", "spanId": "next"}]}]
    path = tmp_path / "big.json"
    path.write_text(json.dumps(doc))
    assert rows(otlp.read_spans(spark, str(path), least=0)) == rows(otlp.flatten(otlp.read_documents(spark, str(path))))


def test_beginnings_by_a_shuffle(spark, small_ranges, tmp_path):
    path = tmp_path / "one.json"
    path.write_text(json.dumps(document(random.Random(6), 8)))
    key = lambda df: sorted((r.kind, r.r, r.s or 0, r.p or 0, r.text) for r in large.whole(df).collect())
    assert key(large.found(spark, str(path), False, 0, many=0)) == key(large.found(spark, str(path), False, 0))


def test_a_folder_of_small_and_large_files(spark, small_ranges, tmp_path):
    (tmp_path / "deep").mkdir()
    for k, n in enumerate((1, 10, 2, 9)):
        (tmp_path / ("deep" if k % 2 else ".") / f"f {k}.json").write_text(json.dumps(document(random.Random(k), n, odd=n > 5)))
    (tmp_path / "skip.txt").write_text("x" * 100_000)
    want = rows(otlp.flatten(otlp.read_documents(spark, str(tmp_path))))
    assert rows(otlp.read_spans(spark, str(tmp_path), least=20_000)) == want
    assert rows(otlp.read_spans(spark, [str(tmp_path)] * 2, least=20_000)) == want * 2


@pytest.mark.parametrize("text", ['{"resourceSpans":[{"scopeSpans":[{"spans":[{"traceId":"a"}]}]}]', '{"resourceSpans":[{}]}}', '{"resourceSpans":[{"scopeSpans":[{"spans":[{"traceId":"a}]}]}]}', '{"resourceSpans":[{"scopeSpans":[{"spans":[{"a" 1}]}]}]}', "[{}"])
def test_malformed_documents_raise(spark, tmp_path, text):
    path = tmp_path / "bad.json"
    path.write_text(text)
    with pytest.raises(Exception, match="(?i)malformed"):
        otlp.read_spans(spark, str(path), least=0).collect()


def test_documents_without_spans(spark, tmp_path):
    for k, text in enumerate(["{}", '{"resourceSpans":null}', '{"resourceSpans":[]}\n']):
        path = tmp_path / f"{k}.json"
        path.write_text(text)
        assert otlp.read_spans(spark, str(path), least=0).count() == 0
