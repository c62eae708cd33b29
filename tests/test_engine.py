"""The engine on documents of our own: rules that the bridges don't reach."""

import json

import pytest

from spanlake import cli
from spanlake.operators import encode, tables
from spanlake.plans import engine
from spanlake.schema import SCHEMAS, check_spec


def kv(**attrs):
    kinds = {str: "stringValue", bool: "boolValue", int: "intValue", float: "doubleValue"}
    return [{"key": k.replace("__", "."), "value": v if isinstance(v, dict) else {kinds[type(v)]: v}} for k, v in attrs.items()]


def span(trace, sid, start=None, parent="", attributes=(), events=None, links=None, status=None):
    return {"traceId": trace, "spanId": sid, "parentSpanId": parent, "name": f"n-{sid}", "startTimeUnixNano": start, "endTimeUnixNano": None if start is None else str(int(start) + 10), "status": {"code": status}, "attributes": list(attributes), "events": events or [], "links": links or []}


def doc(*spans, service="svc"):
    return {"resourceSpans": [{"resource": {"attributes": kv(service__name=service)}, "scopeSpans": [{"scope": {"name": "s", "version": "1"}, "spans": list(spans)}]}, {"scopeSpans": None}]}


REQUEST = json.dumps({"contents": [{"role": "user", "parts": [{"text": "hi"}]}, {"role": "model", "parts": [{"function_call": {"id": "f1", "name": "go"}}, {"function_response": {"id": "f1", "response": {"ok": True}}}]}], "config": {"system_instruction": "be brief"}})


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("traces")
    (top / "deep").mkdir()
    one = doc(
        span("t1", "a", "100", attributes=kv(openinference__span__kind="weird", session__id="", mlflow__trace__session="late", input__value="in")),
        span("t1", "b", "50", "a", kv(llm__input_messages__10__message__content="ten", llm__input_messages__2__message__role="user", retrieval__documents__5__document__metadata="m")),
        span("t1", "c", None, "a", kv(gen_ai__request__model="m", gcp__vertex__agent__llm_request=REQUEST, flag=True, big=1e20, small=5.0)),
        span("t2", "d", "70", attributes=kv(input__value="only"), links=[{"traceId": "t1", "spanId": ""}], status=2),
        span("t2", "e", "70", attributes=[], status="STATUS_CODE_ERROR"),
        span("t3", "f", "60", "gone", kv(ai__toolCall__name="tool", ai__usage__promptTokens="3.7", gen=1)),
    )
    (top / "deep" / "one.json").write_text(json.dumps(one))
    (top / "skip.txt").write_text("not json")
    return top


@pytest.fixture(scope="module")
def made(spark, folder):
    return {name: df.cache() for name, df in engine.load(spark, str(folder)).items()}


def test_schemas(made):
    for name, schema in SCHEMAS.items():
        assert [(f.name, f.dataType) for f in made[name].schema] == [(f.name, f.dataType) for f in schema]


def test_spans(made):
    s = {r.span_id: r for r in made["spans"].collect()}
    assert (s["a"].kind, s["a"].session_id, s["a"].input_text, s["a"].io_format, s["a"].raw_attributes_json) == ("UNKNOWN", "late", "in", "text", None)
    assert s["b"].io_format == "retrieval" and s["b"].input_text is None and s["b"].raw_attributes_json == '{"retrieval.documents.5.document.metadata":"m"}'
    assert s["c"].kind == "LLM" and s["c"].input_text == '[system] be brief\n[user] hi\n[assistant] {"id":"f1","name":"go"}\n[tool] {"ok":true}'
    assert s["c"].raw_attributes_json == '{"flag":true,"big":1e20,"small":5.0}' and s["c"].duration_ns is None
    assert (s["d"].convention, s["d"].status_code, s["e"].convention, s["e"].status_code) == ("generic", "2", "unknown", "ERROR")
    assert (s["f"].kind, s["f"].tool_name, s["f"].input_tokens, s["f"].raw_attributes_json) == ("TOOL", "tool", None, '{"gen":1}')


def test_side_tables(made):
    m = sorted((r.span_id, r.position, r.direction, r.role, r.content, r.tool_call_id) for r in made["messages"].collect())
    assert m[:2] == [("b", 0, "input", "user", None, None), ("b", 1, "input", None, "ten", None)]
    assert [x[3] for x in m[2:]] == ["system", "user", "assistant", "tool"] and [x[5] for x in m[2:]] == [None, None, "f1", "f1"]
    assert [(r.span_id, r.position, r.document_id) for r in made["documents"].collect()] == [("b", 5, None)]
    assert [(r.linked_trace_id, r.linked_span_id) for r in made["links"].collect()] == [("t1", None)]


def test_rollups(made):
    t = {r.trace_id: r for r in made["traces"].collect()}
    assert (t["t1"].root_span_id, t["t1"].start_time_unix_nano, t["t1"].session_turn, t["t1"].total_tokens) == ("a", 50, 0, None)
    assert (t["t2"].root_span_id, t["t2"].status, t["t2"].error_count, t["t2"].session_turn) == ("d", "ERROR", 1, None)
    assert t["t3"].root_span_id is None and t["t3"].service_name is None
    assert [(r.session_id, r.trace_count, r.span_count) for r in made["sessions"].collect()] == [("late", 1, 3)]
    assert [r.span_id for r in tables.orphans(made["spans"]).collect()] == ["f"]


def test_records(spark, folder):
    got = {r["trace_id"]: r for r in engine.to_dicts(spark, [str(folder / "deep" / "one.json")])}
    assert [s["span_id"] for s in got["t1"]["spans"]] == ["a", "b", "c"]
    assert got["t1"]["spans"][2]["raw_attributes"] == {"flag": True, "big": 1e20, "small": 5.0}
    assert [len(got["t1"]["spans"][k]["messages"]) for k in range(3)] == [0, 2, 4] and got["t3"]["spans"][0]["links"] == []


def test_twice_listed_and_missing(spark, folder):
    path = str(folder / "deep" / "one.json")
    assert engine.load(spark, [path, path])["spans"].count() == 12
    with pytest.raises(FileNotFoundError):
        engine.load(spark, str(folder / "nothing"))
    for spec in ("at/v1", "dg/v1"):
        with pytest.raises(ValueError):
            check_spec(spec)
    check_spec("at")


def test_encodings(made):
    out = encode.to_arrays(made, ("traces", "nothing"))["traces"]
    assert out.n_rows == 3 and "trace_id" in out.ids and "spec" not in out.categorical
    assert set(out.vocab["status"]) == {"ERROR", "UNSET"} and out.categorical["service_name"].min() == -1


@pytest.mark.parametrize("fmt", ["parquet", "csv", "arrow", "json", "jsonl"])
def test_cli(spark, folder, tmp_path, fmt, capsys):
    if fmt in ("parquet", "jsonl"):
        assert cli.main(["totables", str(folder), str(tmp_path), "--format", fmt]) == 0
        assert len(capsys.readouterr().out.strip().splitlines()) == 6 and (tmp_path / ("spans" if fmt == "parquet" else "spans.jsonl")).exists()
    else:
        from spanlake.sources.sinks import write_local

        write_local(engine.load(spark, str(folder))["links"], str(tmp_path / f"links.{fmt}"), fmt)
        assert (tmp_path / f"links.{fmt}").stat().st_size > 0


def test_cli_errors(tmp_path, folder, spark, capsys):
    assert cli.main([]) == 2
    assert cli.main(["totables", str(tmp_path / "no"), str(tmp_path)]) == 1
    with pytest.raises(SystemExit):
        cli.main(["totables", str(folder), str(tmp_path), "--format", "xml"])
    assert cli.main(["torecords", str(folder), str(tmp_path), "--format", "json"]) == 0
    assert len(json.loads((tmp_path / "traces.json").read_text())) == 3
