"""Sinks, records, ranking and encoders on documents of our own."""

import json
import random

import numpy as np
import pyarrow.feather
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from spanlake import cli
from spanlake.operators import encode, nested, tables
from spanlake.operators.normalize import normalize
from spanlake.operators.ranking import ranked
from spanlake.plans import engine
from spanlake.schema import SCHEMAS, TABLES
from spanlake.sources import otlp, sinks
from spanlake.streaming import ingest


def span(trace, sid, start, parent="", name="n", **attributes):
    kv = [{"key": k.replace("__", "."), "value": {"stringValue": v}} for k, v in attributes.items()]
    return {"traceId": trace, "spanId": sid, "parentSpanId": parent, "name": name, "startTimeUnixNano": str(start), "endTimeUnixNano": str(start + 5), "attributes": kv}


def written(path, spans):
    path.write_text(json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": list(spans)}]}]}))
    return str(path)


@pytest.fixture(scope="module")
def source(tmp_path_factory):
    spans = [span(f"t{k % 4}", f"s{k}", 100 - k, "" if k < 4 else "s0", f"n{k % 3}", session__id=f"u{k % 2}", llm__model_name="m", odd='a "quoted", text\nof two lines') for k in range(13)]
    return written(tmp_path_factory.mktemp("one") / "one.json", spans)


def test_parquet_batches_codec_and_empty_tables(spark, source, tmp_path):
    paths = engine.to_parquet(spark, source, str(tmp_path), batch_size=3, compression="gzip")
    assert list(paths) == list(TABLES)
    groups = rows = 0
    for name, path in paths.items():
        for file in sorted((tmp_path / name).glob("*.parquet")):
            meta = pq.ParquetFile(file).metadata
            for k in range(meta.num_row_groups):
                group = meta.row_group(k)
                assert group.column(0).compression == "GZIP"
                if name == "spans":
                    assert group.num_rows <= 3
                    groups, rows = groups + 1, rows + group.num_rows
        assert spark.read.parquet(path).schema.fieldNames() == SCHEMAS[name].fieldNames()
    assert rows == 13 and groups >= 5
    assert spark.read.parquet(paths["links"]).count() == 0


@pytest.mark.parametrize("fmt", ["csv", "arrow", "json", "jsonl"])
def test_files_by_uri_in_folders_that_dont_exist(spark, source, tmp_path, fmt, capsys):
    out = tmp_path / "a" / "b"
    assert cli.main(["totables", source, f"file://{out}", "--format", fmt]) == 0
    assert capsys.readouterr().out.count(f".{fmt}\n") == 6
    assert not list(out.glob(".*"))
    path, want = out / f"spans.{fmt}", [r.asDict() for r in engine.load(spark, source, ordered=True)["spans"].collect()]
    if fmt == "arrow":
        assert pyarrow.feather.read_table(path).to_pylist() == want
    elif fmt == "csv":
        got = sinks.read_csv(spark, str(path), SCHEMAS["spans"]).collect()
        assert [r.asDict() for r in got] == want
    else:
        text = path.read_text()
        assert (json.loads(text) if fmt == "json" else [json.loads(x) for x in text.splitlines()]) == want


def test_records_of_any_length(spark, tmp_path):
    """A trace of many spans, one of which stands twice: as dicts, as one file, and as a folder of lines."""
    spans = [span("long", f"s{k}", k, retrieval__documents__0__document__id=f"d{k}") for k in range(5000)] + [span("short", "x", 9)] + [span("long", "s7", 8000, retrieval__documents__0__document__id="again")]
    source = written(tmp_path / "long.json", spans)
    got = engine.to_dicts(spark, source)
    assert [r["trace_id"] for r in got] == ["long", "short"] and [s["span_id"] for s in got[0]["spans"]] == [f"s{k}" for k in range(5000)] + ["s7"]
    of = lambda s: [d["document_id"] for d in s["documents"]]
    assert of(got[0]["spans"][7]) == of(got[0]["spans"][-1]) == ["d7", "again"] and of(got[0]["spans"][8]) == ["d8"]
    path, n = engine.write_records(spark, source, str(tmp_path / "out"), "jsonl")
    assert n == 2 and [json.loads(x) for x in open(path)] == got
    path, _ = engine.write_records(spark, source, str(tmp_path / "out"), "json")
    assert json.loads(open(path).read()) == got
    sinks.write_record_lines(engine.record_pieces(spark, source, whole=True), str(tmp_path / "lines"))
    lines = [json.loads(x) for f in sorted((tmp_path / "lines").glob("part-*")) for x in f.read_text().split("\n") if x.strip()]
    assert sorted(lines, key=lambda r: r["trace_id"]) == got
    (cell,) = engine.record_frame(spark, source).filter("trace_id = 'long'").collect()
    assert [s.span_id for s in cell.spans] == [s["span_id"] for s in got[0]["spans"]] and [d.document_id for d in cell.spans[-1].documents] == ["d7", "again"]


def test_no_records(spark, tmp_path):
    source = written(tmp_path / "none.json", [])
    assert engine.to_dicts(spark, source) == []
    path, n = engine.write_records(spark, source, str(tmp_path), "json")
    assert n == 0 and json.loads(open(path).read()) == []


def test_places_in_groups_of_any_size(spark):
    rnd = random.Random(1)
    rows = [("hot" if rnd.random() < 0.9 else f"g{rnd.randrange(50)}", rnd.randrange(300), k) for k in range(4000)]
    df = spark.createDataFrame(rows, "g string, o int, k int").repartition(3)
    got = ranked(df, ["g"], ["o", "k"], "place")
    seen: dict = {}
    want = {}
    for g, _, k in sorted(rows):
        want[k] = seen.setdefault(g, 0)
        seen[g] += 1
    assert {r.k: r.place for r in got.collect()} == want
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    assert ranked(df.limit(0), ["g"], ["o"], "place").count() == 0


def test_codes_by_first_appearance(spark):
    df = spark.createDataFrame([(k, None if k % 5 == 0 else f"v{(k * 7) % 11}") for k in range(200)], "o int, v string").repartition(4)
    order = list(dict.fromkeys(f"v{(k * 7) % 11}" for k in range(200) if k % 5))
    got = encode.codes(df, "v", "o")
    assert {r.o: r.code for r in got.collect()} == {k: -1 if k % 5 == 0 else order.index(f"v{(k * 7) % 11}") for k in range(200)}
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()


def test_bundles(spark, source):
    made = engine.load(spark, source, ordered=True)
    out = encode.to_arrays(made, ("spans", "sessions", "nothing"), np.float64)
    assert list(out) == ["spans", "sessions"]
    s = out["spans"]
    assert s.n_rows == 13 and s.ids["span_id"] == [f"s{k}" for k in range(13)] and s.ids["parent_span_id"][:5] == [None] * 4 + ["s0"]
    assert s.vocab["name"] == ["n0", "n1", "n2"] and s.categorical["name"].tolist() == [k % 3 for k in range(13)] and s.categorical["tool_name"].tolist() == [-1] * 13
    assert s.numeric["duration_ns"].dtype == np.float64 and np.isnan(s.numeric["input_tokens"]).all()
    assert s.skipped == ["input_text", "output_text", "raw_attributes_json"] and "spec" not in s.categorical
    assert out["sessions"].vocab["session_id"] == ["u0", "u1"]
    with pytest.raises(ImportError, match="torch"):
        encode.to_tensors(made)


def test_frames_keep_whole_numbers(spark, source):
    frames = engine.to_dfs(spark, source)
    assert list(frames) == list(TABLES) and str(frames["spans"]["input_tokens"].dtype) == "int64[pyarrow]"


def test_rollups_of_batches(spark, tmp_path):
    """Later batches change a trace's times, status and sums, not its first session or earlier root; no span is read again."""
    batches = [[span("t", "a", 50, name="late root"), span("u", "x", 1, "gone")], [span("t", "b", 20, name="root", session__id="second"), span("t", "c", 90, "b", session__id="third")], [span("v", "y", 5, session__id="second")]]
    sink = str(tmp_path / "store")
    for k, spans in enumerate(batches):
        raw = otlp.read_spans(spark, written(tmp_path / f"{k}.json", spans))
        ingest.store(raw, sink, k)
        (tmp_path / "store" / "spans" / f"batch={k}").rename(tmp_path / f"gone-{k}")
        if k == 1:
            ingest.compact(spark, sink)
            ingest.store(raw, sink, k)
            (tmp_path / "store" / "spans" / f"batch={k}").rename(tmp_path / f"gone-again-{k}")
    got = {r.trace_id: r for r in ingest.rollups(spark, sink)["traces"].collect()}
    assert (got["t"].root_span_id, got["t"].session_id, got["t"].span_count, got["t"].duration_ns, got["t"].session_turn) == ("b", "second", 3, 75, 1)
    assert got["u"].root_span_id is None and got["v"].session_turn == 0
    sessions = {r.session_id: r.trace_count for r in ingest.rollups(spark, sink)["sessions"].collect()}
    assert sessions == {"second": 2}
    with pytest.raises(FileNotFoundError):
        ingest.rollups(spark, str(tmp_path / "nothing"))


def test_tables_are_made_when_asked_for(spark, source):
    made = tables.all_tables(normalize(otlp.read_spans(spark, source)))
    assert not made.made("traces") and made["sessions"].count() == 2 and not made.made("traces")
    assert made["traces"] is made["traces"] and list(made) == list(TABLES)
    assert nested.records(normalize(otlp.read_spans(spark, source))).select(F.size("spans").alias("n")).agg(F.sum("n")).first()[0] == 13
