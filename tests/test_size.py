"""What must not grow with the input: what one task or the driver holds, and what is computed for each entry."""

import glob

import pytest

from spanlake import bridge, queries
from spanlake.operators import nested
from spanlake.operators.normalize import normalize
from spanlake.queries import QUERIES
from spanlake.sources import otlp, sinks
from spanlake.streaming import ingest

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["arrow_tables", "payload_traces", "tensor_codes", "ordered_traces"])
def test_no_table_passes_through_the_driver(spark, monkeypatch, name):
    def never(self, *_, **__):
        raise AssertionError("a table went to the driver")

    kind = type(spark.range(1))
    for method in ("toArrow", "toPandas", "toLocalIterator"):
        monkeypatch.setattr(kind, method, never)
    assert QUERIES[name](spark, DATA).count() in (397, 1000)


def test_arrow_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "PIECE", 2_000)
    df = spark.range(1000).selectExpr("id", "if(id % 3 = 0, null, concat('é', id)) AS text").orderBy("id")
    sinks.write_arrow(df, f"file://{tmp_path}/t")
    pieces = spark.read.parquet(f"file://{tmp_path}/t")
    assert pieces.count() > 1 and pieces.select("part", "n").distinct().count() == pieces.count()
    back = sinks.read_arrow(spark, f"file://{tmp_path}/t", df.schema)
    assert sorted(back.collect()) == sorted(df.collect())


def _files(tmp_path, monkeypatch, name, spark):
    monkeypatch.setattr(queries, "shared_dir", lambda _: f"file://{tmp_path}/{name}")
    rows = QUERIES[name](spark, DATA).count()
    return rows, glob.glob(f"{tmp_path}/{name}/**/*.json", recursive=True)


def test_large_documents_grow_in_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "BIG", 250)
    rows, files = _files(tmp_path, monkeypatch, "big_document_spans", spark)
    assert rows == 1000 and len(files) == 4


def test_ordered_files_grow_in_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "GROUP", 50)
    rows, files = _files(tmp_path, monkeypatch, "file_order", spark)
    assert rows == 5 and len(files) == 20


def test_taken_keys_are_told_once_a_span(spark):
    raw = bridge.raw_events(spark, DATA)
    plan = normalize(raw).select("raw_attributes_json")._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains(taken#" in plan
    assert raw.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_children_without_repeated_ids_need_no_shuffle(spark, tmp_path):
    normalize(bridge.raw_events(spark, DATA)).write.parquet(f"file://{tmp_path}/wide")
    made = nested.with_children(spark.read.parquet(f"file://{tmp_path}/wide"))
    assert "Exchange hashpartitioning" not in made._jdf.queryExecution().executedPlan().toString()


def test_services_decode_no_attributes(spark):
    plan = QUERIES["dim_services"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "service.name" in plan and "openinference.span.kind" not in plan


def test_joined_messages_write_what_the_join_reads(spark, monkeypatch):
    written = []
    kept = queries.saved
    monkeypatch.setattr(queries, "saved", lambda df, *a: written.append(df.columns) or kept(df, *a))
    assert QUERIES["span_message_join"](spark, DATA).count() == 818
    assert "raw_attributes_json" not in written[0] and "input_text" not in written[0]


def test_streamed_traces_need_no_turns(spark, monkeypatch):
    def never(_):
        raise AssertionError("turns were told")

    monkeypatch.setattr(ingest.tables, "with_turns", never)
    assert QUERIES["streaming_spans"](spark, DATA).count() == 397


def test_batches_are_cut_without_all_ids_in_one_task(spark, monkeypatch):
    def never(*_):
        raise AssertionError("all ids were gathered")

    monkeypatch.setattr(queries.F, "percentile", never)
    assert QUERIES["incremental_rollup"](spark, DATA).count() == 397


def test_documents_are_written_without_a_lambda_for_each_entry(spark):
    plan = otlp.documents_of(bridge.raw_events(spark, DATA))._jdf.queryExecution().optimizedPlan().toString()
    assert '{"key":' not in plan
