"""The source audit against SQL and plain counting."""

import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import regex

from spanlake.llm import divergence, oracles, queries

COLUMNS = ["lang", "source", "part", "item", "value", "rank"]
WORDS = ["the", "The", "of", "été", "straße", "naïve", "日本", "x", "Y", "and", "data", "ſ", "İ"]


def both(spark, tmp_path, rows):
    """Rows of (text, lang, source) as documents whose other columns have clashing names."""
    text, lang, source = zip(*rows, strict=True) if rows else ((),) * 3
    n = len(text)
    strings = lambda v: pa.array(list(v), pa.string())
    pq.write_table(pa.table({"doc_id": pa.array([k // 2 for k in range(n)], pa.int64()), "text": strings(text), "lang": strings(lang), "source": strings(source), "term": strings(["t"] * n), "c": strings(["c"] * n), "vec": strings(["v"] * n)}), tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select doc_id, text, lang, source from '{tmp_path}/documents.parquet'")
    want = sorted(con.sql(f"select {', '.join(COLUMNS)} from ({oracles.DIVERGENCE})").fetchall())
    got = sorted(tuple(r[c] for c in COLUMNS) for r in queries.op12_divergence(spark, str(tmp_path)).collect())
    assert got == want
    return got


def some(rnd, n, langs=("en", "de", None), sources=("a", "b", "é", "", None)):
    return [(" ".join(rnd.choices(WORDS, [5, 3, 3, 2, 2, 1, 1, 1, 1, 1, 1, 1, 1], k=rnd.randrange(14))) + rnd.choice(["", ".", " 12_[x]`{q}", "\x00a\x7fb"]), rnd.choice(langs), rnd.choice(sources)) for _ in range(n)]


def test_odd_rows_against_sql(spark, tmp_path):
    rnd = random.Random(2)
    rows = some(rnd, 400) + [(None, "en", "a"), ("", "fr", "only"), (None, None, None), ("lonely words", "fr", "other"), ("...", "it", "x"), ("...", "it", "y")]
    got = both(spark, tmp_path, rows + rows[:50])
    assert {("fr", "only", "pair", "other", 0, 1), ("it", "x", "pair", "y", 0, 1)} <= set(got) and any(r[2] == "term" for r in got)


def test_terms_with_equal_vectors_count_by_their_number(spark, tmp_path):
    """Sixty terms share two vectors, and their values tie: ranks go by the term, to fifty."""
    rows = [(" ".join(f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60)) + " both", "en", "a")] * 31 + [("both " * 3, "en", "b")] * 5
    got = both(spark, tmp_path, rows)
    assert [r[5] for r in got if r[2] == "term" and r[1] == "a"] == list(range(1, 51))


def test_one_source_and_none(spark, tmp_path):
    got = both(spark, tmp_path, [("a b c", "en", "only")] * 40)
    assert got == []
    assert both(spark, tmp_path, []) == []


def test_a_hot_source_and_a_long_text(spark, tmp_path):
    rnd = random.Random(4)
    rows = some(rnd, 300, ("en",), ("hot",)) + some(rnd, 60, ("en",), ("a", "b")) + [("the data " * 400_000, "en", "b")]
    assert both(spark, tmp_path, rows)


def test_counts_of_a_task_that_hands_on_early(monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 8)
    rows = [(t or "", l or "", s or "") for t, l, s in some(random.Random(6), 200)]
    text, lang, source = zip(*rows, strict=True)
    batch = pa.record_batch({"lang": pa.array(lang), "source": pa.array(source), "text": pa.array(text)})
    made = Counter()
    docs = Counter()
    for out in divergence._count(iter([batch.slice(0, 90), batch.slice(90)])):
        for r in out.to_pylist():
            made[r["lang"], r["source"], r["term"]] += r["c"]
            docs[r["lang"], r["source"], r["term"]] += r["d"]
    find = regex.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    down = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    want, want_docs = Counter(), Counter()
    for t, l, s in rows:
        found = find.findall(t.translate(down))
        want.update((l, s, x) for x in found)
        want_docs.update((l, s, x) for x in set(found))
    assert made == want and docs == want_docs


def test_shares_are_exact(spark):
    rnd = random.Random(9)
    for top in (10, 10**6, 2**47, 10**15):
        pairs = [(c := rnd.randrange(top), c + 5 + rnd.randrange(top)) for _ in range(300)]
        count, whole = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
        assert divergence.shares(count, whole).tolist() == [1 + 10**9 * (c + 5) // w for c, w in pairs]
        df = spark.createDataFrame([(c, w - 5 * 1, 1, 1 + 10**9 * (c + 5) // w) for c, w in pairs], "c long, n long, v long, want long")
        from pyspark.sql import functions as F

        assert df.filter(divergence.share(F.col("c"), F.col("n"), F.col("v")) != F.col("want")).count() == 0


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_the_given_tables(spark, sf):
    d = f"/root/testdata/sf{sf}"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{d}/documents.parquet'")
    want = sorted(con.sql(f"select {', '.join(COLUMNS)} from ({oracles.DIVERGENCE})").fetchall())
    assert sorted(tuple(r[c] for c in COLUMNS) for r in queries.op12_divergence(spark, d).collect()) == want
