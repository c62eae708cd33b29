"""The pipeline's stages, one after another, against brute force on each stage's own input."""

import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from spanlake.llm.queries import CAPACITY, END_ID, QUERIES, tokenizer_path
from test_near_dedup import brute as near_brute
from test_tokens import check_packed
from tokenizers import Tokenizer

DATA = "/root/testdata/sf0.001"
QUALITY, NEAR, PASSAGES, PACKED = (stage for _, stage in corpus_pipeline.STAGES)


def without_passages(texts, length=200, least=50):
    """Texts without bytes of repeated strings, in runs that touch fifty words or more."""
    raw = {k: (t or "").encode() for k, t in texts.items()}
    seen = Counter(b[i : i + length] for b in raw.values() for i in range(len(b) - length + 1))
    out = {}
    for k, b in raw.items():
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)]
        for m in re.finditer(b"\1+", bytes(gone)):
            if sum(s < m.end() and e > m.start() for s, e in spans) < least:
                gone[m.start() : m.end()] = bytes(m.end() - m.start())
        out[k] = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
    return out


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    good = QUALITY(spark, docs, DATA).cache()
    assert good.columns == columns and 0 < good.count() < docs.count()
    texts = {r.doc_id: r.text for r in good.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    told = [d for d in labels if d in {r.doc_id for r in docs.select("doc_id").collect()}]
    assert np.mean([(d in texts) == (labels[d] == 1) for d in told]) > 0.95

    alone = NEAR(spark, good, DATA).cache()
    groups = near_brute(list(texts.items()), 5, 80, 100)
    left = {r.doc_id: r.text for r in alone.collect()}
    assert alone.columns == columns and left == {k: t for k, t in texts.items() if groups[k][1] == k}

    cut = PASSAGES(spark, alone, DATA).cache()
    rows = cut.collect()
    assert cut.columns == columns and {r.doc_id: r.text for r in rows} == without_passages(left)
    assert all(r.n_chars == len(r.text) for r in rows)

    packed = PACKED(spark, cut, DATA)
    pieces = packed.collect()
    check_packed(pieces, CAPACITY)
    library, ids = Tokenizer.from_file(tokenizer_path()), {}
    for r in rows:
        ids[r.doc_id] = library.encode(r.text, add_special_tokens=False).ids + [END_ID]
    assert Counter(r.doc_id for r in pieces).keys() == ids.keys()
    for r in pieces:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    again = QUERIES["pipeline"](spark, DATA)
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in again.collect()) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in pieces)


PASSAGE = " ".join(f"passage{k}" for k in range(60))
PROSE = " ".join(f"alone{k}" for k in range(40))
OWN = [" ".join(f"{w}{k}" for k in range(60)) for w in ("first", "other")]
ODD = [
    (1, None, "a"), (2, "", "b"), (3, " \t\n", "c"), (None, "no id here, and some words more", "d"), (4, PROSE, "e"), (5, PROSE, "f"), (5, PROSE, "f"), (6, f"{OWN[0]} {PASSAGE} end", "g"), (7, f"{OWN[1]} {PASSAGE} tail", "h"),
    (8, "w " * 1_200_000 + "long", "i"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, component_id string, __left string, score string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(k, t, "en", s, len(t or ""), "x", "y", "z", "q") for k, t, s in ODD], SCHEMA)


def test_odd_rows_near_duplicates(spark, odd):
    got = NEAR(spark, odd, DATA)
    assert got.columns == odd.columns
    assert sorted((r.doc_id or 0, r.source, r.kept) for r in got.collect()) == sorted((k or 0, s, "x") for k, _, s in ODD if k != 5)


def test_odd_rows_passages(spark, odd):
    got = PASSAGES(spark, odd, DATA)
    assert got.columns == odd.columns
    texts = {r.source: (r.text, r.n_chars) for r in got.collect()}
    assert got.count() == len(ODD) and texts["a"] == texts["b"] == ("", 0) and texts["c"] == (" \t\n", 3)
    assert "passage1" not in texts["g"][0] + texts["h"][0] and texts["g"][0].startswith(OWN[0][:-10]) and texts["h"][0].startswith(OWN[1][:-10])
    assert texts["d"][0] == ODD[3][1] and len(texts["e"][0]) == texts["e"][1] == len(PROSE)


def test_odd_rows_quality_and_packing(spark, odd):
    got = QUALITY(spark, odd, DATA)
    assert got.columns == odd.columns and got.count() <= len(ODD)
    pieces = PACKED(spark, odd, DATA).collect()
    check_packed(pieces, CAPACITY)
    assert sum(r.length for r in pieces if r.doc_id in (1, 2)) == 2


def test_empty_tables(spark, odd):
    for stage in (QUALITY, NEAR, PASSAGES, PACKED):
        assert stage(spark, odd.limit(0), DATA).count() == 0
