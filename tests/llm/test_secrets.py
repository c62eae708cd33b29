"""Secret scans against plain matching and all segmentations."""

import hashlib
import random
import re
from math import log10

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from spanlake.llm import queries, secret_scan
from spanlake.llm.secret_scan import KINDS

RANKS = {w: log10(k + 1) for k, w in enumerate(["the", "password", "horse", "battery", "a", "correct", "on", "staple", "pass"])}
PATTERNS = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 0, 20),
    ("hex", r"[0-9a-f]+", 0, 0, 24),
)
PIECES = ["token", "Secret", "API_KEY", "apikey", "password", "PASSWD", "pwd", "tokentoken", "ſecret", "toKen", ":", "=", " = ", "\"", "'", " ", "\n", "AKIA", "AKIA" + "Z9" * 8, "AKIAX", "deadbeef" * 3, "0123456789abcdef" * 2, "abc", "x" * 5, "hunter2", "Tr0ub4dor&3", "é", "日本", "a.b=c-d", "Authorization: Bearer ", "."]


def plain_base(text):
    found = []
    for place, (kind, pattern, flags, group, least) in enumerate(PATTERNS):
        found += [(m.start(), place, m.end()) for m in re.finditer(pattern, text, flags) if len(m[group]) >= least]
    return sorted(found)


def test_base_spans_against_plain_patterns():
    rnd = random.Random(1)
    hits = 0
    for _ in range(4000):
        text = "".join(rnd.choices(PIECES, k=rnd.randrange(12)))
        want = plain_base(text)
        assert secret_scan.base_spans(text, secret_scan.named(text)) == want, text
        hits += len(want)
    assert hits > 1000


def all_segmentations(value, words):
    """The least cost by recursion over every cut, each piece priced by its own rules."""
    brute = [0.0]
    for c in value:
        brute.append(brute[-1] + secret_scan.char_cost(c))
    found = [*secret_scan.spells(value, words), *secret_scan.dates(value), *secret_scan.repeats(value, brute, words), *secret_scan.walks(value)]

    def least(i):
        if i == len(value):
            return 0.0
        return min([secret_scan.char_cost(value[i]) + least(i + 1), *(c + least(j) for a, j, c in found if a == i)])

    return least(0)


def test_the_cheapest_segmentation():
    rnd = random.Random(7)
    for _ in range(200):
        value = "".join(rnd.choices(["the", "Horse", "qwe", "1234", "aaa", "2019", "x", "$", "P4ss", "Z", "é", "12-05-1999"], k=rnd.randrange(1, 4)))[:14]
        assert abs(secret_scan.guess_cost(value, RANKS) - all_segmentations(value, RANKS)) < 1e-9, value


@pytest.mark.parametrize(
    ("value", "start", "end"),
    [("qwertz", 0, 5), ("1qaz", 0, 4), ("poiuy", 0, 5), ("abcdef", 0, 6), ("9876", 0, 4), ("xQwErTyx", 1, 7), ("zxcvbnm", 0, 7)],
)
def test_walks(value, start, end):
    assert (start, end) in {(i, j) for i, j, _ in secret_scan.walks(value)}


def test_dates_and_repeats():
    assert {(i, j) for i, j, _ in secret_scan.dates("x2024-02-29y19991231")} >= {(1, 11), (1, 5), (12, 20)}
    assert (0, 8) not in {(i, j) for i, j, _ in secret_scan.dates("20231331")}
    value = "ab" * 6 + "c"
    brute = [secret_scan.char_cost("a") * k for k in range(14)]
    assert (0, 12) in {(i, j) for i, j, _ in secret_scan.repeats(value, brute, {})}


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ('db password: "Tr0ub4dor&3" ok', ["Tr0ub4dor&3"]),
        ("Authorization: Bearer x9$Kq!7pLz.", ["x9$Kq!7pLz"]),
        ("pwd=9Kd#2mXq;", ["9Kd#2mXq"]),
        ("access_key => 'q8Zr7TnB2w'", ["q8Zr7TnB2w"]),
        ("password: P@ssword!, passwd: qwerty12345", []),
        ("The token: Erichenungen. The secret: something unheard", []),
        ("pwd = 2024-01-31", []),
        ("api-key: aaaaaaaaaaaaaaaaaaaaaaaa", []),
        ('token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"', []),
    ],
)
def test_values_that_are_dear_to_guess(text, found):
    base = secret_scan.base_spans(text)
    assert [text[s:e] for s, _, e in secret_scan.guess_spans(text, RANKS, base)] == found


def test_long_values_take_linear_time():
    assert secret_scan.guess_cost("x9$Kq!7pLz" * 2000, RANKS) < 40
    rnd = random.Random(2)
    assert secret_scan.guess_cost("".join(rnd.choices("abcXYZ019$", k=20_000)), RANKS) > 10_000


def whole(spark, tmp_path, rows):
    ids, texts = zip(*rows, strict=True) if rows else ((), ())
    n = len(ids)
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), **{c: pa.array(["x"] * n, pa.string()) for c in ("spans", "n_hex", "lang", "term", "d")}}), tmp_path / "documents.parquet")
    return queries.op13_secrets(spark, str(tmp_path)).collect()


def test_the_query_on_odd_rows(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(k, "".join(rnd.choices(PIECES, k=rnd.randrange(14)))) for k in range(300)] + [(1, None), (None, ""), (5, "token: abcdef1"), (5, "token: abcdef1"), (9, "x " * 1_500_000 + "secret=abcdef1")]
    got = whole(spark, tmp_path, rows)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    made = sorted(((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.n_guess, r.spans) for r in got), key=key)
    want = []
    words = {w: log10(k + 1) for k, w in enumerate(secret_scan.COMMON)}
    from collections import Counter

    counts = Counter(w for _, t in rows for w in {x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")} if len(w) <= 32)
    top = sorted((w for w, n in counts.items() if n >= 30), key=lambda w: (-counts[w], w.encode()))
    words = {w: log10(k + 1) for k, w in enumerate(top)} | {w: min(c, log10(top.index(w) + 1) if w in top else 99) for w, c in words.items()}
    for i, t in rows:
        base = plain_base(t or "")
        more = secret_scan.guess_spans(t or "", words, base)
        say = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))
        want.append((i, *(sum(k == x for _, k, _ in base) for x in range(3)), hashlib.sha256(say(base).encode()).hexdigest(), len(more), say(base + more)))
    assert made == sorted(want, key=key)
    assert sum(r.n_guess for r in got) > 10


def test_no_rows(spark, tmp_path):
    assert whole(spark, tmp_path, []) == []


def test_the_given_documents(spark):
    """Base spans equal plain patterns; the prose gets no further span."""
    d = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op13_secrets(spark, d).collect()}
    assert got.keys() == texts.keys()
    for i, r in got.items():
        base = plain_base(texts[i])
        assert r.spans == ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base) and r.n_guess == 0
    assert sum(r.n_assign for r in got.values()) > 0
