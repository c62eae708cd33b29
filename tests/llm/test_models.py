"""HTML text, language model, chroma, classifier and vectors against brute force or known answers."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from spanlake.llm import chroma, hmm, html_text, quality, vectors


def test_main_text():
    page = (
        "<html><head><title>T</title><script>var a='</p>';</script></head><body><header><h1>Site</h1></header><nav><a>Home</a></nav>"
        "<div class='cookie-notice'>We use cookies</div><article><h1>One &amp; two</h1><p><b>A  b\n c<br><p>d &eacute;<form><input>x</form>"
        "<aside>side</aside><ul><li>e<li>f</ul><div class=comments><p>rude</p></div></article><footer>end</footer>"
    )
    assert html_text.main_text(page, frozenset()) == "One & two\nA b c\nd é\ne\nf"
    assert html_text.main_text("", frozenset()) == ""
    assert html_text.main_text("plain  text", frozenset()) == "plain text"
    assert html_text.main_text("<body><p>keep</p><div id=sidebar><p>no</p></div><p>too < 3</p>", frozenset()) == "keep\ntoo < 3"


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ("<article><div class='related-work'>a</div><p class='social-history'>b</p><p class='ad-hoc'>c</p><div class='social-share'>no</div><p class='ad banner'>no</p></article>", "a\nb\nc"),
        ("<article><p title=it's>Hello</p><p data-x = 'a>b' y=\"c>d\">there</p><a href=/x/>link</a></article>", "Hello\nthere\nlink"),
        ("<article><p>one</p><select><option>A<option>B<p>two</p></article>", "one\ntwo"),
        ("<article><div><select><option>A</div>three<aside>no<p>no</p></article><p>out</p>", "three"),
        ("<article><p>x<script>if (a < b) '</p>'</script >y</p><svg><text>no</text></svg><noscript><p>no</p></noscript><p>z</article><article class=comment><p>rude</p></article>", "xy\nz"),
        ("<main><article><p>in</p></article><p>still in</p></main><p>out</p>", "in\nstill in"),
        ("<p>1 < 2 & 3 > 2 &lt;b&gt; &#233;&nbsp;x</p><p title=\"unclosed>text</p>", "1 < 2 & 3 > 2 <b> é x\ntext"),
    ],
)
def test_odd_markup(body, text):
    assert html_text.main_text(f"<html><body>{body}</body></html>", {}) == text


def test_the_template_decides(spark, monkeypatch):
    """With the templates emptied, texts that stand on all pages of a host come back."""
    rows = [(k, f"http://h.example/{k}", f"<body><div>Same top</div><article><p>Own {k} {k}</p><p>Read more</p><i>of us</i></article>") for k in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    with_it = {r.page_id: r.text for r in html_text.extract(df).collect()}
    real = html_text.templates
    monkeypatch.setattr(html_text, "templates", lambda pages: real(pages).limit(0))
    without = {r.page_id: r.text for r in html_text.extract(df).collect()}
    assert with_it == {k: f"Own {k} {k}" for k in range(6)} and without == {k: f"Own {k} {k}\nRead more\nof us" for k in range(6)}


def test_a_page_longer_than_a_block(spark):
    text = " ".join(f"w{k}" for k in range(400_000))
    df = spark.createDataFrame([(1, None, f"<article><p>{text}</p></article>", "x", 3)], "page_id long, url string, html string, template string, host int")
    (r,) = html_text.extract(df).collect()
    assert r.text == text and r.n_chars == len(text) > 1 << 21


def test_pages_without_article_use_the_template(spark):
    rows = [(k, f"http://h.example/{k}", f"<body><div>Same top</div><p>Own text {k} {k}</p><div>Same end</div>", 1) for k in range(6)] + [(9, None, None, 1), (9, None, "", 1)]
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect())
    assert got == [*((k, f"Own text {k} {k}", 12) for k in range(6)), (9, "", 0), (9, "", 0)]
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def html_texts(spark, bodies):
    rows = [(k, f"http://h.example/{k}", f"<body>{b}</body>") for k, b in enumerate(bodies)]
    return [r.text for r in sorted(html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect(), key=lambda r: r.page_id)]


def test_template_inside_an_article_is_dropped(spark):
    got = html_texts(spark, [f"<article><h1>Own {k}</h1><p>Text {k} {k}</p><div>Thanks for reading</div></article>" for k in range(5)])
    assert got == [f"Own {k}\nText {k} {k}" for k in range(5)]


def test_a_heading_alone_is_no_template(spark):
    got = html_texts(spark, [f"<div>Top</div><h2>{'Shared' if k < 4 else 'Other'}</h2><p>Text {k} {k}</p><div>End</div>" for k in range(5)])
    assert got == [f"{'Shared' if k < 4 else 'Other'}\nText {k} {k}" for k in range(5)]


def test_copies_of_a_page_count_once(spark):
    kinds = [0, 0, 0, 0, 1, 2]
    got = html_texts(spark, [f"<div>Top</div><h2>Head {k}</h2><p>Text {k} {k}</p><div>End</div>" for k in kinds])
    assert got == [f"Head {k}\nText {k} {k}" for k in kinds]


def test_tokens_out_of_order_are_no_template():
    page = lambda a, b: f"<body><i>{a}</i><p>own</p><u>{b}</u></body>"
    key = [html_text._key("body/i", "one"), html_text._key("body/u", "two")]
    assert html_text.main_text(page("one", "two"), html_text.places([key])) == "own"
    assert html_text.main_text(page("one", "two"), html_text.places([key[::-1]])) == "one\nown\ntwo"


def test_forward_equals_all_paths():
    rng = np.random.default_rng(0)
    model = hmm.Model(np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]]), rng.dirichlet(np.ones(4), 2))
    ids, offs = np.array([0, 3, 2, 1, 3]), np.array([0, 1, 5])
    sums = np.zeros(2), np.zeros((2, 2)), np.zeros((2, 4))
    got = hmm.walk(model, ids, offs, sums)
    for a, b, x in zip(offs, offs[1:], got, strict=False):
        seq, total = ids[a:b], 0.0
        for path in itertools.product(range(2), repeat=len(seq)):
            p = model.start[path[0]] * model.draw[path[0], seq[0]]
            for i in range(1, len(seq)):
                p *= model.step[path[i - 1], path[i]] * model.draw[path[i], seq[i]]
            total += p
        assert abs(x - math.log10(total)) < 1e-9
    assert abs(sums[2].sum() - 5) < 1e-9 and abs(sums[1].sum() - 3) < 1e-9 and abs(sums[0].sum() - 2) < 1e-9
    assert np.allclose(sums[2].sum(0), np.bincount(ids, minlength=4))


def test_language_model(spark):
    rng = random.Random(1)
    kinds = [["aa", "bb", "cc", "dd"], ["xx", "yy", "zz", "ww"]]
    rows = [(k, " ".join(rng.choice(kinds[k % 2]) for _ in range(rng.randint(5, 60))), 0) for k in range(200)] + [(300, None, 0), (301, "", 0), (302, "Never SEEN never", 0), (None, "aa", 0), (5, "AA bb", 0)]
    counts, texts = Counter(), []
    for k, t, _ in rows:
        w = (t or "").encode().lower().split()
        held = zlib.crc32(("" if k is None else str(k)).encode()) % 5 == 1
        texts.append((k, held, w))
        if not held:
            counts.update([*w, None])
    total, kinds_n = sum(counts.values()), len(counts)
    want = sorted(((-1 if k is None else k), held, len(w) + 1, sum(counts[x] > 0 for x in [*w, None]), round(sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (kinds_n + 1))) for x in [*w, None]), 6)) for k, held, w in texts)
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    for known in (3, 1000):
        got = hmm.score(df, known=known).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
        assert {r.train_tokens for r in got} == {total}
        own = [r for r in got if r.held_out and r.n_tokens > 5]
        assert sum(r.score for r in own) > sum(r.base_score for r in own)
    assert hmm.score(df.limit(0)).count() == 0


def test_trees_learn_and_walk():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    trees = quality.fit(x[:2000], y[:2000])
    assert ((trees.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.95
    one = trees.raw(x[2000:2003])
    for k, row in enumerate(x[2000:2003]):
        total = trees.base
        for f, t, v in zip(trees.feature, trees.threshold, trees.value, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + (row[f[node]] > t[node])
            total += v[node - len(f)]
        assert abs(total - one[k]) < 1e-9
    assert quality.fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]
    assert (quality.fit(x[:5], np.ones(5)).score(x[:2]) > 0.99).all()


def test_classifier_on_odd_rows(spark):
    rng = random.Random(3)
    good = lambda: " ".join("".join(rng.choice("etaoin") for _ in range(rng.randint(2, 8))) for _ in range(50)) + "."
    rows = [(k, good() if k % 2 else "spam! " * 40, "x") for k in range(200)] + [(500, None, "x"), (501, "", "x"), (None, good(), "x"), (1, good(), "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)] + [(700, None), (None, 1)], "doc_id long, quality int")
    out = quality.scored(docs, quality.learn(docs, labels)).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 200]
    assert held and all(r.predicted == r.doc_id % 2 for r in held)
    assert quality.scored(docs.limit(0), quality.learn(docs, labels.limit(0))).count() == 0


def test_chroma_aligns_a_shifted_noisy_copy():
    rng = np.random.default_rng(4)
    tune = chroma.melody(rng.normal(size=80))
    part = tune[10 * chroma.HOP :] + rng.normal(size=len(tune) - 10 * chroma.HOP) * 0.02
    a, b, c = chroma.fingerprint(tune), chroma.fingerprint(part), chroma.fingerprint(chroma.melody(rng.normal(size=80)))
    off, _, error = chroma.align(a, b)
    assert off == 10 and error < 0.1
    assert chroma.align(a, a)[2] == 0 and chroma.align(a, c)[2] > 0.2
    assert len(chroma.fingerprint(np.zeros(0))) == 0 and chroma.align(a, np.zeros(0, np.uint32)) == (0, 0, 1.0)


def test_chroma_report(spark):
    rng = np.random.default_rng(5)
    x = [rng.normal(size=64).tolist() for _ in range(6)]
    rows = [(0, x[0]), (1, x[1]), (2, x[0]), (50, x[1]), (51, None), (52, []), (None, x[3])]
    got = {r.vec_id: r for r in chroma.report(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding", chroma.melody).collect()}
    assert [m.query_id for m in got[2].matches] == [0] and [m.query_id for m in got[1].matches] == [50] and not got[0].matches
    assert (got[0].query_class, got[50].query_class, got[2].query_class, got[51].query_class) == (0, 50, None, None)
    assert got[51].n_codes == 0 and got[0].codes_sha256 == chroma.digest(chroma.fingerprint(chroma.melody(x[0])))


def brute_matches(prints, queries, most=0.1):
    """Every query aligned with every recording, one by one."""
    out = {}
    for i, codes in prints.items():
        for q in queries:
            offset, votes, error = chroma.align(prints[q], codes)
            n = min(len(prints[q]) - max(offset, 0), len(codes) - max(-offset, 0))
            if votes and n >= chroma.WINDOW and error <= most and q != i:
                out[i, q] = (offset, votes, error)
    return out


@pytest.mark.parametrize(("block", "hits"), [(1 << 20, 1 << 21), (500, 300)])
def test_chroma_matches_equal_brute_force(spark, monkeypatch, block, hits):
    """The registered query's report over a whole small table, with planted parts, noisy copies, silence and copies of queries."""
    monkeypatch.setattr(chroma, "BLOCK", block)
    monkeypatch.setattr(chroma, "HITS", hits)
    rng = np.random.default_rng(8)
    tunes = [chroma.melody(rng.normal(size=24)) for _ in range(30)]
    rows = {k: t for k, t in enumerate(tunes)}
    rows |= {100 + k: t[chroma.HOP * (k % 5) :] + rng.normal(size=len(t) - chroma.HOP * (k % 5)).astype(np.float32) * 0.02 for k, t in enumerate(tunes[:12])}
    rows |= {150: tunes[0], 151: tunes[0], 200: np.zeros(6000, np.float32), 201: np.zeros(9000, np.float32), 250: tunes[3], 251: tunes[20][: chroma.FRAME + chroma.HOP * 20]}
    df = spark.createDataFrame([(k, [float(x) for x in v], "x") for k, v in rows.items()], "vec_id long, embedding array<double>, matches string")
    got = {r.vec_id: r for r in chroma.report(df, "vec_id", "embedding").collect()}
    prints = {k: chroma.fingerprint(v) for k, v in rows.items()}
    asked = sorted(k for k in rows if k % 50 == 0)
    first = {}
    for q in asked:
        first.setdefault(prints[q].tobytes(), q)
    want = brute_matches(prints, sorted(first.values()))
    assert {(k, m.query_id): (m.offset, m.votes, m.bit_error) for k, r in got.items() for m in r.matches} == want
    assert len(want) > 3 and all(r.query_class == (first[prints[k].tobytes()] if k in asked else None) for k, r in got.items())


@pytest.mark.parametrize("part", [16, 65_536])
def test_vectors_against_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(vectors, "PART", part)
    rng = np.random.default_rng(6)
    base = rng.normal(size=(60, 16))
    x = np.concatenate([base, base[:40] + rng.normal(size=(40, 16)) * 0.12, base[:20] + rng.normal(size=(20, 16)) * 0.05, base[:10], base[:10]])
    rows = [(k, v.tolist(), "x") for k, v in enumerate(x)] + [(900, None, "x"), (901, [0.0] * 16, "x"), (902, [None] * 16, "x"), (903, [float("nan")] * 16, "x"), (904, [1.0, 2.0], "x"), (None, x[0].tolist(), "x")]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    got = {r.vec_id: r for r in vectors.groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links string")).collect()}
    found = sum(got[k].n_links for k in range(len(x)))
    assert all(got[k].n_links <= near[k].sum() - 1 for k in range(len(x))) and found >= 0.9 * (near.sum() - len(x)) > 0
    assert all(got[k].n_links == 0 and got[k].kept for k in (900, 901, 902, 903, 904, None))
    assert got[120].component_id == 0 and not got[120].kept
    assert vectors.groups(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_visits_are_the_nearest_cells():
    rng = np.random.default_rng(1)
    a, b = rng.random((20, 9)), rng.random((20, 7))
    query, row, column = vectors.visits(a, b, 0.4)
    for k in range(20):
        mine = query == k
        cells = {int(r) * 7 + int(c) for r, c in zip(row[mine], column[mine], strict=True)}
        assert cells and cells == set(vectors.traversal(a[k], b[k], len(cells)))


@pytest.mark.parametrize("kind", ["float", "double"])
def test_recall_of_planted_pairs(spark, tmp_path, kind):
    """40,000 vectors without structure, 1,500 of them with a neighbour at a cosine of 0.95 to 0.97."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(38_500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    noise = rng.normal(size=(1500, 64))
    noise -= (noise * x[:1500]).sum(1, keepdims=True) * x[:1500]
    cos = rng.uniform(0.9502, 0.97, 1500)[:, None]
    near = cos * x[:1500] + np.sqrt(1 - cos**2) * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    rows = np.concatenate([x, near]).astype(np.float32 if kind == "float" else np.float64)
    pq.write_table(pa.table({"vec_id": np.arange(len(rows)), "embedding": pa.array(list(rows))}), f"{tmp_path}/v.parquet")
    df = spark.read.parquet(f"{tmp_path}/v.parquet").selectExpr("vec_id", f"cast(embedding as array<{kind}>) embedding")
    got = vectors.groups(df).toPandas().set_index("vec_id").sort_index()
    u = rows.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = np.zeros(len(u), np.int64)
    for i in range(0, len(u), 2000):
        want[i : i + 2000] = (u[i : i + 2000] @ u.T >= 0.95).sum(1) - 1
    assert want.sum() >= 3000 and (got.n_links.to_numpy() <= want).all()
    assert got.n_links.sum() >= 0.995 * want.sum(), got.n_links.sum() / want.sum()
