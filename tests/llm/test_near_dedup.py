"""Near-duplicate groups against brute force over all pairs."""

import random

import numpy as np
import pytest

from spanlake.llm import near_dedup
from spanlake.llm.components import components


def shingle_set(text, size):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(rows, size, least, of):
    sets = {k: shingle_set(t, size) for k, t in rows}
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and of * both >= least * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: (len(sets[k]), find(k)) for k in keys}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    word = lambda: rng.choice(["the", "of", "and", "erst", "Ou", "blé", "nd", "ti", "ha", "re", "wh"]) + rng.choice(["", "an", "in", "er", "es", "on"]) + str(rng.randint(0, 30))
    out = [(0, None), (1, ""), (2, " \t\n"), (3, "One two"), (4, "one  TWO"), (5, "solo"), (6, "one two three"), (7, "One two three")]
    for base in range(25):
        text = [word() for _ in range(rng.choice([8, 30, 90, 400]))]
        for _ in range(rng.randint(1, 14)):
            copy = list(text)
            for _ in range(rng.randint(0, max(1, len(copy) // 25))):
                copy[rng.randrange(len(copy))] = word()
            out.append((10 + len(out), " ".join(copy)))
    return out


@pytest.mark.parametrize(("size", "least", "meet", "part"), [(3, 85, 8, 4), (5, 80, 2048, 1024), (3, 85, 4, 3), (5, 80, 2, 1)])
def test_groups(spark, rows, size, least, meet, part, monkeypatch):
    monkeypatch.setattr(near_dedup, "MEET", meet)
    monkeypatch.setattr(near_dedup, "PART", part)
    monkeypatch.setattr(near_dedup, "CROWD", 3 if meet < 8 else 256)
    monkeypatch.setattr(near_dedup, "BROADCAST", 0 if meet < 8 else 1 << 20)
    df = spark.createDataFrame([(k, t, 0) for k, t in rows], "doc_id long, text string, kept int")
    want = brute(rows, size, least, 100)
    got = near_dedup.groups(df, size, least, 100).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id], r
        assert r.kept == (r.doc_id == r.component_id)
    assert sum(not r.kept for r in got) > 40


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, "A b C d")], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id, r.kept) for r in near_dedup.groups(df, 3, 85, 100).collect())
    assert got == [(False, 1, 1, True), (False, 1, 1, True), (False, 2, 1, False), (True, 0, None, True)]
    assert near_dedup.groups(df.limit(0)).count() == 0


def test_estimate_is_near_the_truth():
    rng = np.random.default_rng(3)
    pool = rng.integers(1, 1 << 63, 3000).astype(np.uint64) << np.uint64(1)
    a, b = np.sort(pool[:2000]), np.sort(pool[300:2300])
    regs = near_dedup.registers(np.repeat([0, 1], [2000, 2000]), np.concatenate([a, b]), 2)
    got = near_dedup.estimate(regs[:1], regs[1:], np.array([2000]), np.array([2000]))[0, 0]
    assert abs(got - 1700 / 2300) < 0.15


def test_components(spark):
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(7, 7), (200, 201), (201, 200)]
    parent = {n: n for pair in links for n in pair}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    alone = {n for n in parent if all(a == b for a, b in links if n in (a, b))}
    assert got == {n: find(n) for n in parent if n not in alone}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("least", [80])
def test_short_pairs_at_the_threshold(spark, least):
    """Pairs of 4 and 5 shingles whose bands are headed by their own openings, which are unlike them."""
    rows, want = [], {}
    for base in range(120):
        w = [f"w{base}x{k}" for k in range(9)]
        heads = [w[i : i + n] for n in (5, 6, 7) for i in range(9 - n)]
        for k, words in enumerate([*heads, w[:8], w]):
            rows.append((100 * k + 10_000 * base, " ".join(words)))
        want[rows[-1][0]] = rows[-2][0]
    got = {r.doc_id: r.component_id for r in near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string"), 5, least, 100).collect()}
    assert got == {k: want.get(k, k) for k, _ in rows}


def thue_morse(n):
    """A word and its complement, whose hashes modulo 2^64 are equal under any sum of powers."""
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_periodic_words_differ(spark):
    a, b = thue_morse(2048)
    rows = [(1, f"one two {a}"), (2, f"one two {b}"), (3, f"one two {a}")]
    got = {r.doc_id: r.component_id for r in near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, 100).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_a_text_longer_than_a_block_and_clashing_names(spark):
    rng = random.Random(11)
    long = [f"w{rng.randrange(90000)}" for _ in range(400_000)]
    near = list(long)
    for _ in range(2000):
        near[rng.randrange(len(near))] = "other"
    texts = [" ".join(long), " ".join(near), " ".join(long[:200_000])]
    assert len(texts[0]) > 1 << 21
    df = spark.createDataFrame([(k, t, "x", 0.5, "y") for k, t in enumerate(texts)], "doc_id long, text string, id string, band double, u string")
    got = near_dedup.groups(df, 5, 80, 100).collect()
    assert {r.doc_id: r.component_id for r in got} == {0: 0, 1: 0, 2: 2}
    assert got[0].asDict().keys() == {"doc_id", "n_shingles", "component_id", "kept"}
