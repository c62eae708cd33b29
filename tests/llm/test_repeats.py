"""Suffix sorting and repeat removal against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from spanlake.llm import repeats, suffixes


def brute_order(text, cap):
    order = sorted(range(len(text)), key=lambda i: text[i:].tolist())
    prefix = [0] * len(order)
    for k in range(1, len(order)):
        x, y = text[order[k - 1] :], text[order[k] :]
        while prefix[k] < min(len(x), len(y), cap) and x[prefix[k]] == y[prefix[k]]:
            prefix[k] += 1
    return order, prefix


def test_suffix_order(monkeypatch):
    rng = np.random.default_rng(1)
    for trial in range(200):
        text = rng.integers(1, int(rng.integers(2, 6)), int(rng.integers(1, 200)))
        text = np.tile(text[:5], 30) if trial % 3 == 0 else text
        text = np.append(np.concatenate([text, text]) if trial % 5 == 0 else text, 0).astype(np.uint16)
        monkeypatch.setattr(suffixes, "DIGIT", 2 if trial % 2 else 512)
        with suffixes.Space([300, 2000, 5000][trial % 3]) as space:  # bytes: arrays go to disk, and the recursion down to few symbols
            place, prefix = suffixes.sort(text, 20, space)
            assert (np.array(place).tolist(), np.array(prefix).tolist()) == brute_order(text, 20)


def test_a_shard_ten_times_the_bound():
    """All of a shard's tables are on disk, and so is its text; the runs equal those found by a table of all windows."""
    rng = np.random.default_rng(5)
    length, passage = 60, rng.integers(0, 4, 3000).astype(np.uint8) + 97
    rows = [np.concatenate([rng.integers(0, 4, 100).astype(np.uint8) + 97, passage[a : a + int(rng.integers(60, 300))]]) for a in rng.integers(0, 2700, 300)]
    offs = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    bound = 2 * int(offs[-1]) // 10
    space = suffixes.Space(bound)
    held = repeats.Stretches(length, space)
    for k in range(0, 300, 50):
        own = np.arange(k, k + 50)
        held.add(own, own, 0 * own, np.concatenate(rows[k : k + 50]), offs[k : k + 51] - offs[k])
    got = set()
    with space:
        for t1, _, lo, n in held.repeated():
            got |= {(t, p) for t, a, m in zip(t1.tolist(), lo.tolist(), n.tolist()) for p in range(a, a + m)}
        assert space.n > 10
    seen = {}
    for k, r in enumerate(rows):
        for p in range(len(r) - length + 1):
            seen.setdefault(r[p : p + length].tobytes(), []).append((k, p))
    assert got == {x for places in seen.values() if len(places) > 1 for x in places} and got


def test_small_shards_are_induced_and_full_ones_go_to_disk(monkeypatch):
    """With the bounds of the query: what is sorted in memory is the recursion's end only, and a full shard's queues are files."""
    rng = np.random.default_rng(8)
    seen, files, own = [], [], suffixes.in_memory
    monkeypatch.setattr(suffixes, "in_memory", lambda text, cap: seen.append(len(text)) or own(text, cap))
    for n in (20_000, repeats.SHARD_BYTES):
        passage = rng.integers(2, 30, 3000).astype(np.uint16)
        text = np.append(np.concatenate([np.append(passage[a : a + 500], 1) for a in rng.integers(0, 2500, n // 501 + 1)]), 0).astype(np.uint16)
        with suffixes.Space() as space:
            place, prefix = suffixes.sort(text, 400, space)
            place, prefix, used = np.array(place, np.int64), np.array(prefix, np.int64), space.n
        assert (np.bincount(place, minlength=len(text)) == 1).all()
        assert (prefix[1:] == suffixes.common(text, place[:-1], place[1:], 400)).all()
        a, b = place[:-1] + prefix[1:], place[1:] + prefix[1:]
        assert (text[a] < text[b])[prefix[1:] < 400].all()
        files.append(used)
    assert max(seen) <= suffixes.BASE and files[0] == 0 and files[1] > 5


def test_names_of_large_alphabets_are_one_symbol(monkeypatch):
    """The recursion's texts shrink with every level, and neighbouring symbols share a step: both had their price by the symbol."""
    rng = np.random.default_rng(9)
    texts, steps, own, push = [], [], suffixes.sort, suffixes.Queue.push
    monkeypatch.setattr(suffixes, "sort", lambda text, cap, space: texts.append(len(text)) or own(text, cap, space))
    monkeypatch.setattr(suffixes.Queue, "push", lambda *a: steps.append(len(a[0].ends)) or push(*a))
    passages = rng.integers(2, 60, (400, 500)).astype(np.uint16)
    text = np.append(np.concatenate([np.append(p[a : a + 450], 1) for p in passages for a in (0, 30)]), 0).astype(np.uint16)
    with suffixes.Space() as space:
        place, prefix = suffixes.sort(text, 400, space)
        place, prefix = np.array(place, np.int64), np.array(prefix, np.int64)
    assert (np.bincount(place, minlength=len(text)) == 1).all()
    assert (prefix[1:] == suffixes.common(text, place[:-1], place[1:], 400)).all()
    a, b = place[:-1] + prefix[1:], place[1:] + prefix[1:]
    assert (text[a] < text[b])[prefix[1:] < 400].all()
    assert sum(texts) < 1.6 * len(text)
    assert max(steps) > suffixes.BASE and sum(k == max(steps) for k in steps) < max(steps) / 4


def test_order_of_many_symbols():
    rng = np.random.default_rng(10)
    for trial in range(60):
        kind, top = ((np.uint16, 300), (np.uint32, 70_000), (np.uint32, 40))[trial % 3]
        text = rng.integers(1, top, int(rng.integers(1, 250)))
        text = np.append(np.concatenate([text, text[: len(text) // 2], np.repeat(text[:5], 9)]), 0).astype(kind)
        with suffixes.Space([300, 2000][trial % 2]) as space:
            place, prefix = suffixes.sort(text, 20, space)
            assert (np.array(place).tolist(), np.array(prefix).tolist()) == brute_order(text, 20)


def test_windows_without_a_like_do_not_reach_the_sort(monkeypatch):
    """What stays of stretches holds every window that repeats in its group, however groups are cut into batches; a group beyond the bound stays as it is."""
    rng, length, gram = np.random.default_rng(11), 60, 20
    rows = []  # stretches of (key, place of the gram, bytes), where other bytes come in at some distance from the gram
    for h in range(-20, 20):
        base = rng.integers(97, 123, 200).astype(np.uint8)
        for _ in range(40 if h == 3 else int(rng.integers(1, 6))):
            own = base.copy()
            left, right = rng.integers(60, 99), rng.integers(120, 160)
            own[:left], own[right:] = rng.integers(97, 123, left), rng.integers(97, 123, 200 - right)
            g, n = int(rng.integers(20, 41)), int(rng.integers(10, 21))
            rows.append((h, g, own[100 - g : 100 - g + n - 1 + length]))
    columns = lambda part, k: [np.arange(k, k + len(part)), np.zeros(len(part), np.int64), np.array([r[0] for r in part]), np.zeros(len(part), np.int32), np.array([r[1] for r in part], np.int32)]
    batch = lambda k, m: pa.RecordBatch.from_arrays([*map(pa.array, columns(rows[k : k + m], k)), pa.array([r[2].tobytes() for r in rows[k : k + m]], pa.binary())], ["t1", "t2", "h", "lo", "g", "bytes"])
    seen = {}
    for k, (h, _, b) in enumerate(rows):
        for p in range(len(b) - length + 1):
            seen.setdefault((h, b[p : p + length].tobytes()), []).append((k, p))
    want = {x for places in seen.values() if len(places) > 1 for x in places}
    windows = {(k, p) for k, r in enumerate(rows) for p in range(len(r[2]) - length + 1)}
    found = []
    for bound in (1 << 20, 1500):
        monkeypatch.setattr(repeats, "SHARD_BYTES", bound)
        for many in (7, len(rows)):
            got, wide = set(), set()
            for part, cut in repeats._whole_groups(batch(k, many) for k in range(0, len(rows), many)):
                wide.add(cut)
                t1, _, h, lo, data, offs = repeats._shared(part, cut, length, gram)
                for k, own, at, a, b in zip(t1.tolist(), h.tolist(), lo.tolist(), offs, offs[1:], strict=False):
                    assert own == rows[k][0] and data[a:b].tobytes() == rows[k][2][at : at + b - a].tobytes()
                    got |= {(k, p) for p in range(at, at + b - a - length + 1)}
            assert want and want <= got and len(got) < len(windows)
            large = {(k, p) for k, p in windows if rows[k][0] == 3}
            if bound == 1500 and many == 7:
                assert 3 in wide and large <= got
            elif bound > 1500:
                assert wide == {None}
            found.append(got)
    assert found[0] == found[1] and len(found[0]) < 0.7 * len(windows)


def brute(texts, length):
    seen = {}
    for t in texts:
        for p in range(len(t) - length + 1):
            seen[t[p : p + length]] = seen.get(t[p : p + length], 0) + 1
    out = []
    for t in texts:
        gone = [False] * len(t)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randint(3, 9)))
    passages = [" ".join(word() for _ in range(rng.randint(8, 30))) for _ in range(6)]
    texts = ["", None, "a" * 300, "xy" * 200, "short", "b" * 39, "b" * 41]
    for _ in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(1, 30))) for _ in range(3)]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            parts.insert(rng.randint(0, 3), p[rng.randint(0, 20) : len(p) - rng.randint(0, 20)])
        texts.append("".join(parts))
    texts += [texts[10]] * 3 + [texts[12][:-3] + "Q"] * 2
    return texts


@pytest.mark.parametrize("split", [4096, 1])
def test_removal(spark, monkeypatch, split):
    monkeypatch.setattr(repeats, "SPLIT", split)
    texts = corpus()
    rows = [(k if k != 5 else None, t, "own") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    want = {rows[k][0]: w for k, w in enumerate(brute([(t or "").encode() for t in texts], 40))}
    for gram in (10, 25):
        got = repeats.remove(df, length=40, gram=gram).collect()
        assert len(got) == len(texts)
        for r in got:
            assert (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) == want[r.doc_id], r.doc_id
    assert sum(w[1] > 0 for w in want.values()) > 20
    assert repeats.remove(df.limit(0), length=40).count() == 0


def test_text_output_is_valid(spark):
    df = spark.createDataFrame([(1, "é" * 40 + "a"), (2, "xé" + "é" * 40)], "doc_id long, text string")
    for r in repeats.remove(df, length=21, gram=7, as_text=True).collect():
        r.kept.encode()
        assert r.n_removed > 0


def test_runs_of_few_words_stay(spark):
    long, short = " ".join(f"w{k}" for k in range(60)), "x" * 200
    rows = [(1, f"uno {long} due"), (2, f"tres {long} nine"), (3, f"five {short} six"), (4, f"seven {short} eight")]
    got = {r.doc_id: (r.kept, r.n_spans) for r in repeats.remove(spark.createDataFrame(rows, "doc_id long, text string"), length=100, gram=40, as_text=True, least_words=50).collect()}
    assert got == {1: ("unodue", 1), 2: ("tresnine", 1), 3: (rows[2][1], 0), 4: (rows[3][1], 0)}


def test_periodic_texts_and_a_text_longer_than_a_block(spark):
    rng = random.Random(3)
    a = "a"
    while len(a) < 1024:
        a += a.translate(str.maketrans("ab", "ba"))
    long = "".join(rng.choice("abcdefgh ") for _ in range((1 << 21) + 5000))
    texts = ["p" + a, a.translate(str.maketrans("ab", "ba")) + "q", long, "start " + long[1000:1500], long[-700:] + " end"]
    want = {k: w[:3] for k, w in enumerate(brute([t.encode() for t in [*texts[:2], long[900:1600] + "|" + long[-800:], *texts[3:]]], 400))}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in repeats.remove(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got.pop(2)[1:] == want.pop(2)[1:] and got == want
