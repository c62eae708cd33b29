"""BPE codec, token files and packing against the tokenizers library, piece by piece."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from spanlake.llm import bpe, bpe_codec, packing, token_store
from spanlake.llm.bpe import Bpe
from spanlake.llm.common import utf8
from spanlake.llm.queries import tokenizer_path

PATH = tokenizer_path()
ODD = ["", " ", "  a", "a  b   c", "a \n b", "\n\n x", "don't we'll I'd ''s 's", "x<|endoftext|>y", "é b", "a　 b", "tab\t\tq \t r", "z" * 3000, "ab" * 2000 + " q", "😀" * 300, " " * 300, "1234567890" * 200, "ha" * 500 + "aaa" * 777, "x \n", "a\x1f b"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    rows = [(k, t, "x") for k, t in enumerate(ODD)] + [(100, None, "x"), (101, "same text", "y"), (101, "same text", "y"), (None, "no id", "z")]
    rows += [(200 + k, " ".join(rng.choice(["theand", "erst,", "Ou.\nWh", "1234", "é"]) for _ in range(rng.randint(1, 2500))), "s") for k in range(40)]
    return spark.createDataFrame(rows, "doc_id long, text string, token_ids string")


@pytest.mark.parametrize("by_library", [False, True])
def test_block_encoder_equals_the_library(library, by_library):
    own, rng = Bpe.at(PATH, by_library), random.Random(1)
    texts = ODD + ["".join(rng.choice("abeth '\n\t!.é1") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    ids, offs = own.encode(*utf8(pa.array(texts)))
    for k, text in enumerate(texts):
        assert ids[offs[k] : offs[k + 1]].tolist() == library.encode(text, add_special_tokens=False).ids, text[:40]


def test_tree_concatenation_equals_the_library(library):
    rng, own = random.Random(2), Bpe.at(PATH)
    for alphabet in ("thean", "a", "ab", "etaoinshrdlu"):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(600, 4000)))
        assert own.encode_unsplit(text.encode()).tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("leaf", [1, 3, 8])
def test_joins_of_many_runs(library, monkeypatch, leaf):
    monkeypatch.setattr(bpe, "LEAF", leaf)
    rng, own = random.Random(7), bpe.Bpe(PATH)
    runs = ["".join(rng.choice(rng.choice(["thean", "ab", "etaoinshrdlu"])) for _ in range(rng.randint(1, 90))) for _ in range(400)] + ["a" * 300]
    flat, lens = own.encode_runs([r.encode() for r in runs])
    for r, ids in zip(runs, np.split(flat, np.cumsum(lens)[:-1]), strict=True):
        assert ids.tolist() == library.encode(r, add_special_tokens=False).ids


def test_pieces_of_one_hash(library, monkeypatch):
    """A hash that tells no two pieces of a length apart: their bytes do, and periodic words get ids of their own."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    texts = [word, word.translate(str.maketrans("ab", "ba")), "one two", "two one six", word + " one"]

    class Poor:
        def __init__(self, data):
            pass

        def of(self, starts, ends):
            return (ends - starts).astype(np.uint64)

    for by_library in (False, True):
        for poor in (False, True):
            if poor:
                monkeypatch.setattr(bpe, "Ranges", Poor)
            own = bpe.Bpe(PATH, by_library)
            ids, offs = own.encode(*utf8(pa.array(texts)))
            for k, text in enumerate(texts):
                assert ids[offs[k] : offs[k + 1]].tolist() == library.encode(text, add_special_tokens=False).ids
        monkeypatch.undo()


def test_codec_round_trip(docs, library):
    got = bpe_codec.decode(bpe_codec.encode(docs, PATH), PATH).collect()
    assert len(got) == docs.count()
    for r in got:
        text = r.text or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(r.token_ids, "<u4").tolist() == ids
        assert r.decoded == library.decode(ids, skip_special_tokens=False)


def test_digests(docs, library):
    for r in bpe_codec.digests(docs.filter("doc_id < 100"), PATH).collect():
        ids = library.encode(ODD[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_codes_at_any_place():
    rng = np.random.default_rng(0)
    for ids in (np.zeros(0, np.uint32), np.array([7], np.uint32), rng.integers(0, 1 << 24, 5000).astype(np.uint32), rng.integers(0, 200, 1000).astype(np.uint32), rng.integers(0, 50257, 4097).astype(np.uint32)):
        codes = token_store.Codes(memoryview(token_store.pack(ids)))
        where = rng.permutation(len(ids))
        assert (codes.at(where) == ids[where]).all()
        for a, n in ((0, len(ids)), (len(ids) // 3, len(ids) // 2)):
            assert (codes.run(a, n) == ids[a : a + n]).all()


def test_token_files(spark, docs, library, tmp_path, monkeypatch):
    files, _ = token_store.write(docs, PATH, 2)
    got = sorted(token_store.read(files).collect(), key=lambda r: r.start)
    rows = docs.collect()
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in rows), key=lambda k: (k is not None, k))
    texts, at = {r.doc_id: r.text or "" for r in rows}, 0
    for r in got:
        ids = [*library.encode(texts[r.doc_id], add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    token_store.export(files, str(tmp_path / "out"))
    assert len(list((tmp_path / "out").iterdir())) == files.count()
    empty, _ = token_store.write(docs.limit(0), PATH, 2)
    assert token_store.read(empty).count() == 0


def check_packed(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(bins)


def test_packing(docs, library):
    capacity = 64
    rows = packing.pack(docs, PATH, 2, capacity).collect()
    n = check_packed(rows, capacity)
    total = sum(r.length for r in rows)
    assert -(-total // capacity) <= n <= total / capacity * 1.05 + 1
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for k, text in enumerate(ODD):
        ids, at = [*library.encode(text, add_special_tokens=False).ids, 2], 0
        for i, r in enumerate(sorted(by[k], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (i, at) and (r.length == capacity or i == 0)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert len(by[101]) == 2 and len(by[100]) == 1
    assert packing.pack(docs.limit(0), PATH, 2, capacity).count() == 0


def test_local_search_empties_bins():
    from collections import Counter

    start = Counter({(6,): 2, (4, 3): 2, (3,): 2})
    end = packing.local_search(start, 10)
    assert sum(s * n for k, n in end.items() for s in k) == sum(s * n for k, n in start.items() for s in k)
    assert sum(end.values()) < sum(start.values())
    rng = random.Random(5)
    for _ in range(20):
        counts = Counter(rng.randint(1, 100) for _ in range(rng.randint(1, 400)))
        first = packing.best_fit(counts, 100)
        last = packing.local_search(first, 100)
        have = Counter()
        for kind, n in last.items():
            assert sum(kind) <= 100
            have += Counter({s: c * n for s, c in Counter(kind).items()})
        assert have == counts and sum(last.values()) <= sum(first.values())
