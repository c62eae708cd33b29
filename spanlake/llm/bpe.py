"""Byte-level BPE over whole texts, with the ids that the tokenizers library gives.

A text is cut before single spaces into pieces that the pre-tokeniser's pattern treats
independently. A piece seen before is looked up by its hash and its bytes; a new one is split by the
pattern into runs, all new ones of a block at once. Runs of over LEAF bytes go by tree
concatenation: parts of LEAF bytes are merged side by side by the vocabulary's own ranks, then
neighbours are joined level by level, all joins of a level at once, by re-encoding growing windows
around each join until both sides agree (``joined``). With ``by_library`` new pieces are encoded by the library instead.
Texts that hold an added token's text, white space that could span pieces, or a piece whose hash
another piece has, go to the library whole.
"""

from __future__ import annotations

import json
from itertools import chain

import numpy as np
import regex

from .common import Ranges, quiet_tokenizers, spots

# Fixed value: the pre-tokeniser's pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF = 8  # bytes of an unsplit run that are merged without a tree
TABLE_ROWS = 1 << 21  # pieces that a process remembers
_NONE = np.int64(1) << 40


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + k)
    return [out[b] for b in range(256)]


class Bpe:
    """One vocabulary in one process."""

    _open: dict[tuple, Bpe] = {}

    @classmethod
    def at(cls, path: str, by_library: bool = False) -> Bpe:
        if (path, by_library) not in cls._open:
            cls._open[path, by_library] = cls(path, by_library)
        return cls._open[path, by_library]

    def __init__(self, path: str, by_library: bool = False):
        self.by_library = by_library
        quiet_tokenizers()
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.added = [x["content"].encode() for x in spec.get("added_tokens", [])]
        symbols = byte_symbols()
        back = {c: b for b, c in enumerate(symbols)}
        self.first = np.array([vocab[c] for c in symbols], np.int64)
        self.key_shift = np.int64(1) << 20
        keys = np.array([vocab[a] * (1 << 20) + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)[order]
        size = max(max(vocab.values()), *(x["id"] for x in spec.get("added_tokens", [{"id": 0}]))) + 1
        pieces = [b""] * size
        plain = {x["id"] for x in spec.get("added_tokens", [])}
        for text, k in vocab.items():
            pieces[k] = text.encode() if k in plain else bytes(back[c] for c in text)
        for x in spec.get("added_tokens", []):
            pieces[x["id"]] = x["content"].encode()
        self.piece_len = np.array([len(p) for p in pieces], np.int64)
        self.piece_off = np.concatenate([[0], np.cumsum(self.piece_len)[:-1]])
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.split = regex.compile(PATTERN)
        self.forget()

    def forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.offs, self.lens = np.zeros(0, np.int32), np.zeros(0, np.int32)  # of a piece's ids in flat
        self.flat = np.zeros(0, np.uint32)
        self.raw_offs, self.raw_lens = np.zeros(0, np.int32), np.zeros(0, np.int32)  # of its bytes in raw
        self.raw = np.zeros(0, np.uint8)

    def merge_flat(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs of bytes, joined, and their number by run; the pattern splits no run. All are merged side by side."""
        tok = self.first[data]
        own = np.repeat(np.arange(len(sizes)), sizes)
        done_tok, done_own = [tok[:0]], [own[:0]]
        while len(tok):
            key = tok[:-1] * self.key_shift + tok[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.full(len(tok), _NONE)
            good = (self.keys[at] == key) & (own[1:] == own[:-1])
            rank[:-1][good] = self.rank[at[good]]
            starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            many = np.diff(np.append(starts, len(tok)))
            best = np.repeat(np.minimum.reduceat(rank, starts), many)
            stay = best != _NONE
            done_tok.append(tok[~stay])
            done_own.append(own[~stay])
            hit = stay & (rank == best)
            pos = np.flatnonzero(hit)
            # In a run of overlapping hits (one symbol repeated) the first, third, ... merge.
            fresh = np.concatenate([[True], np.diff(pos) != 1])[: len(pos)]
            lead = np.maximum.accumulate(np.where(fresh, np.arange(len(pos)), 0))
            pos = pos[(np.arange(len(pos)) - lead) % 2 == 0]
            tok[pos] = self.made[at[pos]]
            stay[pos + 1] = False
            tok, own = tok[stay], own[stay]
        tok, own = np.concatenate(done_tok), np.concatenate(done_own)
        return tok[np.argsort(own, kind="stable")], np.bincount(own, minlength=len(sizes))

    def encode_unsplit(self, run: bytes) -> np.ndarray:
        return self.encode_runs([run])[0]

    def encode_runs(self, runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs that the pattern doesn't split, joined, and their number by run, by tree concatenation."""
        sizes = np.array([len(r) for r in runs], np.int64)
        parts = -(-sizes // LEAF)
        own = np.repeat(np.arange(len(runs)), parts)
        lens = np.full(len(own), LEAF)
        last = np.cumsum(parts) - 1
        lens[last[parts > 0]] = (sizes - (parts - 1) * LEAF)[parts > 0]
        flat, lens = self.merge_flat(np.frombuffer(b"".join(runs), np.uint8), lens)
        while True:
            # Of each run's parts, the first and second, the third and fourth ... are joined.
            heads = np.concatenate([[True], own[1:] != own[:-1]])[: len(own)]
            place = np.arange(len(own)) - np.maximum.accumulate(np.where(heads, np.arange(len(own)), 0))
            right = np.flatnonzero(place % 2 == 1)
            if not len(right):
                return flat, np.bincount(own, lens, len(runs)).astype(np.int64)
            flat, lens = self.joined(flat, lens, right)
            own = np.delete(own, right)

    def joined(self, flat: np.ndarray, lens: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequences of ids with each of ``right`` joined to the one before it.

        BPE's result is the one sequence in which every two neighbours encode to themselves, so
        once a window's first and last ids are those that stood there before, the whole is exact.
        """
        ends = np.cumsum(lens)
        middle, before, after = ends[right - 1], lens[right - 1], lens[right]
        a, b, todo, k = np.zeros(len(right), np.int64), np.zeros(len(right), np.int64), np.arange(len(right)), 4
        found, at, many = [flat], np.zeros(len(right), np.int64), np.zeros(len(right), np.int64)
        held = len(flat)
        while len(todo):
            a[todo], b[todo] = np.minimum(k, before[todo]), np.minimum(k, after[todo])
            size = a[todo] + b[todo]
            ids = flat[spots(middle[todo] - a[todo], size)]
            width = np.add.reduceat(self.piece_len[ids], np.cumsum(size) - size)
            new, count = self.merge_flat(self.decode_bytes(ids), width)
            stops = np.cumsum(count)
            first = (a[todo] == before[todo]) | (new[stops - count] == flat[middle[todo] - a[todo]])
            last = (b[todo] == after[todo]) | (new[stops - 1] == flat[middle[todo] + b[todo] - 1])
            good = first & last
            at[todo], many[todo] = held + stops - count, count
            found.append(new)
            held += len(new)
            todo, k = todo[~good], 2 * k
        # Each sequence as up to three parts: what stays on the left, the window, what stays on the right.
        begin, size = np.zeros((len(lens), 3), np.int64), np.zeros((len(lens), 3), np.int64)
        begin[:, 0], size[:, 0] = ends - lens, lens
        size[right - 1, 0] = before - a
        begin[right - 1, 1], size[right - 1, 1] = at, many
        begin[right - 1, 2], size[right - 1, 2] = middle + b, after - b
        begin, size = np.delete(begin, right, 0), np.delete(size, right, 0)
        return np.concatenate(found)[spots(begin.ravel(), size.ravel())], size.sum(axis=1)

    def piece(self, ids: np.ndarray) -> bytes:
        return self.decode_bytes(ids).tobytes()

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that ids stand for, joined."""
        lens = self.piece_len[ids]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        return self.piece_bytes[np.repeat(self.piece_off[ids] - (ends - lens), lens) + np.arange(total)]

    def _ids(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, joined, and their number by piece."""
        if self.by_library:
            got = [x.ids for x in self.library.encode_batch([p.decode() for p in pieces], add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(got), np.int64), np.array([len(x) for x in got], np.int64)
        index: dict[str, int] = {}
        own, parts = [], []
        for p in pieces:
            found = self.split.findall(p.decode("utf-8", "surrogateescape"))
            parts.extend(index.setdefault(x, len(index)) for x in found)
            own.append(len(found))
        flat, lens = self.encode_runs([x.encode("utf-8", "surrogateescape") for x in index])
        starts, parts = np.cumsum(lens) - lens, np.array(parts, np.int64)
        bounds = np.concatenate([[0], np.cumsum(lens[parts])])[np.concatenate([[0], np.cumsum(np.array(own, np.int64))])]
        return flat[spots(starts[parts], lens[parts])], np.diff(bounds)

    def _learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        """Add new pieces to the table."""
        flat, lens = self._ids(pieces)
        raw_lens = np.array([len(p) for p in pieces], np.int64)
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.offs, self.lens = np.insert(self.offs, at, np.cumsum(lens) - lens + len(self.flat)), np.insert(self.lens, at, lens)
        self.raw_offs, self.raw_lens = np.insert(self.raw_offs, at, np.cumsum(raw_lens) - raw_lens + len(self.raw)), np.insert(self.raw_lens, at, raw_lens)
        self.flat = np.concatenate([self.flat, flat.astype(np.uint32)])
        self.raw = np.concatenate([self.raw, np.frombuffer(b"".join(pieces), np.uint8)])

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a block, joined, and each row's offsets into them."""
        n = len(offs) - 1
        sizes = np.diff(offs)
        odd = self._odd(data, offs)
        if len(data) == 0:
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        mark = data == 0x20
        mark[offs[:-1][sizes > 0]] = True
        starts = np.flatnonzero(mark)
        rows = np.searchsorted(offs, starts, "right") - 1
        ends = np.append(starts[1:], len(data))
        keep = ~odd[rows]
        starts, ends, rows = starts[keep], ends[keep], rows[keep]
        hashes, first, inverse = np.unique(Ranges(data).of(starts, ends), return_index=True, return_inverse=True)
        if len(self.hashes) > TABLE_ROWS or max(len(self.flat), len(self.raw)) > 1 << 28:
            self.forget()
        at = np.searchsorted(self.hashes, hashes)
        known = np.zeros(len(hashes), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == hashes[inside]
        if not known.all():
            raw = data.tobytes()
            new = first[~known]
            self._learn(hashes[~known], [raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            at = np.searchsorted(self.hashes, hashes)
        spot = at[inverse]
        # A hash alone is no proof: the bytes have to be the piece's, too.
        size = ends - starts
        wrong = size != self.raw_lens[spot]
        same = np.flatnonzero(~wrong)
        held = data if int(size[same].sum()) == len(data) else data[spots(starts[same], size[same])]  # pieces follow each other
        differ = held != self.raw[spots(self.raw_offs[spot[same]], size[same])]
        if differ.any():
            wrong[same[np.searchsorted(np.cumsum(size[same]), np.flatnonzero(differ), "right")]] = True
        odd[rows[wrong]] = True
        lens = self.lens[spot]
        stops = np.cumsum(lens)
        total = int(stops[-1]) if len(stops) else 0
        ids = self.flat[np.repeat(self.offs[spot] - (stops - lens), lens) + np.arange(total)]
        counts = np.bincount(rows, weights=lens, minlength=n).astype(np.int64) if len(rows) else np.zeros(n, np.int64)
        out_offs = np.concatenate([[0], np.cumsum(counts)])
        if odd.any():
            parts, new_counts = [], counts.copy()
            for k in range(n):
                if odd[k]:
                    text = data[offs[k] : offs[k + 1]].tobytes().decode("utf-8", "replace")
                    got = np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
                    new_counts[k] = len(got)
                else:
                    got = ids[out_offs[k] : out_offs[k + 1]]
                parts.append(got)
            ids, out_offs = np.concatenate(parts), np.concatenate([[0], np.cumsum(new_counts)])
        return ids, out_offs

    def _odd(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Rows that go to the library: an added token's start, wide white space, or a space between white space."""
        n = len(offs) - 1
        bad = np.zeros(len(data) + 1, bool)
        if len(data) == 0:
            return np.zeros(n, bool)
        white = (data == 0x20) | ((data >= 9) & (data <= 13)) | ((data >= 0x1C) & (data <= 0x1F))
        nxt = np.append(data[1:], np.uint8(0))
        third = np.append(data[2:], np.zeros(min(2, len(data)), np.uint8))[: len(data)]
        bad[:-1] |= (data == 0xC2) & ((nxt == 0x85) | (nxt == 0xA0))
        bad[:-1] |= (data == 0xE1) & (nxt == 0x9A) & (third == 0x80)
        bad[:-1] |= (data == 0xE2) & (nxt == 0x80) & ((third <= 0x8A) | (third == 0xA8) | (third == 0xA9) | (third == 0xAF))
        bad[:-1] |= (data == 0xE2) & (nxt == 0x81) & (third == 0x9F)
        bad[:-1] |= (data == 0xE3) & (nxt == 0x80) & (third == 0x80)
        for token in self.added:
            if len(token) > 1:
                bad[:-1] |= (data == token[0]) & (nxt == token[1])
        before = np.zeros(len(data), bool)
        before[1:] = white[:-1]
        heads = offs[:-1][np.diff(offs) > 0]
        before[heads] = False
        after = np.ones(len(data), bool)
        after[:-1] = white[1:]
        after[offs[1:][np.diff(offs) > 0] - 1] = True
        bad[:-1] |= (data == 0x20) & before & after
        total = np.concatenate([[0], np.cumsum(bad)])
        return total[offs[1:]] > total[offs[:-1]]
