"""Token ids in directly addressable codes (DAC).

Each id is split into 8-bit chunks, lowest first. Level k holds the k-th chunk of every id that
has one, and a bitmap that says which of them go on to level k + 1. A rank directory (ones
before every 512th bit) finds an id's place on the next level, so any id is read without
decoding those before it. A file (``shard``) holds whole documents: a header, a directory of
documents, then the levels.

Documents are stored in ascending id order (null ids first; rows with equal ids by their text),
each with an end id. An empty or null text is the end id alone. An empty table gives no files.
The files travel as binary cells of a Parquet table in the shared folder, which any store that
Spark writes can hold; ``export`` writes them out one by one.
"""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Bpe
from .common import saved, text_blocks

MAGIC = b"DACT0001"
SHARD_TOKENS = 1 << 20  # a shard is closed at the first document that reaches this
STEP = 512  # bits between entries of the rank directory
SHARDS = "pid int, shard int, local_start long, n_ids long, n_docs long, payload binary"


def pack(ids: np.ndarray) -> bytes:
    """Levels of 8-bit chunks, bitmaps and rank directories of unsigned ids."""
    out, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        last = not more.any()
        ranks = np.zeros(0, "<u4") if last else np.concatenate([[0], np.cumsum(_sums(more))[:-1]]).astype("<u4")
        out.append(struct.pack("<QQQ", len(rest), 0 if last else len(bits), len(ranks)) + (rest & 255).astype(np.uint8).tobytes() + (b"" if last else bits.tobytes()) + ranks.tobytes())
        if last:
            return struct.pack("<I", len(out)) + b"".join(out)
        rest = rest[more] >> 8


def _sums(more: np.ndarray) -> np.ndarray:
    full = np.zeros(-(-len(more) // STEP) * STEP, np.uint8)
    full[: len(more)] = more
    return full.reshape(-1, STEP).sum(axis=1, dtype=np.int64)


_ONES = np.array([bin(x).count("1") for x in range(256)], np.int64)


class Codes:
    """Random access to the ids of one packed buffer."""

    def __init__(self, raw: memoryview):
        (n,), at, self.levels = struct.unpack_from("<I", raw), 4, []
        for _ in range(n):
            size, bits, ranks = struct.unpack_from("<QQQ", raw, at)
            at += 24
            chunk = np.frombuffer(raw, np.uint8, size, at)
            bitmap = np.frombuffer(raw, np.uint8, bits, at + size)
            directory = np.frombuffer(raw, "<u4", ranks, at + size + bits)
            at += size + bits + 4 * ranks
            self.levels.append((chunk, bitmap, directory))

    def at(self, where: np.ndarray) -> np.ndarray:
        """Ids at any places, each by rank through the levels."""
        out, live, place = np.zeros(len(where), np.uint32), np.arange(len(where)), np.asarray(where, np.int64)
        for k, (chunk, bitmap, directory) in enumerate(self.levels):
            out[live] |= chunk[place].astype(np.uint32) << np.uint32(8 * k)
            if not len(bitmap):
                break
            on = (bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
            live, place = live[on], place[on]
            place = self._rank(bitmap, directory, place)
        return out

    @staticmethod
    def _rank(bitmap: np.ndarray, directory: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Ones before each place: the directory's entry, then whole bytes, then the bits of the last byte."""
        block = place // STEP
        byte, head = place >> 3, block * (STEP // 8)
        rank = directory[block].astype(np.int64)
        for k in range(STEP // 8):
            inside = head + k < byte
            if not inside.any():
                break
            rank[inside] += _ONES[bitmap[head[inside] + k]]
        return rank + _ONES[bitmap[byte] & ((1 << (place & 7)) - 1).astype(np.uint8)]

    def run(self, start: int, n: int) -> np.ndarray:
        """Ids start .. start + n: the rank of the first place on each level, then a plain read on."""
        out, live, first, size = np.zeros(n, np.uint32), np.arange(n), start, n
        for k, (chunk, bitmap, directory) in enumerate(self.levels):
            out[live] |= chunk[first : first + size].astype(np.uint32) << np.uint32(8 * k)
            if not len(bitmap) or not size:
                break
            byte = first >> 3
            on = np.unpackbits(bitmap[byte : ((first + size + 7) >> 3)], bitorder="little")[first - 8 * byte :][:size].astype(bool)
            first = int(self._rank(bitmap, directory, np.array([first]))[0])
            live = live[on]
            size = len(live)
        return out


def shard(keys: list, lens: np.ndarray, ids: np.ndarray) -> bytes:
    """One file: magic, number of documents, their ids, null flags and lengths, then the codes."""
    flags = np.array([k is None for k in keys], np.uint8)
    own = np.array([0 if k is None else k for k in keys], "<i8")
    return MAGIC + struct.pack("<Q", len(keys)) + own.tobytes() + flags.tobytes() + lens.astype("<i8").tobytes() + pack(ids)


def opened(raw: bytes) -> tuple[list, np.ndarray, Codes]:
    """Documents' ids, their lengths, and the codes of one file."""
    if raw[:8] != MAGIC:
        raise ValueError("not a token file")
    (n,) = struct.unpack_from("<Q", raw, 8)
    own, flags = np.frombuffer(raw, "<i8", n, 16), np.frombuffer(raw, np.uint8, n, 16 + 8 * n)
    lens = np.frombuffer(raw, "<i8", n, 16 + 9 * n)
    return [None if f else k for k, f in zip(own.tolist(), flags.tolist(), strict=True)], lens, Codes(memoryview(raw)[16 + 17 * n :])


def shards(df: DataFrame, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of SHARDS: the files, by range partition and place in it."""

    def run(batches):
        bpe, pid, done, k = Bpe.at(path, by_library=True), TaskContext.get().partitionId(), 0, 0
        keys, lens, parts, held = [], [], [], 0

        def close():
            flat = np.concatenate(parts)
            cells = [[pid], [k], [done], [len(flat)], [len(keys)], [shard(keys, np.array(lens, np.int64), flat)]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["pid", "shard", "local_start", "n_ids", "n_docs", "payload"])

        for batch, data, offs in text_blocks(batches, text):
            ids, at = bpe.encode(data, offs)
            counts = np.diff(at) + 1
            flat = np.insert(ids, at[1:], end_id).astype(np.uint32)
            bounds, own = np.concatenate([[0], np.cumsum(counts)]), batch.column(0).to_pylist()
            i = 0
            while i < len(own):
                j = min(len(own), max(i + 1, int(np.searchsorted(bounds, bounds[i] + SHARD_TOKENS - held, "left"))))
                keys += own[i:j]
                lens += counts[i:j].tolist()
                parts.append(flat[bounds[i] : bounds[j]])
                held += int(bounds[j] - bounds[i])
                if held >= SHARD_TOKENS:
                    yield close()
                    done, k, keys, lens, parts, held = done + held, k + 1, [], [], [], 0
                i = j
        if keys:
            yield close()

    order = [F.col(key).asc_nulls_first(), F.xxhash64(text)]
    dealt = df.select(F.col(key).cast("long").alias(key), text).repartitionByRange(*order)
    return dealt.sortWithinPartitions(*order, F.col(text)).mapInArrow(run, SHARDS)


def write(df: DataFrame, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, str]:
    """Write the files to the shared folder; return them, read again with their first id's place in the whole, and the folder."""
    files, where = saved(shards(df, path, end_id, key, text), "dac")
    sums = files.groupBy("pid").agg(F.sum("n_ids").alias("n")).orderBy("pid").collect()  # a row for each write task
    starts, at = [], 0
    for pid, n in sums:
        starts.append((pid, at))
        at += n
    base = files.sparkSession.createDataFrame(starts, "pid int, base long")
    return files.join(base, "pid").withColumn("start", F.col("base") + F.col("local_start")), where


def read(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document, from the files: its id, start, n_tokens and the crc32 of its ids."""

    def run(batches):
        for batch in batches:
            for raw, start in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                keys, lens, codes = opened(raw.as_py())
                at = np.concatenate([[0], np.cumsum(lens)])
                ids = memoryview(codes.run(0, int(at[-1])).astype("<u4").tobytes())  # all of a file, level by level
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(at[:-1] + start), pa.array(np.array(lens, np.int64)), pa.array(crc, pa.int64())], [key, "start", "n_tokens", "ids_crc32"])

    return files.select("payload", "start").mapInArrow(run, f"`{key}` long, start long, n_tokens long, ids_crc32 long")


def export(files: DataFrame, folder: str) -> None:
    """Write each file to a folder that the executors share."""

    def one(row):
        name = f"{folder}/{row.pid:06d}-{row.shard:06d}.dac"
        with open(f"{name}.part", "wb") as f:
            f.write(row.payload)
        os.replace(f"{name}.part", name)

    os.makedirs(folder, exist_ok=True)
    files.foreach(one)
