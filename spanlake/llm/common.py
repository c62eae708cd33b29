"""Shared helpers: the shared work folder, text buffers, hashes of byte ranges, groups of rows."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
BLOCK_BYTES = 1 << 21  # bytes of text that one numpy step works on


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode one of our own if it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spanlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def saved(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df as Parquet to the shared folder and read it back; cuts the lineage and survives lost executors.

    The write's shuffle files go once it has ended: nothing reads them again. Python gets batches of few bytes.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = {key: spark.conf.get(key, None) for key in _WRITING}
    for key, value in _WRITING.items():
        spark.conf.set(key, value)
    try:
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete saved tables that no later step reads."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id) -> F.Column:
    """crc32(doc_id as text) mod 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def local_bytes(uri: str) -> str:
    return uri[len("file://") :] if uri.startswith("file://") else uri


def quiet_tokenizers() -> None:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and each row's offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def blocks(offs: np.ndarray, limit: int = BLOCK_BYTES):
    """Row ranges of at most limit bytes, or of one longer row."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def text_blocks(batches, column: str = "text", limit: int = BLOCK_BYTES):
    """(rows of a record batch, their bytes, their offsets), some bytes at a time."""
    for batch in batches:
        data, offs = utf8(batch.column(batch.schema.get_field_index(column)))
        for i, j in blocks(offs, limit):
            yield batch.slice(i, j - i), data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]


# Hashes of byte ranges: eight bytes at a time, each mixed with its place; no sum of powers, so periodic texts don't cancel out.
_U = np.uint64
_K = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0xD1B54A32D192ED03))
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the word."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, zeros beyond the end; one more for the end itself."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,)).copy()


class Ranges:
    """Hashes of any byte ranges of one buffer; ``which`` picks one of two independent hashes."""

    def __init__(self, data: np.ndarray):
        self.eights = _eights(data)

    def of(self, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, np.uint64)
        size = ends - starts
        many = np.maximum((size + 7) >> 3, 1)
        stops = np.cumsum(many)
        place = np.arange(int(stops[-1])) - np.repeat(stops - many, many)
        got = self.eights[np.repeat(starts, many) + 8 * place]
        got[stops - 1] &= _MASKS[size - 8 * (many - 1)]
        got ^= (place.astype(np.uint64) + _U(1 + (which << 40))) * _K[which]
        return mix(np.add.reduceat(mix(got), stops - many) + size.astype(np.uint64) * _K[2])


def windows(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` bytes from each place on, by joining hashes of shorter windows."""
    n = len(data) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    eights, have = _eights(data)[:-1], min(width, 8)
    out = mix((eights[: len(data) - have + 1] & _MASKS[have]) ^ _K[0])
    while have < width:
        step = min(have, width - have)
        out = mix(out[:-step] * _K[1] + out[step:])
        have += step
    return out


def words(data: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of each maximal run of bytes other than those marked in ``space``: 0x20 and 0x09-0x0D."""
    n = len(data)
    if n == 0:
        return (np.zeros(0, np.int64),) * 3
    solid = ~space[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    edge = offs[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    before[edge] = False
    after[edge - 1] = False
    starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; every other byte stays."""
    return _FOLD[data]


def spots(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places begin, begin + 1, ... of runs of the given sizes, one run after another."""
    stops = np.cumsum(sizes)
    return np.repeat(begins - (stops - sizes), sizes) + np.arange(int(stops[-1]) if len(stops) else 0)


def grouped(batches, keys: int):
    """One table for each run of rows with equal leading keys (integers without nulls)."""
    held: list = []
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        marks = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)])
        cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), n]
        if held and (marks[:, 0] != last).any():
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            held.append(batch.slice(a, b - a))
            if b < n:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
        last = marks[:, -1]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def parts(spark: SparkSession) -> int:
    """Partitions for a shuffle into Python: fixed, as a stage that computes much on few bytes mustn't be coalesced by bytes."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
