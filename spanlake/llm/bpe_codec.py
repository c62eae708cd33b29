"""BPE encoding and decoding of text columns.

Null text is empty text and has no ids. Rows, also repeated ones, are handled one by one, so
ties and empty tables need no rule. Of extra columns with the name of an output column, the
output column wins.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import Bpe
from .common import text_blocks


def _with(df: DataFrame, name: str, kind) -> tuple[DataFrame, T.StructType]:
    df = df.drop(name)
    return df, T.StructType([*df.schema.fields, T.StructField(name, kind)])


def encode(df: DataFrame, path: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """Append the ids of each text as little-endian unsigned 32-bit integers."""

    def run(batches):
        bpe = Bpe.at(path)
        for batch, data, offs in text_blocks(batches, text):
            ids, at = bpe.encode(data, offs)
            raw = ids.astype("<u4").tobytes()
            cells = [raw[4 * a : 4 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            keep = [k for k, n in enumerate(batch.schema.names) if n != out]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(cells, pa.binary())], [*(batch.schema.names[k] for k in keep), out])

    schema = T.StructType([*(f for f in df.schema.fields if f.name != out), T.StructField(out, T.BinaryType())])
    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Append the text of ids (special tokens included); null ids give the empty text."""
    df, schema = _with(df, out, T.StringType())

    def run(batches):
        bpe = Bpe.at(path)
        for batch in batches:
            cells = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            got = [bpe.piece(np.frombuffer(c or b"", "<u4").astype(np.int64)).decode("utf-8", "replace") for c in cells]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.string())], [*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode each text in one pass; return the key, n_tokens, ids_sha256 and decoded_sha256."""

    def run(batches):
        bpe = Bpe.at(path)
        for batch, data, offs in text_blocks(batches, text):
            ids, at = bpe.encode(data, offs)
            raw = memoryview(ids.astype("<u4").tobytes())
            wide = ids.astype(np.int64)
            back = memoryview(bpe.decode_bytes(wide).tobytes())
            ends = np.concatenate([[0], np.cumsum(bpe.piece_len[wide])])[at]
            spans = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
            places = zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.diff(at)),
                    pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in spans]),
                    pa.array([hashlib.sha256(str(back[a:b], "utf-8", "replace").encode()).hexdigest() for a, b in places]),
                ],
                [key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
