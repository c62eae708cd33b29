"""A quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a text's bytes and words are the only inputs. Trees are grown on the driver over
at most ``SAMPLE`` labelled rows (those with the least hash of their id; the bound is a
parameter), flattened into arrays and walked by numpy over all rows.

Rows: null text is empty and has a score; a null id is held in or out as the empty text's id;
repeated rows each get their score; null labels teach nothing; without labels, or with one kind
only, every score is the share of good labels (one half without any); an empty table gives no
rows; other columns pass through, but for those named as the outputs, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Ranges, fold, lower, text_blocks, words

SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, RIDGE = 80, 4, 64, 0.2, 2.0
FEATURES = ["bytes", "upper", "lower", "digit", "space", "newline", "stop", "symbol", "bang", "bar", "high", "entropy", "words", "word_len", "longest", "distinct", "top_word", "pairs", "top_pair", "line_len", "caps_words", "marked_words"]


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text."""
    n, sizes = len(offs) - 1, np.diff(offs)
    out = np.zeros((n, len(FEATURES)))
    row = np.repeat(np.arange(n), sizes)
    hist = np.bincount(row * 256 + data, minlength=256 * n).reshape(n, 256).astype(float)
    size = np.maximum(sizes, 1)[:, None]
    share = lambda *codes: hist[:, list(codes)].sum(axis=1) / size[:, 0]
    p = hist / size
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)
    out[:, :12] = np.stack([np.log1p(sizes), share(*range(65, 91)), share(*range(97, 123)), share(*range(48, 58)), share(32), share(10), share(*b".,;:"), share(*b"#$%&*@^~"), share(*b"!"), share(*b"|"), share(*range(128, 256)), entropy], axis=1)
    starts, ends, own = words(data, offs)
    if not len(own):
        return out
    count = np.bincount(own, minlength=n)
    some = np.maximum(count, 1)
    length = ends - starts
    out[:, 12] = np.log1p(count)
    out[:, 13] = np.bincount(own, length, n) / some
    np.maximum.at(out[:, 14], own, length)
    h = Ranges(lower(data)).of(starts, ends)

    def repeats(own: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((h, own))
        o, x = own[order], h[order]
        first = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (x[1:] != x[:-1])]))
        many, top = np.diff(np.append(first, len(o))), np.zeros(n)
        np.maximum.at(top, o[first], many)
        total = np.maximum(np.bincount(own, minlength=n), 1)
        return np.bincount(o[first], minlength=n) / total, top / total

    out[:, 15], out[:, 16] = repeats(own, h)
    pair = own[1:] == own[:-1]
    if pair.any():
        out[:, 17], out[:, 18] = repeats(own[1:][pair], (h[:-1] * np.uint64(31) + h[1:])[pair])
    out[:, 19] = sizes / (hist[:, 10] + 1)
    first, last = data[starts], data[ends - 1]
    second = data[np.minimum(starts + 1, len(data) - 1)]
    out[:, 20] = np.bincount(own, (first >= 65) & (first <= 90) & (second >= 65) & (second <= 90) & (length > 1), n) / some
    marks = np.zeros(256, bool)
    marks[list(b"#$%&*!|@^~")] = True
    out[:, 21] = np.bincount(own, marks[last], n) / some
    return out


@dataclass
class Trees:
    """Complete trees, node after node: feature and threshold of each split, value of each leaf."""

    base: float
    feature: np.ndarray  # trees x (2^depth - 1)
    threshold: np.ndarray
    value: np.ndarray  # trees x 2^depth

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Boosted trees by log loss; splits are sought over histograms of at most BINS bins."""
    inner = 2**depth - 1
    rate = float(y.mean()) if len(y) else 0.5
    none = Trees(0.0, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if rate in (0.0, 1.0) or not len(y):
        none.base = 0.0 if not len(y) else 30.0 * (2 * rate - 1)
        return none
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS)[1:-1])) for c in x.T]
    bins = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    base = float(np.log(rate / (1 - rate)))
    raw, d = np.full(len(y), base), x.shape[1]
    feature, threshold, value = (np.zeros((trees, k), t) for k, t in ((inner, np.int64), (inner, float), (inner + 1, float)))
    flat = bins + np.arange(d) * BINS
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node, threshold[t] = np.zeros(len(y), np.int64), np.inf
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            cell = ((node - first)[:, None] * (d * BINS) + flat).ravel()
            sums = [np.bincount(cell, np.repeat(v, d), width * d * BINS).reshape(width, d, BINS).cumsum(axis=2) for v in (g, h)]
            gl, hl = sums
            gr, hr = gl[:, :, -1:] - gl, hl[:, :, -1:] - hl
            gain = gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE) - gl[:, :, -1:] ** 2 / (hl[:, :, -1:] + RIDGE)
            gain[(hl < 1) | (hr < 1)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                f, b = divmod(int(best[k]), BINS)
                if gain[k, f, b] > 1e-6 and b < len(cuts[f]):
                    feature[t, first + k], threshold[t, first + k] = f, cuts[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t][node]] > threshold[t][node])
        leaf = node - inner
        value[t] = -RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + RIDGE)
        raw += value[t][leaf]
    return Trees(base, feature, threshold, value)


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Trees:
    """Trees from labelled rows of the folds other than 0."""
    chosen = labels.select(F.col(key), F.col(label).cast("int").alias("__y")).filter((fold(F.col(key)) != 0) & F.col("__y").isin(0, 1))
    chosen = chosen.orderBy(F.xxhash64(key), key, "__y").limit(sample)  # at most ``sample`` short rows: may be broadcast

    def run(batches):
        for batch, data, offs in text_blocks(batches, text):
            x = statistics(data, offs)
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(c) for c in x.T)], ["y", *FEATURES])

    got = docs.select(key, text).join(F.broadcast(chosen), key).select(text, "__y").mapInArrow(run, "y int, " + ", ".join(f"{f} double" for f in FEATURES))
    table = got.toPandas().sort_values(["y", *FEATURES], ignore_index=True)
    return fit(table[FEATURES].to_numpy(float), table["y"].to_numpy(float))


def scored(df: DataFrame, trees: Trees, threshold: float = 0.3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Append held_out, score and predicted."""
    own = ("held_out", "score", "predicted")
    df = df.drop(*own).withColumn("held_out", fold(F.col(key)) == 0)
    names = df.columns

    def run(batches):
        for batch, data, offs in text_blocks(batches, text):
            score = trees.score(statistics(data, offs))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*names, "score", "predicted"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
