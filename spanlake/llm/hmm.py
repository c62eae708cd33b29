"""A hidden Markov language model over words.

Counts of all training words give the base. The model's symbols are the SYMBOLS commonest words, one
symbol for all others, and the end; a word of the others is drawn by its smoothed count. The KNOWN commonest
words of at most WORD bytes are at hand everywhere, which bounds what is broadcast; a join looks up the counts of the rest. Latent states start from a bounded
sample and are trained by Baum-Welch: each task adds up expected counts, Spark sums them over all
training texts. A text's likelihood is the scaled forward recursion over its symbols, exactly.

Rows: null text is empty, and has the end alone; a null id is in the empty text's fold; texts of any length are
walked whole; repeated rows are scored one by one, and of equally common words those that sort first are known; without
training rows N and V are 0 and every unseen token has the base probability 1; an empty table gives
no rows; other columns don't pass through, so their names are no matter.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, saved, text_blocks

STATES, SYMBOLS, KNOWN, WORD, SAMPLE, ROUNDS, START_ROUNDS = 6, 1 << 16, 1 << 18, 64, 300, 2, 10
BATCH = 2048  # texts that are walked side by side
FLUSH = 400_000


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over all texts."""

    def run(batches):
        held: Counter = Counter()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "c"])

        for _, data, offs in text_blocks(batches, "text"):
            low = data.tobytes().lower()
            for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                held.update(low[a:b].split())
            if len(held) > FLUSH:
                yield flush()
                held = Counter()
        if held:
            yield flush()

    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Model:
    """Start, step and draw probabilities; draw has a column a symbol, the last two for other words and the end."""

    def __init__(self, start: np.ndarray, step: np.ndarray, draw: np.ndarray):
        self.start, self.step, self.draw = start, step, draw

    @classmethod
    def of(cls, start, step, draw, prior: np.ndarray) -> Model:
        """From expected counts; to each state's draws the prior is added."""
        start = (start + 0.1) / (start + 0.1).sum()
        step = (step + 0.1) / (step + 0.1).sum(axis=1, keepdims=True)
        draw = draw + prior
        return cls(start, step, draw / draw.sum(axis=1, keepdims=True))


def _grid(ids: np.ndarray, offs: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of rows by place, longest row first; rows alive at each place."""
    lens = np.diff(offs)[rows]
    place = np.arange(int(lens.max()))
    live = len(rows) - np.searchsorted(np.sort(lens), place, "right")
    return offs[rows], live


def walk(model: Model, ids: np.ndarray, offs: np.ndarray, sums: tuple | None = None) -> np.ndarray:
    """Log10 likelihood of each row by the scaled forward recursion; with sums, adds its expected counts."""
    out, draw, ones = np.zeros(len(offs) - 1), np.ascontiguousarray(model.draw.T), np.ones(len(model.start))
    order = np.argsort(-np.diff(offs), kind="stable")
    for i in range(0, len(order), BATCH):
        rows = order[i : i + BATCH]
        begin, live = _grid(ids, offs, rows)
        kept, scales = [], []
        alpha = np.broadcast_to(model.start, (len(rows), len(model.start)))
        total = np.zeros(len(rows))
        for t, n in enumerate(live.tolist()):
            alpha = (alpha[:n] @ model.step if t else alpha[:n]) * draw[ids[begin[:n] + t]]
            scale = alpha @ ones
            alpha = alpha / scale[:, None]
            total[:n] += np.log10(scale)
            if sums is not None:
                kept.append(alpha)
                scales.append(scale)
        out[rows] = total
        if sums is None:
            continue
        start, step, emit = sums
        drawn, shares = [], []
        beta = np.ones((0, len(model.start)))
        for t in range(len(live) - 1, -1, -1):
            n = int(live[t])
            if t + 1 < len(live):
                m = int(live[t + 1])
                ahead = beta * draw[ids[begin[:m] + t + 1]] / scales[t + 1][:, None]
                step += model.step * (kept[t][:m].T @ ahead)
                beta = np.concatenate([ahead @ model.step.T, np.ones((n - m, beta.shape[1]))])
            else:
                beta = np.ones((n, len(model.start)))
            gamma = kept[t] * beta  # both are scaled alike, so its rows add up to one
            drawn.append(ids[begin[:n] + t])
            shares.append(gamma)
            if t == 0:
                start += gamma.sum(axis=0)
        drawn, shares = np.concatenate(drawn), np.concatenate(shares)
        for k in range(shares.shape[1]):
            emit[k] += np.bincount(drawn, shares[:, k], emit.shape[1])
    return out


def _symbols(data: np.ndarray, offs: np.ndarray, index: dict, end: int):
    """Known numbers (-1: unknown) of all words and ends of a block, their offsets, and the words."""
    low = data.tobytes().lower()
    split = [low[a:b].split() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
    get, lens = index.get, np.array([len(x) for x in split], np.int64)
    at = np.concatenate([[0], np.cumsum(lens + 1)])
    flat = list(chain.from_iterable(split))
    out = np.full(int(at[-1]), end, np.int64)
    mask = np.ones(len(out), bool)
    mask[at[1:] - 1] = False
    out[mask] = np.fromiter(map(get, flat, repeat(-1)), np.int64, len(flat))
    return out, at, mask, flat


def _limited(known: np.ndarray, end: int, symbols: int) -> np.ndarray:
    """Model symbols of known numbers: ``symbols`` for the other words, then the end's."""
    return np.where(known == end, symbols + 1, np.where((known < 0) | (known >= symbols), symbols, known))


def train(docs: DataFrame, head, weight: np.ndarray, kinds: np.ndarray) -> Model:
    """A model of the words of ``head``, a broadcast list; by symbol, weight is its share of all tokens and kinds how many words it stands for.

    The prior: half a token of each word, dealt over the states as the base does over all, and a little of the words' overall shares.
    """
    end = len(head.value)
    prior = 0.5 / STATES * kinds + 50.0 * weight
    sample = docs.filter("length(text) > 0").orderBy(F.xxhash64("doc_id", "text")).limit(SAMPLE).select("text")  # for start values only
    got = sample.toArrow()
    blocks = list(text_blocks(got.to_batches(), "text", 1 << 30))
    rng = np.random.default_rng(0)
    shape = (STATES, end + 2)
    index = {w: k for k, w in enumerate(head.value)}
    model = Model.of(np.ones(STATES), np.ones((STATES, STATES)) + 20 * np.eye(STATES), rng.gamma(0.3, 1, shape) * weight * 2000, prior)
    for _ in range(START_ROUNDS if blocks else 0):
        sums = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros(shape)
        for _, data, offs in blocks:
            known, at, _, _ = _symbols(data, offs, index, end)
            walk(model, _limited(known, end, end), at, sums)
        model = Model.of(*sums, prior)
    names = ["symbol", *(f"e{k}" for k in range(STATES))]
    for _ in range(ROUNDS):
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches, shared=shared):
            index = {w: k for k, w in enumerate(head.value)}
            sums = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros(shape)
            for _, data, offs in text_blocks(batches, "text"):
                known, at, _, _ = _symbols(data, offs, index, end)
                walk(shared.value, _limited(known, end, end), at, sums)
            # Rows: the start, the steps from each state, then the draws of each symbol.
            table = np.concatenate([sums[0][None], sums[1], sums[2].T])
            some = np.flatnonzero((table > 1e-9).any(axis=1))
            for i in range(0, len(some), 20_000):
                part = some[i : i + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *(pa.array(x) for x in table[part].T)], names)

        added = docs.select("text").mapInArrow(run, "symbol int, " + ", ".join(f"{n} double" for n in names[1:]))
        rows = added.groupBy("symbol").agg(*(F.sum(n).alias(n) for n in names[1:])).toArrow()  # KNOWN rows and a few
        table = np.zeros((1 + STATES + end + 2, STATES))
        table[rows.column(0).to_numpy()] = np.stack([rows.column(k + 1).to_numpy() for k in range(STATES)], axis=1) if rows.num_rows else 0
        model = Model.of(table[0], table[1 : STATES + 1], table[STATES + 1 :].T, prior)
        shared.destroy()
    return model


def score(docs: DataFrame, held_out_fold: int = 1, known: int = KNOWN, symbols: int = SYMBOLS) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    docs = docs.select("doc_id", "text").withColumn("held_out", fold(F.col("doc_id")) == held_out_fold)
    learn = docs.filter(~F.col("held_out"))
    counts, _ = saved(word_counts(learn), "words")
    n_docs = learn.count()
    words, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, kinds = words + n_docs, distinct + (1 if n_docs else 0)
    top = counts.filter(F.length("word") <= WORD).orderBy(F.desc("c"), "word").limit(known).toArrow()  # ``known`` short rows at most
    head, head_counts = top.column("word").to_pylist(), top.column("c").to_numpy().astype(float)
    symbols, end, session = min(symbols, len(head)), len(head), docs.sparkSession
    rest = words - head_counts[:symbols].sum()
    types = np.append(np.ones(symbols), [distinct - symbols + 1, 1])
    shares = np.append(head_counts[:symbols], [rest, n_docs]) + 0.5 * types
    model = train(learn, session.sparkContext.broadcast(head[:symbols]), shares / shares.sum(), types)
    below, bottom = total + 0.5 * (kinds + 1), rest + 0.5 * (distinct - symbols + 1)
    base = np.log10((np.append(head_counts, [n_docs, 0.0]) + 0.5) / below)  # the last: unseen
    tail = np.log10((np.append(head_counts, [n_docs, 0.0]) + 0.5) / bottom)
    tail[:symbols] = tail[end] = 0
    every = len(head) == distinct  # no word beyond the head: no look-up
    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, others array<struct<word:binary,n:long>>"
    shared = session.sparkContext.broadcast((head, base, tail, model))

    def run(batches):
        head, base, tail, model = shared.value
        index = {w: k for k, w in enumerate(head)}
        pid, done = TaskContext.get().partitionId(), 0
        for batch, data, offs in text_blocks(batches, "text"):
            number, at, mask, flat = _symbols(data, offs, index, end)
            n = len(offs) - 1
            own = np.repeat(np.arange(n), np.diff(at))
            place = np.where(number < 0, len(base) - 1, number)
            lost = number < 0
            add = lambda table: np.bincount(own, np.where(lost & (not every), 0, table[place]), n)  # noqa: E731, B023
            out = walk(model, _limited(number, end, symbols), at)
            others: list = [None] * n
            if not every:
                at_word = np.flatnonzero(lost[mask])
                row = own[mask][at_word]
                for r in np.unique(row).tolist():
                    a, b = np.searchsorted(row, [r, r + 1])
                    others[r] = [{"word": w, "n": c} for w, c in Counter(flat[k] for k in at_word[a:b].tolist()).items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array((pid << 40) + done + np.arange(n)), batch.column(0).cast(pa.int64()), batch.column(2), pa.array(np.diff(at)), pa.array(np.bincount(own, ~lost & ((number != end) | (n_docs > 0)), n).astype(np.int64)), pa.array(add(base)), pa.array(out + add(tail)), pa.array(others, pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())])))],
                schema_names,
            )
            done += n

    schema_names = [x.split()[0] for x in schema.split(", ")]
    made, _ = saved(docs.mapInArrow(run, schema), "scored")
    if not every:
        # Words beyond the head meet their counts in a join; its sums go back to their rows.
        rare = made.select("row", F.explode("others").alias("o")).select("row", "o.word", "o.n")
        found = rare.join(counts, "word", "left").select("row", "n", F.coalesce("c", F.lit(0)).alias("c"))
        c = F.col("c") + 0.5
        sums = found.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("k"), F.sum(F.col("n") * F.log10(c / below)).alias("b"), F.sum(F.col("n") * F.log10(c / bottom)).alias("s"))
        made = made.drop("others").join(sums, "row", "left")
        made = made.withColumns({"n_known": F.col("n_known") + F.coalesce("k", F.lit(0)), "base_score": F.col("base_score") + F.coalesce("b", F.lit(0.0)), "score": F.col("score") + F.coalesce("s", F.lit(0.0))})
    return made.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
