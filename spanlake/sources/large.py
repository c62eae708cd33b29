"""Large OTLP/JSON documents, each read by many tasks.

The text reader cuts a file into byte ranges on any file system if lines end with "}". What a range means depends
on what stands before it, so the file is read twice. The first pass sums a range up, once as if it began outside a
string and once as if inside: how many containers it closes that it didn't open, and which ones it leaves open. A
few rows a range are folded in order to what stands open where each begins. The second pass then knows its place and
gives the texts of spans, resources and scopes; one that is cut by a range's end is put together from its pieces.
No task holds more than a batch of text and the span it is in.

Places count bytes from a range's start, so they order spans as a whole read does, but aren't ordinals.
A document that isn't closed, or that closes more than it opened, raises. A span that is null gives no row here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.sources.shared import saved

OPEN = {ord("{"): "{", ord("["): "["}
QUOTE, SLASH, COLON = 34, 92, 58
_STRUCTURE = np.zeros(256, bool)
_STRUCTURE[[ord(c) for c in "{}[]"]] = True
_OPENS = np.zeros(256, bool)
_OPENS[list(OPEN)] = True
SHIFT = 40  # bits of a place within its range

STACK = "array<struct<mark:string,key:string,at:bigint>>"
SUMMARY = f"file bigint, block bigint, inside boolean, closed bigint, opened {STACK}, ends_inside boolean, bytes bigint, blank_end boolean"
BEGIN = f"file bigint, block bigint, number bigint, inside boolean, stack {STACK}"
FOUND = "file bigint, kind string, r bigint, s bigint, p bigint, number bigint, cut boolean, text string"
_LONG, _BOOL, _NAME = pa.int64(), pa.bool_(), pa.string()
_STACK = pa.list_(pa.struct([("mark", _NAME), ("key", _NAME), ("at", _LONG)]))
_SUMMARY = pa.schema([("file", _LONG), ("block", _LONG), ("inside", _BOOL), ("closed", _LONG), ("opened", _STACK), ("ends_inside", _BOOL), ("bytes", _LONG), ("blank_end", _BOOL)])
_BEGIN = pa.schema([("file", _LONG), ("block", _LONG), ("number", _LONG), ("inside", _BOOL), ("stack", _STACK)])
_FOUND = pa.schema([("file", _LONG), ("kind", _NAME), ("r", _LONG), ("s", _LONG), ("p", _LONG), ("number", _LONG), ("cut", _BOOL), ("text", _NAME)])
MANY = 100_000  # ranges whose beginnings go to all tasks at most; beyond, each goes with its range by a shuffle

# Where the parts of a document stand; "" is an element of a list.
KINDS = {("", "{", ""): "root", ("root", "[", "resourceSpans"): "resources", ("resources", "{", ""): "r", ("r", "{", "resource"): "resource", ("r", "[", "scopeSpans"): "scopes", ("scopes", "{", ""): "s", ("s", "{", "scope"): "scope", ("s", "[", "spans"): "spans", ("spans", "{", ""): "span"}
KEPT = ("resource", "scope", "span")
DEEPEST = 7  # the level of a span


def fragments(spark: SparkSession, path: str, folder: bool, least: int) -> DataFrame:
    """(file, block, value): the texts between closing braces of the files over ``least`` bytes, in order within a range."""
    reader = spark.read.option("lineSep", "}")
    if folder:
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
    df = reader.text(path).filter(F.col("_metadata.file_size") > least)
    return df.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def files(spark: SparkSession, path: str, folder: bool, least: int) -> DataFrame:
    """(file, path, size) of the files over ``least`` bytes; their contents aren't read."""
    reader = spark.read.format("binaryFile")
    if folder:
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
    df = reader.load(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")).filter(F.col("size") > least)
    return df.select(F.xxhash64("path").alias("file"), "path", "size")


def _text(column: pa.Array) -> np.ndarray:
    """The bytes of fragments, each with its brace."""
    column = column.cast(pa.large_binary())
    offs = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offs[0] : offs[-1]] if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    out = np.empty(len(data) + len(column), np.uint8)
    ends = offs[1:] - offs[0] + np.arange(len(column))
    out[ends] = ord("}")
    own = np.ones(len(out), bool)
    own[ends] = False
    out[own] = data
    return out


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(file, block, rows) of the batches' stretches of one range."""
    for batch in batches:
        if not batch.num_rows:
            continue
        file, block = (batch.column(k).to_numpy() for k in (0, 1))
        cuts = [0, *(np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1).tolist(), batch.num_rows]
        for i, j in zip(cuts, cuts[1:], strict=False):
            yield int(file[i]), int(block[i]), batch.slice(i, j - i)


def _quotes(text: np.ndarray) -> np.ndarray:
    """Places of the quotes that no backslash takes out. A text follows a brace, so no backslash is pending."""
    at = np.flatnonzero(text == QUOTE)
    odd, live, back = np.zeros(len(at), bool), np.arange(len(at)), 1
    while len(live):
        live = live[at[live] - back >= 0]
        live = live[text[at[live] - back] == SLASH]
        odd[live] ^= True
        back += 1
    return at[~odd]


def _tokens(text: np.ndarray, quotes: np.ndarray, inside: bool) -> np.ndarray:
    """Places of braces and brackets outside strings."""
    at = np.flatnonzero(_STRUCTURE[text])
    return at[(np.searchsorted(quotes, at) + inside) % 2 == 0]


def _key(text: np.ndarray, at: int, quotes: np.ndarray) -> str:
    """The key of the container that opens at a place; "" for an element of a list."""
    k = at - 1
    while k >= 0 and text[k] in b" \t\r\n":
        k -= 1
    if k < 0 or text[k] != COLON:
        return ""
    q = int(np.searchsorted(quotes, k)) - 1
    # A key that began before this text holds a brace, so it is none of ours.
    return text[quotes[q - 1] + 1 : quotes[q]].tobytes().decode("utf-8", "replace") if q >= 1 else "?"


class _Summary:
    """What a range closes and leaves open, if it begins inside a string or not."""

    def __init__(self, inside: bool):
        self.begins, self.inside, self.closed, self.opened = inside, inside, 0, []

    def add(self, text: np.ndarray, quotes: np.ndarray, start: int) -> None:
        at = _tokens(text, quotes, self.inside)
        self.inside ^= len(quotes) % 2 == 1
        if not len(at):
            return
        opens = _OPENS[text[at]]
        depth = np.cumsum(np.where(opens, 1, -1))
        pops = max(0, -int(depth.min()))
        self.closed += max(0, pops - len(self.opened))
        del self.opened[max(0, len(self.opened) - pops) :]
        least = np.minimum.accumulate(depth[::-1])[::-1]
        for j in np.flatnonzero(opens & (least == depth)):
            self.opened.append({"mark": OPEN[int(text[at[j]])], "key": _key(text, int(at[j]), quotes), "at": start + int(at[j])})


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, ways, size, blank = None, [], 0, False

    def rows():
        return pa.RecordBatch.from_pylist([{"file": key[0], "block": key[1], "inside": w.begins, "closed": w.closed, "opened": w.opened, "ends_inside": w.inside, "bytes": size, "blank_end": blank} for w in ways], _SUMMARY)

    for file, block, part in _ranges(batches):
        if key != (file, block):
            if key:
                yield rows()
            key, ways, size = (file, block), [_Summary(False), _Summary(True)], 0
        text = _text(part.column(2))
        quotes = _quotes(text)
        for w in ways:
            w.add(text, quotes, size)
        size += len(text)
        blank = not part.column(2)[-1].as_py().strip()
    if key:
        yield rows()


def _fold(table: pa.Table) -> pa.Table:
    """What stands open where each range of a file begins."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["block"], r["inside"]))
    path, size = rows[0]["path"], rows[0]["size"]
    total = sum(r["bytes"] for r in rows[::2])
    # The last text may have had no brace; then it must be blank. A byte order mark isn't counted.
    extra = total in (size + 1, size - 2)
    if total not in (size, size + 1, size - 3, size - 2) or (extra and not rows[-1]["blank_end"]):
        raise ValueError(f"{path}: malformed JSON document: it doesn't end with a closing brace, or isn't UTF-8")
    out, inside, stack = [], False, []
    for n, pair in enumerate(zip(rows[::2], rows[1::2], strict=True)):
        out.append({"file": pair[0]["file"], "block": pair[0]["block"], "number": n, "inside": inside, "stack": list(stack)})
        r = pair[inside]
        closed = r["closed"] - (extra and 2 * (n + 1) == len(rows) and not r["opened"])
        if closed < 0:
            raise ValueError(f"{path}: malformed JSON document: it isn't closed")
        if closed > len(stack):
            raise ValueError(f"{path}: malformed JSON document: it closes more than it opens")
        stack = stack[: len(stack) - closed] + [{**x, "at": x["at"] + (n << SHIFT)} for x in r["opened"]]
        inside = r["ends_inside"]
    if stack or inside:
        raise ValueError(f"{path}: malformed JSON document: {len(stack)} containers aren't closed")
    return pa.Table.from_pylist(out, _BEGIN)


class _Reader:
    """Finds spans, resources and scopes in a range, from what stands open at its beginning."""

    def __init__(self, file: int, number: int, inside: bool, stack: list[dict]):
        self.file, self.number, self.inside, self.depth, self.start = file, number, inside, len(stack), 0
        self.levels: list[tuple[str, int]] = []
        for x in stack[:DEEPEST]:
            self.levels.append((self.kind(len(self.levels), x["mark"], x["key"]), x["at"]))
        self.held: list[bytes] | None = [] if any(kind in KEPT for kind, _ in self.levels) else None
        self.cut = self.held is not None
        self.rows: list[tuple] = []

    def kind(self, level: int, mark: str, key: str) -> str:
        above = self.levels[level - 1][0] if level else ""
        return KINDS.get((above, mark, key), "other") if above or not level else "other"

    def put(self, cut: bool) -> None:
        at = dict(self.levels)
        kind = next(x for x in KEPT if x in at)
        self.rows.append((self.file, kind, at.get("r"), at.get("s"), at.get("span"), self.number, cut, b"".join(self.held).decode()))
        self.held, self.cut = None, False

    def add(self, text: np.ndarray) -> None:
        quotes = _quotes(text)
        at = _tokens(text, quotes, self.inside)
        self.inside ^= len(quotes) % 2 == 1
        opens = _OPENS[text[at]]
        after = self.depth + np.cumsum(np.where(opens, 1, -1))
        begin = 0  # of the text that is kept, if any
        for j in np.flatnonzero(after <= np.where(opens, DEEPEST, DEEPEST - 1)):
            place, level = int(at[j]), int(after[j])
            if opens[j]:
                del self.levels[level - 1 :]
                key = "" if self.levels and self.levels[-1][0] in ("resources", "scopes", "spans") else _key(text, place, quotes)
                self.levels.append((self.kind(level - 1, OPEN[int(text[place])], key), (self.number << SHIFT) + self.start + place))
                if self.held is None and self.levels[-1][0] in KEPT:
                    self.held, begin = [], place
            else:
                if self.held is not None and len(self.levels) == level + 1 and self.levels[-1][0] in KEPT:
                    self.held.append(text[begin : place + 1].tobytes())
                    self.put(self.cut)
                del self.levels[max(0, level) :]
        if self.held is not None:
            self.held.append(text[begin:].tobytes())
        self.depth = int(after[-1]) if len(after) else self.depth
        self.start += len(text)

    def end(self) -> None:
        if self.held is not None:
            self.put(True)


def _extract(batches: Iterator[pa.RecordBatch], begins: dict | None) -> Iterator[pa.RecordBatch]:
    """FOUND rows of ranges; their beginnings by (file, block), or from the first row of each."""
    key, reader = None, None

    def rows():
        made, reader.rows = reader.rows, []
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*made, strict=True), _FOUND, strict=True)], schema=_FOUND)

    for file, block, part in _ranges(batches):
        if key != (file, block):
            if reader:
                reader.end()
                if reader.rows:
                    yield rows()
            key = (file, block)
            reader = _Reader(file, *(begins[key] if begins is not None else (part.column(k)[0].as_py() for k in (3, 4, 5))))
            if begins is None:
                part = part.slice(1)
        reader.add(_text(part.column(2)))
        if reader.rows:
            yield rows()
    if reader:
        reader.end()
        if reader.rows:
            yield rows()


def found(spark: SparkSession, path: str, folder: bool, least: int, many: int = MANY) -> DataFrame:
    """(path, kind, r, s, p, number, cut, text) of the spans, resources and scopes of the files over ``least`` bytes. The first pass runs at once."""
    parts, known = fragments(spark, path, folder, least), files(spark, path, folder, least)
    begins = parts.mapInArrow(_summaries, SUMMARY).join(known, "file").groupBy("file").applyInArrow(_fold, BEGIN)
    begins = saved(begins, "ranges")
    if begins.count() <= many:
        at = {(r["file"], r["block"]): (r["number"], r["inside"], [x.asDict() for x in r["stack"]]) for r in begins.collect()}
        texts = parts.mapInArrow(lambda batches: _extract(batches, at), FOUND)
    else:  # a range's beginning comes as its first row
        empty = F.lit(None)
        heads = begins.select("file", "block", F.lit(-1).cast("bigint").alias("n"), F.lit("").alias("value"), "number", "inside", "stack")
        rows = parts.select("file", "block", F.monotonically_increasing_id().alias("n"), "value", empty.cast("bigint").alias("number"), empty.cast("boolean").alias("inside"), empty.cast(STACK).alias("stack"))
        dealt = heads.unionByName(rows).repartition("file", "block").sortWithinPartitions("file", "block", "n")
        texts = dealt.select("file", "block", "value", "number", "inside", "stack").mapInArrow(lambda batches: _extract(batches, None), FOUND)
    return texts.join(known.select("file", "path"), "file")


def whole(texts: DataFrame) -> DataFrame:
    """Texts that were cut, put together; the others as they are, without a shuffle."""
    keys = ["path", "kind", "r", "s", "p"]
    pieces = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "text"))), lambda x: x["text"]), "")
    return texts.filter("not cut").select(*keys, "text").unionByName(texts.filter("cut").groupBy(*keys).agg(pieces.alias("text")))
