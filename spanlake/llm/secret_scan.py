"""Secret scans: patterns, and values in credential contexts that are dear to guess.

Three patterns give the base spans. Beyond them, a value that stands behind a credential's name is cut into
words, dates, repeats, keyboard walks and single characters so that the product of their guesses is least;
where even that needs ``GUESSES`` or more, the value is a secret of kind ``guess``. Words are ranked by the
documents of the table in which they stand, ``WORDS`` of them at most, so what is common there is cheap.

Texts are read whole, a row at a time; only values behind a credential's name reach the segmentation, which takes
time in proportion to their length. No rows are moved but the word counts.

Odd rows: a null text is empty; empty texts have no spans and the digest of the empty text. Repeated rows and ids
stay, each with its own result. An empty table gives no rows. Columns other than doc_id and text are ignored.
Matches of one kind never overlap; spans that start together stand in the order of KINDS. Case is ASCII's.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from datetime import date
from functools import lru_cache
from math import comb, log10

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import drop, saved
from .divergence import COUNTS, _count

KINDS = ("assign", "access", "hex", "guess")
GUESSES = 10.0  # log10 of the guesses that make a secret
WORDS, LEAST_DOCS, LONGEST = 32_768, 30, 32  # ranked words, documents that each stands in at least, letters of one

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CONTEXT = re.compile(r"""(?:pass(?:word|wd|phrase|code)|passwd|pwd|secret|token|(?:api|access|private|account|signing|encryption)[_-]?key|authorization|credentials?)["'`]?\x20*(?:=>|:=|[:=])\x20*(?:(?:bearer|basic)\x20+)?["'`]?([^\s"'`<>,;]+)""", re.I | re.A)
_TRAIL = ".:!?)]}"
# What every match of the two holds in small letters: plain searches tell most texts apart, many times faster.
_NAMED = ("pass", "pwd", "secret", "token", "key", "authorization", "credential")

# Passwords that come first in any guesser's list, and what stands in place of one.
COMMON = "password passwd pass admin root user guest test default secret letmein welcome login master hello monkey dragon shadow sunshine princess football baseball superman batman trustno iloveyou changeme example sample dummy none null true false your token key value here todo redacted placeholder".split()
# Rows of a keyboard, plain and shifted, each shifted half a key against the one above.
ROWS = (("`1234567890-=", "~!@#$%^&*()_+"), (" qwertyuiop[]\\", " QWERTYUIOP{}|"), (" asdfghjkl;'", ' ASDFGHJKL:"'), (" zxcvbnm,./", " ZXCVBNM<>?"))
LEET = str.maketrans("4@301$57", "aaeoisst")
PLACES = {key: (x + y / 2, y) for y, pair in enumerate(ROWS) for row in pair for x, key in enumerate(row) if key != " "}
STARTS, WAYS = len(PLACES) // 2, 6
_DATES = [re.compile(p, re.A) for p in (r"(?P<y>(?:19|20)\d\d)(?P<s>[-/._]?)(?P<m>\d\d?)(?P=s)(?P<d>\d\d?)", r"(?P<d>\d\d?)(?P<s>[-/._]?)(?P<m>\d\d?)(?P=s)(?P<y>(?:19|20)\d\d)", r"(?P<m>\d\d?)(?P<s>[-/._]?)(?P<d>\d\d?)(?P=s)(?P<y>(?:19|20)\d\d)")]
DAY, YEAR = log10(365 * 120), log10(120)
UNIT = 16  # characters of a repeated unit at most


def char_cost(c: str) -> float:
    return log10(10 if "0" <= c <= "9" else 26 if "a" <= c <= "z" or "A" <= c <= "Z" else 33 if c < "\x80" else 1000)


def case_cost(word: str) -> float:
    """Guesses for the upper-case letters of a word: none, the first or all cost little."""
    upper = sum(c.isupper() for c in word)
    if not upper:
        return 0.0
    return log10(2) if upper == len(word) or (upper == 1 and word[0].isupper()) else log10(sum(comb(len(word), k) for k in range(1, upper + 1)))


@lru_cache(maxsize=4096)
def _direction(a: str, b: str):
    """The direction from one key to a neighbour, None if they aren't neighbours."""
    if a not in PLACES or b not in PLACES:
        return None
    dx, dy = PLACES[b][0] - PLACES[a][0], PLACES[b][1] - PLACES[a][1]
    return (dx, dy) if (dy == 0 and abs(dx) == 1) or (abs(dy) == 1 and abs(dx) == 0.5) else None


def walks(value: str) -> Iterator[tuple[int, int, float]]:
    """(start, end, cost) of the longest keyboard walk and run of successive characters from each place, three long or more."""
    n = len(value)
    for kind in ("keys", "codes"):
        steps = [_direction(value[k], value[k + 1]) if kind == "keys" else (x if (x := ord(value[k + 1]) - ord(value[k])) in (1, -1) and value[k].isalnum() and value[k + 1].isalnum() else None) for k in range(n - 1)]
        end, turns, last = n, 0, None
        for k in range(n - 2, -1, -1):
            if steps[k] is None or (kind == "codes" and last is not None and steps[k] != last):
                end, turns, last = k + 1, 0, None
                if steps[k] is None:
                    continue
                end = k + 2
            elif last is None:
                end, turns = k + 2, 0
            elif steps[k] != last:
                turns += 1
            last = steps[k]
            if end - k >= 3:
                yield k, end, (log10(STARTS) + turns * log10(WAYS) if kind == "keys" else char_cost(value[k])) + log10(end - k)


def repeats(value: str, brute: list[float], words: dict[str, float]) -> Iterator[tuple[int, int, float]]:
    """(start, end, cost) of the longest repetition of each unit from each place, three characters or more; brute: costs of the characters before each place."""
    n = len(value)
    for unit in range(1, min(UNIT, n // 2) + 1):
        run = 0
        for k in range(n - unit - 1, -1, -1):
            run = run + 1 if value[k] == value[k + unit] else 0
            times = run // unit + 1
            if times > 1 and times * unit >= 3:
                own = min(brute[k + unit] - brute[k], words.get(value[k : k + unit].lower(), 99.0))
                yield k, k + times * unit, own + log10(times)


def dates(value: str) -> Iterator[tuple[int, int, float]]:
    """Days of the years 1900 to 2099, with or without separators, and years alone."""
    for k, c in enumerate(value):
        if not "0" <= c <= "9":
            continue
        for form in _DATES:
            if m := form.match(value, k):
                try:
                    date(int(m["y"]), int(m["m"]), int(m["d"]))
                except ValueError:
                    continue
                yield k, m.end(), DAY + (log10(4) if m["s"] else 0)
        if value[k : k + 2] in ("19", "20") and value[k + 2 : k + 4].isdigit() and value[k + 2 : k + 4].isascii() and len(value) >= k + 4:
            yield k, k + 4, YEAR


def spells(value: str, words: dict[str, float]) -> Iterator[tuple[int, int, float]]:
    """Ranked words, also with digits for letters, which cost a factor of two each."""
    low = value.lower()
    if len(low) != len(value):  # a letter whose small form is longer: such values have none of the words' places
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(LEET)
    for i in range(len(value)):
        for j in range(i + 1, min(len(value), i + LONGEST) + 1):
            found = words.get(low[i:j])
            if found is None and plain[i:j] != low[i:j] and (found := words.get(plain[i:j])) is not None:
                found += log10(2) * sum(a != b for a, b in zip(low[i:j], plain[i:j], strict=True))
            if found is not None:
                yield i, j, found + case_cost(value[i:j])


def guess_cost(value: str, words: dict[str, float]) -> float:
    """log10 of the guesses of the cheapest segmentation; words: log10 ranks."""
    brute = [0.0]
    for c in value:
        brute.append(brute[-1] + char_cost(c))
    into: dict[int, list] = {}
    for found in (spells(value, words), dates(value), repeats(value, brute, words), walks(value)):
        for i, j, cost in found:
            into.setdefault(j, []).append((i, cost))
    best = [0.0]
    for j in range(1, len(value) + 1):
        best.append(min([best[j - 1] + brute[j] - brute[j - 1], *(best[i] + cost for i, cost in into.get(j, ()))]))
    return best[-1]


def worded(value: str) -> bool:
    """Whether a value looks like a word of prose: letters only, and at most its first in upper case."""
    return value.isalpha() and (value[1:].islower() or len(value) == 1)


def named(text: str) -> bool:
    """Whether a text may name a credential."""
    low = text.lower()
    return any(x in low for x in _NAMED)


def base_spans(text: str, named: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6] if named else []
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def guess_spans(text: str, words: dict[str, float], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Values behind a credential's name that no base span holds and that are dear to guess."""
    out = []
    for m in _CONTEXT.finditer(text):
        value = m[1].rstrip(_TRAIL)
        start, end = m.start(1), m.start(1) + len(value)
        if value and not worded(value) and not any(s <= start and end <= e for s, _, e in base) and guess_cost(value, words) >= GUESSES:
            out.append((start, 3, end))
    return out


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scan(batches: Iterator[pa.RecordBatch], schema: pa.Schema, words: dict[str, float]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column("text"):
            text = text.as_py()
            credential = named(text)
            base = base_spans(text, credential)
            more = guess_spans(text, words, base) if credential else []
            kinds = [k for _, k, _ in base]
            rows.append((*(kinds.count(k) for k in range(3)), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(sorted(base + more)), len(more)))
        columns = zip(*rows, strict=True) if rows else [[]] * (len(schema) - 1)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(c), f.type) for c, f in zip(columns, list(schema)[1:], strict=True))], schema=schema)


def common_words(docs: DataFrame, most: int = WORDS, least_docs: int = LEAST_DOCS) -> dict[str, float]:
    """log10 ranks of the words that stand in most documents, and of COMMON. All texts are counted; the driver gets ``most`` words of up to 32 letters."""
    texts = docs.select(F.lit("").alias("lang"), F.lit("").alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    counts, path = saved(texts.mapInArrow(_count, COUNTS).groupBy("term").agg(F.sum("d").alias("d")).filter((F.col("d") >= least_docs) & (F.length("term") <= LONGEST)), "words")
    # How many words there are by size of their count, sixteen sizes a doubling, tells what the least count is: tasks then send no others.
    size = F.floor(F.log2("d") * 16)
    least, n = 0, 0
    for k, words in counts.groupBy(size.alias("k")).agg(F.count("*")).orderBy(F.desc("k")).collect():
        least, n = k, n + words
        if n >= most:
            break
    top = counts.filter(size >= least).orderBy(F.desc("d"), "term").limit(most).collect()
    drop(docs.sparkSession, path)
    ranks = {r["term"]: log10(k + 1) for k, r in enumerate(top)}
    for k, word in enumerate(COMMON):
        ranks[word] = min(ranks.get(word, 99.0), log10(k + 1))
    return ranks


def scan(docs: DataFrame, words: dict[str, float]) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_guess of each row."""
    shape = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *T.StructType.fromDDL("n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long").fields])
    arrow = to_arrow_schema(shape)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(lambda batches: _scan(batches, arrow, words), shape)
