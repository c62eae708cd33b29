"""Conversation structure repair: the cheapest edits after which a conversation's roles fit a grammar.

Roles must read ``(s?(ua)+)?`` by their initials. Four states say how far a conversation has come: nothing
yet, after s, after u, after a; nothing and after a may end it. A forward pass carries, for each state, the
least (cost, audit string) and the digest of the repaired text so far. A row is kept, given a role, or
deleted; after each row up to two empty rows may be inserted. Paths of one state, row and cost never begin
with one another (a row has one letter, and each insertion costs), so the least string so far stays least.

Identical rows of a turn are one row with a count. Rows are dealt by ranges of (conversation, turn, role,
text), so a conversation of any length is spread: a task folds each stretch of a conversation to its costs
and strings from each state to each, and a conversation's stretches are joined in order. Only a conversation
cut by such a range is read a second time, as a stream, for its SHA-256, which has no parallel form.

Odd rows: null role and text are one space (such a text is blank), null turns come first, a null conv_id is
a conversation of its own. Rows of one turn stand by role, then text, byte by byte. A conversation of which
no row is left has zeros, an empty audit and the digest of the empty text. An empty table gives no rows;
columns other than conv_id, turn, role and text are ignored, so their names may clash. Roles count by their
first letter only: one that starts with none of s, u, a can only be changed or deleted.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import drop, parts, saved

WHITE = " \t\n\x0b\x0c\r"
NOTHING, AFTER_S, AFTER_U, AFTER_A = range(4)
MOVES = ((NOTHING, AFTER_S, "s"), (NOTHING, AFTER_U, "u"), (AFTER_S, AFTER_U, "u"), (AFTER_A, AFTER_U, "u"), (AFTER_U, AFTER_A, "a"))
NAMES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
CLEAN, BLANK, DUPLICATE, TRUNCATED = range(4)
CHUNK = 4096  # letters of an audit string that are copied from row to row
PREFIX = 64  # characters of a text by which rows of one turn are dealt

PIECE = "whole boolean, at long, live long, turn_lo long, turn_hi long, turns long, head string, tail string, blank long, duplicate long, truncated long, illegal long, costs array<long>, audits array<string>, sha string"
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and n, by the remainder of crc32(`conv_id:turn`) by 20; a dropped row stays as a mark of its conversation, with n 0."""
    code = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    df = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), code.alias("code"))
    gone = F.col("code") == 0
    text = F.when(gone | (F.col("code") == 1), "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(gone, "").when(F.col("code") == 4, "user").otherwise(F.col("role"))
    return df.select("conv_id", F.when(~gone, F.col("turn")).alias("turn"), role.alias("role"), text.alias("text"), F.when(gone, 0).when(F.col("code") == 3, 2).otherwise(1).cast("long").alias("n"))


def undamaged(rows: DataFrame) -> DataFrame:
    """As ``damaged``, but of rows as they are."""
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.lit(1).cast("long").alias("n"))


def _flagged(once: DataFrame) -> DataFrame:
    """Distinct rows with the fault of their first copy; a message repeated in later turns is told by its first turn."""
    end = F.rtrim("text", F.lit(WHITE))
    once = once.withColumn("said", F.when(F.col("n") > 0, F.unhex(F.sha2(F.concat("role", F.lit("\0"), "text"), 256))))
    first = once.filter("n > 0").groupBy(F.col("conv_id").alias("c"), F.col("said").alias("d")).agg(F.min("turn").alias("first"), F.bool_or(F.col("turn").isNull()).alias("at_null"), F.count("*").alias("times")).filter("times > 1")
    later = F.coalesce(F.col("turn").isNotNull() & (F.col("at_null") | (F.col("turn") > F.col("first"))), F.lit(False))
    fault = F.when(end == "", BLANK).when(later, DUPLICATE).when(~F.right(end, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(CLEAN)
    joined = once.join(first, once["conv_id"].eqNullSafe(first["c"]) & (once["said"] == first["d"]), "left")
    return joined.select("conv_id", "turn", "role", "text", "n", fault.alias("fault"))


# A path: (cost, chain of chunks, letters behind them, digest so far or None).


def _chunks(chain) -> list:
    out = []
    while chain is not None:
        out.append(chain)
        chain = chain[0]
    return out[::-1]


def _text(path) -> str:
    return "".join(x[1] for x in _chunks(path[1])) + path[2]


def _less(a, b) -> bool:
    if a[0] != b[0]:
        return a[0] < b[0]
    if a[1] is b[1]:
        return a[2] < b[2]
    x, y, k = _chunks(a[1]), _chunks(b[1]), 0
    while k < min(len(x), len(y)) and x[k] is y[k]:
        k += 1
    return "".join(c[1] for c in x[k:]) + a[2] < "".join(c[1] for c in y[k:]) + b[2]


def _longer(path, more: int, letter: str, line: bytes | None = None, chain=None):
    """The path with a further letter; its digest takes in the line, if any."""
    sha = path[3]
    if line is not None and sha is not None:
        sha = sha.copy()
        sha.update(line)
    tail = path[2] + letter
    return (path[0] + more, (path[1], tail), "", sha) if len(tail) > CHUNK else (path[0] + more, path[1], tail, sha)


def _closed(now: list) -> list:
    """Insertions behind a row: a user, an assistant or both; and states that another one beats whatever follows are left out."""
    for target, sources in ((AFTER_U, (NOTHING, AFTER_S, AFTER_A)), (AFTER_A, (AFTER_U,))):
        won, best = None, now[target]
        for s in sources:
            p = now[s]
            if p is not None and (best is None or p[0] + INSERT <= best[0]):
                q = (p[0] + INSERT, p[1], p[2] + "I", None)
                if best is None or _less(q, best):
                    won, best = s, q
        if won is not None:
            line = (b"" if won == NOTHING else b"\n") + (b"user:" if target == AFTER_U else b"assistant:")
            now[target] = _longer(now[won], INSERT, "I", line)
    end = now[AFTER_A]
    if end is not None:
        # From "after a" all goes on as from the others, but for one kept s, whose row is deleted instead.
        if now[NOTHING] is not None and now[NOTHING][0] > end[0] + DELETE:
            now[NOTHING] = None
        if now[AFTER_S] is not None and now[AFTER_S][0] > end[0]:
            now[AFTER_S] = None
    return now


def begun(state: int = NOTHING) -> list:
    now = [None] * 4
    now[state] = (0, None, "", hashlib.sha256() if state == NOTHING else None)
    return _closed(now)


def stepped(now: list, role: str, text: bytes, fault: int) -> list:
    """The least paths behind one more row."""
    new = [None if p is None else _longer(p, DELETE, "D") for p in now]
    if fault not in (BLANK, DUPLICATE):
        base, initial, won = CUT if fault == TRUNCATED else 0, role[:1], {}
        for source, target, want in MOVES:
            p = now[source]
            if p is None or (want == "s" and initial != "s"):
                continue
            cost, letter = (base, "K") if initial == want else (base + REROLE, "R")
            best = new[target]
            if best is None or p[0] + cost <= best[0]:
                q = (p[0] + cost, p[1], p[2] + letter, None)
                if best is None or _less(q, best):
                    new[target], won[target] = q, (source, cost, letter, want)
        for target, (source, cost, letter, want) in won.items():
            said = (role if letter == "K" else NAMES[want]).encode() + b":" + text
            new[target] = _longer(now[source], cost, letter, said if source == NOTHING else b"\n" + said)
    return _closed(new)


def ended(now: list):
    """The least path that may end: with nothing, or after a."""
    a, b = now[NOTHING], now[AFTER_A]
    return b if a is None or (b is not None and _less(b, a)) else a


class _Run:
    """A stretch of a conversation's rows in order."""

    def __init__(self, conv, at: int, open_: bool):
        self.conv, self.at, self.open = conv, at, open_
        self.ways = [begun(s) for s in range(4 if open_ else 1)]
        self.live = self.turns = self.illegal = 0
        self.faults = [0] * 4
        self.lo = self.hi = self.head = self.tail = None

    def add(self, turn, role: str, text: bytes, n: int, fault: int) -> None:
        for k in range(n):
            kind = DUPLICATE if k and fault != BLANK else fault
            self.faults[kind] += 1
            if self.live and self.tail + role[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            if not self.live:
                self.head = role[:1]
            self.tail, self.live = role[:1], self.live + 1
            self.ways = [stepped(w, role, text, kind) for w in self.ways]
        if n and turn is not None and turn != self.hi:
            self.lo, self.hi, self.turns = turn if self.lo is None else self.lo, turn, self.turns + 1

    def row(self, closed: bool) -> tuple:
        whole = closed and not self.open
        best = ended(self.ways[0])
        sha = best[3].hexdigest()
        if whole:
            costs, audits = [best[0]], [_text(best)]
        else:
            paths = [w[t] for w in (self.ways + [[None] * 4] * 3)[:4] for t in range(4)]
            costs, audits = [None if p is None else p[0] for p in paths], [None if p is None else _text(p) for p in paths]
        return (self.conv, whole, self.at, self.live, self.lo, self.hi, self.turns, self.head, self.tail, *self.faults[1:], self.illegal, costs, audits, sha)


def _table(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _in_batches(made, schema: pa.Schema, size: int = 1000):
    held = []
    for row in made:
        held.append(row)
        if len(held) >= size:
            yield _table(held, schema)
            held = []
    yield _table(held, schema)


def _pieces(batches, schema: pa.Schema):
    """A row for each stretch. A stretch is whole if the rows before and behind it in the order belong to others."""

    def walk():
        run, last = None, None
        for batch in batches:
            lists = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
            for conv, turn, role, text, n, fault, at in zip(*lists, strict=True):
                follows = last is not None and at == last + 1
                if run is None or not follows or conv != run.conv:
                    if run is not None:
                        yield run.row(follows)
                    run = _Run(conv, at, not follows)
                run.add(turn, role, text, n, fault)
                last = at
        if run is not None:
            yield run.row(False)

    return _in_batches(walk(), schema)


def _one_result(live, lo, hi, turns, blank, duplicate, truncated, illegal, cost, audit, sha) -> tuple:
    return (hi - lo + 1 - turns if turns else 0, blank, duplicate, truncated, illegal, cost, audit, sha)


def _joined(rows: list[dict]) -> tuple:
    """One conversation from its stretches in order; its digest is left open unless there is one stretch only."""
    now, sums = None, dict.fromkeys(("live", "turns", "blank", "duplicate", "truncated", "illegal"), 0)
    lo = hi = tail = None
    for r in rows:
        ways = [[None if c is None else (c, None, a, None) for c, a in zip(r["costs"][4 * s : 4 * s + 4], r["audits"][4 * s : 4 * s + 4], strict=True)] for s in range(4)]
        if now is None:
            now = ways[NOTHING]
        else:
            new = [None] * 4
            for s, p in enumerate(now):
                for t, q in enumerate(ways[s] if p is not None else ()):
                    if q is not None:
                        path = (p[0] + q[0], (p[1], p[2]), q[2], None)
                        if new[t] is None or _less(path, new[t]):
                            new[t] = path
            now = new
        for k in sums:
            sums[k] += r[k]
        if r["live"]:
            if tail is not None and tail + r["head"] not in ("su", "ua", "au"):
                sums["illegal"] += 1
            tail = r["tail"]
        if r["turns"]:
            sums["turns"] -= hi is not None and hi == r["turn_lo"]
            lo, hi = r["turn_lo"] if lo is None else lo, r["turn_hi"]
    best = ended(now)
    return (rows[0]["conv_id"], *_one_result(sums["live"], lo, hi, sums["turns"], sums["blank"], sums["duplicate"], sums["truncated"], sums["illegal"], best[0], _text(best), rows[0]["sha"] if len(rows) == 1 else None))


def _merged(batches, schema: pa.Schema):
    rows = (r for b in batches for r in b.to_pylist())
    return _in_batches((_joined(list(group)) for _, group in groupby(rows, lambda r: r["conv_id"])), schema)


def _digests(batches, schema: pa.Schema):
    """The SHA-256 of repaired conversations: first comes a conversation's audit, then its rows in order; only the digest is held."""

    def lines():
        conv, sha, audit, at, out, odd = None, None, "", 0, 0, 0

        def inserts():
            nonlocal at, out
            while at < len(audit) and audit[at] == "I":
                say(None, b"")
                at += 1

        def say(role, text):
            nonlocal out
            # The place of a row tells its role: s first where the number of rows is odd, then u and a in turn.
            name = role if role is not None else "user" if (out - odd) % 2 == 0 else "assistant"
            sha.update((b"\n" if out else b"") + name.encode() + b":" + text)
            out += 1

        for batch in batches:
            for conv_, _, role, text, n, audit_ in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if audit_ is not None:
                    if sha is not None:
                        yield conv, sha.hexdigest()
                    conv, sha, audit, at, out = conv_, hashlib.sha256(), audit_, 0, 0
                    odd = sum(audit.count(x) for x in "KRI") % 2
                    inserts()
                    continue
                for _ in range(n):
                    letter, at = audit[at], at + 1
                    if letter != "D":
                        say(role if letter == "K" else None, text)
                    inserts()
        if sha is not None:
            yield conv, sha.hexdigest()

    return _in_batches(lines(), schema)


def repair(rows: DataFrame) -> DataFrame:
    """One row a conversation of (conv_id, turn, role, text, n): see RESULT. Rows with n 0 stand for a conversation only."""
    spark = rows.sparkSession
    key = rows.schema["conv_id"]
    shape = lambda text: T.StructType([T.StructField("conv_id", key.dataType), *T.StructType.fromDDL(text).fields])
    once, once_path = saved(rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n")), "said")
    order = ["conv_id", "turn", "role"]
    dealt = _flagged(once).repartitionByRange(parts(spark), *order, F.substring("text", 1, PREFIX)).sortWithinPartitions(*order, "text")
    turns, turns_path = saved(dealt.select("conv_id", "turn", "role", F.col("text").cast("binary").alias("text"), "n", "fault", F.monotonically_increasing_id().alias("at")), "turns")
    drop(spark, once_path)

    piece = shape(PIECE)
    arrow = to_arrow_schema(piece)
    pieces, _ = saved(turns.mapInArrow(lambda batches: _pieces(batches, arrow), piece), "stretches")
    whole = pieces.filter("whole").select("conv_id", F.when(F.col("turns") > 0, F.col("turn_hi") - F.col("turn_lo") + 1 - F.col("turns")).otherwise(0).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.col("costs")[0].alias("cost"), F.col("audits")[0].alias("audit"), F.col("sha").alias("repaired_sha256"))

    result = shape(RESULT)
    result_arrow = to_arrow_schema(result)
    cut = pieces.filter("not whole").repartition(parts(spark), "conv_id").sortWithinPartitions("conv_id", "at")
    merged, _ = saved(cut.mapInArrow(lambda batches: _merged(batches, result_arrow), result), "joined")
    long = merged.filter("repaired_sha256 is null").select(F.col("conv_id").alias("c"), "audit")
    if not long.isEmpty():
        found = shape("repaired_sha256 string")
        found_arrow = to_arrow_schema(found)
        lines = turns.join(long.select("c"), turns["conv_id"].eqNullSafe(F.col("c")), "left_semi").select("conv_id", "at", "role", "text", "n", F.lit(None).cast("string").alias("audit"))
        heads = long.select(F.col("c").alias("conv_id"), F.lit(-1).cast("long").alias("at"), F.lit("").alias("role"), F.lit(b"").alias("text"), F.lit(0).cast("long").alias("n"), "audit")
        stream = heads.unionByName(lines).repartition(parts(spark), "conv_id").sortWithinPartitions("conv_id", "at")
        hashed = stream.mapInArrow(lambda batches: _digests(batches, found_arrow), found).select(F.col("conv_id").alias("c"), F.col("repaired_sha256").alias("sha"))
        merged = merged.join(hashed, merged["conv_id"].eqNullSafe(hashed["c"]), "left").withColumn("repaired_sha256", F.coalesce("repaired_sha256", "sha")).drop("c", "sha")
    return whole.unionByName(merged)
