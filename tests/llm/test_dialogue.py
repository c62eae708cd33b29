"""Conversation repair against brute force and SQL."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from spanlake.llm import dialogue, oracles, queries
from spanlake.llm.dialogue import BLANK, CLEAN, DUPLICATE, TRUNCATED

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def brute(rows):
    """The least (cost, audit) of all edits of (role, text, fault) rows with up to two insertions at a place, and its lines."""
    edits = {"K": 0, "R": 1, "D": 2}
    best = None
    for letters in itertools.product("KRD", repeat=len(rows)):
        if any(x != "D" and f in (BLANK, DUPLICATE) for x, (_, _, f) in zip(letters, rows, strict=True)):
            continue
        for inserts in itertools.product(range(3), repeat=len(rows) + 1):
            audit = "I" * inserts[0] + "".join(x + "I" * k for x, k in zip(letters, inserts[1:], strict=True))
            cost = 5 * sum(inserts) + sum(edits[x] + 5 * (x != "D" and f == TRUNCATED) for x, (_, _, f) in zip(letters, rows, strict=True))
            if best is not None and (cost, audit) >= best[:2]:
                continue
            kept = len(rows) - letters.count("D") + sum(inserts)
            want = ("s" if kept % 2 else "") + "ua" * (kept // 2)
            out, rest = [], iter(rows)
            for x in audit:
                role, text, _ = (None, "", 0) if x == "I" else next(rest)
                if x == "D":
                    continue
                place = want[len(out)]
                if (x == "K" and role[:1] != place) or (x != "K" and place == "s"):
                    break
                out.append(f"{role if x == 'K' else {'u': 'user', 'a': 'assistant'}[place]}:{text}")
            else:
                if re.fullmatch("(s?(ua)+)?", want):
                    best = (cost, audit, out)
    return best


def test_walk_against_all_edits():
    rnd = random.Random(5)
    for _ in range(150):
        rows = [(rnd.choice(["system", "user", "assistant", "user", "tool", "s2", ""]), rnd.choice("xyz"), rnd.choice([CLEAN, CLEAN, BLANK, DUPLICATE, TRUNCATED])) for _ in range(rnd.randrange(5))]
        now = dialogue.begun()
        for role, text, fault in rows:
            now = dialogue.stepped(now, role, text.encode(), fault)
        got = dialogue.ended(now)
        cost, audit, lines = brute(rows)
        assert (got[0], dialogue._text(got), got[3].hexdigest()) == (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()), rows


def test_long_strings_are_compared_whole(monkeypatch):
    monkeypatch.setattr(dialogue, "CHUNK", 3)
    test_walk_against_all_edits()


def tables(tmp_path, rows):
    """Conversations as Parquet, with columns whose names clash, and the SQL's result over them."""
    conv, turn, role, text = zip(*rows, strict=True) if rows else ((),) * 4
    pq.write_table(pa.table({"conv_id": pa.array(conv, pa.int64()), "turn": pa.array(turn, pa.int64()), "role": pa.array(role, pa.string()), "text": pa.array(text, pa.string()), "n": pa.array(["x"] * len(conv), pa.string()), "at": pa.array(["y"] * len(conv), pa.string())}), tmp_path / "conversations.parquet")
    con = duckdb.connect()
    con.sql(f"create view conversations as select conv_id, turn, role, text from '{tmp_path}/conversations.parquet'")
    return sorted(con.sql(f"select {', '.join(COLUMNS)} from ({oracles.DIALOGUE})").fetchall(), key=repr)


def both(spark, tmp_path, rows):
    want = tables(tmp_path, rows)
    got = sorted((tuple(r[c] for c in COLUMNS) for r in queries.op11_dialogue(spark, str(tmp_path)).collect()), key=repr)
    assert got == want
    return got


def random_rows(rnd, convs, most):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, ""]
    said = lambda: rnd.choice(["", " \t", None, "Yes.", "No", "Why? ", "é!", "End.\n", "a" * 200]) if rnd.random() < 0.5 else f"Said {rnd.randrange(10**6)}."
    return [(c, rnd.choice([None, k, k, k, k, 2 * k]), rnd.choice(roles), said()) for c in convs for k in range(rnd.randrange(1, most))]


def test_odd_rows_against_sql(spark, tmp_path):
    rnd = random.Random(11)
    rows = random_rows(rnd, [None, *range(60)], 12)
    rows += rnd.sample(rows, 40) + [(7, 3, "user", "Same.")] * 5
    got = both(spark, tmp_path, rows)
    assert len(got) == 61


def test_conversations_of_which_no_row_is_left(spark, tmp_path):
    gone = [(c, 0, "user", "Hi.") for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    got = both(spark, tmp_path, gone)
    assert len(got) == len(gone) > 5 and {r[1:] for r in got} == {(0,) * 6 + ("", hashlib.sha256(b"").hexdigest())}


def test_no_rows(spark, tmp_path):
    assert both(spark, tmp_path, []) == []


def test_a_conversation_over_many_tasks(spark, tmp_path):
    """One conversation holds most rows: it is cut, joined in order, and its digest streamed."""
    rnd = random.Random(3)
    rows = [(1, k, ["user", "assistant"][(k + (k > 900)) % 2], f"Line {k if k % 7 else 0}{'.' if k % 5 else ''}") for k in range(1500)] + random_rows(rnd, range(2, 12), 6)
    got = both(spark, tmp_path, rows)
    assert len(got) == 11 and max(len(r[7]) for r in got) > 1400


def test_very_long_texts(spark, tmp_path):
    rows = [(k, t, r, f"{k} {t} " + "long " * 400_000 + "end.") for k in range(2) for t, r in enumerate(["user", "assistant"])]
    assert len(both(spark, tmp_path, rows)) == 2


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_the_given_tables(spark, sf):
    d = f"/root/testdata/sf{sf}"
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{d}/conversations.parquet'")
    want = sorted(con.sql(f"select {', '.join(COLUMNS)} from ({oracles.DIALOGUE})").fetchall())
    assert sorted(tuple(r[c] for c in COLUMNS) for r in queries.op11_dialogue(spark, d).collect()) == want
