"""Repairs against an exhaustive search over edits, and odd conversations."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from loomspark.llm import turn_repair

GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def exhaustive(turns):
    """(cost, audit) of the least edits by trying all, at most two inserts in one place."""
    best = None
    work = [(0, "", 0, "", 0)]
    while work:
        cost, audit, at, roles, held = work.pop()
        if best and cost > best[0]:
            continue
        if at == len(turns) and GRAMMAR.match(roles):
            best = min(best or (cost, audit), (cost, audit))
        if held < 2:
            work += [(cost + 5, audit + "I", at, roles + r, held + 1) for r in "ua"]
        if at < len(turns):
            initial, fault = turns[at]
            work.append((cost + 2, audit + "D", at + 1, roles, 0))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                work.append((cost + more, audit + "K", at + 1, roles + (initial or "-"), 0))
                work += [(cost + more + 1, audit + "R", at + 1, roles + r, 0) for r in "ua"]
        work = [w for w in work if not re.search(r"[^sua]|.s|^a|uu|aa|sa", w[3])]
    return best


def test_cheapest_is_least_of_all_edits():
    rng = random.Random(3)
    for _ in range(300):
        turns = [(rng.choice(["s", "u", "a", "a", "u", "t", ""]), rng.choice(["", "", "", "blank", "duplicate", "truncated"])) for _ in range(rng.randint(0, 6))]
        assert turn_repair.cheapest(turns) == exhaustive(turns), turns


def test_pieces_change_nothing():
    rng = random.Random(5)
    for _ in range(200):
        turns = [(rng.choice("suaau t"), rng.choice(["", "", "blank", "truncated"])) for _ in range(rng.randint(0, 60))]
        whole = turn_repair.cheapest(turns)
        assert all(turn_repair.cheapest(turns, piece) == whole for piece in (1, 2, 7, 19))


def plain(rows):
    """Rows (conv_id, turn, role, text) as the query returns them, by plain steps."""
    out = {}
    for c in {r[0] for r in rows}:
        kept = []
        for conv, turn, role, text in rows:
            if conv != c:
                continue
            k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            if k:
                text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
                kept += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
        kept.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1][:1].encode(), hashlib.md5(f"{len(t[1])}:{t[1]}:{t[2]}".encode()).digest()))
        seen, turns = set(), []
        for _, role, text in kept:
            bare = text.rstrip(" \t\n\x0b\f\r")
            turns.append((role[:1], "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"))
            seen.add((role, text))
        cost, audit = turn_repair.cheapest(turns)
        lines, at, users = [], 0, 0
        for e in audit:
            wanted = ("user", "assistant")[users % 2]
            role, text = kept[at][1:] if e != "I" else ("", "")
            at += e != "I"
            if e != "D":
                lines.append(f"{role if e == 'K' else wanted}:{text}")
                users += not (e == "K" and role[0] == "s")
        numbers = [t for t, *_ in kept if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        faults = [f for _, f in turns]
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        out[c] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def got(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(c) for c in ("head", "initial", "key", "present", "again", "turns", "audit")})
    found = turn_repair.repair(turn_repair.damage(df.repartition(parts))).collect()
    assert len({r["conv_id"] for r in found}) == len(found)
    return {r["conv_id"]: tuple(r)[1:] for r in found}


def test_conversations_as_by_plain_steps(spark):
    rng = random.Random(11)
    rows = []
    for c in range(120):
        for turn in range(rng.randint(1, 12)):
            rows.append((c, rng.choice([turn, turn, turn, turn - 1, None, -turn]), rng.choice(["user", "assistant", "assistant", "user", "system", "tool", "", None]), rng.choice(["Ja.", "No", "What?", " ", "", None, f"é {turn}!", "ends. \x0b\t", "x" * rng.randint(1, 30) + "."])))
    rows += rows[:40] + [(None, 1, "user", "Hi."), (None, None, None, None), (None, 2, "assistant", "Yes.")]
    assert got(spark, rows) == plain(rows)
    assert got(spark, rows, 1) == got(spark, rows, 5)


def test_very_long_conversation_and_text(spark):
    rows = [(7, k, ("user", "assistant")[k % 2], f"{k}.") for k in range(2500)] + [(8, 0, "user", "w " * 500_000 + "?"), (8, 1, "assistant", "Yes.")]
    assert got(spark, rows) == plain(rows)
    assert got(spark, []) == {}


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_given_conversations(spark, size):
    df = spark.read.parquet(f"/root/testdata/{size}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    found = turn_repair.repair(turn_repair.damage(df)).collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in found} == plain(rows)
