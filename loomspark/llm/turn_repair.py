"""Repair of conversations whose turns are lost, blank, repeated, cut off or given to the wrong role.

A repaired conversation is an optional system turn and then pairs of user and assistant. Its cheapest edits are a shortest
path in a lattice of (turn index, state of that grammar): Keep, Rerole and Delete go to the next turn, Insert stays. The
path is found by Dijkstra's algorithm with the key (cost, audit), an audit being the initials of the edits so far.

Two audits that reach one node at one cost are never each other's beginning, as what the longer has more could only be
inserts, which cost; so the lesser of them stays the lesser whatever follows, and the key is sound.
"""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: White space that leaves a turn blank.
SPACE = " \t\n\x0b\f\r"
DELETE, REROLE, INSERT, CUT_OFF = 2, 1, 5, 5
#: What may follow each state of the grammar, by the role's initial; the initial is also the next state.
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}
ROLES = {"u": "user", "a": "assistant"}
ACCEPTING = ("", "a")
LEGAL = {"su", "ua", "au"}
#: Turns that one search goes through; longer conversations are searched piece by piece (see cheapest).
PIECE = 1000

COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, present): each turn (nulls: one space) dropped, emptied, robbed of its ends, doubled, given to the user or left, by crc32(conv_id:turn) modulo 20.

    A dropped turn is a row whose `present` is false, so its conversation stays known.
    """
    blank = F.lit(" ")
    kind = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), blank), F.coalesce(F.col("turn").cast("string"), blank)).cast("binary")) % 20
    text, role = F.coalesce("text", blank), F.coalesce("role", blank)
    return conversations.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), (kind != 0).alias("present"),
        F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("again"),
    ).drop("again")


def cheapest(turns: list[tuple[str, str]], piece: int = PIECE) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits, of equally cheap ones those with the ASCII-least audit. turns: (initial of the role, fault or "").

    The last search stops at the first accepting end that it pops. Of a longer conversation each piece is searched from
    all states that the piece before ends in, until all its own ends are popped; what those states' audits begin with is
    kept aside, so a search holds audits of its piece only.
    """
    ends = {"": (0, "")}
    for at in range(0, max(len(turns), 1), piece):
        begins: list[str] = []  # audits, none of which begins another
        heap = []
        for audit, cost, state in sorted((a, c, s) for s, (c, a) in ends.items()):
            if not begins or not audit.startswith(begins[-1]):
                begins.append(audit)
            heap.append((cost, chr(len(begins)) + audit[len(begins[-1]) :], 0, state))
        found = _search(turns[at : at + piece], heap, at + piece >= len(turns))
        ends = {s: (c, begins[ord(a[0]) - 1] + a[1:]) for s, (c, a) in found.items()}
    return next(iter(ends.values()))


def _search(turns: list[tuple[str, str]], heap: list[tuple[int, str, int, str]], last: bool) -> dict[str, tuple[int, str]]:
    """Dijkstra from the nodes in heap (cost, audit, index, state): the ends popped, only the first accepting one if it is the last piece."""
    heapq.heapify(heap)
    done, ends = set(), {}
    while heap and len(ends) < len(NEXT):
        cost, audit, at, state = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        end = at == len(turns)
        if end and last and state in ACCEPTING:
            return {state: (cost, audit)}
        wanted = NEXT[state][-1]
        if end:
            ends[state] = (cost, audit)
        else:
            initial, fault = turns[at]
            steps = [(DELETE, "D", state)]
            if fault not in ("blank", "duplicate"):
                rest = CUT_OFF if fault == "truncated" else 0
                steps.append((rest + REROLE, "R", wanted))
                if initial and initial in NEXT[state]:
                    steps.append((rest, "K", initial))
            for more, edit, to in steps:
                if (at + 1, to) not in done:
                    heapq.heappush(heap, (cost + more, audit + edit, at + 1, to))
        if (not end or last) and (at, wanted) not in done:
            heapq.heappush(heap, (cost + INSERT, audit + "I", at, wanted))
    return ends


def diagnosis(turns: list[dict]) -> tuple:
    """The values of COUNTS for a conversation's turns in order: turn, initial, key (of role and text), fault."""
    numbers = [t["turn"] for t in turns if t["turn"] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    seen, judged = set(), []
    for t in turns:
        fault = "duplicate" if t["fault"] != "blank" and t["key"] in seen else t["fault"]
        seen.add(t["key"])
        judged.append((t["initial"], fault))
    faults = [f for _, f in judged]
    illegal = sum(a + b not in LEGAL for (a, _), (b, _) in zip(judged, judged[1:]))
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, *cheapest(judged))


def _diagnosed(batches):
    """COUNTS of the conversations of batches (conv_id, turns)."""
    for batch in batches:
        found = [diagnosis(row) for row in batch.column("turns").to_pylist()]
        names = [c.split()[0] for c in COUNTS.split(", ")]
        kinds = [pa.string() if c.endswith("string") else pa.int64() for c in COUNTS.split(", ")]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(v, k) for v, k in zip(zip(*found) if found else [()] * len(kinds), kinds))], ["conv_id", *names])


class _Line:
    """The repaired text of one conversation as a running hash, while its turns go by in order."""

    def __init__(self, audit: str):
        self.edits, self.state, self.hash, self.first = iter(audit), "", hashlib.sha256(), True

    def write(self, role: str, text: str, state: str) -> None:
        self.hash.update(("" if self.first else "\n").encode() + f"{role}:{text}".encode())
        self.state, self.first = state, False

    def turn(self, role: str, text: str) -> None:
        """The inserts before a turn and the turn's own edit."""
        for edit in self.edits:
            wanted = NEXT[self.state][-1]
            if edit == "I":
                self.write(ROLES[wanted], "", wanted)
                continue
            if edit == "K":
                self.write(role, text, role[0])
            elif edit == "R":
                self.write(ROLES[wanted], text, wanted)
            return

    def end(self) -> str:
        self.turn("", "")  # inserts only are left
        return self.hash.hexdigest()


def _repaired(batches):
    """A row for each conversation of a sorted partition: a head with its COUNTS, then its turns in order. Nothing but a batch and a hash is held."""
    line, head = None, None
    for batch in batches:
        out = []
        heads, roles, texts = (batch.column(c).to_pylist() for c in ("head", "role", "text"))
        for h, role, text in zip(heads, roles, texts):
            if h is None:
                line.turn(role, text)
                continue
            if line is not None:
                out.append(head | {"repaired_sha256": line.end()})
            head, line = h, _Line(h["audit"])
        if out:
            yield pa.RecordBatch.from_pylist(out, _result(batch))
    if line is not None:
        yield pa.RecordBatch.from_pylist([head | {"repaired_sha256": line.end()}], _result(batch))


def _result(batch: pa.RecordBatch) -> pa.Schema:
    return pa.schema([*batch.schema.field("head").type, pa.field("repaired_sha256", pa.string())])


def repair(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for each conv_id of turns (conv_id, turn, role, text, present).

    Turns come in order of their number (null first), then of the role's initial and of an MD5 of role and text. Rows that
    are not present only name their conversation. Null text or role counts as one space; a null conv_id is a conversation
    of its own; an empty table gives no rows; other columns are not read. A role counts by its first character, so an
    empty or other role is never kept.

    What the search needs of a turn is some 50 bytes and comes together by conversation, as the audit in the result does;
    texts go by in order, one batch at a time, past the audit.
    """
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    key = F.unhex(F.md5(F.concat_ws(":", F.length(role).cast("string"), role, text)))
    ordered = turns.select("conv_id", "turn", F.substring(role, 1, 1).alias("initial"), key.alias("key"), role.alias("role"), text.alias("text"), "present")
    bare = F.rtrim("text", F.lit(SPACE))
    fault = F.when(bare == "", "blank").when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated").otherwise("")
    codes = F.collect_list(F.when(F.col("present"), F.struct("turn", "initial", "key", fault.alias("fault"))))
    kind = dict(turns.dtypes)["conv_id"]
    diagnosed = common.tune(ordered.groupBy("conv_id").agg(F.array_sort(codes).alias("turns"))).mapInArrow(_diagnosed, f"conv_id {kind}, {COUNTS}")
    names = ["conv_id", *(c.split()[0] for c in COUNTS.split(", "))]
    heads = diagnosed.select("conv_id", F.struct(*names).alias("head"))
    lines = ordered.filter("present").drop("present")
    every = heads.unionByName(lines, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", F.col("head").isNull(), "turn", "initial", "key")
    return every.select("head", "role", "text").mapInArrow(_repaired, f"conv_id {kind}, {COUNTS}, repaired_sha256 string")
