"""Conversation repair against plain enumeration of all edits."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from lociframe.llm import conversations, queries

GRAMMAR = re.compile(r"(s?(ua)+)?\Z")
ROLES = {"u": "user", "a": "assistant"}


@cache
def enumerated(initials, faults):
    """Cheapest, then least audit of every sequence of edits with up to three inserts at a place."""
    options = []
    inserts = ["", "u", "a", "ua", "au", "uau", "aua"]
    for initial, fault in zip(initials, faults, strict=True):
        moves = [(4, "D", "")]
        if fault in (0, 3):
            moves += [(3 * (fault == 3), "K", initial)] + [(3 + 3 * (fault == 3), "R", r) for r in "ua"]
        options.append([(c + 3 * len(w), "I" * len(w) + m, w + g) for w in inserts for c, m, g in moves])
    options.append([(3 * len(w), "I" * len(w), w) for w in inserts])
    partial = {("", ""): 0}
    for choices in options:
        grown = {}
        for (moves, text), cost in partial.items():
            for c, m, g in choices:
                if re.match(r"s?(ua)*u?\Z", text + g):
                    key = (moves + m, text + g)
                    grown[key] = min(grown.get(key, 1 << 30), cost + c)
        partial = grown
    return min((cost, moves) for (moves, text), cost in partial.items() if GRAMMAR.match(text))


@pytest.mark.parametrize("seed", range(60))
def test_alignments_equal_enumeration(seed):
    rng = random.Random(seed)
    initials = "".join(rng.choice("uuaas?") for _ in range(rng.randrange(4)))
    faults = bytes(rng.choice([0, 0, 0, 1, 2, 3]) for _ in initials)
    want = enumerated(initials, faults)
    assert conversations.align_lengths(initials, faults) == want
    assert conversations.align_states(initials, faults) == want


@pytest.mark.parametrize("seed", range(60))
def test_both_alignments_agree(seed):
    rng = random.Random(seed)
    initials = "".join(rng.choice("uuuaaas?") for _ in range(rng.randrange(4, 40)))
    faults = bytes(rng.choice([0, 0, 0, 0, 1, 2, 3]) for _ in initials)
    assert conversations.align_lengths(initials, faults) == conversations.align_states(initials, faults)


def plain(rows):
    """The contract of the query, row by row."""
    text = lambda v: " " if v is None else str(v)
    whole = {}
    for c, t, role, body in rows:
        kept = whole.setdefault(c, [])
        code = zlib.crc32(f"{text(c)}:{text(t)}".encode()) % 20
        body = "" if code == 1 else re.sub("[.!?]", "", text(body)) if code == 2 else text(body)
        kept += [(t, "user" if code == 4 else text(role), body)] * (0 if code == 0 else 2 if code == 3 else 1)
    out = {}
    for c, turns in whole.items():
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        faults, seen = [], set()
        for _, role, body in turns:
            marks = re.findall(r"[^\x20\x09-\x0D]", body)
            faults.append(1 if not marks else 2 if (role, body) in seen else 3 if marks[-1] not in ".!?" else 0)
            seen.add((role, body))
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(turns, turns[1:], strict=False)]
        cost, audit = conversations.align_states("".join(r[:1] if r[:1] in ("s", "u", "a") else "?" for _, r, _ in turns), bytes(faults))
        left, wanted, lines = iter(turns), "u", []
        for move in audit:
            _, role, body = (0, "", "") if move == "I" else next(left)
            if move != "D":
                role = role if move == "K" else ROLES[wanted]
                wanted = "a" if role[0] == "u" else "u"
                lines.append(f"{role}:{body}")
        out[c] = (gaps, *[faults.count(k) for k in (1, 2, 3)], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                  hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_the_query_equals_plain_python(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in queries.table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in queries.op12_conversation_repair(spark, folder).collect()}
    assert got == plain(rows)
    assert sum(v[5] > 0 for v in got.values()) > 5


AWKWARD = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes!"), (None, None, None, None), (None, 3, "user", "x."), (None, 3, "user", "x."), (None, 3, "tool", "y"),
           (2, 0, "", "a."), (2, 1, "user", "b. "), (2, None, "system", "c?"), (3, 5, "user", " \t\n"), (3, 9, "assistant", "é日本。"),
           *[(4, k, ["user", "assistant", "tool"][k % 3], f"turn {k % 70}" + ".!?,"[k % 4]) for k in range(300)], *[(5, k, "user", "same.") for k in range(90)],
           *[(k, 0, "user", "Gone or not.") for k in range(10, 60)]]


@pytest.mark.parametrize("held", [4096, 2])
def test_awkward_rows_and_long_conversations(spark, held):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(AWKWARD, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("c", "t", "gone", "k", "audit", "n")})
    turns = conversations.damage(df)
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in conversations.repair(turns, held_turns=held).collect()}
    assert got == plain(AWKWARD)


def test_repaired_turns_and_undamaged_rows(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Again."), (2, 0, "tool", "x."), (2, 1, "assistant", "Yes.")], "conv_id long, turn long, role string, text string")
    turns = conversations.as_turns(df)
    repairs = conversations.repair(turns)
    assert {r["conv_id"]: (r["cost"], r["audit"]) for r in repairs.collect()} == {1: (3, "KR"), 2: (3, "RK")}
    rows = sorted(tuple(r) for r in conversations.repaired_turns(turns, repairs).collect())
    assert rows == [(1, 0, "user", "Hi."), (1, 1, "assistant", "Again."), (2, 0, "user", "x."), (2, 1, "assistant", "Yes.")]


def test_an_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.repair(conversations.damage(df)).collect() == []
