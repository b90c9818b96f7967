"""Repair the turn structure of conversations by aligning them with an alternating grammar.

A conversation should be empty or read ``s?(ua)+`` by the initials of its roles (system, user, assistant). Its turns are aligned with the
grammar's string of each feasible length by Wagner-Fischer; a diagonal outside the Ukkonen band of the best cost so far cannot
take part in an alignment as cheap, so neither can a length. Of all cheapest alignments the audit (initials of Delete, Insert, Keep,
Rerole in order) that is least in ASCII order wins. Costs are in ``COSTS``.

Turns go to tasks by conversation and stream through in order. What is held of a conversation is two bytes and a digest a turn, and its
texts up to ``HELD_TURNS`` turns and ``HELD_BYTES``; the texts of a longer one are hashed as they pass a second time, beside the audit.
Beyond ``ALIGNED_TURNS`` turns all lengths are folded into one table of four grammar states, which gives the same audit.

NULL: a NULL conv_id is a conversation of its own, a NULL turn comes first, a NULL role or text is one space. Turns of equal number are
in order of role and text. An empty role has no initial, is never kept as it is and makes both its neighbourhoods illegal.
Repeated rows are turns like any others. An empty table gives an empty one. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..scale import checkpoint

COSTS = {"delete": 4, "insert": 3, "rerole": 3, "truncated": 3}
DELETE, INSERT, REROLE, TRUNCATED = COSTS.values()
ALIGNED_TURNS = 64
HELD_TURNS = 4096
HELD_BYTES = 4 << 20
SPACES = " \t\n\v\f\r"
LEGAL = {"su", "ua", "au"}
NEVER = 1 << 60
ROLES = {"u": "user", "a": "assistant"}
# Faults of a turn; the first that holds counts.
SOUND, BLANK, DUPLICATE, CUT = range(4)


def _target(length: int) -> list[str]:
    """Grammar strings of one length: empty, (ua)+ or s(ua)+."""
    if length == 0:
        return [""]
    return ["ua" * (length // 2)] if length % 2 == 0 else ["s" + "ua" * (length // 2)] if length > 1 else []


def _align(initials: str, faults: bytes, target: str, most: int) -> tuple[int, str] | None:
    """(cost, least audit) of aligning turns with one grammar string, or None where it costs more than ``most``."""
    n, length = len(initials), len(target)
    if INSERT * (length - n) > most or DELETE * (n - length) > most:
        return None
    low, high = -((most - INSERT * (length - n)) // (INSERT + DELETE)), (most + DELETE * (length - n)) // (INSERT + DELETE)
    width = high - low + 3  # a column of NEVER on both sides of the band
    # rest[i][j - i - low + 1]: cost of turns i.. against target j..
    rest = [[NEVER] * width for _ in range(n + 1)]
    for i in range(n, -1, -1):
        row = rest[i]
        for j in range(min(length, i + high), max(0, i + low) - 1, -1):
            at = j - i - low + 1
            best = 0 if i == n and j == length else NEVER
            if i < n:
                best = DELETE + rest[i + 1][at - 1]
                if j < length and (step := _meet(initials[i], faults[i], target[j])) is not None:
                    best = min(best, step + rest[i + 1][at])
            if j < length and target[j] != "s":
                best = min(best, INSERT + row[at + 1])
            row[at] = min(best, NEVER)
    cost = rest[0][1 - low]
    if cost > most:
        return None
    audit, i, j = [], 0, 0
    while i < n or j < length:
        at = j - i - low + 1
        left = rest[i][at]
        if i < n and left == DELETE + rest[i + 1][at - 1]:
            audit.append("D")
            i += 1
        elif j < length and target[j] != "s" and left == INSERT + rest[i][at + 1]:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if initials[i] == target[j] else "R")
            i, j = i + 1, j + 1
    return cost, "".join(audit)


def _meet(initial: str, fault: int, wanted: str) -> int | None:
    """Cost of keeping a turn, or giving it another role, where the grammar has ``wanted``; None where neither can be."""
    if fault in (BLANK, DUPLICATE) or (initial != wanted and wanted == "s"):
        return None
    return (REROLE if initial != wanted else 0) + (TRUNCATED if fault == CUT else 0)


@lru_cache(maxsize=50_000)
def align_lengths(initials: str, faults: bytes) -> tuple[int, str]:
    """(cost, audit) over the grammar strings of all lengths, nearest to the number of sound turns first."""
    n = len(initials)
    found = (DELETE * n, "D" * n)
    sound = n - sum(f in (BLANK, DUPLICATE) for f in faults)
    away = 0
    # A string longer by d needs d inserts at least beside the deletes of faulty turns, one shorter d more deletes.
    while INSERT * away + DELETE * (n - sound) <= found[0]:
        for length in {sound + away, sound - away}:
            for target in _target(length) if length >= 0 else ():
                aligned = _align(initials, faults, target, found[0])
                if aligned is not None:
                    found = min(found, aligned)
        away += 1
    return found


# The grammar as states: nothing yet, behind s, behind u, behind a. Each state has one letter of u and a that may follow.
_FOLLOWS = (("u", 2), ("u", 2), ("a", 3), ("u", 2))


def align_states(initials: str, faults: bytes) -> tuple[int, str]:
    """The same as ``align_lengths`` in time and memory that follow the number of turns."""
    n = len(initials)
    moves = bytearray(4 * n)  # letter to write in each state in front of each turn
    after = [0, 2 * INSERT, INSERT, 0]
    for i in range(n - 1, -1, -1):
        initial, fault = initials[i], faults[i]
        here = []
        for q, (letter, to) in enumerate(_FOLLOWS):
            best = (DELETE + after[q], "D")
            step = _meet(initial, fault, letter)
            if step is not None:
                best = min(best, (step + after[to], "K" if initial == letter else "R"))
            if q == 0 and initial == "s" and (step := _meet(initial, fault, "s")) is not None:
                best = min(best, (step + after[1], "K"))
            here.append(best)
        for _ in range(3):
            for q, (_, to) in enumerate(_FOLLOWS):
                here[q] = min(here[q], (INSERT + here[to][0], "I"))
        for q in range(4):
            moves[4 * i + q] = ord(here[q][1])
        after = [cost for cost, _ in here]
    audit, q, i = bytearray(), 0, 0
    while i < n:
        move = chr(moves[4 * i + q])
        audit.append(ord(move))
        if move == "I":
            q = _FOLLOWS[q][1]
            continue
        if move == "K" and q == 0 and initials[i] == "s":
            q = 1
        elif move != "D":
            q = _FOLLOWS[q][1]
        i += 1
    audit += b"I" * {0: 0, 1: 2, 2: 1, 3: 0}[q]
    return after[0], audit.decode()


def align(initials: str, faults: bytes) -> tuple[int, str]:
    return align_lengths(initials, faults) if len(initials) <= ALIGNED_TURNS else align_states(initials, faults)


def repaired(turns: Iterator[tuple[str, str]], audit: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired conversation; the audit alone decides the roles, as the grammar alternates."""
    wanted = "u"
    for move in audit:
        role, text = ("", "") if move == "I" else next(turns)
        if move == "D":
            continue
        if move != "K":
            role = ROLES[wanted]
        yield role, text
        wanted = "a" if role[:1] == "u" else "u"


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Columns c, t, role, text and gone: seeded damage by crc32(``conv:turn``) % 20, see the query. Dropped turns stay, marked gone."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(blank(conv_col), F.lit(":"), blank(turn_col)).cast("binary")) % 20
    text = F.when(code == 1, "").when(code == 2, F.translate(blank(text_col), ".!?", "")).otherwise(blank(text_col))
    out = rows.select(F.col(conv_col).alias("c"), F.col(turn_col).cast("bigint").alias("t"), F.when(code == 4, "user").otherwise(blank(role_col)).alias("role"),
                      text.alias("text"), (code == 0).alias("gone"), F.explode(F.when(code == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("__n"))
    return out.drop("__n")


def as_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The columns ``repair`` reads, nothing damaged."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select(F.col(conv_col).alias("c"), F.col(turn_col).cast("bigint").alias("t"), blank(role_col).alias("role"), blank(text_col).alias("text"), F.lit(False).alias("gone"))


class _Conversation:
    """What is held of the conversation that streams by."""

    def __init__(self, key, most_turns: int):
        self.most_turns = most_turns
        self.key, self.seen, self.initials, self.faults, self.illegal = key, set(), bytearray(), bytearray(), 0
        self.low = self.high = self.before = None
        self.distinct, self.held, self.size = 0, [], 0

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None:  # turns come in order
            self.distinct += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        stripped = text.strip(SPACES)
        same = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        fault = BLANK if not stripped else DUPLICATE if same in self.seen else SOUND if stripped[-1] in ".!?" else CUT
        if fault != BLANK:
            self.seen.add(same)
        initial = role[:1]
        if self.before is not None:
            self.illegal += self.before + initial not in LEGAL
        self.before = initial
        # Initials outside the grammar are alike to it.
        self.initials.append(ord(initial) if initial in ("s", "u", "a") else ord("?"))
        self.faults.append(fault)
        if self.held is not None:
            self.held.append((role, text))
            self.size += len(role) + len(text)
            if len(self.held) > self.most_turns or self.size > HELD_BYTES:
                self.held = None

    def row(self) -> tuple:
        initials, faults = self.initials.decode(), bytes(self.faults)
        cost, audit = align(initials, faults)
        digest = None
        if self.held is not None:
            digest = hashlib.sha256("\n".join(f"{role}:{text}" for role, text in repaired(iter(self.held), audit)).encode()).hexdigest()
        gaps = 0 if self.high is None else self.high - self.low + 1 - self.distinct
        return (self.key, gaps, faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT), self.illegal, cost, audit, digest)


_LONGS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _examined(batches: Iterator[pa.RecordBatch], most_turns: int) -> Iterator[pa.RecordBatch]:
    now, out, kind, names = None, [], None, ["c", *_LONGS, "audit", "repaired_sha256"]

    def batch_of(rows):
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *[pa.array(x, pa.int64()) for x in columns[1:7]],
                                           *[pa.array(x, pa.string()) for x in columns[7:]]], names=names)

    for batch in batches:
        kind = batch.schema.field("c").type
        for c, t, role, text, gone in zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True):
            if now is None or c != now.key:
                if now is not None:
                    out.append(now.row())
                    if len(out) >= 1000:
                        yield batch_of(out)
                        out = []
                now = _Conversation(c, most_turns)
            if not gone:
                now.add(t, role, text)
    if now is not None:
        yield batch_of([*out, now.row()])


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(id, role, text) of the repaired turns, and (id, None, None) behind the last of a conversation.

    Rows are (id, audit, role, text) in order: a conversation's audit stands in front of its turns.
    """
    key, moves, at, wanted = None, None, 0, "u"
    end = [(None, "", None, None)]
    for c, audit, role, text in chain((r for batch in batches for r in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True)), end):
        turn = audit is None
        while moves is not None and at < len(moves) and (turn or moves[at] == "I"):
            move = moves[at]
            at += 1
            if move != "D":
                kept = role if move == "K" else ROLES[wanted]
                yield key, kept, "" if move == "I" else text
                wanted = "a" if kept[:1] == "u" else "u"
            if move != "I":
                break
        if not turn:
            if moves is not None:
                yield key, None, None
            key, moves, at, wanted = c, audit, 0, "u"


def _hashed(batches: Iterator[pa.RecordBatch], shape: pa.Schema) -> Iterator[pa.RecordBatch]:
    digest, any_turn = hashlib.sha256(), False
    for c, role, text in _written(batches):
        if role is not None:
            digest.update((b"\n" if any_turn else b"") + f"{role}:{text}".encode())
            any_turn = True
        else:
            yield pa.RecordBatch.from_pylist([{"c": c, "sha": digest.hexdigest()}], shape)
            digest, any_turn = hashlib.sha256(), False


def _with_audits(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """Columns c, audit, role, text: the audit of each conversation in front of its turns. ``audits`` has columns k and moves."""
    heads = audits.select(F.col("k").alias("c"), F.col("moves").alias("audit"), F.lit(False).alias("turn"), F.lit(None).cast("bigint").alias("t"),
                          F.lit("").alias("role"), F.lit("").alias("text"))
    body = turns.where("not gone").join(audits, F.col("c").eqNullSafe(F.col("k")), "left_semi").select(
        "c", F.lit(None).cast("string").alias("audit"), F.lit(True).alias("turn"), "t", "role", "text")
    return (heads.union(body).repartition("c").sortWithinPartitions(F.asc_nulls_first("c"), "turn", F.asc_nulls_first("t"), "role", "text")
            .select("c", "audit", "role", "text"))


def repair(turns: DataFrame, conv_col: str = "conv_id", held_turns: int = HELD_TURNS) -> DataFrame:
    """One row for each conversation of ``turns`` (``damage`` or ``as_turns``), also where all its turns are gone: the id, gaps, blank,
    duplicate, truncated, illegal, cost, audit and repaired_sha256."""
    kind = turns.schema["c"].dataType.simpleString()
    order = [F.asc_nulls_first("c"), F.asc_nulls_first("t"), "role", "text"]
    found = (turns.repartition("c").sortWithinPartitions(*order).select("c", "t", "role", "text", "gone")
             .mapInArrow(lambda batches: _examined(batches, held_turns), f"c {kind}, {', '.join(f'{x} bigint' for x in _LONGS)}, audit string, repaired_sha256 string"))
    found = checkpoint(found)
    long = found.where("repaired_sha256 is null").select(F.col("c").alias("k"), F.col("audit").alias("moves"))
    shape = pa.schema([("c", to_arrow_type(turns.schema["c"].dataType)), ("sha", pa.string())])
    digests = _with_audits(turns, long).mapInArrow(lambda batches: _hashed(batches, shape), f"c {kind}, sha string").withColumnRenamed("c", "k")
    # Few or no rows: only conversations beyond the held bounds.
    out = found.join(digests, F.col("c").eqNullSafe(F.col("k")), "left")
    return out.select(F.col("c").alias(conv_col), *_LONGS, "audit", F.coalesce("repaired_sha256", "sha").alias("repaired_sha256"))


def repaired_turns(turns: DataFrame, repairs: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """The repaired turns themselves: the id, position from 0, role and text. ``repairs`` comes from ``repair`` of the same turns."""
    kind = turns.schema["c"].dataType.simpleString()
    shape = pa.schema([("c", to_arrow_type(turns.schema["c"].dataType)), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, at = [], 0
        for c, role, text in _written(batches):
            if role is None:
                at = 0
                continue
            rows.append({"c": c, "position": at, "role": role, "text": text})
            at += 1
            if len(rows) == 1000:
                yield pa.RecordBatch.from_pylist(rows, shape)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, shape)

    audits = repairs.select(F.col(conv_col).alias("k"), F.col("audit").alias("moves"))
    return _with_audits(turns, audits).mapInArrow(write, f"c {kind}, position bigint, role string, text string").withColumnRenamed("c", conv_col)
