"""Conversation structure repair: turns aligned to the grammar's strings with the cheapest edits.

A conversation is in order if the initials of its roles read ``(s?(ua)+)?``: an
optional system turn, then user and assistant in turns. For each length there
is one such string with and one without s, so repair is alignment: the turns
against a string of the grammar, by the edits Keep (0), Rerole (2, to user or
assistant), Delete (3) and Insert (2, an empty user or assistant turn). Blank and
duplicate turns must be deleted; a truncated turn that stays adds 1. Of the
cheapest edits the audit (the edits' initials in order) that is least in ASCII
order counts; D < I < K < R.

Method: Wagner-Fischer alignment to each feasible length, the nearest to the
number of turns that may stay first. The best cost so far bounds the lengths
(each turn more or less costs an insertion or a deletion) and, as Ukkonen's
band, the cells of each table: a cell is left out when the turns and places on
both sides of it cannot be brought together for that cost. The audits of equal
cost are traced back and compared.

Long conversations: the rows are ranged by conversation and turn, so a
conversation may lie on many tasks, and each task aligns stretches of at most
``stretch`` turns. A stretch starts and ends in one of four states (nothing yet;
after s; user next; assistant next). Per pair of states it keeps the least cost
and audit, aligned to each feasible length of the string from the one state to
the other. An insertion stands before a turn of its stretch, or at the
conversation's end; so of two audits of one stretch neither is the beginning of
the other, and choosing, from the first stretch on, the least audit among those
on a cheapest way gives the least audit of the whole.

The repaired turns are hashed in order as they stream past in a last pass, one
row at a time; a SHA-256 has no other order. Held for one conversation at a time
are its stretches' audits, a few bytes a turn, which the result holds as well.

Order and defined cases: rows are taken by turn, nulls first, then role and the
hash of role and text; equal rows lie next to each other, and all but the first
are duplicates.
Null roles and texts count as one space. A role without a first letter fits no
place. A null conv_id is a conversation. A conversation whose rows are all
dropped has zeros, an empty audit and the hash of the empty string. Further
columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from abode.llm.common import WHITE_SPACE, Scratch

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
FAR = 1 << 60
#: States between turns: nothing yet, after s, user next, assistant next.
BEGIN, SYSTEM, USER_NEXT, ASSISTANT_NEXT = range(4)
#: Cost and audit of ending a conversation in each state.
CLOSING = ((0, ""), (2 * INSERT, "II"), (0, ""), (INSERT, "I"))


@dataclass(frozen=True)
class Settings:
    stretch: int = 16


# --- alignment of one stretch -------------------------------------------------

def _place(kind: str, j: int) -> str:
    """Letter j of the string that starts with system, user or assistant."""
    if kind == "s":
        return "s" if j == 0 else "ua"[(j - 1) % 2]
    return "ua"[(j + (kind == "a")) % 2]


def _ends_in(kind: str, length: int) -> int:
    last = _place(kind, length - 1)
    return {"s": SYSTEM, "u": ASSISTANT_NEXT, "a": USER_NEXT}[last]


def aligned(turns: str, kind: str, length: int, most: int) -> tuple[int, str] | None:
    """Least (cost, audit) of ``turns`` aligned to ``length`` letters, None above ``most``.

    ``turns``: two characters a turn, the role's initial and its fault: ``-``,
    ``t`` (truncated) or ``x`` (must be deleted).
    """
    n = len(turns) // 2
    must = [turns[2 * i + 1] == "x" for i in range(n)]
    free = [0] * (n + 1)                       # turns from i on that may stay
    for i in range(n - 1, -1, -1):
        free[i] = free[i + 1] + (not must[i])
    forced = DELETE * sum(must)
    wide = length + 1
    rows = [[FAR] * wide for _ in range(n + 1)]
    rows[n][length] = 0                        # an insertion stands before a turn of the stretch
    for i in range(n - 1, -1, -1):
        letter, fault = turns[2 * i], turns[2 * i + 1]
        extra = TRUNCATED if fault == "t" else 0
        now, after = rows[i], rows[i + 1]
        before = free[0] - free[i]
        for j in range(length, -1, -1):
            # Ukkonen's band: surplus turns are deleted, surplus places inserted, before and after the cell
            ahead, behind = j - before, (length - j) - free[i]
            least = forced + (INSERT * ahead if ahead > 0 else -DELETE * ahead) + (INSERT * behind if behind > 0 else -DELETE * behind)
            if least > most:
                continue
            best = after[j] + DELETE
            if j < length:
                if fault != "x":
                    place = _place(kind, j)
                    if letter == place:
                        best = min(best, after[j + 1] + KEEP + extra)
                    elif place != "s":
                        best = min(best, after[j + 1] + REROLE + extra)
                best = min(best, now[j + 1] + INSERT)
            now[j] = best
    if rows[0][0] > most:
        return None
    audit, i, j = [], 0, 0
    while i < n:
        cost, letter, fault = rows[i][j], turns[2 * i], turns[2 * i + 1]
        extra = TRUNCATED if fault == "t" else 0
        if rows[i + 1][j] + DELETE == cost:
            audit.append("D")
            i += 1
        elif j < length and rows[i][j + 1] + INSERT == cost:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if letter == _place(kind, j) else "R")
            i, j = i + 1, j + 1
    return rows[0][0], "".join(audit)


def _nearest(turns: str, kind: str, end: int) -> tuple[int, str] | None:
    """Least (cost, audit) over all lengths of the string of ``kind`` that end in state ``end``."""
    n = len(turns) // 2
    free = sum(turns[2 * i + 1] != "x" for i in range(n))

    def least(length: int) -> int:
        off = length - free
        return DELETE * (n - free) + (INSERT * off if off > 0 else -DELETE * off)
    best = None
    # of four insertions before one turn two could be left out: no cheapest string is longer
    for length in sorted((k for k in range(1, 4 * n + 3) if _ends_in(kind, k) == end), key=least):
        most = FAR // 2 if best is None else best[0]
        if least(length) > most:
            break
        got = aligned(turns, kind, length, most)
        if got is not None and (best is None or got < best):
            best = got
    return best


@lru_cache(maxsize=1 << 16)
def stretch_audits(turns: str) -> tuple[tuple[tuple[int, str] | None, ...], ...]:
    """[start state][end state] -> least (cost, audit), or None where no string leads."""
    n = len(turns) // 2
    nothing = (DELETE * n, "D" * n)
    found = {(kind, end): _nearest(turns, kind, end) for kind in "ua" for end in (USER_NEXT, ASSISTANT_NEXT)}
    if any(turns[2 * i] == "s" and turns[2 * i + 1] != "x" for i in range(n)):
        found |= {("s", end): _nearest(turns, "s", end) for end in (SYSTEM, USER_NEXT, ASSISTANT_NEXT)}
    kinds = {BEGIN: "us", SYSTEM: "u", USER_NEXT: "u", ASSISTANT_NEXT: "a"}
    return tuple(tuple(min((got for got in [nothing if start == end else None, *(found.get((k, end)) for k in kinds[start])]
                            if got is not None), default=None)
                       for end in range(4)) for start in range(4))


def joined_audit(stretches: list[list[list[tuple[int, str] | None]]]) -> tuple[int, str]:
    """Least (cost, audit) of a conversation from its stretches in order."""
    to_go = [[c for c, _ in CLOSING]]
    for table in reversed(stretches):
        after = to_go[-1]
        to_go.append([min((got[0] + after[e] for e, got in enumerate(row) if got is not None), default=FAR) for row in table])
    to_go.reverse()
    state, audit = BEGIN, []
    for k, table in enumerate(stretches):
        letters, state = min((got[1], e) for e, got in enumerate(table[state])
                             if got is not None and got[0] + to_go[k + 1][e] == to_go[k][state])
        audit.append(letters)
    return to_go[0][BEGIN], "".join(audit) + CLOSING[state][1]


# --- rows ---------------------------------------------------------------------

def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: rows after damage by the crc32 of ``conv_id:turn`` mod 20 (0 copies: dropped)."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind, text = F.crc32(key.cast("binary")) % 20, F.coalesce("text", space)
    return conversations.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def intact(conversations: DataFrame) -> DataFrame:
    """The rows as they are, in the form of ``damaged``."""
    space = F.lit(" ")
    return conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
                                F.lit(1).alias("copies"))


def _body() -> Column:
    """128-bit key of role and text."""
    return F.unhex(F.md5(F.concat(F.col("role"), F.lit("\0"), F.col("text")).cast("binary")))


def faulty_turns(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, turn, role, body, copies, initial, fault (b, t or -), first: rows without their texts, equal rows once.

    ``first``: no earlier row of the conversation has the role and text.
    """
    last = F.substring(F.rtrim(F.col("text"), F.lit(WHITE_SPACE)), -1, 1)
    fault = F.when(last == "", "b").when(last.isin(".", "!", "?"), "-").otherwise("t")
    turns = rows.filter("copies > 0").select(
        "conv_id", "turn", "role", _body().alias("body"), "copies", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))
    turns = turns.groupBy("conv_id", "turn", "role", "body", "initial", "fault").agg(F.sum("copies").alias("copies"))
    turns = scratch.write(turns, "turns")
    # written: a join that shuffles both sides can be split where a conversation repeats one text
    firsts = scratch.write(turns.groupBy("conv_id", "body").agg(F.min(F.struct("turn")).alias("at")), "firsts")
    firsts = firsts.select(F.col("conv_id").alias("c"), F.col("body").alias("b"), "at")
    return turns.join(firsts, turns["conv_id"].eqNullSafe(firsts["c"]) & (turns["body"] == firsts["b"])) \
        .select("conv_id", "turn", "role", "body", "copies", "initial", "fault", F.col("turn").eqNullSafe(F.col("at.turn")).alias("first"))


@dataclass
class _Stretch:
    conv: object
    turns: list[str] = field(default_factory=list)
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    distinct: int = 0
    first_initial: str = ""
    last_initial: str = ""
    low: int | None = None
    high: int | None = None

    def add(self, turn: int | None, initial: str, fault: str) -> None:
        """One row; ``fault``: b, d, t or -."""
        if not self.turns:
            self.first_initial = initial
        elif self.last_initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last_initial = initial
        self.blank += fault == "b"
        self.duplicate += fault == "d"
        self.truncated += fault == "t"
        # one character a role; an empty role or an astral one fits no place
        self.turns.append((initial if initial in ("s", "u", "a") else "?") + ("x" if fault in "bd" else fault))
        if turn is not None and turn != self.high:
            self.distinct += 1
            self.low = turn if self.low is None else self.low
            self.high = turn

    def row(self) -> tuple:
        audits = stretch_audits("".join(self.turns))
        costs = [-1 if got is None else got[0] for row in audits for got in row]
        return (self.conv, self.blank, self.duplicate, self.truncated, self.illegal, self.distinct, self.first_initial,
                self.last_initial, self.low, self.high, costs, ["" if got is None else got[1] for row in audits for got in row])


_STRETCH = ["blank long", "duplicate long", "truncated long", "illegal long", "distinct_turns long", "first_initial string",
            "last_initial string", "low long", "high long", "costs array<long>", "audits array<string>"]


def stretches(turns: DataFrame, settings: Settings) -> DataFrame:
    """Summaries of stretches of turns, ``part`` and ``number`` in their order.

    The rows are ranged by conversation and turn: a long conversation lies on
    several tasks, each of which reads its share in order.
    """
    schema = f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, {', '.join(_STRETCH)}, part int, number long"
    wanted = _arrow(schema)
    order = ["conv_id", "turn", "role", "body"]
    ranged = turns.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done, number, part = None, [], 0, 0
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "fault", "first", "copies", "part")]
            for conv, turn, initial, fault, first, copies, part in zip(*cols):
                for k in range(copies):
                    if now is None or now.conv != conv or len(now.turns) >= settings.stretch:
                        if now is not None:
                            done.append((*now.row(), part, number))
                            number += 1
                        now = _Stretch(conv)
                    now.add(turn, initial, fault if fault == "b" else "d" if k or not first else fault)
            if done:
                yield _table(done, wanted)
                done = []
        if now is not None:
            done.append((*now.row(), part, number))
        if done:
            yield _table(done, wanted)
    return ranged.select("conv_id", "turn", "initial", "fault", "first", "copies", "part").mapInArrow(made, schema)


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def _table(rows: list[tuple], wanted: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), wanted)], names=wanted.names)


class _Conversation:
    """Streams one conversation: first its stretches, then its rows in order."""

    def __init__(self, conv: object):
        self.conv, self.stretches, self.audit, self.cost = conv, [], None, 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.low = self.high = None
        self.last = None
        self.at = 0
        self.hash, self.any = hashlib.sha256(), False
        self.parity_s = False
        self.out = 0

    def add_stretch(self, r: dict) -> None:
        if self.last is not None and self.last + r["first_initial"] not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = r["last_initial"]
        self.blank += r["blank"]
        self.duplicate += r["duplicate"]
        self.truncated += r["truncated"]
        self.illegal += r["illegal"]
        if r["low"] is not None:
            self.distinct += r["distinct_turns"] - (self.high is not None and self.high == r["low"])
            self.low = r["low"] if self.low is None else self.low
            self.high = r["high"]
        c, a = r["costs"], r["audits"]
        self.stretches.append([[None if c[4 * s + e] < 0 else (c[4 * s + e], a[4 * s + e]) for e in range(4)] for s in range(4)])

    def settle(self) -> None:
        if self.audit is None:
            self.cost, self.audit = joined_audit(self.stretches)
            self.stretches = []
            places = sum(x != "D" for x in self.audit)
            self.parity_s = places % 2 == 1

    def _role(self) -> str:
        """Role at the next place of the repaired conversation."""
        j = self.out - self.parity_s
        return ("user", "assistant")[j % 2]

    def _emit(self, role: str, text: str) -> None:
        if self.any:
            self.hash.update(b"\n")
        self.hash.update(f"{role}:{text}".encode())
        self.any, self.out = True, self.out + 1

    def _insertions(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._emit(self._role(), "")
            self.at += 1

    def add_row(self, role: str, text: str) -> None:
        self.settle()
        self._insertions()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self._emit(role if edit == "K" else self._role(), text)

    def row(self) -> tuple:
        self.settle()
        self._insertions()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return (self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, self.audit, self.hash.hexdigest())


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repaired(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per conversation of ``rows`` (as ``damaged`` or ``intact`` give them): faults, audit and the repaired hash."""
    scratch = Scratch(rows.sparkSession, "turn-repair")
    turns = scratch.write(faulty_turns(rows, scratch), "faulty")
    found = scratch.write(stretches(turns, settings), "stretches")
    names = [c for c in found.columns if c not in ("conv_id", "part", "number")]
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {_RESULT}"
    wanted = _arrow(schema)
    turn_type = rows.schema["turn"].dataType.simpleString()
    head = found.select("conv_id", F.lit(0).alias("kind"), "part", "number", F.lit(None).cast(turn_type).alias("turn"),
                        F.lit(None).cast("string").alias("role"), F.lit(None).cast("binary").alias("body"),
                        F.lit(None).cast("string").alias("text"), F.lit(0).alias("copies"), *names)
    kept = F.col("copies") > 0
    body = rows.select("conv_id", F.lit(1).alias("kind"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("number"), "turn",
                       F.when(kept, F.col("role")).alias("role"), F.when(kept, _body()).alias("body"),
                       F.when(kept, F.col("text")).alias("text"), "copies",
                       *[F.lit(None).cast(found.schema[c].dataType).alias(c) for c in names])
    order = ["conv_id", "kind", "part", "number", "turn", "role", "body"]
    stream = head.unionByName(body).repartition("conv_id").sortWithinPartitions(*order) \
        .drop("part", "number", "turn", "body")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for b in batches:
            for r in b.to_pylist():
                if now is None or now.conv != r["conv_id"]:
                    if now is not None:
                        done.append(now.row())
                    now = _Conversation(r["conv_id"])
                if r["kind"] == 0:
                    now.add_stretch(r)
                else:
                    for _ in range(r["copies"]):
                        now.add_row(r["role"], r["text"])
            if done:
                yield _table(done, wanted)
                done = []
        if now is not None:
            done.append(now.row())
        if done:
            yield _table(done, wanted)
    return stream.mapInArrow(made, schema)
