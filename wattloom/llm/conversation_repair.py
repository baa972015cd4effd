"""Conversation repair by lazy weighted determinisation.

A conversation is right if its role initials read ``(s?(ua)+)?``. Edits have costs: a row is kept, gets another role or is
deleted, and an empty turn may be inserted anywhere. The cheapest repair is a shortest path in a weighted automaton over
edits with four states (nothing yet, after s, after u, after a). For the fast scan it is made deterministic as far as the
data need it: the vector of the cheapest costs from each state to the end, less its least entry, is one state of the
deterministic automaton, and a table remembers where each kind of row leads from it and what it costs. Few vectors
arise, so nearly every row is one table look-up, from the last row to the first. Going back from the first row to the last, an
arc is tight if its cost and the cost after it add up to the cost before it; of the tight edits the ASCII-least is taken.

Rows are dealt in ranges of (conversation, turn), so a conversation may hold any share of them. One that lies in one task and is
of ordinary length is repaired there. The rows of the others are written out: their first occurrences are found by a
grouping, their costs to the end by a streamed scan of one byte a row, and their repair by a streamed pass that holds one
row at a time (the digest of a whole repaired conversation is a sequence by its nature).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Edge, cut, deal

SPACE = " \t\n\x0b\x0c\r"
#: Costs of the edits, and of leaving a truncated row in.
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
NEVER = 1 << 20
#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a. The turn that may be inserted or put into a role there, and the state after it.
NEXT = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
ACCEPTS = (0, NEVER, NEVER, 0)
INITIALS = "sua"
CLEAN, TRUNCATED, BAD = 0, 1, 2


def symbol(initial: str, fault: int) -> int:
    """A kind of row: its role's initial (s, u, a, another, or none at all) and what its fault allows."""
    kind = 4 if initial == "" else INITIALS.find(initial) % 4
    return kind * 3 + fault


def _with_inserts(costs: list[int]) -> list[int]:
    """The costs to the end from each state if turns may be inserted first."""
    for _ in range(3):
        costs = [min(c, INSERT + costs[NEXT[q][1]]) for q, c in enumerate(costs)]
    return costs


def _arcs(kind: int, q: int) -> Iterator[tuple[str, int, int]]:
    """(edit, cost, state after it) of a row's edits in a state, by rising initial."""
    initial, fault = divmod(kind, 3)
    yield "D", DELETE, q
    if fault == BAD:
        return
    extra = CUT_OFF if fault == TRUNCATED else 0
    after = (1 if q == 0 else -1, 2 if q != 2 else -1, 3 if q == 2 else -1, -1, q)[initial]
    if after >= 0:
        yield "K", KEEP + extra, after
    yield "R", REROLE + extra, NEXT[q][1]


class Automaton:
    """Deterministic states are normalised cost vectors; their transitions and tight arcs are found when first asked for."""

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        self.table: dict[tuple[int, int], tuple[int, int]] = {}
        self.traces: dict[tuple[int, int, int], tuple[str, int]] = {}
        self.end = self._number(_with_inserts(list(ACCEPTS)))[0]

    def _number(self, costs: list[int]) -> tuple[int, int]:
        least = min(costs)
        vector = tuple(c - least for c in costs)
        if vector not in self.numbers:
            self.numbers[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.numbers[vector], least

    def before(self, state: int, kind: int) -> tuple[int, int]:
        """The state before a row of that kind if ``state`` is the one after it, and what all costs rise by."""
        got = self.table.get((state, kind))
        if got is None:
            after = self.vectors[state]
            got = self.table[state, kind] = self._number(_with_inserts([min(c + after[to] for _, c, to in _arcs(kind, q)) for q in range(4)]))
        return got

    def trace(self, state: int, kind: int | None, q: int) -> tuple[str, int]:
        """The ASCII-least tight edits from q through the row (None: after the last row), ``state`` being the one after it, and where they lead."""
        got = self.traces.get((state, -1 if kind is None else kind, q))
        if got is None:
            after = self.vectors[state]
            if kind is None:
                now, rise, ends = after, 0, ACCEPTS
            else:
                number, rise = self.before(state, kind)
                now = self.vectors[number]
            edits, at = "", q
            while True:
                arcs = [("", ends[at], -1)] if kind is None else [(e, c + after[to], to) for e, c, to in _arcs(kind, at)]
                arcs.append(("I", INSERT + rise + now[NEXT[at][1]], -2))
                edit, _, to = min((a for a in arcs if a[1] == rise + now[at]), key=lambda a: a[0])
                edits += edit
                if to == -2:
                    at = NEXT[at][1]
                    continue
                break
            got = self.traces[state, -1 if kind is None else kind, q] = edits, at if to == -1 else to
        return got

    def scan(self, kinds: list[int]) -> tuple[list[int], int]:
        """The state after each row, and the cost of the cheapest repair of all."""
        state, cost = self.end, 0
        states = [0] * len(kinds)
        for i in range(len(kinds) - 1, -1, -1):
            states[i] = state
            state, rise = self.before(state, kinds[i])
            cost += rise
        return states, cost + self.vectors[state][0]


def _lines(edits: str, q: int, role: str, text: str) -> Iterator[str]:
    """The lines that the edits of one row leave."""
    for e in edits:
        if e == "K":
            yield f"{role}:{text}"
        elif e in "RI":
            to, q = NEXT[q]
            yield f"{to}:{text if e == 'R' else ''}"


class Repair:
    """The repair of one conversation, row by row in order: counts, audit and digest."""

    def __init__(self, automaton: Automaton):
        self.automaton, self.q, self.audit, self.sha, self.some = automaton, 0, [], hashlib.sha256(), False
        self.counts, self.illegal, self.former = [0, 0, 0], 0, None
        self.low = self.high = self.turn = None
        self.turns = 0

    def row(self, state: int, kind: int, fault: int, turn: int | None, role: str, text: str) -> list[str]:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.turn
            self.high = self.turn = turn
        if fault:
            self.counts[fault - 1] += 1
        if self.former is not None:
            self.illegal += self.former + role[:1] not in ("su", "ua", "au")
        self.former = role[:1]
        edits, q = self.automaton.trace(state, kind, self.q)
        return self._take(edits, q, role, text)

    def _take(self, edits: str, q: int, role: str, text: str) -> list[str]:
        lines = list(_lines(edits, self.q, role, text))
        for line in lines:
            self.sha.update(("\n" if self.some else "").encode() + line.encode())
            self.some = True
        self.audit.append(edits)
        self.q = q
        return lines

    def close(self, cost: int) -> dict:
        self._take(*self.automaton.trace(self.automaton.end, None, self.q), "", "")
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        blank, duplicate, truncated = self.counts
        return {"gaps": gaps, "blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": self.illegal, "cost": cost, "audit": "".join(self.audit), "repaired_sha256": self.sha.hexdigest()}


_RESULT = {"conv_id": pa.int64(), "gaps": pa.int64(), "blank": pa.int64(), "duplicate": pa.int64(), "truncated": pa.int64(), "illegal": pa.int64(), "cost": pa.int64(), "audit": pa.string(), "repaired_sha256": pa.string()}
_RESULT_SQL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_ROW = {"at": pa.int64(), "turn": pa.int64(), "role": pa.string(), "text": pa.string(), "fault": pa.int32(), "gone": pa.bool_()}
_ROW_SQL = "at long, turn long, role string, text string, fault int, gone boolean"


def _kind(role: str, fault: int) -> int:
    return symbol(role[:1], BAD if fault in (1, 2) else TRUNCATED if fault == 3 else CLEAN)


def _batch(rows: list[dict], types: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in types.items()], names=list(types))


class _Row(NamedTuple):
    at: int
    turn: int | None
    role: str
    text: str
    fault: int  # 0, 1 blank, 3 truncated; 2, a duplicate, is found below
    gone: bool  # the damage dropped it


def _repair_local(edges: dict[int, Edge], spread: set[int], most_rows: int, most_bytes: int):
    """The task of a partition: results of the conversations that it has whole, rows of the others."""

    def run(batches):
        automaton, out = Automaton(), []
        held: list[_Row] = []
        now: dict = {"key": None, "long": False, "bytes": 0, "fresh": True, "seen": 0}
        here = None

        def finish() -> None:
            if now["fresh"] or now["long"]:
                return
            seen, rows = set(), []
            for r in held:
                if not r.gone:
                    fault = r.fault
                    if fault != 1:
                        if (r.role, r.text) in seen:
                            fault = 2
                        seen.add((r.role, r.text))
                    rows.append((_kind(r.role, fault), fault, r.turn, r.role, r.text))
            states, cost = automaton.scan([r[0] for r in rows])
            repair = Repair(automaton)
            for state, row in zip(states, rows, strict=True):
                repair.row(state, *row)
            out.append({"conv_id": now["key"], **repair.close(cost)})
            held.clear()

        def spill() -> None:
            out.extend({"conv_id": now["key"], **r._asdict()} for r in held)
            held.clear()

        for batch in batches:
            cols = [batch.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text", "fault", "gone", "pid")]
            for key, turn, role, text, fault, gone, pid in zip(*cols, strict=True):
                here = pid
                if now["fresh"] or key != now["key"]:
                    finish()
                    before = edges[pid].before if now["fresh"] else 0
                    now = {"key": key, "long": before > 0, "bytes": 0, "fresh": False, "seen": before}
                held.append(_Row(now["seen"], turn, role, text, fault, gone))
                now["seen"] += 1
                now["bytes"] += len(text)
                if not now["long"] and (len(held) > most_rows or len(held) > 1 and now["bytes"] > most_bytes):
                    now["long"] = True
                if now["long"]:
                    spill()
            if len(out) >= 512:
                yield _batch(out, _RESULT | _ROW)
                out.clear()
        if here in spread:  # the last conversation goes on in the next partition
            now["long"] = True
            spill()
        finish()
        yield _batch(out, _RESULT | _ROW)

    return run


def _scan_long(batches):
    """From the last row to the first: the state after each row, and at the first one the cost of the whole."""
    automaton = Automaton()
    key, state, cost, fresh = None, 0, 0, True
    for batch in batches:
        out = []
        for conv, at, kind, first in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "at", "kind", "first")), strict=True):
            if fresh or conv != key:
                key, state, cost, fresh = conv, automaton.end, 0, False
            out.append({"conv_id": conv, "at": at, "vector": list(automaton.vectors[state])})
            state, rise = automaton.before(state, kind)
            cost += rise
            out[-1]["cost"] = cost + automaton.vectors[state][0] if first else None
        yield _batch(out, {"conv_id": pa.int64(), "at": pa.int64(), "vector": pa.list_(pa.int32()), "cost": pa.int64()})


def _repair_long(batches):
    """From the first row to the last, one row at a time."""
    automaton = Automaton()
    repair, key, cost = None, None, 0
    names = ("conv_id", "vector", "cost", "turn", "role", "text", "fault")
    for batch in batches:
        out = []
        for conv, vector, whole, turn, role, text, fault in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
            if repair is None or conv != key:
                if repair:
                    out.append({"conv_id": key, **repair.close(cost)})
                repair, key, cost = Repair(automaton), conv, whole
            repair.row(automaton._number(vector)[0], _kind(role, fault), fault, turn, role, text)
        yield _batch(out, _RESULT)
    yield _batch([{"conv_id": key, **repair.close(cost)}] if repair else [], _RESULT)


def _repair_spread(rows: DataFrame) -> DataFrame:
    """Results of the conversations that no task has whole."""
    there = rows.where(~F.col("gone"))
    same = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    firsts = there.where("fault <> 1").groupBy("conv_id", same.alias("same")).agg(F.min("at").alias("at")).select("conv_id", "at", F.lit(True).alias("new"))
    joined = there.alias("r").join(firsts.alias("f"), F.col("r.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("r.at") == F.col("f.at")), "left")
    fault = F.when((F.col("r.fault") != 1) & F.col("f.new").isNull(), F.lit(2)).otherwise(F.col("r.fault"))
    judged = cut(joined.select("r.conv_id", "r.at", "r.turn", "r.role", "r.text", fault.cast("int").alias("fault")))
    initial, hard = F.substring("role", 1, 1), F.when(F.col("fault").isin(1, 2), BAD).when(F.col("fault") == 3, TRUNCATED).otherwise(CLEAN)
    kind = F.when(initial == "", 4).when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3) * 3 + hard
    least = judged.groupBy("conv_id").agg(F.min("at").alias("least"))
    light = judged.alias("j").join(least.alias("l"), F.col("j.conv_id").eqNullSafe(F.col("l.conv_id")))
    light = light.select("j.conv_id", "j.at", kind.cast("int").alias("kind"), (F.col("j.at") == F.col("l.least")).alias("first"))
    light = light.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("at"))
    scanned = cut(light.mapInArrow(_scan_long, "conv_id long, at long, vector array<int>, cost long"))
    both = judged.alias("j").join(scanned.alias("s"), F.col("j.conv_id").eqNullSafe(F.col("s.conv_id")) & (F.col("j.at") == F.col("s.at")))
    both = both.select("j.conv_id", "j.at", "s.vector", "s.cost", "j.turn", "j.role", "j.text", "j.fault")
    done = both.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(_repair_long, _RESULT_SQL)
    lost = rows.groupBy("conv_id").agg(F.bool_and("gone").alias("all")).where("all").select("conv_id", *[F.lit(0).cast("long").alias(n) for n in list(_RESULT)[1:7]], F.lit("").alias("audit"), F.sha2(F.lit(""), 256).alias("repaired_sha256"))
    return done.unionByName(lost)


def repair_conversations(rows: DataFrame, most_rows: int = 8192, most_bytes: int = 16 << 20) -> DataFrame:
    """One row per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    ``rows`` has conv_id, turn, role, text and, if wanted, ``gone`` (the row is no more, but its conversation is named all the same).
    A null role or text is one space. Rows go by turn, null turns first; rows of one turn by role, by the first 64 characters of
    the text, by a hash of it. A null conv_id is a conversation like others. An empty role has no initial, so keeping its row
    leads from any state to the same one. Texts of any length are read whole. A conversation of more than ``most_rows`` rows or
    ``most_bytes`` characters, or one that lies on several tasks, is repaired in streams. Other columns are not read.
    An empty table gives no rows.
    """
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), gone.alias("gone"))
    rest = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(rest == "", 1).when(~F.substring(rest, -1, 1).isin(".", "!", "?"), 3).otherwise(0).cast("int")
    ties = [F.substring("role", 1, 64).alias("_role"), F.substring("text", 1, 64).alias("_text"), F.xxhash64("role", "text").alias("_hash")]
    dealt, edges = deal(rows.select("*", fault.alias("fault"), *ties), "conv_id", ["turn", "_role", "_text", "_hash"])
    pids = sorted(edges)
    spread = {a for a, b in zip(pids, pids[1:], strict=False) if edges[b].before}
    names = ["conv_id", "turn", "role", "text", "fault", "gone", "pid"]
    out = cut(dealt.select(*names).mapInArrow(_repair_local(edges, spread, most_rows, most_bytes), f"{_RESULT_SQL}, {_ROW_SQL}"))
    done = out.where("at is null").select(*_RESULT)
    long = out.where("at is not null").select("conv_id", *_ROW)
    return done.unionByName(_repair_spread(long)) if not long.isEmpty() else done


def damage(rows: DataFrame) -> DataFrame:
    """Rows with seeded faults: of crc32(`conv_id:turn`) % 20, 0 drops (``gone``), 1 empties the text, 2 takes its .!? out, 3 repeats the row, 4 makes the role user.

    Nulls are one space in role and text and in the hashed name; a null turn stays null.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit: Column = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(hit == 1, "").when(hit == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    role = F.when(hit == 4, "user").otherwise(space("role"))
    twice = F.explode(F.when(hit == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (hit == 0).alias("gone"), twice.alias("_copy")).drop("_copy")
