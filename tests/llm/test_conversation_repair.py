import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from wattloom.llm.conversation_repair import Automaton, _kind, damage, repair_conversations

WS = " \t\n\x0b\x0c\r"
RIGHT = re.compile(r"(s?(ua)+)?")
NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        rest = text.rstrip(WS)
        if not rest:
            out.append(1)
        elif (role, text) in seen:
            out.append(2)
        else:
            out.append(0 if rest[-1] in ".!?" else 3)
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """Best-first search over whole edit strings, so that the least string of the least cost comes first."""
    heap, best = [(0, "", 0, (), "")], {}
    while heap:
        cost, audit, i, lines, initials = heapq.heappop(heap)
        if i == len(rows) and RIGHT.fullmatch(initials):
            return cost, audit, lines
        tail = initials[-1:]
        if best.get((i, tail)) is not None and best[i, tail] <= (cost, audit):
            continue
        best[i, tail] = cost, audit
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 5, audit + "I", i, (*lines, f"{role}:"), initials + role[0])) if viable(initials + role[0]) else None
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, lines, initials))
            if found[i] in (0, 3):
                extra = 5 if found[i] == 3 else 0
                if viable(initials + role[:1]):
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, (*lines, f"{role}:{text}"), initials + role[:1]))
                for to in ("user", "assistant"):
                    if viable(initials + to[0]):
                        heapq.heappush(heap, (cost + extra + 1, audit + "R", i + 1, (*lines, f"{to}:{text}"), initials + to[0]))


def viable(initials):
    return re.fullmatch(r"s?(ua)*u?", initials) is not None


def brute(rows):
    """rows: (turn, role, text) of one conversation in order."""
    found = faults(rows)
    cost, audit, lines = cheapest(rows, found)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return gaps, found.count(1), found.count(2), found.count(3), illegal, cost, audit, sha


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(hit, text)
        role = "user" if hit == 4 else role
        out += [(conv, turn, role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    return out


def check(spark, rows, **settings):
    df = spark.createDataFrame([(*r, 1, True) for r in rows], "conv_id long, turn long, role string, text string, at int, fault boolean").repartition(3)
    got = {r["conv_id"]: tuple(r[n] for n in NAMES) for r in repair_conversations(damage(df), **settings).collect()}
    groups = {r[0]: [] for r in rows}
    for conv, turn, role, text in damaged(rows):
        groups[conv].append((turn, role, text))
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        assert got[conv] == brute(own), (conv, own)
    assert len(got) == len(groups)


def conversations(rng, n, longest):
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \n", "Done.\t", "end. x", None, "Ünï."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]
    rows = []
    for conv in range(n):
        turn = 0
        for _ in range(rng.randrange(1, longest)):
            rows.append((conv, turn if rng.random() < 0.95 else None, rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"Text {rng.random()}."))
            turn += rng.choice([1, 1, 1, 2, 5])
    return rows


def test_against_search(spark):
    rng = random.Random(1)
    rows = conversations(rng, 150, 8)
    rows += [(None, 1, "user", "A."), (None, 2, "assistant", "B."), (1000, None, None, None), (1001, 3, "user", "x" * 50_000 + "."), (1002, 5, "system", "Only.")]
    check(spark, rows)
    assert repair_conversations(damage(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


@pytest.mark.parametrize("most", [0, 3])
def test_streams_give_the_same(spark, most):
    check(spark, conversations(random.Random(7), 60, 9), most_rows=most)


def test_one_hot_conversation_over_many_tasks(spark):
    rng = random.Random(5)
    rows = [(None, i, rng.choice(["user", "assistant"]), f"Say {i}." if i % 7 else "Same.") for i in range(400)] + [(i % 9, i, "user", f"A {i}.") for i in range(60)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check(spark, rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_few_deterministic_states():
    rng, automaton = random.Random(3), Automaton()
    for _ in range(300):
        automaton.scan([_kind(rng.choice(["s", "u", "a", "x", ""]), rng.randrange(4)) for _ in range(50)])
    assert len(automaton.vectors) < 200
    assert all(min(v) == 0 for v in automaton.vectors)
