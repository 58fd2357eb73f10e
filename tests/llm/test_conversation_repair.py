"""Repair of conversations against an exhaustive search and a plain version of the query."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from marketlens.llm import conversation_repair, queries

SCHEMA = "conv_id long, turn long, role string, text string, pos long, kind string, block int, mark string"
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def legal(state, initial):
    return {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((initial, state))


def faults(rows):
    seen, found = set(), []
    for _, role, text in rows:
        marks = BLANK.findall(text)
        if not marks:
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        else:
            fault = None if marks[-1] in ".!?" else "truncated"
        seen.add((role, text))
        found.append(fault)
    return found


def cheapest(rows, found):
    """(cost, audit, roles and texts) by search in the order of (cost, audit): no dynamic programming."""
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if i == len(rows) and state in (0, 3):
            return cost, audit, out
        if (i, state) in done:
            continue
        done.add((i, state))
        name = "assistant" if state == 2 else "user"
        heapq.heappush(heap, (cost + 2, audit + "I", i, legal(state, name[0]), (*out, (name, ""))))
        if i == len(rows):
            continue
        _, role, text = rows[i]
        heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, out))
        if found[i] in (None, "truncated"):
            more = found[i] == "truncated"
            if legal(state, role[:1]) is not None:
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, legal(state, role[:1]), (*out, (role, text))))
            heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, legal(state, name[0]), (*out, (name, text))))


def summary(rows):
    found = faults(rows)
    cost, audit, out = cheapest(rows, found)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return gaps, *(found.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def damage(conv, turn, role, text):
    name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
    role, text, kind = " " if role is None else role, " " if text is None else text, zlib.crc32(name.encode()) % 20
    text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
    return [] if kind == 0 else [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def plain(rows):
    found = {r[0]: [] for r in rows}
    for conv, turn, role, text, *_ in rows:
        found[conv] += damage(conv, turn, role, text)
    return {conv: summary(ordered(turns)) for conv, turns in found.items()}


def random_rows(n, seed, convs=40):
    rng = random.Random(seed)
    texts = ["Hello there.", "cut short", "Why?", " \t\n", "", None, "End!  \n", "é 1", "ok."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "User"]
    rows = []
    for _ in range(n):
        conv = rng.choice([None, *range(convs)])
        rows.append((conv, rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts), 1, "k", 2, "m"))
    return rows + rows[: n // 10]


def as_found(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def query_of(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    found = conversation_repair.audit(conversation_repair.damaged(df), df)
    return found.select(F.col("conv").cast("long"), *found.columns[1:])


def test_query_equals_plain_version(spark, small_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{small_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = queries.op12_conversation_repair(spark, small_dir)
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert as_found(found) == plain(rows)


@pytest.mark.parametrize("block", [2, 5, 4096])
def test_awkward_rows_and_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(conversation_repair, "BLOCK", block)
    rows = random_rows(600, block)
    assert as_found(query_of(spark, rows)) == plain(rows)


def test_long_conversation_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(conversation_repair, "BLOCK", 64)
    rng = random.Random(3)
    rows = [(1, i, rng.choice(["user", "assistant", "system"]), f"text {rng.randint(0, 900)}" + rng.choice([".", ""]), 1, "k", 2, "m") for i in range(1500)]
    assert as_found(query_of(spark, rows)) == plain(rows)


def test_conversation_without_turns(spark):
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    found = as_found(query_of(spark, [(dropped, 0, "user", "Hello.", 1, "k", 2, "m")]))
    assert found == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert conversation_repair.audit(df, df).collect() == []
    assert conversation_repair.repair(df).collect() == []


@pytest.mark.parametrize("block", [3, 4096])
def test_repaired_turns(spark, monkeypatch, block):
    monkeypatch.setattr(conversation_repair, "BLOCK", block)
    rows = random_rows(300, 9, convs=8)
    df = spark.createDataFrame(rows, SCHEMA)
    turns = {}
    for r in conversation_repair.repair(df).orderBy("conv", "place").collect():
        turns.setdefault(r["conv"], []).append(r)
    spaced = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x, *_ in rows]
    assert {None if c is None else int(c) for c in turns} == {r[0] for r in rows}
    for conv, found in turns.items():
        own = ordered([r[1:4] for r in spaced if r[0] == (None if conv is None else int(conv))])
        seen = faults(own)
        _, audit, out = cheapest(own, seen)
        assert "".join(r["edit"] for r in found) == audit
        assert tuple((r["role"], r["text"]) for r in found if r["edit"] != "D") == out
        assert [(r["turn"], r["fault"]) for r in found if r["edit"] != "I"] == [(t[0], f) for t, f in zip(own, seen)]
        assert len({r["place"] for r in found}) == len(found)


def test_checkpoints_change_nothing():
    """Edits recomputed between checkpoints equal those of a search, for every beginning of a block."""
    rng = random.Random(1)
    for n in (0, 1, 2, 7, 30):
        rows = [(i, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["a.", "b", "c?", "", "d!"]) + str(i) * 0) for i in range(n)]
        found = faults(rows)
        kinds = [
            "0sua".find(r[:1]) % 4 * (r[:1] in "sua") + (4 if f in ("blank", "duplicate") else 8 if f else 0) for (_, r, _), f in zip(rows, found)
        ]
        (audit, state), *_ = conversation_repair.cheapest_edits(kinds, conversation_repair.AT_THE_END, [0, 1, 2, 3], True)
        assert audit == cheapest(rows, found)[1] and state in (0, 3)
