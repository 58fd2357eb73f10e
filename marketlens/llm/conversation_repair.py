"""Repair of conversations: the cheapest edits that give turns of a legal structure.

Legal are the role initials ``(s?(ua)+)?``: nothing, or pairs of user and assistant, after at most one
system turn. Edits, with their costs: Keep 0, Rerole to user or assistant 2, Delete 3 (the only one for
blank and duplicate turns), Insert an empty user or assistant turn anywhere 2; a truncated turn that is
not deleted adds 1. Of the cheapest repairs the one with the ASCII-least string of initials is taken. A
state of the structure admits one role for Rerole and Insert, so the initials tell the whole repair.

The backward costs (per state, what the rest of the turns costs) are kept at checkpoints only: one per
``BLOCK`` turns between tasks, and one per square root of a block within a task, which recomputes the
costs of one such stretch at a time while it walks forward along the edits that lose nothing.

A long conversation is many blocks, worked on by many tasks: the cost matrix of each block, backward
along the blocks the costs at their ends, each block's edits for every state it may begin in, and
forward along the blocks the state that it does begin in. What goes along the blocks of a conversation
is a row of at most two letters per turn, as a stream; and so is, in the end, the repaired text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from math import inf, isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.ordering import numbered, runs
from marketlens.llm.storage import written

#: Turns of a block.
BLOCK = 4096
#: States after the role initials so far: nothing, system, user, assistant.
STATES = range(4)
ROLES = ("", "system", "user", "assistant")
LEGAL_ENDS = (0, 3)
#: The state after a user or assistant turn that is given to a state by Rerole or Insert.
GIVEN = (2, 2, 3, 2)
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Kinds of turns: the state that its role leads to (0: none), plus these.
FAULTY, CUT_SHORT = 4, 8

Costs = tuple[float, float, float, float]


def row_edits(kind: int) -> list[list[tuple[str, int, int]]]:
    """Per state the edits of a turn, ASCII-least first: initial, cost and next state."""
    role, more = kind & 3, TRUNCATED if kind & CUT_SHORT else 0
    found = []
    for state in STATES:
        edits = [("D", DELETE, state)]
        if not kind & FAULTY:
            if role and (role == GIVEN[state] or (role == 1 and state == 0)):
                edits.append(("K", more, role))
            edits.append(("R", REROLE + more, GIVEN[state]))
        found.append(edits)
    return found


EDITS = [row_edits(kind) for kind in range(16)]


def with_inserts(costs: list[float]) -> Costs:
    """Costs per state if turns may be inserted first."""
    user, assistant = min(costs[2], INSERT + costs[3]), min(costs[3], INSERT + costs[2])
    return min(costs[0], INSERT + user), min(costs[1], INSERT + user), user, assistant


AT_THE_END = with_inserts([0 if state in LEGAL_ENDS else inf for state in STATES])


def before(kind: int, after: Costs) -> Costs:
    """Costs before a turn, given those after it."""
    return with_inserts([min(cost + after[to] for _, cost, to in EDITS[kind][state]) for state in STATES])


def cost_matrix(kinds: list[int]) -> list[float]:
    """Least costs from state to state, row by row; inserts after the last turn belong to what follows."""
    columns = []
    for end in STATES:
        costs: Costs = tuple(0 if state == end else inf for state in STATES)
        for kind in reversed(kinds):
            costs = before(kind, costs)
        columns.append(costs)
    return [columns[end][begin] for begin in STATES for end in STATES]


def cheapest_edits(kinds: list[int], after: Costs, begins: list[int], last: bool) -> list[tuple[str, int]]:
    """For each state to begin in, the ASCII-least initials of the cheapest edits, and the state they end in.

    ``after``: the costs behind the last turn; inserts there belong to this block only if it is the last.
    """
    step = isqrt(len(kinds)) + 1
    checkpoints = {}
    costs = after
    for i in range(len(kinds) - 1, -1, -1):
        costs = before(kinds[i], costs)
        if i % step == 0:
            checkpoints[i] = costs
    states, letters = list(begins), [[] for _ in begins]
    for first in range(0, len(kinds), step):
        stretch = kinds[first : first + step]
        rest = [checkpoints.get(first + step, after)]
        for kind in reversed(stretch):
            rest.append(before(kind, rest[-1]))
        rest.reverse()
        for w, state in enumerate(states):
            for kind, costs, then in zip(stretch, rest, rest[1:], strict=False):
                state = walk(kind, state, costs, then, letters[w])
            states[w] = state
    if last:
        for w, state in enumerate(states):
            while state not in LEGAL_ENDS:
                letters[w].append("I")
                state = GIVEN[state]
            states[w] = state
    return [("".join(text), state) for text, state in zip(letters, states, strict=True)]


def walk(kind: int, state: int, costs: Costs, then: Costs, letters: list[str]) -> int:
    """Take the least letters that lose nothing, up to the edit of one turn; the state behind it."""
    while True:
        delete, *others = EDITS[kind][state]
        if delete[1] + then[state] == costs[state]:
            letters.append("D")
            return state
        if INSERT + costs[GIVEN[state]] == costs[state]:
            letters.append("I")
            state = GIVEN[state]
            continue
        for letter, cost, to in others:
            if cost + then[to] == costs[state]:
                letters.append(letter)
                return to
        raise AssertionError("no edit keeps the cost")


def matrices(rows: DataFrame) -> DataFrame:
    """The cost matrix of every block but the first ones, whose beginnings need no costs."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, lambda batch: batch.column("pos").to_numpy() % BLOCK == 0):
            matrix = cost_matrix(run.column("kind").to_pylist())
            columns = {"conv": [run.column("conv")[0].as_py()], "block": [run.column("pos")[0].as_py() // BLOCK], "matrix": [matrix]}
            yield pa.RecordBatch.from_pydict(columns, schema=pa.schema([("conv", pa.string()), ("block", pa.int64()), ("matrix", pa.list_(pa.float64()))]))

    later = in_blocks(rows.where(F.col("pos") >= BLOCK).select("conv", "pos", "kind"))
    return later.mapInArrow(find, "conv string, block long, matrix array<double>")


def in_blocks(rows: DataFrame) -> DataFrame:
    dealt = rows.withColumn("block", F.expr(f"pos div {BLOCK}"))
    return dealt.repartition("conv", "block").sortWithinPartitions("conv", "pos").drop("block")


def costs_at_ends(blocks: DataFrame) -> DataFrame:
    """conv, pos (-1 with the block before) and ``after``, the costs at the end of every block that another follows."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, costs, later = False, AT_THE_END, None
        for batch in batches:
            found = []
            for conv, block, matrix in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if not known or conv != later:
                    known, costs, later = True, AT_THE_END, conv
                costs = tuple(min(matrix[4 * begin + end] + costs[end] for end in STATES) for begin in STATES)
                found.append({"conv": conv, "block": block - 1, "after": list(costs)})
            yield pa.RecordBatch.from_pylist(found, schema=pa.schema([("conv", pa.string()), ("block", pa.int64()), ("after", pa.list_(pa.float64()))]))

    back = blocks.repartition("conv").sortWithinPartitions("conv", F.desc("block"))
    return back.mapInArrow(find, "conv string, block long, after array<double>")


AUDITS = pa.schema([("conv", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("audits", pa.list_(pa.string())), ("ends", pa.list_(pa.int32()))])


def block_audits(rows: DataFrame, after: DataFrame) -> DataFrame:
    """The edits of every block, for each state that it may begin in, and the states they lead to."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for run in runs(batches, lambda batch: batch.column("head").to_numpy(zero_copy_only=False)):
            costs = run.column("after")[0].as_py()
            rows = run.slice(1 if costs else 0)
            conv, pos, n = (rows.column(name)[0].as_py() for name in ("conv", "pos", "n"))
            last = pos + len(rows) == n
            edits = cheapest_edits(rows.column("kind").to_pylist(), AT_THE_END if last else tuple(costs), [0] if pos == 0 else [*STATES], last)
            found.append({"conv": conv, "block": pos // BLOCK, "n": n, "audits": [a for a, _ in edits], "ends": [e for _, e in edits]})
            if len(found) >= 1024:
                yield pa.RecordBatch.from_pylist(found, schema=AUDITS)
                found = []
        yield pa.RecordBatch.from_pylist(found, schema=AUDITS)

    own = rows.select("conv", "pos", "n", "kind", F.expr(f"pos div {BLOCK}").alias("block"), F.lit(None).cast("array<double>").alias("after"))
    # the last block of a conversation has no row of costs, and begins with its first turn
    is_last = F.col("block") == F.expr(f"(n - 1) div {BLOCK}")
    own = own.withColumn("head", is_last & (F.col("pos") % BLOCK == 0))
    heads = after.select("conv", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("int").alias("kind"), "block", "after", F.lit(True).alias("head"))
    dealt = own.unionByName(heads).repartition("conv", "block").sortWithinPartitions("conv", "block", "pos")
    return dealt.drop("block").mapInArrow(find, "conv string, block long, n long, audits array<string>, ends array<int>")


def chosen_audits(blocks: DataFrame) -> DataFrame:
    """conv, block, audit and the state that each block begins in."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = 0
        for batch in batches:
            found = []
            for conv, block, audits, ends in zip(*(batch.column(name).to_pylist() for name in ("conv", "block", "audits", "ends")), strict=True):
                state = state if block else 0
                found.append({"conv": conv, "block": block, "audit": audits[state], "begins": state})
                state = ends[state]
            yield pa.RecordBatch.from_pylist(found, schema=pa.schema([("conv", pa.string()), ("block", pa.int64()), ("audit", pa.string()), ("begins", pa.int32())]))

    alone = blocks.where(F.col("n") <= BLOCK).select("conv", "block", F.col("audits")[0].alias("audit"), F.lit(0).alias("begins"))
    along = blocks.where(F.col("n") > BLOCK).repartition("conv").sortWithinPartitions("conv", "block")
    return alone.unionByName(along.mapInArrow(find, "conv string, block long, audit string, begins int"))


def with_faults(turns: DataFrame) -> DataFrame:
    """Numbered turns (conv, turn, role, text, pos, n) with ``fault`` (blank, duplicate, truncated or null) and ``kind``.

    A turn is a duplicate if its role and text were seen earlier in the conversation. The first of
    equal turns is found by grouping; only groups with several turns are joined back.
    """
    key = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    keyed = turns.withColumn("key", key)
    again = keyed.groupBy(F.col("conv").alias("c"), F.col("key").alias("k")).agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("copies"))
    again = again.where("copies > 1").drop("copies")
    joined = keyed.join(again, F.col("conv").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k")), "left")
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    fault = (
        F.when(blank, "blank")
        .when(F.col("pos") > F.col("first"), "duplicate")
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
    )
    role = F.coalesce(*(F.when(F.substring("role", 1, 1) == name[0], state) for state, name in enumerate(ROLES) if name), F.lit(0))
    found = joined.withColumn("fault", fault).drop("key", "c", "k", "first")
    more = F.when(F.col("fault").isin("blank", "duplicate"), FAULTY).when(F.col("fault") == "truncated", CUT_SHORT).otherwise(0)
    return found.withColumn("kind", (role + more).cast("int"))


def repaired(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The faulty turns (see ``with_faults``) and the audits of their blocks (see ``chosen_audits``), both written.

    ``turns``: conv (text), turn, role, text, without nulls in the last two. Turns are ordered by turn,
    null first, then role and text.
    """
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    rows = written(with_faults(numbered(turns.select("conv", "turn", "role", "text"), "conv", order)), "turns")
    after = costs_at_ends(written(matrices(rows), "cost-matrices"))
    return rows, written(chosen_audits(written(block_audits(rows, after), "block-audits")), "audits")


class Conversation:
    """One conversation as a stream of faulty turns and audits of blocks; a subclass collects what comes out."""

    def __init__(self, conv: str | None, pos: int):
        self.conv, self.state, self.audit, self.at = conv, 0, "", 0

    def block(self, audit: str) -> None:
        self.audit, self.at = audit, 0

    def inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.at, self.state = self.at + 1, GIVEN[self.state]
            self.put("I", ROLES[self.state], "")

    def add(self, kind: int, role: str, text: str) -> None:
        self.inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = kind & 3
        elif letter == "R":
            self.state = GIVEN[self.state]
            role = ROLES[self.state]
        self.put(letter, role, text)

    def put(self, letter: str, role: str, text: str) -> None:
        raise NotImplementedError


def streamed(rows: DataFrame, audits: DataFrame, conversations: DataFrame, key: list[str], begin: Callable, out: pa.Schema, schema: str) -> DataFrame:
    """Runs of a conversation's marker, audits and turns through ``begin(conv, pos)``, an object with ``turn``, ``block`` and ``end``.

    Dealt by ``key``. Every run begins with a marker row: those of ``conversations``.
    """
    names = ["conv", "pos", "mark", "turn", "role", "text", "fault", "kind", "audit", "begins"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, found = None, []
        for batch in batches:
            for conv, pos, mark, turn, role, text, fault, kind, audit, begins in zip(*(batch.column(name).to_pylist() for name in names), strict=True):
                if mark == 0:
                    found += current.end() if current else []
                    current = begin(conv, pos)
                elif mark == 1:
                    current.block(audit, begins)
                else:
                    found += current.turn(turn, role, text, fault, kind)
            if found:
                yield pa.RecordBatch.from_pylist(found, schema=out)
                found = []
        if current:
            yield pa.RecordBatch.from_pylist(current.end(), schema=out)

    turns = rows.withColumns({"mark": F.lit(2), "block": F.expr(f"pos div {BLOCK}")})
    edits = audits.withColumns({"mark": F.lit(1), "pos": F.col("block") * BLOCK})
    marks = conversations.withColumn("mark", F.lit(0))
    both = turns.unionByName(edits, allowMissingColumns=True).unionByName(marks, allowMissingColumns=True)
    return both.repartition(*key).sortWithinPartitions(*key, "pos", "mark").select(*names).mapInArrow(find, schema)


class Summary(Conversation):
    """Counts, cost, audit and digest of one conversation; holds nothing of its texts."""

    def __init__(self, conv: str | None, pos: int):
        super().__init__(conv, pos)
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.illegal = self.cost = self.distinct = 0
        self.least = self.most = self.initial = None
        self.audits: list[str] = []
        self.sha, self.first = hashlib.sha256(), True

    def block(self, audit: str, begins: int) -> None:
        super().block(audit)
        self.audits.append(audit)

    def put(self, letter: str, role: str, text: str) -> None:
        self.cost += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[letter]
        if letter != "D":
            self.sha.update(("" if self.first else "\n").encode() + f"{role}:{text}".encode())
            self.first = False

    def turn(self, turn: int | None, role: str, text: str, fault: str | None, kind: int) -> list:
        if turn is not None:
            self.distinct += turn != self.most
            self.least, self.most = turn if self.least is None else self.least, turn
        if fault:
            self.counts[fault] += 1
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in ("su", "ua", "au")
        self.initial = role[:1]
        self.add(kind, role, text)
        self.cost += TRUNCATED if fault == "truncated" and self.audit[self.at - 1] != "D" else 0
        return []

    def end(self) -> list[dict]:
        self.inserts()
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.distinct
        counts = {"gaps": gaps, **self.counts, "illegal": self.illegal, "cost": self.cost}
        return [{"conv": self.conv, **counts, "audit": "".join(self.audits), "repaired_sha256": self.sha.hexdigest()}]


class Turns(Conversation):
    """The turns of one block of a conversation after their edits, inserted and deleted ones included."""

    def __init__(self, conv: str | None, pos: int):
        super().__init__(conv, pos)
        self.found: list[dict] = []
        self.place = 2 * pos  # a turn has one insert before it at most, and two follow the last

    def block(self, audit: str, begins: int) -> None:
        super().block(audit)
        self.state = begins

    def put(self, letter: str, role: str, text: str) -> None:
        self.found.append({"conv": self.conv, "place": self.place, "edit": letter, "role": role, "text": text})
        self.place += 1

    def turn(self, turn: int | None, role: str, text: str, fault: str | None, kind: int) -> list:
        self.add(kind, role, text)
        return self.taken(turn, fault)

    def taken(self, turn: int | None, fault: str | None) -> list[dict]:
        """What was put since, with the turn and fault of the last."""
        found, self.found = self.found, []
        for row in found:
            row |= {"turn": None, "fault": None}
        found[-1:] = [found[-1] | {"turn": turn, "fault": fault}] if found else []
        return found

    def end(self) -> list[dict]:
        self.inserts()
        return self.taken(None, None)


def as_turns(conversations: DataFrame) -> DataFrame:
    """conv, turn, role and text of a table; null roles and texts count as one space."""
    space = F.lit(" ")
    return conversations.select(
        F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("long"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text")
    )


def audit(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """Per conversation: conv (its id as text), gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    ``turns``: conv_id, turn, role, text, anything else; ``conversations``: conv_id of all conversations
    that are reported, also those without turns (zeros, an empty audit, the digest of nothing); ids
    may repeat there. A null id is a conversation. Turns that repeat a number are ordered by role and text,
    repeated rows are duplicates. ``gaps`` are the numbers missing between the least and the largest; null numbers do
    not count. Roles are known by their first letter. The audit is one letter per turn and inserted turn.
    """
    rows, audits = repaired(as_turns(turns))
    out = pa.schema(
        [("conv", pa.string())]
        + [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        + [("audit", pa.string()), ("repaired_sha256", pa.string())]
    )
    schema = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    ids = conversations.select(F.col("conv_id").cast("string").alias("conv")).distinct()
    return streamed(rows, audits, ids.withColumn("pos", F.lit(-1).cast("long")), ["conv"], Summary, out, schema)


def repair(conversations: DataFrame) -> DataFrame:
    """The turns of ``conversations`` (conv_id, turn, role, text, anything else) with their edits, conversation by conversation:

    conv (the id as text), ``place`` (ascending in the repaired order, with gaps), ``edit`` (K, R, D or I), ``turn`` and ``fault`` of the turn
    (null for inserted ones), role and text after the edit. Deleted turns are among them, marked D. Many
    tasks work on one long conversation. Nulls, ties and repeated rows as in ``audit``.
    """
    rows, audits = repaired(as_turns(conversations))
    out = pa.schema([("conv", pa.string()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string()), ("turn", pa.int64()), ("fault", pa.string())])
    marks = audits.select("conv", "block", (F.col("block") * BLOCK).alias("pos"))
    schema = "conv string, place long, edit string, role string, text string, turn long, fault string"
    return streamed(rows, audits, marks, ["conv", "block"], Turns, out, schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """A test damage, decided by a checksum of conversation and turn (null: one space): conv_id, turn, role, text.

    Of twenty remainders, 0 drops a turn, 1 empties its text, 2 removes its full stops, question and
    exclamation marks, 3 repeats it, 4 makes it a user's.
    """
    space = F.lit(" ")
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(name.cast("binary")) % 20).alias("damage"))
    rows = rows.where("damage <> 0")
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("damage") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("damage") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")
