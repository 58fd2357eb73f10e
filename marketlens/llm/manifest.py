"""Merkle manifest of a dataset: every row's digest, its witness, and a root that covers all rows.

The rows of a group, in order, are the leaves of a tree of runs of eight; the group roots, in order,
are the leaves of one more tree, whose root stands for the dataset. A *witness* is what is needed to
get from a leaf to the root: the digests of its siblings, level by level.

Digests are appended to a tree one after the other. A level holds its open run; each later sibling
that completes the run extends the witnesses of all leaves below. The leaves of a group are dealt in
aligned blocks of ``BLOCK``, each a stream of such appends in one task. The root of a block with its
complete partial witnesses is appended as a leaf of the level above, where block roots are dealt in
blocks again, until a group has one root. On the way back each block gets the witness of its root and
adds it to those of its leaves. A hot group is many blocks, and the rounds grow with the logarithm of
the largest group: two for 16 million leaves, four for 2 * 10**14.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.ordering import numbered, runs
from marketlens.llm.storage import written

#: Nodes of a run, levels of a block, and the nodes of a block.
ARITY, LEVELS = 8, 4
BLOCK = ARITY**LEVELS
HEX = 64


def digest(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


def levels(n: int) -> int:
    """Levels above n nodes: runs are combined while there is more than one node."""
    count = 0
    while n > 1:
        n, count = -(-n // ARITY), count + 1
    return count


class Subtree:
    """Digests appended in order; partial witnesses grow as later siblings complete their runs."""

    def __init__(self, height: int):
        self.height, self.leaves = height, 0
        self.witnesses: list[list[str]] = []
        # per level the open run: digest, first leaf and end leaf of each node
        self.open: list[list[tuple[str, int, int]]] = [[] for _ in range(height + 1)]

    def append(self, node: str) -> None:
        self.witnesses.append([])
        self.put(0, (node, self.leaves, self.leaves + 1))
        self.leaves += 1

    def put(self, level: int, node: tuple[str, int, int]) -> None:
        self.open[level].append(node)
        if len(self.open[level]) == ARITY and level < self.height:
            self.complete(level)

    def complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        for k, (_, first, end) in enumerate(run):
            siblings = "".join(node[0] for i, node in enumerate(run) if i != k)
            for leaf in range(first, end):
                self.witnesses[leaf].append(siblings)
        self.put(level + 1, (digest("".join(node[0] for node in run).encode()), run[0][1], run[-1][2]))

    def close(self) -> str:
        """Combine what is still open, each last run as it is; the digest at the top."""
        for level in range(self.height):
            if self.open[level]:
                self.complete(level)
        return self.open[self.height][0][0]


def grown(nodes: list[str], n: int) -> Subtree:
    """The subtree over a block of a tree of n nodes."""
    tree = Subtree(min(LEVELS, levels(n)))
    for node in nodes:
        tree.append(node)
    return tree


def block_roots(nodes: DataFrame) -> DataFrame:
    """The next tree of (tree, pos, n, node): a node for each block."""

    def append(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = lambda batch: batch.column(1).to_numpy() % BLOCK == 0
        for run in runs(batches, starts):
            tree, pos, n = (run.column(i)[0].as_py() for i in range(3))
            root = grown(run.column(3).to_pylist(), n).close()
            columns = {"tree": [tree], "pos": [pos // BLOCK], "n": [-(-n // BLOCK)], "node": [root]}
            yield pa.RecordBatch.from_pydict(columns, schema=run.select(range(4)).schema)

    dealt = nodes.select("tree", "pos", "n", "node", F.expr(f"pos div {BLOCK}").alias("block"))
    in_order = dealt.repartition("tree", "block").sortWithinPartitions("tree", "pos").drop("block")
    return in_order.mapInArrow(append, "tree string, pos long, n long, node string")


#: What a block learns from above: the witness of its root, and facts about the whole.
ABOVE = {"witness": "string", "subroot": "string", "root": "string", "place": "long", "places": "long"}


def extended(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """``nodes`` (tree, pos, n, node, anything else) with the columns of ABOVE, the witnesses of their blocks extended.

    ``above``: tree, pos (the number of the block) and the columns of ABOVE.
    """
    own = nodes.columns
    names = [*own, *ABOVE]

    def append(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, lambda batch: batch.column("head").to_numpy(zero_copy_only=False)):
            head = {name: run.column(name)[0].as_py() for name in ABOVE}
            rows = run.slice(1).select(own)
            tree = grown(rows.column("node").to_pylist(), rows.column("n")[0].as_py())
            tree.close()
            grew = {"witness": pa.array(["".join(w) + head["witness"] for w in tree.witnesses], pa.string())}
            same = {name: pa.array([head[name]] * len(rows), run.schema.field(name).type) for name in ABOVE if name != "witness"}
            for name, column in (grew | same).items():
                rows = rows.append_column(name, column)
            yield from rows.combine_chunks().to_batches()

    heads = above.select(F.lit(True).alias("head"), F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), "tree", *ABOVE)
    rows = nodes.withColumns({"head": F.lit(False), "block": F.expr(f"pos div {BLOCK}")})
    dealt = rows.unionByName(heads, allowMissingColumns=True).repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
    kinds = dict(nodes.dtypes) | ABOVE
    return dealt.drop("block").mapInArrow(append, ", ".join(f"`{name}` {kinds[name]}" for name in names))


def rounds(nodes: DataFrame) -> list[DataFrame]:
    """The nodes and the block roots above them, round by round, until every tree has one node."""
    found = [nodes]
    largest = nodes.agg(F.max("n")).first()[0] or 0
    while largest > 1:
        found.append(written(block_roots(found[-1]), "block-roots"))
        largest = -(-largest // BLOCK)
    return found


def witnessed(found: list[DataFrame], above: DataFrame) -> DataFrame:
    """The nodes of the first round with the columns of ABOVE; ``above`` has them for the only node of every tree."""
    for nodes in reversed(found[1:]):
        only = nodes.select("tree", "pos", "n", "node")
        above = written(extended(only, above), "witnesses")
    # a tree of one node is a block of its own
    return extended(found[0], above)


def build(rows: DataFrame, group: Column, order: list[Column], leaf: Column, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """The manifest of ``rows``: the columns ``keep`` and a row's

    * ``leaf``, its digest (hexadecimal SHA-256, as the column given),
    * ``tree`` (its group as text), ``pos`` and ``n``: the place from 0 among the leaves of the group, and their number,
    * ``place`` and ``places``: the same of the group among the groups, in the order of UTF-8 bytes, null first,
    * ``subroot`` and ``root``: the roots of the group and of the dataset,
    * ``witness``: the digests of the siblings, level by level up to the root, one after the other.

    Equal rows are leaves of their own. Rows that tie in the order are ordered by digest, so the roots
    do not depend on how the rows are stored; the kept columns of ties with equal digests may change
    places. A null group is a group, null order columns come first. An empty table gives an empty
    manifest. Names of other columns of ``rows`` do not matter.
    """
    ordered = {f"_by_{i}": column for i, column in enumerate(order)}
    leaves = rows.select(*(F.col(c).alias(f"_keep_{c}") for c in keep), group.cast("string").alias("tree"), leaf.alias("node"), *(c.alias(n) for n, c in ordered.items()))
    placed = numbered(leaves, "tree", [*(F.col(n).asc_nulls_first() for n in ordered), F.col("node")]).drop(*ordered)
    lower = rounds(written(placed, "leaves"))
    subroots = lower[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("node").alias("subroot"), F.col("node"))
    upper = rounds(written(numbered(subroots, "tree", [F.col("name").asc_nulls_first()]), "subroots"))
    nothing = F.lit(None).cast("long")
    top = upper[-1].select(
        "tree", F.lit(0).cast("long").alias("pos"), F.lit("").alias("witness"), F.lit(None).cast("string").alias("subroot"), F.col("node").alias("root"),
        nothing.alias("place"), nothing.alias("places"),
    )
    groups = witnessed([upper[0].select("tree", "pos", "n", "node", "name"), *upper[1:]], top)
    above = groups.select(
        F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), "witness", F.col("node").alias("subroot"), "root",
        F.col("pos").alias("place"), F.col("n").alias("places"),
    )
    found = witnessed(lower, written(above, "group-witnesses"))
    return found.select(*(F.col(f"_keep_{c}").alias(c) for c in keep), F.col("node").alias("leaf"), "tree", "pos", "n", "place", "places", "subroot", "root", "witness")


def folded(leaf: str, witness: str, pos: int, n: int, place: int, places: int) -> str:
    """The root that a leaf and a witness lead to."""
    at = 0
    for place_in, count in ((pos, n), (place, places)):
        while count > 1:
            k = place_in % ARITY
            others = min(ARITY, count - (place_in - k)) - 1
            run, at = witness[at : at + HEX * others], at + HEX * others
            leaf = digest((run[: HEX * k] + leaf + run[HEX * k :]).encode())
            place_in, count = place_in // ARITY, -(-count // ARITY)
    return leaf


def verify(manifest: DataFrame, leaf: str = "leaf") -> DataFrame:
    """``manifest`` with ``folded_root``, the root recomputed from the column ``leaf`` and the witness, and ``verified``."""
    parts = [leaf, "witness", "pos", "n", "place", "places"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = [folded(*row) for row in zip(*(batch.column(name).to_pylist() for name in parts), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.string())], [*batch.schema.names, "folded_root"])

    schema = ", ".join(f"`{name}` {kind}" for name, kind in manifest.dtypes)
    found = manifest.mapInArrow(fold, f"{schema}, folded_root string")
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def sized(value: Column) -> Column:
    """A value without ambiguity: ``-`` for null, else its length in UTF-8 bytes, a colon, and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(*values: Column) -> Column:
    """SHA-256 of some values, each told from the next by its length."""
    return F.sha2(F.concat(*map(sized, values)).cast("binary"), 256)
