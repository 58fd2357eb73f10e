"""Candidate pairs of similar sets from shared signatures, and their exact verification.

A *posting* says that a set bears a signature: columns ``signature, place, key, size, position,
parity``. Sets of Jaccard similarity of at least ``threshold`` share a signature; the callers see
to that. Postings are dealt by signature and sorted, so that each signature is a run of rows that
a task reads as a stream and of which it compares at most ``held`` rows with each other:

* the pairs of a signature of up to ``held`` sets are all compared, by size, parity and position; if these
  are many, a set keeps one with a leader, or a few if ``held`` is not given;
* the sets of a more frequent signature are compared with one set only, the first of those at hand. Whatever that leaves
  open is found by ``open_pairs``: a join on the signature of the sets that are not settled yet,
  which gives a pair once, at the first signature that both bear.

Nothing is dropped: both ways together compare all sets that share a signature, but for pairs that
the caller knows to be settled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm import hashing
from marketlens.llm.storage import few_tasks

POSTINGS = "signature long, place long, key long, size int, position int, parity long"
#: Sets of one signature whose pairs are all given, however many; and pairs for each set from which a larger run is one of copies.
RUN, DENSE = 128, 4
#: Sets of one signature from which on a set keeps so many pairs of it.
THIN, KEPT = 16, 2
#: Sets of one signature that a task holds at most, and of which it tells copies from others.
HELD, LEADERS = 8192, 32
#: Rows that a task gathers before it looks for pairs.
GATHERED = 200_000
#: Frequent signatures of a set that its rows carry, to tell the first that two sets share.
CARRIED = 32


def least_overlap(size: np.ndarray, threshold: Fraction) -> np.ndarray:
    """Tokens of a set that a similar set, of any size, must share."""
    return -(-size * threshold.numerator // threshold.denominator)


def possible(a: dict[str, np.ndarray], b: dict[str, np.ndarray], threshold: Fraction) -> np.ndarray:
    """Whether sets that first meet at these positions can be similar enough, by whole numbers only."""
    num, den = threshold.numerator, threshold.denominator
    small, large, total = np.minimum(a["size"], b["size"]), np.maximum(a["size"], b["size"]), a["size"] + b["size"]
    overlap = -(-total * num // (num + den))
    left = np.minimum(a["size"] - a["position"], b["size"] - b["position"])
    apart = np.bitwise_count((a["parity"] ^ b["parity"]).view(np.uint64)).astype(np.int64)
    return (small * den >= large * num) & (left >= overlap) & (apart <= total - 2 * overlap) & (a["key"] != b["key"])


def few_differences(size: np.ndarray, threshold: Fraction) -> np.ndarray:
    """Parity bits in which a similar set that is no larger may differ at most; all 64 for large sets."""
    num, den = threshold.numerator, threshold.denominator
    return np.minimum(64, 2 * size * (den - num) // (num + den)).astype(np.uint8)


def pairs_of_runs(rows: dict[str, np.ndarray], threshold: Fraction, thin: int | None = None) -> tuple[tuple[np.ndarray, np.ndarray], dict[str, np.ndarray], np.ndarray]:
    """Possible pairs within runs of equal signatures; rows of pairs that are left out; signatures that are left out whole.

    The rows of a run are ordered by size, so that a row meets those of similar size only, and by parity first.
    In runs of more than ``thin`` rows a row keeps the pairs with the ``KEPT`` first ones before it by place; the rows of all
    others are given. Runs of more than RUN rows with DENSE pairs a row or more are left out.
    """
    begins = np.flatnonzero(np.concatenate([[True], rows["signature"][1:] != rows["signature"][:-1]]))
    run = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(rows["signature"]))))
    order = np.lexsort((rows["key"], rows["size"], run))
    rows = {k: v[order] for k, v in rows.items()}
    fresh = np.concatenate([[True], (rows["key"][1:] != rows["key"][:-1]) | (run[1:] != run[:-1])])
    rows, run = {k: v[fresh] for k, v in rows.items()}, run[fresh]
    sizes = np.bincount(run, minlength=len(begins))
    # the row after the last one of the run that is not too large
    spread = int(rows["size"].max()) * threshold.denominator // threshold.numerator + 1
    ends = np.searchsorted(run * (spread + 1) + rows["size"], run * (spread + 1) + rows["size"] * threshold.denominator // threshold.numerator, "right")
    parity, limit = rows["parity"].view(np.uint64), few_differences(rows["size"], threshold)
    pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    found, dense, unseen = np.zeros(len(begins), np.int64), np.zeros(len(begins), bool), 0
    at = np.arange(len(run))
    reach = ends - at
    apart = 0
    while len(at):
        apart += 1
        far = reach[at] > apart
        at = at[far]
        near = at[np.bitwise_count(parity[at] ^ parity[at + apart]) <= limit[at + apart]]
        if not len(near):
            continue
        one, two = ({k: v[i] for k, v in rows.items()} for i in (near, near + apart))
        good = possible(one, two, threshold)
        pairs.append((near[good], near[good] + apart, run[near[good]]))
        unseen += int(good.sum())
        if unseen > len(run):
            found += np.bincount(np.concatenate([p[2] for p in pairs]), minlength=len(begins))
            dense |= (sizes > RUN) & (found >= DENSE * sizes)
            found[:] = 0
            pairs = [tuple(np.concatenate([p[side] for p in pairs]) for side in range(3))]
            pairs = [tuple(side[~dense[pairs[0][2]]] for side in pairs[0])]
            at, unseen = at[~dense[run[at]]], 0
    one, two = (np.concatenate([p[side] for p in pairs] or [at]) for side in (0, 1))
    rank = np.empty(len(run), np.int64)
    rank[np.lexsort((rows["key"], rows["place"]))] = np.arange(len(run))
    swapped = rank[one] > rank[two]
    one, two = np.where(swapped, two, one), np.where(swapped, one, two)
    order = np.lexsort((rank[one], two))
    one, two = one[order], two[order]
    nth = np.arange(len(two)) - np.searchsorted(two, two)
    left = (nth >= KEPT) & (sizes[run[two]] > thin) if thin is not None else np.zeros(len(two), bool)
    open_ = np.unique(np.concatenate([one[left], two[left]]))
    whole = rows["signature"][np.searchsorted(run, np.flatnonzero(dense))]
    return (rows["key"][one[~left]], rows["key"][two[~left]]), {k: v[open_] for k, v in rows.items()}, whole


def pairs_of_run(rows: dict[str, np.ndarray], threshold: Fraction) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Pairs of one run of up to HELD rows with the first of LEADERS rows that they may be copies of; and rows of pairs that are not given.

    A run of many pairs is not compared pair by pair: no more pairs than rows come out, all other pairs are left
    to ``open_pairs``, which compares what is not settled by then.
    """
    n = len(rows["key"])
    free = np.arange(n)
    pairs = []
    for _ in range(LEADERS):
        if len(free) < 2:
            break
        one, others = free[0], free[1:]
        copies = possible({k: np.full(len(others), v[one]) for k, v in rows.items()}, {k: v[others] for k, v in rows.items()}, threshold)
        pairs.append((np.full(int(copies.sum()), rows["key"][one]), rows["key"][others[copies]]))
        free = others[~copies]
    return pairs, np.full(n, n > 2)


def candidates(postings: DataFrame, threshold: Fraction, held_rows: int | None = None) -> DataFrame:
    """Pairs (a, b, frequent signature or null): keys of sets that may be similar enough, each pair at least once.

    A row with equal a and b says that b bears a signature of more than ``held_rows`` (``HELD``) sets, and was
    compared with its first set only, or that some of its pairs of that signature are left out, as it has others.
    """
    most = HELD if held_rows is None else held_rows
    names = [f.name for f in postings.schema.fields]

    def rows_of(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        return {n: batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for n in names}

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        count = 0
        leader: dict[str, np.ndarray] | None = None  # of the frequent signature that the stream is in

        def out(a: np.ndarray, b: np.ndarray, frequent: np.ndarray | None = None) -> pa.RecordBatch:
            mark = pa.nulls(len(a), pa.int64()) if frequent is None else pa.array(frequent)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), mark], ["a", "b", "frequent"])

        def by_place(rows: dict[str, np.ndarray]) -> np.ndarray:
            return np.lexsort((rows["key"], rows["place"]))

        def against_leader(rows: dict[str, np.ndarray], leader: dict[str, np.ndarray] | None = None) -> Iterator[pa.RecordBatch]:
            first = {k: np.broadcast_to(v, len(rows["key"])) for k, v in (leader or first_of(rows)).items()}
            first = {k: np.ascontiguousarray(v) for k, v in first.items()}
            good = possible(first, rows, threshold)
            if good.any():
                yield out(first["key"][good], rows["key"][good])
            yield out(rows["key"], rows["key"], rows["signature"])

        def first_of(*runs: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
            """The row of the smallest place, and key."""
            rows = {n: np.concatenate([r[n] for r in runs]) for n in names}
            return {k: v[by_place(rows)[:1]] for k, v in rows.items()}

        def found(rows: dict[str, np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
            """Pairs among all rows but those of the last signature, which stay in ``held`` unless it is the last call."""
            nonlocal held, count, leader
            signature = rows["signature"]
            if leader is not None:
                same = int(np.searchsorted(signature != leader["signature"][0], True))
                if same:
                    run = {k: v[:same] for k, v in rows.items()}
                    yield from against_leader(run, leader)
                    leader = first_of(leader, run)
                rows = {k: v[same:] for k, v in rows.items()}
                signature = rows["signature"]
                if len(signature):
                    leader = None
            if not len(signature):
                held, count = [], 0
                return
            cut = len(signature) if last else int(np.flatnonzero(signature == signature[-1])[0])
            done = {k: v[:cut] for k, v in rows.items()}
            if cut:
                begins = np.flatnonzero(np.concatenate([[True], done["signature"][1:] != done["signature"][:-1]]))
                sizes = np.diff(np.append(begins, cut))
                few = np.repeat((sizes > 1) & (sizes <= most), sizes)
                dense = np.zeros(0, np.int64)
                if few.any():
                    pairs, left, dense = pairs_of_runs({k: v[few] for k, v in done.items()}, threshold, THIN if held_rows is None else None)
                    yield out(*pairs)
                    yield out(left["key"], left["key"], left["signature"])
                for i in np.flatnonzero((sizes > most) | np.isin(done["signature"][begins], dense)):
                    run = {k: v[begins[i] : begins[i] + sizes[i]] for k, v in done.items()}
                    if sizes[i] > most:
                        yield from against_leader(run)
                        continue
                    order = by_place(run)
                    run = {k: v[order] for k, v in run.items()}
                    pairs, copies = pairs_of_run(run, threshold)
                    yield out(*(np.concatenate([p[side] for p in pairs] or [run["key"][:0]]) for side in (0, 1)))
                    yield out(run["key"][copies], run["key"][copies], run["signature"][copies])
            rest = {k: v[cut:] for k, v in rows.items()}
            if len(rest["key"]) > most:
                leader = first_of(rest)
                yield from against_leader(rest, leader)
                rest = {k: v[:0] for k, v in rest.items()}
            held, count = ([rest], len(rest["key"])) if len(rest["key"]) else ([], 0)

        for batch in batches:
            held.append(rows_of(batch))
            count += batch.num_rows
            if count >= GATHERED:
                yield from found({n: np.concatenate([h[n] for h in held]) for n in names}, False)
        if held:
            yield from found({n: np.concatenate([h[n] for h in held]) for n in names}, True)

    # by one long only, which Spark sorts by its digits; tasks order the rows of a signature themselves
    dealt = postings.repartition("signature").sortWithinPartitions("signature")
    return dealt.mapInArrow(find, "a long, b long, frequent long")


def folded_bits(sets: DataFrame, words: int) -> DataFrame:
    """key, size and the parity bits (binary), folded into an array of ``words`` longs."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.bitwise_xor.reduce(np.frombuffer(x, np.int64).reshape(-1, words), axis=0).tolist() for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.int64()))], ["key", "size", "bits"])

    return sets.select("key", "size", "parity").mapInArrow(fold, "key long, size int, bits array<long>")


def leader_pairs(bearers: DataFrame, leaders: int = 8) -> DataFrame:
    """Pairs of a set with some sets of one of its frequent signatures that are in other groups.

    Not all pairs, but few and mostly good: they join most of a group of near copies before
    ``open_pairs`` compares what is left. ``bearers``: signature, key, root.
    """
    own = bearers.groupBy("key").agg(F.min("signature").alias("signature"), F.first("root").alias("root"))
    picks = [F.min_by(F.struct("key", "root"), F.xxhash64("key", F.lit(i))) for i in range(leaders)]
    chosen = own.groupBy("signature").agg(F.array_distinct(F.array(*picks)).alias("lead"))
    met = own.join(chosen, "signature").select("key", "root", F.explode("lead").alias("lead")).where("root <> lead.root")
    return met.select(F.least("key", "lead.key").alias("a"), F.greatest("key", "lead.key").alias("b")).distinct()


def some_bearers(bearers: DataFrame, about: int, draw: int) -> DataFrame:
    """About so many rows of every signature, by a hash of their keys, so that signatures mostly choose the same; all rows of one that has no more."""
    counts = bearers.groupBy("signature").agg(F.count("*").alias("of"))
    chosen = F.pmod(F.xxhash64("key", F.lit(draw)), F.lit(1 << 30)) * F.col("of") < F.lit(about << 30)
    return bearers.join(counts, "signature").where(chosen).drop("of")


def open_pairs(bearers: DataFrame, words: int, threshold: Fraction, unsettled, leaders: int | None = None, draw: int = 0) -> DataFrame:
    """Pairs of sets with a frequent signature in common for which ``unsettled(a, b)`` holds.

    ``bearers``: signature, the columns of ``folded_bits`` and what the condition needs. A plain join
    on the signature, which Spark may split, with all filters inside it. A row carries the first ``CARRIED``
    signatures of its set: if two sets share one of those, they meet at the first of them only.
    With ``leaders`` not all pairs, but those with about so many sets b of each signature, another choice for each
    ``draw``: their number grows as the rows do.
    """
    if leaders is None:
        own = bearers.groupBy("key").agg(F.slice(F.array_sort(F.collect_set("signature")), 1, CARRIED).alias("first_ones"))
        bearers = bearers.join(own, "key")
    a, b = bearers.alias("a"), (bearers if leaders is None else some_bearers(bearers, leaders, draw)).alias("b")
    num, den = threshold.numerator, threshold.denominator
    size = F.least("a.size", "b.size") * den >= F.greatest("a.size", "b.size") * num
    total = F.col("a.size") + F.col("b.size")
    apart = sum((F.bit_count(F.col("a.bits")[i].bitwiseXOR(F.col("b.bits")[i])) for i in range(words)), F.lit(0))
    # the least overlap is the total times num / (num + den), rounded up
    near = apart <= total - 2 * F.expr(f"(({num} * (a.size + b.size) + {num + den - 1}) div {num + den})")
    met = (F.col("a.signature") == F.col("b.signature")) & (F.col("a.key") != F.col("b.key")) & size & unsettled & near
    if leaders is None:
        shared = F.array_min(F.array_intersect("a.first_ones", "b.first_ones"))
        met = met & F.coalesce(shared == F.col("a.signature"), F.lit(True))
    return a.join(b, met).select(F.least("a.key", "b.key").alias("a"), F.greatest("a.key", "b.key").alias("b")).distinct()


def key_filter(keys: DataFrame, column: str, bits: int = 1 << 24) -> np.ndarray:
    """A bitmap of fixed length with the place of every key set: where it is unset, the key is absent."""

    slices = 16

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            at = places(batch.column(0).to_numpy(zero_copy_only=False), bits)
            np.bitwise_or.at(marks, at >> np.uint64(3), bit_of(at))
        parts = marks.reshape(slices, -1)
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([parts[i].tobytes() for i in some], pa.binary())], ["slice", "marks"])

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                whole[i] = whole.get(i, 0) | np.frombuffer(part, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(whole), pa.int32()), pa.array([m.tobytes() for m in whole.values()], pa.binary())], ["slice", "marks"])

    schema = "slice int, marks binary"
    parts = keys.select(column).where(F.col(column).isNotNull()).mapInArrow(place, schema)
    marks = np.zeros((slices, bits // slices // 8), np.uint8)
    for row in parts.repartition("slice").coalesce(slices).mapInArrow(union, schema).collect():
        marks[row["slice"]] = np.frombuffer(row["marks"], np.uint8)
    return np.unpackbits(marks.ravel()).astype(bool)


def places(keys: np.ndarray, bits: int) -> np.ndarray:
    return hashing.mixed(keys.view(np.uint64)) & np.uint64(bits - 1)


def bit_of(at: np.ndarray) -> np.ndarray:
    """The bit of each place within its byte, as ``packbits`` orders them."""
    return np.uint8(128) >> (at & np.uint64(7)).astype(np.uint8)


def marked(keys: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Whether the place of each key is set in a packed bitmap, which is not unpacked: a task holds 2 MB of it, not 16."""
    at = places(keys, 8 * len(packed))
    return packed[at >> np.uint64(3)] & bit_of(at) > 0


def close_pairs(pairs: DataFrame, bits: DataFrame, threshold: Fraction, carried: str | None = None, rows: int | None = None) -> DataFrame:
    """The pairs (a, b) whose sets may reach the threshold by their sizes and parity bits.

    ``bits``: one row of key, size and parity (binary) for each set. Its column ``carried`` is added for both sets, as ``..._a``, ``..._b``.
    ``rows``: how many pairs there are, if known.
    """
    num, den = threshold.numerator, threshold.denominator
    more = [] if carried is None else [carried]
    added = [f"{c}_{k}" for c in more for k in "ab"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, n = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
            u, v = (batch.column(i).to_pylist() for i in (4, 5))
            apart = np.empty(len(m), np.int64)
            words = np.array([(len(x) // 8, len(y) // 8) for x, y in zip(u, v, strict=True)], np.int64).reshape(-1, 2)
            for one, two in np.unique(words, axis=0).tolist():
                at = np.flatnonzero((words == (one, two)).all(axis=1))
                few = min(one, two)
                x, y = (np.bitwise_xor.reduce(np.frombuffer(b"".join([w[i] for i in at]), np.uint64).reshape(len(at), -1, few), axis=1) for w in (u, v))
                apart[at] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            good = apart <= m + n - 2 * -(-(m + n) * num // (num + den))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *batch.columns[6:]], ["a", "b", *added]).filter(pa.array(good))

    one, two = (bits.select(F.col("key").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ["size", "parity", *more])) for k in "ab")
    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "size_a", "size_b", "parity_a", "parity_b", *added)
    types = "".join(f", {c}_{k} {bits.schema[c].dataType.simpleString()}" for c in more for k in "ab")
    return (joined if rows is None else few_tasks(joined, rows)).mapInArrow(compare, f"a long, b long{types}")


def ends_of(pairs: DataFrame) -> DataFrame:
    """Keys of the sets of the written pairs (a, b), each side folded before it meets the other: no row for every pair."""
    rows = pairs.count()
    one, two = (few_tasks(pairs.select(F.col(x).alias("key")).distinct(), rows) for x in "ab")
    return few_tasks(one.union(two).distinct(), rows)


def verified(pairs: DataFrame, sets: DataFrame, threshold: Fraction, rows: int | None = None) -> DataFrame:
    """Pairs (a, b) whose sets reach the threshold, compared token by token.

    ``sets``: key and tokens (binary of sorted 64-bit hashes); several rows of a key are alike. ``rows``: how many
    pairs there are, if known, so that few are compared in few tasks.
    """
    num, den = threshold.numerator, threshold.denominator

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (batch.column(i).to_pylist() for i in range(4))
            good = []
            for i in range(len(a)):
                u, v = np.frombuffer(x[i], np.uint64), np.frombuffer(y[i], np.uint64)
                both = len(np.intersect1d(u, v, assume_unique=True))
                good.append(both * den >= (len(u) + len(v) - both) * num)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good))

    one = sets.groupBy("key").agg(F.any_value("tokens").alias("tokens"))
    left = one.select(F.col("key").alias("a"), F.col("tokens").alias("x"))
    right = one.select(F.col("key").alias("b"), F.col("tokens").alias("y"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return (joined if rows is None else few_tasks(joined, rows)).mapInArrow(compare, "a long, b long")


def token_sets(docs: DataFrame, sets_of: Callable[[pa.RecordBatch], Iterator[hashing.Sets]], wanted: np.ndarray) -> DataFrame:
    """key and tokens of the sets in the documents whose key is wanted, or shares its place in the bitmap."""
    spark = docs.sparkSession
    marks = spark.sparkContext.broadcast(np.packbits(wanted))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for sets in sets_of(batch):
                keys = hashing.set_keys(sets)
                at = np.flatnonzero(marked(keys, marks.value))
                at = at[np.unique(keys[at], return_index=True)[1]]
                at = at[[key not in seen for key in keys[at].tolist()]] if len(at) else at
                seen.update(keys[at].tolist())
                if len(seen) > 1_000_000:
                    seen.clear()
                if len(at):
                    tokens = [np.sort(sets.tokens[sets.starts[i] : sets.starts[i + 1]]).tobytes() for i in at]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[at]), pa.array(tokens, pa.binary())], ["key", "tokens"])

    return docs.mapInArrow(find, "key long, tokens binary")
