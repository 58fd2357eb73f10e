"""Exact top-k search by distributed histogram selection.

Vectors are packed into blocks. Every block of queries meets every block of candidates in a task
of its own: a stated query set against all rows, in blocks. All scores of a pair of blocks are
computed at once, and only histograms leave the task: per query, the numbers of scores in equal
parts of the range in which its k-th score lies. Their sums over all blocks narrow the range down
to one whole number, the exact k-th score. Then each pair of blocks yields the scores above it,
and of those equal to it the k smallest ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.storage import written

#: Parts into which a range of scores is divided per round.
BINS = 1024
#: Rows of a block of candidates and of queries.
CANDIDATES, QUERIES = 4096, 256
#: Holds the product of a bin and its width before it is added to a lower end.
WIDE = "decimal(19,0)"
BLOCK = "block long, n int, dim int, ids binary, vectors binary, peak double"


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component as double; doubles from 2**53 are whole numbers, which a long need not hold."""

    def whole(x: Column) -> Column:
        x = x.cast("double") * scale
        return F.when(F.abs(x) < float(2**53), F.floor(x).cast("double")).otherwise(x)

    return F.transform(vector, whole)


def usable(vector: Column) -> Column:
    """Whether a vector is there, not empty and free of null, NaN and infinite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine, F.lit(False))


def packed(rows: DataFrame, most: int) -> DataFrame:
    """Blocks of up to ``most`` rows (id, vector) of one length each; numbered by task and place."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: dict[int, list] = {}

        def block(dim: int, part: list) -> pa.RecordBatch:
            nonlocal number
            number += 1
            vectors = np.array([v for _, v in part], np.float64).reshape(len(part), dim)
            values = [number, len(part), dim, np.array([i for i, _ in part], np.int64).tobytes(), vectors.tobytes(), float(np.abs(vectors).max())]
            types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], ["block", "n", "dim", "ids", "vectors", "peak"])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = held.setdefault(len(v), [])
                part.append((i, v))
                if len(part) == most:
                    yield block(len(v), held.pop(len(v)))
        for dim, part in held.items():
            yield block(dim, part)

    return rows.select("id", "vector").mapInArrow(pack, BLOCK)


def block_scores(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, candidate ids, exact scores as longs); the scores of a query's own rows are 0 and do not count."""
    ids, others = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
    a, b = (np.frombuffer(row[k], np.float64).reshape(-1, row["dim"]) for k in ("q_vectors", "vectors"))
    if float(np.abs(a).max()) * float(np.abs(b).max()) * row["dim"] < 2**53:  # every partial sum is exact
        return ids, others, (a @ b.T).astype(np.int64)
    with np.errstate(over="ignore", invalid="ignore"):
        about = a @ b.T
        slack = np.abs(a) @ np.abs(b).T * (row["dim"] * 2.0**-52)
        sure = np.abs(about) + slack < 2.0**62
    own = ids[:, None] == others[None, :]
    if max(np.abs(a).max(), np.abs(b).max()) < 2.0**62:
        scores = a.astype(np.int64) @ b.astype(np.int64).T  # wraps around, which is right for a score that fits
    else:
        scores, sure = np.zeros(about.shape, np.int64), np.zeros(about.shape, bool)
    for i, j in np.argwhere(~sure & ~own):
        score = sum(int(x) * int(y) for x, y in zip(a[i], b[j], strict=True))
        if not -(2**63) <= score < 2**63:
            raise OverflowError(f"the score of {ids[i]} and {others[j]} does not fit into a long")
        scores[i, j] = score
    return ids, others, np.where(own, 0, scores)


def top_k(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id and score: the k best of ``rows`` (id, vector) by inner product for each of ``queries``.

    Vectors hold whole numbers as doubles, of any size; only those of equal length are compared. A query never
    gets rows of its own id; ties go to the smaller id, and repeated rows count each. Queries with
    fewer candidates get all; without any, none. Scores are exact; one that no long holds stops the search.
    """
    spark = rows.sparkSession
    candidates = written(packed(rows, CANDIDATES), "topk-candidates")
    asked = written(packed(queries, QUERIES), "topk-queries")
    q = asked.select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.col("dim").alias("q_dim"), F.col("peak").alias("q_peak"))
    # each block of queries is sent to each block of candidates of that length: pairs of numbers, then the blocks
    pairs = candidates.select("block", "dim").join(q.select("q_block", "q_dim"), F.col("dim") == F.col("q_dim")).select("block", "q_block")
    pairs = written(pairs, "topk-pairs")
    peak = candidates.groupBy("dim").agg(F.max("peak").alias("peak")).join(q.groupBy(F.col("q_dim").alias("dim")).agg(F.max("q_peak").alias("q_peak")), "dim")
    widest = peak.agg(F.max(F.col("peak") * F.col("q_peak") * F.col("dim"))).first()[0]
    if widest is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    most = int(widest) + 1 if widest < 2.0**62 else 2**63  # all scores are longs
    low, width = -most, 1
    while width * BINS < 2 * most + 1:
        width *= BINS

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, others, scores = block_scores(row)
                starts, span = np.frombuffer(row["lows"], np.int64), row["width"]
                # the distance from the start as an unsigned number, as it may take all 64 bits
                bins = (scores.view(np.uint64) - starts[:, None].view(np.uint64)) // np.uint64(span)
                inside = (scores >= starts[:, None]) & (bins < BINS) & (ids[:, None] != others[None, :])
                bins = np.where(inside, bins, 0).astype(np.int64)
                who = np.broadcast_to(np.arange(len(ids))[:, None], scores.shape)[inside]
                flat = np.bincount(who * BINS + bins[inside], minlength=len(ids) * BINS)
                some = np.flatnonzero(flat)
                yield pa.RecordBatch.from_arrays([pa.array(ids[some // BINS]), pa.array(some % BINS), pa.array(flat[some])], ["query_id", "bin", "n"])

    # the range of each query: its lower end, and the number of scores above it
    state = queries.select(F.col("id").alias("query_id")).distinct().select("query_id", F.lit(low).cast("long").alias("low"), F.lit(0).cast("long").alias("above"))
    state = written(state, "topk-range")
    order = asked.select(F.col("block").alias("q_block"), "ids")

    def lows(at: DataFrame, span: int) -> DataFrame:
        """Per block of queries, the lower ends of the ranges in the order of its ids."""

        def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    ids = np.frombuffer(ids, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), block)), pa.array(np.arange(len(ids))), pa.array(ids)], ["q_block", "place", "query_id"])

        spelled = order.mapInArrow(spell, "q_block long, place long, query_id long").join(at, "query_id")
        gathered = spelled.groupBy("q_block").agg(F.array_sort(F.collect_list(F.struct("place", "low"))).alias("list"))

        def as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = [np.array([x["low"] for x in part], np.int64).tobytes() for part in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.binary())], ["q_block", "lows"])

        return gathered.mapInArrow(as_bytes, "q_block long, lows binary").withColumn("width", F.lit(span).cast("long"))

    def work(at: DataFrame, span: int) -> DataFrame:
        """A row for each pair of blocks; a block of candidates is read by one task, or more if Spark splits it."""
        return pairs.join(q.drop("q_dim").join(lows(at, span), "q_block"), "q_block").join(candidates, "block")

    while True:
        counted = work(state, width).mapInArrow(histogram, "query_id long, bin long, n long")
        sums = counted.groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("query_id").orderBy(F.desc("bin")))  # at most BINS rows a query
        reached = sums.join(state, "query_id").withColumn("upto", F.col("above") + upto)
        hit = reached.where(F.col("upto") >= k).groupBy("query_id").agg(F.max(F.struct("bin", (F.col("upto") - F.col("n")).alias("above"))).alias("hit"))
        moved = state.join(hit, "query_id", "left")
        # a query with fewer than k candidates keeps the lower end, below all scores
        state = written(
            moved.select(
                "query_id",
                F.when(F.col("hit").isNull(), F.col("low")).otherwise((F.col("low").cast(WIDE) + F.col("hit.bin").cast(WIDE) * F.lit(width).cast(WIDE)).cast("long")).alias("low"),
                F.coalesce("hit.above", "above").alias("above"),
            ),
            "topk-range",
        )
        if width == 1:
            break
        width //= BINS

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, others, scores = block_scores(row)
                least = np.frombuffer(row["lows"], np.int64)
                good = (scores >= least[:, None]) & (ids[:, None] != others[None, :])
                for i in np.flatnonzero(good.any(axis=1)):
                    at = np.flatnonzero(good[i])
                    at = at[np.lexsort((others[at], -scores[i, at]))][:k]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), ids[i])), pa.array(others[at]), pa.array(scores[i, at])], ["query_id", "vec_id", "score"])

    found = work(state, 1).mapInArrow(best, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))  # k rows of each block
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(table: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """The k best for the rows of ``table`` (vec_id, embedding, anything else) whose vec_id is divisible by ``every``.

    Components x count as floor(scale * x), exactly, for every finite x of which scale * x is finite. Rows without id or with an unusable vector take no part;
    of several query rows with one id, the one with the smallest vector asks.
    """
    fit = table.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows = fit.select(F.col("vec_id").cast("long").alias("id"), scaled(F.col("embedding"), scale).alias("vector"))
    queries = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("vector").alias("vector"))
    return top_k(rows, queries, k)
