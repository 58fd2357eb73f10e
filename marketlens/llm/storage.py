"""Intermediate results in the folder all executors share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.session import scratch_folder

#: Rows of at most a hundred bytes that may be broadcast: 20 MB on every executor.
BROADCAST_ROWS = 200_000
#: Counters of one row when a task hands over its counts.
SLICE = 1 << 16
#: Types of those counters by their bytes.
COUNTS = {1: np.uint8, 2: np.uint16, 4: np.int32, 8: np.int64}
#: Rows from which on another task is worth starting.
ROWS_EACH = 1000


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows, written once to the shared folder: a short lineage that survives lost executors."""
    path = scratch_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of short rows, marked for broadcasting only if counting shows that it is small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def added_up(parts: DataFrame, slots: int) -> np.ndarray:
    """Sum of the tasks' counter arrays, given as slices (see ``sliced``): rows of (slice, counts).

    The length of the sum is fixed by the caller, whatever the number of rows.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                values = np.frombuffer(counts, COUNTS[len(counts) // SLICE]).astype(np.int64)
                sums[number] = sums[number] + values if number in sums else values
        yield pa.RecordBatch.from_pydict(
            {"slice": pa.array(list(sums), pa.int32()), "counts": pa.array([s.tobytes() for s in sums.values()], pa.binary())}
        )

    schema = "slice int, counts binary"
    # no more tasks than slices
    total = parts.repartition("slice").coalesce(max(1, slots // SLICE)).mapInArrow(add, schema).collect()
    out = np.zeros(slots, np.int64)
    for row in total:
        out[row["slice"] * SLICE : (row["slice"] + 1) * SLICE] = np.frombuffer(row["counts"], np.int64)
    return out


def sliced(counts: np.ndarray) -> pa.RecordBatch:
    """A task's counters as rows of (slice, counts), without slices of zeros; a slice has as many bytes for each as its largest needs."""
    parts = counts.reshape(-1, SLICE)
    most = parts.max(axis=1)
    some = np.flatnonzero(most)
    kinds = [next(kind for kind in COUNTS.values() if most[i] <= np.iinfo(kind).max) for i in some]
    packed = [parts[i].astype(kind).tobytes() for i, kind in zip(some, kinds, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(packed, pa.binary())], ["slice", "counts"])


def few_tasks(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in no more tasks than so many rows are worth, but one for each core."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, rows // ROWS_EACH))
