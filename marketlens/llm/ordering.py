"""Places of rows in the order of their group, without a window over the group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.storage import written


def numbered(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """``rows`` with ``pos``, the place from 0 in the order of the group, and ``n``, the rows of the group.

    Null groups and null order columns come first. Rows that tie are ordered by their place in a first
    written copy, so that even one row repeated very often is dealt to many tasks. All rows are sorted in
    ranges; what a range holds of each group is counted, and those counts (a row per range and group, no
    more than ranges and groups together) are added up along the ranges.
    """
    kept = written(rows.withColumn("_row", F.monotonically_increasing_id()), "unordered")
    keys = [F.col(group).asc_nulls_first(), *order, F.col("_row")]
    in_ranges = kept.repartitionByRange(*keys).sortWithinPartitions(*keys)
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    ordered = written(in_ranges.drop("_row").withColumn("_range", F.spark_partition_id()).withColumn("_at", place), "ordered")
    counts = ordered.groupBy(F.col("_range").alias("_r"), F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    along = Window.partitionBy("_g").orderBy("_r")  # at most a row per range
    before = F.sum("_n").over(along) - F.col("_n")
    starts = counts.select("_r", "_g", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(Window.partitionBy("_g")).alias("n"))
    found = ordered.join(starts, (F.col("_range") == F.col("_r")) & F.col(group).eqNullSafe(F.col("_g")))
    return found.withColumn("pos", F.col("_at") + F.col("_shift")).select(*rows.columns, "pos", "n")


def runs(batches: Iterator[pa.RecordBatch], begins: Callable[[pa.RecordBatch], np.ndarray]) -> Iterator[pa.Table]:
    """The stream cut before every row that ``begins`` marks; one run is held at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        cuts = np.flatnonzero(begins(batch)).tolist()
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if a in cuts and held:
                yield pa.Table.from_batches(held)
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
