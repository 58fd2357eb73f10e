"""Exact median without sorting or collecting the values."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A bucket of the first level is 2^36 microseconds (19 hours) wide: spans between any two
# timestamps (59 bits) fill at most 2^23 buckets, those of ten years fewer than 5,000. Each
# deeper level cuts one bucket into 2^18.
LEVEL_SHIFTS = (36, 18, 0)


TOTALS = "_totals"


def middle_sum(values: DataFrame, column: str, measures: Mapping[str, Column] | None = None) -> DataFrame:
    """One row: ``middle_sum``, the sum of the two middle values of a bigint column, and ``measures`` over all rows.

    For an odd number of values the middle one counts twice, so half of the sum is the
    interpolated median; without any value the sum is NULL. The first level counts the values per
    bucket (combined on the map side) and aggregates the measures, which must be sums or counts, in the
    same pass; each level keeps the bucket of each of the two middle ranks, and the next level
    looks only inside those. So the rows are read three times, twice for the one column only.
    """
    measures = dict(measures or {})
    first, *deeper = LEVEL_SHIFTS
    everything = Window.partitionBy()
    counts = values.groupBy(F.shiftright(column, first).alias("_bucket")).agg(
        F.count(column).alias("_n"), *(measure.alias(name) for name, measure in measures.items())
    )
    total = F.sum("_n").over(everything)
    totals = F.struct(total.alias("_values"), *(F.sum(name).over(everything).alias(name) for name in measures))
    sides = F.array(
        F.struct(F.lit(0).alias("id"), F.expr(f"({TOTALS}._values - 1) div 2").alias("rank")),
        F.struct(F.lit(1).alias("id"), F.expr(f"{TOTALS}._values div 2").alias("rank")),
    )
    ranked = counts.select("_bucket", "_n", _before(Window.orderBy("_bucket")).alias("_before"), totals.alias(TOTALS))
    picked = _pick(
        ranked.select("*", F.explode(sides).alias("_side")).select(
            "_bucket", "_n", "_before", TOTALS, F.col("_side.id").alias("_id"), F.col("_side.rank").alias("_rank")
        )
    )
    spans = values.select(F.col(column).alias("_v"))
    previous = first
    for shift in deeper:
        inside = spans.join(
            # two rows: one per middle rank; rows without a value meet them only if no row has one
            F.broadcast(picked.withColumnRenamed("_bucket", "_outer")),
            F.shiftright("_v", previous).eqNullSafe(F.col("_outer")),
        )
        counts = inside.groupBy("_id", "_rank", TOTALS, F.shiftright("_v", shift).alias("_bucket")).agg(F.count("_v").alias("_n"))
        per_rank = Window.partitionBy("_id").orderBy("_bucket")
        picked = _pick(counts.withColumn("_before", _before(per_rank)))
        previous = shift
    middle = F.sum(F.col("_bucket").cast("decimal(20,0)")).alias("middle_sum")
    return picked.agg(middle, F.first(TOTALS).alias(TOTALS)).select("middle_sum", *(F.col(f"{TOTALS}.{name}").alias(name) for name in measures))


def _before(window: Window) -> Column:
    return F.sum("_n").over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")


def _pick(counts: DataFrame) -> DataFrame:
    """The bucket that holds the rank, and the rank inside that bucket; the one without values if there are none."""
    inner = F.col("_rank") - F.col("_before")
    return counts.filter(((inner >= 0) & (inner < F.col("_n"))) | (F.col(f"{TOTALS}._values") == 0)).select(
        "_id", inner.alias("_rank"), "_bucket", TOTALS
    )
