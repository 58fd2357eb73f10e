"""Additive delivery measures and the figures computed from them.

Every measure is a count or an exact sum, so it may be aggregated at a fine grain
first and summed up again: this keeps hot keys out of joins.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketlens.functions.delivery import micros_between
from marketlens.functions.exact import exact_sum, mean2, mean_days2, pct2
from marketlens.schema import APPROVED, CARRIER, DELIVERED, ESTIMATED, PURCHASED

SPANS = {
    "actual": (PURCHASED, DELIVERED),
    "promised": (PURCHASED, ESTIMATED),
    "buffer": (DELIVERED, ESTIMATED),
    "pre_carrier": (APPROVED, CARRIER),
    "transit": (CARRIER, DELIVERED),
}


#: Columns that the counts of lateness read.
LATENESS = ("is_late", "delay_days")


def lateness_measures() -> dict[str, Column]:
    late = F.col("is_late")
    late_delay = F.when(late, F.col("delay_days"))
    return {
        "n_orders": F.count(F.lit(1)),
        "n_late": F.count_if(late),
        "n_flagged": F.count(late),
        "late_delay": F.sum(late_delay),
        "n_late_delay": F.count(late_delay),
    }


def span_measures(name: str, span: Column) -> dict[str, Column]:
    return {f"us_{name}": exact_sum(span), f"n_{name}": F.count(span)}


def measures_of_spans(name: str, span: Column) -> dict[str, Column]:
    """Counts, lateness and one span that is computed already, by name."""
    return lateness_measures() | span_measures(name, span)


def order_measures(*spans: str) -> list[Column]:
    """Aggregates over orders: counts, lateness and the named spans."""
    measures = lateness_measures()
    for name in spans:
        measures |= span_measures(name, micros_between(*SPANS[name]))
    return [measure.alias(name) for name, measure in measures.items()]


def resum(*spans: str) -> list[Column]:
    """Sum pre-aggregated measures up to a coarser grain. Unused ones are pruned by the optimizer."""
    names = ["n_orders", "n_late", "n_flagged", "late_delay", "n_late_delay"]
    names += [f"{kind}_{span}" for span in spans for kind in ("us", "n")]
    return [F.sum(name).alias(name) for name in names]


def average_days(span: str) -> Column:
    return mean_days2(F.col(f"us_{span}"), F.col(f"n_{span}"))


def late_rate() -> Column:
    """Late orders among those whose lateness is known, in percent."""
    return pct2(F.col("n_late"), F.col("n_flagged"))


def average_late_delay() -> Column:
    return mean2(F.col("late_delay").cast("decimal(20,0)"), F.col("n_late_delay"))
