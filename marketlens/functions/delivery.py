"""Order status, lateness and delivery bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketlens.schema import APPROVED, CARRIER, DELIVERED, ESTIMATED

# Status names, labels and the last day of each band.
STATUS_DELIVERED = "delivered"
STATUS_CANCELED = "canceled"
LATE = "Late"
NOT_LATE = "On time / Early"
UNKNOWN_BAND = "Unknown"
BANDS = (
    ("7+ days early", -7),
    ("1-6 days early", -1),
    ("On estimated date", 0),
    ("1-3 days late", 3),
    ("4-7 days late", 7),
    ("7+ days late", None),
)


def has_status(status: str) -> Column:
    """True or False, never NULL: a missing status is not that status."""
    return F.col("order_status").eqNullSafe(F.lit(status))


def delivered() -> Column:
    """Orders whose status says delivered."""
    return F.col("order_status") == F.lit(STATUS_DELIVERED)


def delivered_with_evidence() -> Column:
    """Delivered orders whose delivery time is known."""
    return delivered() & F.col(DELIVERED).isNotNull()


def delivered_with_stages() -> Column:
    """Delivered orders for which every stage of the journey is known."""
    return delivered_with_evidence() & F.col(APPROVED).isNotNull() & F.col(CARRIER).isNotNull()


def micros_between(start: str, end: str) -> Column:
    """Microseconds from start to end, independent of the session time zone."""
    return F.timestamp_diff("MICROSECOND", F.col(start), F.col(end))


def delay_days() -> Column:
    """Calendar days from the promised to the actual delivery date."""
    return F.datediff(F.col(DELIVERED), F.col(ESTIMATED))


def late_flag(delay: Column) -> Column:
    """True late, False not late, NULL without a delivery time.

    Delivered without a promise is not late: there was no date to miss.
    """
    return F.when(F.col(DELIVERED).isNotNull(), F.coalesce(delay > 0, F.lit(False)))


def late_label() -> Column:
    """Two-way label. Use only behind a filter on known deliveries: NULL reads as not late."""
    return F.when(F.col("is_late"), F.lit(LATE)).otherwise(F.lit(NOT_LATE))


def band_rank(delay: Column) -> Column:
    """1 (earliest) to 6 (latest); NULL when the delay is unknown."""
    rank = F.when(delay.isNull(), F.lit(None).cast("int"))
    for number, (_, last_day) in enumerate(BANDS, start=1):
        if last_day is None:
            return rank.otherwise(F.lit(number))
        rank = rank.when(delay <= last_day, F.lit(number))
    raise AssertionError("the last band must be open")


def band_label(rank: Column, unknown: str | None = None) -> Column:
    """Name of a band rank; ranks are grouped on, names attached to the few groups after."""
    names = F.array(*(F.lit(name) for name, _ in BANDS))
    return F.coalesce(F.get(names, rank - 1), F.lit(unknown).cast("string"))
