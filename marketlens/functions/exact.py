"""Exact sums and one-step rounding.

Averages, shares and growth rates are ratios of exact sums, rounded once, half away
from zero, to two decimals. Dividing decimals and rounding the quotient would round
twice; dividing doubles would depend on the order in which partitions are added up.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketlens.schema import MONEY

MICROS_PER_SECOND = 1_000_000
MICROS_PER_DAY = 86_400_000_000


def exact_sum(whole_number: Column) -> Column:
    """Sum of a bigint that cannot overflow at any row count."""
    return F.sum(whole_number.cast("decimal(18,0)"))


def cents_sum(amount: Column) -> Column:
    """Sum of money in hundredths, as a bigint: as exact as a decimal sum and as quick as a count.

    For sums per order or finer; sum those up with ``exact_sum``.
    """
    return F.sum((amount.cast(MONEY) * 100).cast("bigint"))


def money(cents: Column) -> Column:
    """Hundredths as an amount."""
    return (cents * F.lit(Decimal("0.01"))).cast("decimal(24,2)")


def ratio2(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator to two decimals; NULL when the denominator is 0."""
    n = numerator if isinstance(numerator, Column) else F.lit(numerator)
    d = F.abs(denominator)
    hundredths = F.call_function("div", F.abs(n) * F.lit(200) + d, F.nullif(d * F.lit(2), F.lit(0)))
    sign = F.signum(n).cast("int") * F.signum(denominator).cast("int")
    return ((sign * hundredths).cast("decimal(18,0)") * F.lit(Decimal("0.01"))).cast("decimal(18,2)")


def wide(count: Column) -> Column:
    """A count as a decimal, so that scaling it cannot overflow."""
    return count.cast("decimal(20,0)")


def mean2(total: Column, count: Column) -> Column:
    """total / count."""
    return ratio2(total, wide(count))


def mean_money2(cents: Column, count: Column) -> Column:
    """Average amount, given the sum in hundredths."""
    return ratio2(cents, wide(count) * F.lit(100))


def pct2(part: Column, whole: Column) -> Column:
    """part as a percentage of whole, both counts."""
    return ratio2(wide(part) * F.lit(100), wide(whole))


def growth2(current: Column, previous: Column) -> Column:
    """Change against the previous value in percent."""
    return ratio2((current - previous).cast("decimal(30,2)") * F.lit(100), previous.cast("decimal(30,2)"))


def mean_days2(micros: Column, count: Column) -> Column:
    """Average of spans, given their sum in microseconds, in days."""
    return ratio2(micros, wide(count) * F.lit(Decimal(MICROS_PER_DAY)))
