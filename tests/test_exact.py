"""Rounding, bands, medians and joins against plain Python."""

import random
import statistics
from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction

import pytest
from build import rows
from pyspark.sql import functions as F

from marketlens.functions import delivery, exact
from marketlens.operators import lookup
from marketlens.operators.median import middle_sum


def half_up(fraction):
    cents = Decimal(fraction.numerator * 100) / Decimal(fraction.denominator)
    return cents.quantize(Decimal(1), ROUND_HALF_UP) / 100


def test_ratio_rounds_once_half_away_from_zero(spark):
    pairs = [(1, 200), (-1, 200), (201, 200), (-5, 2), (2, 3), (-2, 3), (1, -200), (0, 7), (10**27 + 5, 10**20), (7, 0)]
    df = spark.createDataFrame([(Decimal(n), Decimal(d)) for n, d in pairs], "n decimal(30,0), d decimal(30,0)")
    got = [r[0] for r in df.select(exact.ratio2(F.col("n"), F.col("d"))).collect()]
    expected = [half_up(Fraction(n, d)) if d else None for n, d in pairs]
    assert got == expected
    assert got[0] == Decimal("0.01") and got[1] == Decimal("-0.01") and got[3] == Decimal("-2.50")


def test_price_averages_are_not_rounded_twice(spark):
    """0.0049999.. would become 0.01 if the quotient were first rounded to six decimals."""
    df = spark.createDataFrame([(Decimal("0.01"),)] + [(Decimal("0.00"),)] * 2_000_0, "p decimal(12,2)")
    assert rows(df.agg(exact.mean2(F.sum("p") * 10000 - Decimal("0.01"), F.lit(20000)))) == [(Decimal("0.00"),)]


def test_sums_do_not_overflow(spark):
    df = spark.range(40).select(F.lit(9 * 10**17).alias("x"))
    assert rows(df.agg(exact.exact_sum(F.col("x")))) == [(Decimal(36 * 10**18),)]


def test_band_edges(spark):
    delays = [-8, -7, -6, -1, 0, 1, 3, 4, 7, 8, None]
    df = spark.createDataFrame([(d,) for d in delays], "d int").select(delivery.band_rank(F.col("d")).alias("r"))
    assert [r[0] for r in df.collect()] == [1, 1, 2, 2, 3, 4, 4, 5, 5, 6, None]
    named = df.select(delivery.band_label(F.col("r")), delivery.band_label(F.col("r"), "Unknown")).distinct()
    assert set(rows(named)) == {(name, name) for name, _ in delivery.BANDS} | {(None, "Unknown")}


CASES = {
    "none": [],
    "only nulls": [None, None],
    "one": [5],
    "odd with null": [3, None, 1, 2],
    "even": [1, 2, None],
    "far apart": [-(2**58), 2**58, 0, 1],
    "negative": [-1, -2, -3, -(2**37)],
    "bucket edge": [2**36 - 1, 2**36],
    "same": [7] * 9,
}


@pytest.mark.parametrize("name", CASES)
def test_median_cases(spark, name):
    values = CASES[name]
    known = [v for v in values if v is not None]
    (got,) = rows(middle_sum(spark.createDataFrame([(v,) for v in values], "v bigint"), "v"))
    expected = 2 * statistics.median([Fraction(v) for v in known]) if known else None
    assert (got[0] if got[0] is None else Fraction(got[0])) == expected


@pytest.mark.parametrize("seed", range(4))
def test_median_of_random_values(spark, seed):
    rng = random.Random(seed)
    values = [rng.choice([rng.randrange(10), rng.randrange(-(2**20), 2**20), rng.randrange(2**55)]) for _ in range(301 + seed)]
    (got,) = rows(middle_sum(spark.createDataFrame([(v,) for v in values], "v bigint"), "v"))
    assert Fraction(got[0]) == 2 * statistics.median([Fraction(v) for v in values])


def skewed(spark):
    """Half of the facts on key 1, a third without key, the rest spread out."""
    key = (
        F.when(F.col("id") % 6 < 3, F.lit(1)).when(F.col("id") % 6 < 5, F.lit(None)).otherwise(F.col("id") % 50 + 2)
    ).cast("int")
    facts = spark.range(1200).select("id", key.alias("k"))
    dim = spark.createDataFrame([(k, f"name {k}") for k in [None, *range(0, 40)]], "k int, name string")
    return facts, dim


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("null_safe", [False, True])
def test_lookup_join_equals_plain_join(spark, how, null_safe):
    facts, dim = skewed(spark)
    other = dim.withColumnRenamed("k", "dk")
    same = F.col("k").eqNullSafe(F.col("dk")) if null_safe else F.col("k") == F.col("dk")
    expected = sorted(rows(facts.join(other, same, how).select("id", "k", "name")), key=repr)
    for shuffled in (False, True):
        joined = lookup.lookup_join(facts, dim, "k", how, null_safe, shuffled)
        assert joined.columns == ["id", "k", "name"]
        assert sorted(rows(joined), key=repr) == expected


def test_a_lookup_reads_its_facts_once_and_forces_no_broadcast(spark):
    facts, dim = skewed(spark)
    plan = lookup.lookup_join(facts, dim, "k", "inner", shuffled=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (") == 1 and "SortMergeJoin" in plan and "Broadcast" not in plan
    assert "strategy=broadcast" not in lookup.lookup_join(facts, dim, "k", "inner")._jdf.queryExecution().logical().toString()
