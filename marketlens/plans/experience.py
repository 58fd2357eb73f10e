"""Customer experience: reviews against delivery, and repeat customers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions import delivery
from marketlens.functions.exact import mean2, pct2
from marketlens.operators.grains import reviewed_deliveries
from marketlens.plans.business import counted_share
from marketlens.schema import Tables

# Fixed value: an order whose average score is at most this was rated low.
LOW_RATING = 2


def review_shares(t: Tables, share_name: str = "share_pct") -> DataFrame:
    return counted_share(t.reviews, "review_score", "reviews", share_name)


def review_distribution(t: Tables) -> DataFrame:
    """Reviews per score; a missing score comes last."""
    return review_shares(t).orderBy(F.asc_nulls_last("review_score"))


def _rated() -> list[Column]:
    """Aggregates over one row per reviewed order.

    An order counts once, with the average of its scores; one without any known score counts
    as not low and is left out of the average.
    """
    average = F.col("score_sum").cast("decimal(20,0)") / F.nullif(F.col("scores"), F.lit(0)).cast("decimal(20,0)")
    low = F.col("score_sum") <= F.col("scores") * LOW_RATING
    return [
        F.count(F.lit(1)).alias("reviewed_orders"),
        mean2(F.sum(average), F.count(average)).alias("avg_review_score"),
        pct2(F.count_if(low), F.count(F.lit(1))).alias("low_rating_rate_pct"),
    ]


def late_vs_review(t: Tables) -> DataFrame:
    """Ratings of late orders beside those of all others."""
    return (
        reviewed_deliveries(t)
        .groupBy(delivery.late_label().alias("delivery_status"))
        .agg(*_rated())
        .orderBy("delivery_status")
    )


def delay_vs_review(t: Tables) -> DataFrame:
    """Ratings per delivery band, from early to late; an unknown delay has no band name."""
    return (
        reviewed_deliveries(t)
        .groupBy(delivery.band_rank(F.col("delay_days")).alias("_rank"))
        .agg(*_rated())
        .orderBy(F.asc_nulls_last("_rank"))
        .select(
            delivery.band_label(F.col("_rank")).alias("delivery_band"),
            "reviewed_orders",
            "avg_review_score",
            "low_rating_rate_pct",
        )
    )


def band_experience(t: Tables) -> DataFrame:
    """Ratings per delivery band and lateness, in no order."""
    return (
        reviewed_deliveries(t)
        .groupBy(
            delivery.band_rank(F.col("delay_days")).alias("sort_order"),
            delivery.late_label().alias("delivery_status"),
        )
        .agg(*_rated())
        .select(
            delivery.band_label(F.col("sort_order")).alias("delivery_band"),
            "sort_order",
            "delivery_status",
            "reviewed_orders",
            "avg_review_score",
            "low_rating_rate_pct",
        )
    )


def repeat_customers(t: Tables) -> DataFrame:
    """Persons, those with more than one order of any status, and orders per person.

    Orders are counted per customer record first; a person's records are summed after.
    """
    per_record = t.orders.groupBy("customer_id").agg(F.count_distinct("order_id").alias("orders"))
    per_person = (
        t.customers.select("customer_id", "customer_unique_id")
        .join(per_record, "customer_id")
        .groupBy("customer_unique_id")
        .agg(F.sum("orders").alias("orders"))
    )
    repeat = F.when(F.col("orders") > 1, 1).otherwise(0)
    people = F.count(F.lit(1))
    return per_person.agg(
        people.alias("unique_customers"),
        F.sum(repeat).alias("repeat_customers"),
        pct2(F.sum(repeat), people).alias("repeat_customer_rate_pct"),
        mean2(F.sum("orders").cast("decimal(20,0)"), people).alias("avg_orders_per_customer"),
    )
