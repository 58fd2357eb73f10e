"""The twelve marts a dashboard reads. None is sorted: readers sort what they show."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions import delivery
from marketlens.functions.exact import exact_sum, mean2, money, pct2
from marketlens.operators.facts import stage_facts
from marketlens.operators.grains import delivered_sales
from marketlens.plans import business, experience, fulfillment, operations
from marketlens.schema import PURCHASE_MONTH, PURCHASED, Tables

# Purchases shown by the monthly mart, the end excluded.
MONTHLY_START = dt.datetime(2017, 1, 1)
MONTHLY_END = dt.datetime(2018, 9, 1)


def executive_kpis(t: Tables) -> DataFrame:
    """Headline figures in one row; the two counts over all orders share one scan."""
    total = t.orders.agg(F.count(F.lit(1)).alias("n"))
    canceled = t.orders.agg(F.count_if(delivery.has_status(delivery.STATUS_CANCELED)).alias("n"))
    return (
        delivered_sales(t)
        .agg(
            F.count_distinct("order_id").alias("delivered_orders"),
            money(exact_sum(F.col("price_cents"))).alias("merchandise_gmv"),
        )
        .select(
            total.scalar().alias("total_orders"),
            "delivered_orders",
            "merchandise_gmv",
            mean2(F.col("merchandise_gmv"), F.col("delivered_orders")).alias("merchandise_aov"),
            pct2(canceled.scalar(), total.scalar()).alias("cancellation_rate_pct"),
        )
    )


def monthly_business(
    t: Tables, start: dt.datetime | None = MONTHLY_START, end: dt.datetime | None = MONTHLY_END
) -> DataFrame:
    """Sales and growth per month. Purchases are cut before growth, so the first month has none.

    From the order-grain fact only the months of the range are read.
    """
    within = F.lit(True)
    if start is not None:
        within = within & (F.col(PURCHASED) >= F.lit(str(start)).cast("timestamp_ntz"))
        if t.facts is not None:
            within = within & (F.col(PURCHASE_MONTH) >= F.lit(start.date().replace(day=1)))
    if end is not None:
        within = within & (F.col(PURCHASED) < F.lit(str(end)).cast("timestamp_ntz"))
        if t.facts is not None:
            within = within & (F.col(PURCHASE_MONTH) <= F.lit((end - dt.timedelta(microseconds=1)).date()))
    return business.with_growth(business.monthly_sales(t, within)).select(
        "month",
        "orders",
        "merchandise_gmv",
        mean2(F.col("merchandise_gmv"), F.col("orders")).alias("merchandise_aov"),
        "order_mom_pct",
        "gmv_mom_pct",
    )


def order_status(t: Tables) -> DataFrame:
    return business.counted_share(t.orders, "order_status", "orders", "order_share_pct")


def delivery_bands(t: Tables) -> DataFrame:
    """Orders per band; an unknown delay has neither band nor rank."""
    return fulfillment.band_counts(t).select(
        delivery.band_label(F.col("sort_order")).alias("delivery_band"), "sort_order", "orders", "share_pct"
    )


def fulfillment_kpis(t: Tables) -> DataFrame:
    return fulfillment.overall(t, "analyzable_delivered_orders", "avg_delay_days_late")


def review_distribution(t: Tables) -> DataFrame:
    return experience.review_shares(t, "review_share_pct")


MARTS: dict[str, Callable[[Tables], DataFrame]] = {
    "vw_executive_kpis": executive_kpis,
    "vw_monthly_business": monthly_business,
    "vw_order_status": order_status,
    "vw_delivery_bands": delivery_bands,
    "vw_state_fulfillment": fulfillment.state_priority,
    "vw_fulfillment_stage": fulfillment.stage_by_lateness,
    "vw_seller_performance": operations.seller_performance,
    "vw_category_performance": operations.category_performance,
    "vw_review_distribution": review_distribution,
    "vw_delivery_customer_experience": experience.band_experience,
    "vw_repeat_customer_kpis": experience.repeat_customers,
    "vw_fulfillment_kpis": fulfillment_kpis,
}


def register_views(t: Tables) -> list[str]:
    """Create or replace one temporary view per mart and return their names."""
    for name, mart in MARTS.items():
        mart(t).createOrReplaceTempView(name)
    return list(MARTS)


#: Marts that are written at the same time: while the last tasks of one end, cores work on others.
AT_ONCE = 4


def write_marts(t: Tables, folder: str) -> None:
    """Materialise every mart as parquet, for readers outside the session.

    The order-grain fact is stored first, beside them. All marts read their orders from it, and those that need
    items or reviews per order share it: items are read once per grain, for orders, sellers and categories.
    """
    t = stage_facts(t, f"{folder}/order_facts")
    plans = {name: mart(t) for name, mart in MARTS.items()}

    def write(name: str) -> None:
        plans[name].write.mode("overwrite").parquet(f"{folder}/{name}")

    with ThreadPoolExecutor(AT_ONCE) as pool:
        list(pool.map(inheritable_thread_target(write), plans))  # raises what a write raised
