"""Fulfillment: delivery speed, bands, stages and states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions import delivery
from marketlens.functions.exact import MICROS_PER_DAY, pct2, ratio2
from marketlens.functions.measures import LATENESS, average_days, average_late_delay, late_rate, measures_of_spans, order_measures
from marketlens.operators.grains import state_measures
from marketlens.operators.median import middle_sum
from marketlens.schema import DELIVERED, PURCHASED, Tables

# Fixed value: states with fewer delivered orders are not reported.
MIN_STATE_ORDERS = 100

STAGE_SPANS = ("pre_carrier", "transit", "actual")
PROMISE_SPANS = ("promised", "actual", "buffer")


def overall(
    t: Tables,
    count_name: str = "delivered_orders",
    late_delay_name: str = "avg_delay_days_for_late_orders",
) -> DataFrame:
    """Delivery speed and lateness in one row."""
    orders = t.orders.filter(delivery.delivered_with_evidence())
    span = delivery.micros_between(PURCHASED, DELIVERED).alias("span")
    figures = middle_sum(orders.select(span, *LATENESS), "span", measures_of_spans("actual", F.col("span")))
    return figures.select(
        F.coalesce("n_orders", F.lit(0)).alias(count_name),
        average_days("actual").alias("avg_delivery_days"),
        ratio2(F.col("middle_sum"), F.lit(2 * MICROS_PER_DAY).cast("decimal(20,0)")).alias("median_delivery_days"),
        late_rate().alias("late_rate_pct"),
        average_late_delay().alias(late_delay_name),
    )


def band_counts(t: Tables) -> DataFrame:
    """Orders and share per band rank. The window sees at most seven rows."""
    return (
        t.orders.filter(delivery.delivered_with_evidence())
        .groupBy(delivery.band_rank(F.col("delay_days")).alias("sort_order"))
        .agg(F.count(F.lit(1)).alias("orders"))
        .withColumn("share_pct", pct2(F.col("orders"), F.sum("orders").over(Window.partitionBy())))
    )


def bands(t: Tables) -> DataFrame:
    """Orders per delivery band from early to late; orders of unknown delay come last."""
    label = delivery.band_label(F.col("sort_order"), delivery.UNKNOWN_BAND)
    return (
        band_counts(t)
        .orderBy(F.asc_nulls_last("sort_order"))
        .select(label.alias("delivery_band"), "orders", "share_pct")
    )


def states(t: Tables, min_orders: int, *spans: str) -> DataFrame:
    """Measures of the states with enough delivered orders."""
    return state_measures(t, *spans).filter(F.col("n_orders") >= min_orders)


def state_performance(t: Tables, min_orders: int = MIN_STATE_ORDERS) -> DataFrame:
    """Speed and lateness per state, highest late rate first."""
    return (
        states(t, min_orders, "actual")
        .select(
            "customer_state",
            F.col("n_orders").alias("delivered_orders"),
            average_days("actual").alias("avg_delivery_days"),
            late_rate().alias("late_rate_pct"),
            average_late_delay().alias("avg_delay_days_for_late_orders"),
        )
        .orderBy(F.desc_nulls_first("late_rate_pct"), "customer_state")
    )


def stages(t: Tables) -> DataFrame:
    """Average days before the carrier, in transit and in total."""
    orders = t.orders.filter(delivery.delivered_with_stages())
    return orders.agg(*order_measures(*STAGE_SPANS)).select(
        average_days("pre_carrier").alias("avg_pre_carrier_days"),
        average_days("transit").alias("avg_transit_days"),
        average_days("actual").alias("avg_total_delivery_days"),
    )


def stage_by_lateness(t: Tables) -> DataFrame:
    """The stages of late orders beside those of all others."""
    return (
        t.orders.filter(delivery.delivered_with_stages())
        .groupBy(delivery.late_label().alias("delivery_status"))
        .agg(*order_measures(*STAGE_SPANS))
        .select(
            "delivery_status",
            F.col("n_orders").alias("orders"),
            average_days("pre_carrier").alias("avg_pre_carrier_days"),
            average_days("transit").alias("avg_transit_days"),
            average_days("actual").alias("avg_total_delivery_days"),
        )
    )


def stage_late_vs_ontime(t: Tables) -> DataFrame:
    return stage_by_lateness(t).orderBy("delivery_status")


def promise_by_state(t: Tables, min_orders: int = MIN_STATE_ORDERS) -> DataFrame:
    """Promised against actual days per state, longest promise first."""
    return (
        states(t, min_orders, *PROMISE_SPANS)
        .select(
            "customer_state",
            F.col("n_orders").alias("delivered_orders"),
            average_days("promised").alias("avg_promised_days"),
            average_days("actual").alias("avg_actual_delivery_days"),
            average_days("buffer").alias("avg_delivery_buffer_days"),
            late_rate().alias("late_rate_pct"),
        )
        .orderBy(F.desc_nulls_first("avg_promised_days"), "customer_state")
    )


def state_priority(t: Tables, min_orders: int = MIN_STATE_ORDERS) -> DataFrame:
    """Rate, volume and promise of every state side by side, in no order."""
    return states(t, min_orders, *PROMISE_SPANS).select(
        "customer_state",
        F.col("n_orders").alias("delivered_orders"),
        F.col("n_late").alias("late_orders"),
        late_rate().alias("late_rate_pct"),
        average_days("actual").alias("avg_actual_delivery_days"),
        average_days("promised").alias("avg_promised_days"),
        average_days("buffer").alias("avg_buffer_days"),
    )


def priority_by_state(t: Tables, min_orders: int = MIN_STATE_ORDERS) -> DataFrame:
    """The states with the most late orders first."""
    return state_priority(t, min_orders).orderBy(F.desc("late_orders"), "customer_state")
