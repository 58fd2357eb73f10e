"""Sellers and product categories: contribution and fulfillment risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.delivery import delivered, delivered_with_evidence, micros_between
from marketlens.functions.exact import exact_sum, mean2, money
from marketlens.functions.measures import average_days, late_rate
from marketlens.operators.grains import category_orders, seller_orders
from marketlens.schema import DELIVERED, PURCHASED, Tables

# Length of the top lists and smallest groups whose risk is reported.
TOP = 20
MIN_SELLER_ORDERS = 100
MIN_CATEGORY_ORDERS = 300


def _delivered_ids(t: Tables) -> DataFrame:
    """For semi-joins: a group and order then stays one row, and counting rows counts distinct orders."""
    return t.orders.filter(delivered()).select("order_id")


def _delivery_facts(t: Tables) -> DataFrame:
    return t.orders.filter(delivered_with_evidence()).select(
        "order_id", "is_late", micros_between(PURCHASED, DELIVERED).alias("_span")
    )


def _risk_measures() -> list[Column]:
    """Aggregates over one row per group and order."""
    return [
        F.count(F.lit(1)).alias("n_orders"),
        money(exact_sum(F.col("price_cents"))).alias("merchandise_gmv"),
        F.count_if("is_late").alias("n_late"),
        F.count("is_late").alias("n_flagged"),
        exact_sum(F.col("_span")).alias("us_actual"),
        F.count("_span").alias("n_actual"),
    ]


def top_sellers(t: Tables, top: int = TOP) -> DataFrame:
    """The sellers with the highest merchandise value of delivered orders."""
    return (
        seller_orders(t.order_items)
        .join(_delivered_ids(t), "order_id", "left_semi")
        .groupBy("seller_id")
        .agg(
            F.count("order_id").alias("orders"),
            F.sum("items").alias("items_sold"),
            money(exact_sum(F.col("price_cents"))).alias("merchandise_gmv"),
            money(exact_sum(F.col("freight_cents"))).alias("freight_value"),
        )
        .withColumn("gmv_per_order", mean2(F.col("merchandise_gmv"), F.col("orders")))
        .orderBy(F.desc_nulls_first("merchandise_gmv"), "seller_id")
        .limit(top)
    )


def seller_performance(t: Tables, min_orders: int = MIN_SELLER_ORDERS) -> DataFrame:
    """Volume and lateness of the sellers with enough orders, in no order."""
    return (
        seller_orders(t.order_items)
        .join(_delivery_facts(t), "order_id")
        .groupBy("seller_id")
        .agg(*_risk_measures())
        .filter(F.col("n_orders") >= min_orders)
        .select(
            "seller_id",
            F.col("n_orders").alias("seller_orders"),
            "merchandise_gmv",
            F.col("n_late").alias("late_orders"),
            late_rate().alias("late_rate_pct"),
            average_days("actual").alias("avg_delivery_days"),
        )
    )


def seller_risk(t: Tables, min_orders: int = MIN_SELLER_ORDERS) -> DataFrame:
    """The sellers with the most late orders first."""
    return seller_performance(t, min_orders).orderBy(F.desc("late_orders"), "seller_id")


def top_categories(t: Tables, top: int = TOP, shuffled: bool = False) -> DataFrame:
    """The categories with the highest merchandise value of delivered orders."""
    return (
        category_orders(t, shuffled)
        .join(_delivered_ids(t), "order_id", "left_semi")
        .groupBy("product_category")
        .agg(
            F.count("order_id").alias("orders"),
            F.sum("items").alias("items_sold"),
            money(exact_sum(F.col("price_cents"))).alias("merchandise_gmv"),
            F.sum("priced_items").alias("_priced"),
        )
        .select(
            "product_category",
            "orders",
            "items_sold",
            "merchandise_gmv",
            mean2(F.col("merchandise_gmv"), F.col("orders")).alias("category_revenue_per_order"),
            mean2(F.col("merchandise_gmv"), F.col("_priced")).alias("avg_item_price"),
        )
        .orderBy(F.desc_nulls_first("merchandise_gmv"), "product_category")
        .limit(top)
    )


def category_performance(t: Tables, min_orders: int = MIN_CATEGORY_ORDERS, shuffled: bool = False) -> DataFrame:
    """Value, volume and lateness of the categories with enough orders, in no order."""
    return (
        category_orders(t, shuffled)
        .join(_delivery_facts(t), "order_id")
        .groupBy("product_category")
        .agg(*_risk_measures())
        .filter(F.col("n_orders") >= min_orders)
        .select(
            "product_category",
            F.col("n_orders").alias("category_orders"),
            "merchandise_gmv",
            F.col("n_late").alias("late_orders"),
            late_rate().alias("late_rate_pct"),
            average_days("actual").alias("avg_delivery_days"),
        )
    )


def category_risk(t: Tables, min_orders: int = MIN_CATEGORY_ORDERS) -> DataFrame:
    """The categories with the most late orders first, without their value."""
    return (
        category_performance(t, min_orders)
        .drop("merchandise_gmv")
        .orderBy(F.desc("late_orders"), "product_category")
    )
