"""Business overview: coverage, status mix, sales and growth."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.exact import exact_sum, growth2, mean2, mean_money2, money, pct2
from marketlens.operators.grains import delivered_sales
from marketlens.schema import PURCHASED, Tables

# Fixed value: first month whose growth the analysis reports.
GROWTH_SINCE = dt.date(2017, 2, 1)


def coverage(t: Tables) -> DataFrame:
    """First and last purchase and the number of orders."""
    return t.orders.agg(
        F.min(PURCHASED).alias("first_order_date"),
        F.max(PURCHASED).alias("last_order_date"),
        F.count(F.lit(1)).alias("total_orders"),
    )


def counted_share(df: DataFrame, key: str, count_name: str, share_name: str) -> DataFrame:
    """Rows per key and their share of all rows.

    The total is a scalar subquery, not a window over the groups: nothing bounds their number.
    """
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return (
        df.groupBy(key)
        .agg(F.count(F.lit(1)).alias(count_name))
        .withColumn(share_name, pct2(F.col(count_name), total.scalar()))
    )


def status_share(t: Tables) -> DataFrame:
    """Orders per status, most first."""
    shares = counted_share(t.orders, "order_status", "orders", "order_share_pct")
    return shares.orderBy(F.desc("orders"), "order_status")


def delivered_overview(t: Tables) -> DataFrame:
    """Sales of delivered orders in one row."""
    orders = F.count_distinct("order_id")
    merchandise = exact_sum(F.col("price_cents"))
    return delivered_sales(t).agg(
        orders.alias("delivered_orders"),
        money(merchandise).alias("merchandise_gmv"),
        money(exact_sum(F.col("freight_cents"))).alias("freight_revenue"),
        money(exact_sum(F.col("total_cents"))).alias("gross_order_value"),
        mean_money2(merchandise, orders).alias("merchandise_aov"),
    )


def monthly_sales(t: Tables, within: Column | None = None) -> DataFrame:
    """Delivered orders and their merchandise value per month of purchase."""
    sales = delivered_sales(t)
    if within is not None:
        sales = sales.filter(within)
    return sales.groupBy(F.trunc(PURCHASED, "MM").alias("month")).agg(
        F.count_distinct("order_id").alias("orders"),
        money(exact_sum(F.col("price_cents"))).alias("merchandise_gmv"),
    )


def with_growth(monthly: DataFrame) -> DataFrame:
    """Growth against the previous month that has sales; an unknown month stands last.

    The window runs over one row per calendar month, never over orders.
    """
    by_month = Window.orderBy(F.asc_nulls_last("month"))
    return monthly.withColumns(
        {
            "order_mom_pct": growth2(F.col("orders"), F.lag("orders").over(by_month)),
            "gmv_mom_pct": growth2(F.col("merchandise_gmv"), F.lag("merchandise_gmv").over(by_month)),
        }
    )


def monthly(t: Tables) -> DataFrame:
    """Orders, merchandise value and average order value per month."""
    return (
        monthly_sales(t)
        .withColumn("aov", mean2(F.col("merchandise_gmv"), F.col("orders")))
        .orderBy(F.asc_nulls_last("month"))
    )


def mom_growth(t: Tables, since: dt.date = GROWTH_SINCE) -> DataFrame:
    """Monthly growth from ``since`` on; the first month shown still sees its predecessor."""
    return with_growth(monthly_sales(t)).filter(F.col("month") >= F.lit(since)).orderBy("month")
