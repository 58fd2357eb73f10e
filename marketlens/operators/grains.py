"""The grains the analyses aggregate from.

Facts are brought to the grain of the join key before they are joined: the shuffle then
carries combined rows and a key that holds a large part of the rows arrives as one row.
Amounts are carried in hundredths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions.delivery import delivered, delivered_with_evidence
from marketlens.functions.exact import cents_sum
from marketlens.functions.measures import order_measures, resum
from marketlens.operators.lookup import lookup_join
from marketlens.schema import HAS_ITEMS, HAS_REVIEWS, Tables


def item_totals(order_items: DataFrame) -> DataFrame:
    """One row per order that has items."""
    return order_items.groupBy("order_id").agg(
        cents_sum(F.col("price")).alias("price_cents"),
        cents_sum(F.col("freight_value")).alias("freight_cents"),
        cents_sum(F.col("item_total_value")).alias("total_cents"),
    )


def delivered_sales(t: Tables) -> DataFrame:
    """Delivered orders that have items, with the sums of their items."""
    if t.facts is not None:
        return t.facts.filter(delivered() & F.col(HAS_ITEMS))
    return t.orders.filter(delivered()).join(item_totals(t.order_items), "order_id")


def seller_orders(order_items: DataFrame) -> DataFrame:
    """One row per seller and order."""
    return order_items.groupBy("seller_id", "order_id").agg(
        F.count(F.lit(1)).alias("items"),
        cents_sum(F.col("price")).alias("price_cents"),
        cents_sum(F.col("freight_value")).alias("freight_cents"),
    )


def category_orders(t: Tables, shuffled: bool = False) -> DataFrame:
    """One row per order and product category, with the items, their prices and their sum."""
    items = t.order_items.select("order_id", "product_id", "price").filter(F.col("product_id").isNotNull())
    products = t.products.select("product_id", "product_category")
    return (
        lookup_join(items, products, "product_id", "inner", shuffled=shuffled)
        .groupBy("order_id", "product_category")
        .agg(
            F.count(F.lit(1)).alias("items"),
            cents_sum(F.col("price")).alias("price_cents"),
            F.count("price").alias("priced_items"),
        )
    )


def state_measures(t: Tables, *spans: str) -> DataFrame:
    """Delivery measures per customer state, of delivered orders with a known delivery time.

    Summed per customer record before the join, so both of its sides have unique keys.
    """
    per_customer = t.orders.filter(delivered_with_evidence()).groupBy("customer_id").agg(*order_measures(*spans))
    return (
        per_customer.join(t.customers.select("customer_id", "customer_state"), "customer_id")
        .groupBy("customer_state")
        .agg(*resum(*spans))
    )


def order_reviews(reviews: DataFrame) -> DataFrame:
    """One row per reviewed order: sum and number of its known scores."""
    return reviews.groupBy("order_id").agg(
        F.sum("review_score").alias("score_sum"),
        F.count("review_score").alias("scores"),
    )


def reviewed_deliveries(t: Tables) -> DataFrame:
    """Delivered orders with a known delivery time that were reviewed."""
    if t.facts is not None:
        reviewed = t.facts.filter(delivered_with_evidence() & F.col(HAS_REVIEWS))
        return reviewed.select("order_id", "delay_days", "is_late", "score_sum", "scores")
    return (
        t.orders.filter(delivered_with_evidence())
        .select("order_id", "delay_days", "is_late")
        .join(order_reviews(t.reviews), "order_id")
    )
