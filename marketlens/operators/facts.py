"""The order-grain fact: every order with the sums of its items and reviews, stored by month of purchase.

Marts that need items or reviews per order aggregate from it, so that the two large tables are read and
folded once, and a mart over a range of months reads no other month.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.operators.grains import item_totals, order_reviews
from marketlens.schema import HAS_ITEMS, HAS_REVIEWS, PURCHASE_MONTH, PURCHASED, Tables


def order_facts(t: Tables) -> DataFrame:
    """All orders, with the columns of their folded items and reviews and whether they have any.

    Both joins have at most one row per order on either side, as ``validate`` asserts for orders.
    """
    items = item_totals(t.order_items).withColumn(HAS_ITEMS, F.lit(True))
    reviews = order_reviews(t.reviews).withColumn(HAS_REVIEWS, F.lit(True))
    joined = t.orders.join(items, "order_id", "left").join(reviews, "order_id", "left")
    known = {name: F.coalesce(name, F.lit(False)) for name in (HAS_ITEMS, HAS_REVIEWS)}
    return joined.withColumns({**known, PURCHASE_MONTH: F.trunc(PURCHASED, "MM")})


def stage_facts(t: Tables, folder: str) -> Tables:
    """Store the fact in ``folder``, a partition per month, and return the tables with it; their orders are its rows.

    Rows are dealt by month before they are written; large months are divided, small ones share a task.
    """
    facts = order_facts(t)
    facts.hint("rebalance", PURCHASE_MONTH).write.mode("overwrite").partitionBy(PURCHASE_MONTH).parquet(folder)
    stored = facts.sparkSession.read.schema(facts.schema).parquet(folder)
    return t.replacing(orders=stored.select(*t.orders.columns)).with_facts(stored)
