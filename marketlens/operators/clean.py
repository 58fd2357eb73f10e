"""Cleaning: typing, derived columns and categories, one lazy function per table.

Missing values are NULL already: the readers of text files see to that.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions import delivery
from marketlens.functions.exact import MICROS_PER_SECOND
from marketlens.functions.text import cast_known, parse_timestamps
from marketlens.operators.lookup import lookup_join
from marketlens.schema import (
    APPROVED,
    COLUMN_TYPES,
    DELIVERED,
    ITEM_TIMESTAMPS,
    ORDER_TIMESTAMPS,
    PURCHASED,
    REVIEW_TIMESTAMPS,
    RawTables,
    Tables,
)

#: Per column the layout of its timestamps.
Layouts = Mapping[str, str] | None

# Fixed value: category of a product whose category is missing or has no translation.
UNKNOWN_CATEGORY = "unknown"


def seconds_between(start: str, end: str) -> Column:
    """Seconds as a double, with their fraction."""
    return delivery.micros_between(start, end) / MICROS_PER_SECOND


def clean_orders(raw: DataFrame, layouts: Layouts = None) -> DataFrame:
    """Type the lifecycle timestamps, add status flags, durations and the late flag."""
    typed = parse_timestamps(raw, ORDER_TIMESTAMPS, layouts)
    return typed.withColumns(
        {
            "is_delivered": delivery.has_status(delivery.STATUS_DELIVERED),
            "is_canceled": delivery.has_status(delivery.STATUS_CANCELED),
            "approval_hours": seconds_between(PURCHASED, APPROVED) / 3600,
            "delivery_days": seconds_between(PURCHASED, DELIVERED) / 86400,
            "delay_days": delivery.delay_days(),
            "is_late": delivery.late_flag(delivery.delay_days()),
        }
    )


def clean_order_items(raw: DataFrame, layouts: Layouts = None) -> DataFrame:
    """Type the shipping limit and the money columns, add the total value of the item."""
    typed = cast_known(parse_timestamps(raw, ITEM_TIMESTAMPS, layouts), COLUMN_TYPES["order_items"])
    return typed.withColumn("item_total_value", F.col("price") + F.col("freight_value"))


def rename_products(raw: DataFrame) -> DataFrame:
    """Correct the two misspelt column names."""
    return raw.withColumnsRenamed(
        {
            "product_name_lenght": "product_name_length",
            "product_description_lenght": "product_description_length",
        }
    )


def translate_category(products: DataFrame, translation: DataFrame, shuffled: bool = False) -> DataFrame:
    """Add ``product_category``, the translated name; NULL where there is none.

    A missing category matches a missing key of the translation.
    """
    names = translation.select(
        "product_category_name",
        F.col("product_category_name_english").alias("product_category"),
    )
    return lookup_join(products, names, "product_category_name", "left", null_safe=True, shuffled=shuffled)


def fill_category(products: DataFrame) -> DataFrame:
    return products.fillna(UNKNOWN_CATEGORY, subset=["product_category"])


def clean_products(raw: DataFrame, translation: DataFrame) -> DataFrame:
    typed = cast_known(raw, COLUMN_TYPES["products"])
    return fill_category(translate_category(rename_products(typed), translation))


def clean_reviews(raw: DataFrame, layouts: Layouts = None) -> DataFrame:
    """Type the review timestamps and the score."""
    return cast_known(parse_timestamps(raw, REVIEW_TIMESTAMPS, layouts), COLUMN_TYPES["reviews"])


def clean_tables(raw: RawTables, layouts: Mapping[str, Mapping[str, str]] | None = None) -> Tables:
    """The cleaned tables; ``layouts`` names per table the layouts of timestamp columns that are not the usual one."""
    layouts = layouts or {}
    return Tables(
        orders=lambda: clean_orders(raw.orders, layouts.get("orders")),
        customers=lambda: raw.customers,
        order_items=lambda: clean_order_items(raw.order_items, layouts.get("order_items")),
        products=lambda: clean_products(raw.products, raw.category_translation),
        sellers=lambda: raw.sellers,
        reviews=lambda: clean_reviews(raw.reviews, layouts.get("reviews")),
    )
