"""Tables of the marketplace model: columns, keys and the container the plans work on."""

from __future__ import annotations

from collections.abc import Callable
from typing import Self

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Column names of the lifecycle timestamps, in the order an order passes them.
PURCHASED = "order_purchase_timestamp"
APPROVED = "order_approved_at"
CARRIER = "order_delivered_carrier_date"
DELIVERED = "order_delivered_customer_date"
ESTIMATED = "order_estimated_delivery_date"

ORDER_TIMESTAMPS = (PURCHASED, APPROVED, CARRIER, DELIVERED, ESTIMATED)
ITEM_TIMESTAMPS = ("shipping_limit_date",)
REVIEW_TIMESTAMPS = ("review_creation_date", "review_answer_timestamp")

# Columns of the order-grain fact beyond those of orders and of folded items and reviews.
PURCHASE_MONTH, HAS_ITEMS, HAS_REVIEWS = "purchase_month", "has_items", "has_reviews"

MONEY = T.DecimalType(12, 2)

# Parents stand before their children: the order in which tables are published.
LOAD_ORDER = ("customers", "products", "sellers", "orders", "reviews", "order_items")
RAW_TABLES = (
    "orders",
    "customers",
    "order_items",
    "products",
    "sellers",
    "category_translation",
    "reviews",
)

PRIMARY_KEYS = {
    "orders": "order_id",
    "customers": "customer_id",
    "products": "product_id",
    "sellers": "seller_id",
}
ITEM_KEY = ("order_id", "order_item_id")

# child table, child column, parent table (the parent column has the same name)
FOREIGN_KEYS = (
    ("orders", "customer_id", "customers"),
    ("order_items", "order_id", "orders"),
    ("order_items", "product_id", "products"),
    ("order_items", "seller_id", "sellers"),
)
# The validation gate enforces only the links of the items; orders to customers is profiled.
ENFORCED_FOREIGN_KEYS = tuple(fk for fk in FOREIGN_KEYS if fk[0] == "order_items")

# Types of the columns the engine computes with. Ids stay as the source delivers them
# and columns not named here pass through every step untouched.
COLUMN_TYPES: dict[str, dict[str, T.DataType]] = {
    "orders": {
        **{name: T.TimestampNTZType() for name in ORDER_TIMESTAMPS},
        "is_delivered": T.BooleanType(),
        "is_canceled": T.BooleanType(),
        "approval_hours": T.DoubleType(),
        "delivery_days": T.DoubleType(),
        "delay_days": T.IntegerType(),
        "is_late": T.BooleanType(),
    },
    "customers": {},
    "order_items": {
        "order_item_id": T.IntegerType(),
        "shipping_limit_date": T.TimestampNTZType(),
        "price": MONEY,
        "freight_value": MONEY,
        "item_total_value": T.DecimalType(13, 2),
    },
    "products": {
        "product_name_length": T.IntegerType(),
        "product_description_length": T.IntegerType(),
        "product_name_lenght": T.IntegerType(),
        "product_description_lenght": T.IntegerType(),
    },
    "sellers": {},
    "category_translation": {},
    "reviews": {
        "review_score": T.IntegerType(),
        **{name: T.TimestampNTZType() for name in REVIEW_TIMESTAMPS},
    },
}

# Columns of which no delivered value may be lost; unreadable timestamps are only counted.
STRICT_COLUMNS = {
    "order_items": ("order_item_id", "price", "freight_value"),
    "reviews": ("review_score",),
}


class Tables:
    """The six cleaned tables every analysis and mart reads, as attributes.

    A table may be given as a function; it is then built when it is first asked for, so a
    query over two tables does not open the other four.
    """

    NAMES = LOAD_ORDER
    #: The stored order-grain fact of these tables, if there is one.
    facts: DataFrame | None = None

    def __init__(self, **sources: DataFrame | Callable[[], DataFrame]):
        if set(sources) != set(self.NAMES):
            raise TypeError(f"expected the tables {', '.join(self.NAMES)}")
        self._sources = sources

    def __getattr__(self, name: str) -> DataFrame:
        if name not in type(self).NAMES:
            raise AttributeError(name)
        source = self._sources[name]
        if callable(source):
            source = self._sources[name] = source()
        return source

    def as_dict(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in self.NAMES}

    def with_facts(self, facts: DataFrame) -> Self:
        """The same tables with their order-grain fact, from which plans then aggregate."""
        same = type(self)(**self._sources)
        same.facts = facts
        return same

    def replacing(self, **sources: DataFrame | Callable[[], DataFrame]) -> Self:
        """The same tables with some exchanged, without a fact."""
        return type(self)(**{**self._sources, **sources})


class RawTables(Tables):
    """The seven tables as delivered, before cleaning."""

    NAMES = RAW_TABLES
