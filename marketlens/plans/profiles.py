"""The profiling reports by name, each over the raw tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame

from marketlens.operators import quality
from marketlens.schema import RawTables

# Reports that take any tables by name, also some beyond the model.
TABLE_PROFILES: dict[str, Callable[[Mapping[str, DataFrame]], DataFrame]] = {
    "profile_shape": quality.profile_shape,
    "profile_missing": quality.profile_missing,
    "profile_tables": quality.profile_tables,
    "key_uniqueness": quality.key_uniqueness,
    "entity_counts": quality.entity_counts,
    "orphan_counts": quality.orphan_counts,
}


def _of_tables(report: Callable[[Mapping[str, DataFrame]], DataFrame]) -> Callable[[RawTables], DataFrame]:
    return lambda raw: report(raw.as_dict())


PROFILES: dict[str, Callable[[RawTables], DataFrame]] = {
    **{name: _of_tables(report) for name, report in TABLE_PROFILES.items()},
    "null_counts_orders": lambda raw: quality.null_counts(raw.orders),
    "null_counts_by_status": lambda raw: quality.null_counts_by_status(raw.orders),
    "orders_without_items": lambda raw: quality.orders_without_items(raw.orders, raw.order_items),
    "orders_without_items_by_status": lambda raw: quality.orders_without_items_by_status(
        raw.orders, raw.order_items
    ),
    "product_missing": lambda raw: quality.product_missing(raw.products),
    "review_profile": lambda raw: quality.review_profile(raw.reviews),
    "reviews_per_order_hist": lambda raw: quality.reviews_per_order(raw.reviews),
}
