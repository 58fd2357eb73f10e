"""Profiling and validation. Reports are small DataFrames; only ``validate`` runs anything."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.functions.text import LAYOUTS, USUAL_LAYOUT, lost, parse_timestamp
from marketlens.schema import (
    APPROVED,
    CARRIER,
    COLUMN_TYPES,
    DELIVERED,
    ENFORCED_FOREIGN_KEYS,
    FOREIGN_KEYS,
    ITEM_KEY,
    PRIMARY_KEYS,
    STRICT_COLUMNS,
    Tables,
)


class DataQualityError(Exception):
    """A key, reference or type rule is broken."""


def _stack(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _missing(name: str) -> Column:
    return F.col(f"`{name}`").isNull()


def _distinct_rows(df: DataFrame) -> DataFrame:
    """Distinct rows (NULL equals NULL) with the number of their copies."""
    return df.groupBy(*(F.col(f"`{c}`") for c in df.columns)).agg(F.count(F.lit(1)).alias("_copies"))


def _or_zero(total: Column) -> Column:
    return F.coalesce(total, F.lit(0)).cast("bigint")


def profile_shape(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows and column names per table."""
    return _stack(
        [
            df.agg(F.count(F.lit(1)).alias("row_count")).select(
                F.lit(name).alias("table_name"),
                "row_count",
                F.lit(len(df.columns)).alias("column_count"),
                F.lit(",".join(df.columns)).alias("column_names"),
            )
            for name, df in tables.items()
        ]
    )


def profile_missing(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Duplicate rows per table and the missing values of each column that has any.

    A table without missing values keeps one row, with a NULL column name and the count 0.
    """
    return _stack([_profile_missing(name, df) for name, df in tables.items()])


def _profile_missing(name: str, df: DataFrame) -> DataFrame:
    counts = F.array(
        *(F.struct(F.lit(c).alias("column_name"), F.col(f"_m{i}").alias("n")) for i, c in enumerate(df.columns))
    )
    return (
        _count_missing(df)
        .select("row_count", "duplicate_rows", F.filter(counts, lambda entry: entry["n"] > 0).alias("found"))
        .select("row_count", "duplicate_rows", F.explode_outer("found").alias("entry"))
        .select(
            F.lit(name).alias("table_name"),
            "row_count",
            F.lit(len(df.columns)).alias("column_count"),
            "duplicate_rows",
            F.col("entry.column_name").alias("column_name"),
            F.coalesce(F.col("entry.n"), F.lit(0)).alias("missing_count"),
        )
    )


def _count_missing(df: DataFrame) -> DataFrame:
    """One row: rows, duplicate rows and the missing values of every column."""
    counts = df.agg(
        F.count(F.lit(1)).alias("row_count"),
        *(F.count_if(_missing(c)).alias(f"_m{i}") for i, c in enumerate(df.columns)),
    )
    return counts.select("*", _duplicate_rows(df).scalar().alias("duplicate_rows"))


#: Places of the bitmap that marks repeated rows: 8 MB, whatever the table.
BITMAP_PLACES = 1 << 26
#: Places of one row of it (a fixed value of the bitmap functions).
BITMAP_ROW = 1 << 15


def _row_hashes(df: DataFrame) -> dict[str, Column]:
    """Two 64-bit hashes of a whole row."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    return {f"_h{seed}": F.xxhash64(F.lit(seed), *columns) for seed in (1, 2)}


def _duplicate_rows(df: DataFrame) -> DataFrame:
    """One row ``n``: the rows that repeat an earlier one (NULL equals NULL).

    Only hashes of rows are shuffled to find those that occur more than once. Their places are marked
    in a bitmap of fixed size, and the rows whose place is marked are compared whole, combined on the
    map side. Rows that only share a place, or a hash, are told apart there: the bitmap saves work and
    decides nothing.
    """
    hashes = _row_hashes(df)
    place = F.pmod(F.col("_h1"), F.lit(BITMAP_PLACES)) + 1
    repeated = df.select(*(h.alias(n) for n, h in hashes.items())).groupBy(*hashes).agg(F.count(F.lit(1)).alias("_copies"))
    marks = (
        repeated.filter("_copies > 1")
        .groupBy(F.bitmap_bucket_number(place).alias("_bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_marks"))
    )
    # at most BITMAP_PLACES / BITMAP_ROW rows of 4 KB
    bounded = F.broadcast(marks)
    rows = df.select(*(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(df.columns)), hashes["_h1"].alias("_h1"))
    byte = F.conv(F.hex(F.substring("_marks", F.expr("bitmap_bit_position(_place) div 8 + 1").cast("int"), F.lit(1))), 16, 10).cast("int")
    marked = (
        rows.withColumn("_place", place)
        .withColumn("_own", F.bitmap_bucket_number("_place"))
        .join(bounded, F.col("_own") == F.col("_bucket"))
        .filter(byte.bitwiseAND(F.expr("shiftleft(1, cast(bitmap_bit_position(_place) % 8 as int))")) != 0)
        .select(*(f"_c{i}" for i in range(len(df.columns))))
    )
    return _distinct_rows(marked).agg(_or_zero(F.sum(F.col("_copies") - 1)).alias("n"))


def profile_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table: rows, columns, duplicate rows, missing cells and columns; largest first."""
    parts = []
    for name, df in tables.items():
        missing = [F.col(f"_m{i}") for i in range(len(df.columns))]
        parts.append(
            _count_missing(df).select(
                F.lit(name).alias("table_name"),
                "row_count",
                F.lit(len(df.columns)).alias("column_count"),
                "duplicate_rows",
                reduce(Column.__add__, missing).alias("missing_cells"),
                reduce(Column.__add__, [(m > 0).cast("int") for m in missing]).alias("missing_columns"),
            )
        )
    return _stack(parts).orderBy(F.desc("row_count"), "table_name")


def key_uniqueness(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows against distinct values of the four single keys and of the item key.

    A single key ignores NULL; NULL parts of the item key count as values.
    """
    parts = [
        tables[table]
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("_copies"))
        .agg(
            _or_zero(F.sum("_copies")).alias("row_count"),
            F.count(key).alias("distinct_keys"),
        )
        .select(F.lit(table).alias("table_name"), F.lit(key).alias("key_columns"), "row_count", "distinct_keys")
        for table, key in PRIMARY_KEYS.items()
    ]
    parts.append(
        _distinct_rows(tables["order_items"].select(*ITEM_KEY))
        .agg(_or_zero(F.sum("_copies")).alias("row_count"), F.count(F.lit(1)).alias("distinct_keys"))
        .select(
            F.lit("order_items").alias("table_name"),
            F.lit(",".join(ITEM_KEY)).alias("key_columns"),
            "row_count",
            "distinct_keys",
        )
    )
    return _stack(parts)


def entity_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Distinct entities, one plain distinct count per row instead of one widened pass."""
    entities = (
        ("customer records", "customers", "customer_id"),
        ("real customers", "customers", "customer_unique_id"),
        ("orders", "orders", "order_id"),
        ("orders with items", "order_items", "order_id"),
        ("products sold", "order_items", "product_id"),
        ("active sellers", "order_items", "seller_id"),
    )
    return _stack(
        [
            tables[table].agg(F.count_distinct(column).alias("distinct_count")).select(
                F.lit(entity).alias("entity"), "distinct_count"
            )
            for entity, table, column in entities
        ]
    )


def _key_sides(children: DataFrame, parents: DataFrame, column: str) -> DataFrame:
    """One row per key: ``_key``, the child rows that bear it, and whether a parent does. NULL is a key.

    Both sides go through one aggregate, combined on the map side: one exchange of keys and counts, in which
    no key is hot.
    """
    child = children.select(F.col(column).alias("_key"), F.lit(1).cast("bigint").alias("_rows"), F.lit(0).alias("_parent"))
    parent = parents.select(F.col(column).alias("_key"), F.lit(0).cast("bigint").alias("_rows"), F.lit(1).alias("_parent"))
    sides = child.unionByName(parent).groupBy("_key").agg(F.sum("_rows").alias("_rows"), F.max("_parent").alias("_parent"))
    return sides.select("_key", "_rows", (F.col("_parent") == 1).alias("_has_parent"))


def _orphans(tables: Mapping[str, DataFrame], child: str, column: str, parent: str) -> DataFrame:
    """One row ``orphans``: child rows without parent. NULL finds only a NULL key."""
    sides = _key_sides(tables[child], tables[parent], column)
    return sides.filter(~F.col("_has_parent")).agg(_or_zero(F.sum("_rows")).alias("orphans"))


def orphan_counts(tables: Mapping[str, DataFrame], foreign_keys=FOREIGN_KEYS) -> DataFrame:
    """Rows per child table whose reference has no parent."""
    return _stack(
        [
            _orphans(tables, child, column, parent).select(
                F.lit(child).alias("child_table"),
                F.lit(column).alias("key_column"),
                F.lit(parent).alias("parent_table"),
                "orphans",
            )
            for child, column, parent in foreign_keys
        ]
    )


def null_counts(df: DataFrame) -> DataFrame:
    """NULLs of every column, most first."""
    wide = df.agg(*(F.count_if(_missing(c)).alias(c) for c in df.columns))
    return wide.unpivot([], df.columns, "column_name", "null_count").orderBy(F.desc("null_count"), "column_name")


def product_missing(products: DataFrame) -> DataFrame:
    """NULLs of the product columns that have any, most first."""
    return null_counts(products).filter(F.col("null_count") > 0)


def null_counts_by_status(orders: DataFrame) -> DataFrame:
    """Unknown lifecycle timestamps per order status; orders without a status are left out."""
    return (
        orders.filter(F.col("order_status").isNotNull())
        .groupBy("order_status")
        .agg(*(F.count_if(_missing(c)).alias(c) for c in (APPROVED, CARRIER, DELIVERED)))
    )


def orders_without_items(orders: DataFrame, order_items: DataFrame) -> DataFrame:
    """The orders that have no item; a NULL id finds only a NULL id.

    The ids without items are found first, from keys alone; whole orders meet only those.
    """
    lacking = _key_sides(orders, order_items, "order_id").filter((F.col("_rows") > 0) & ~F.col("_has_parent"))
    return orders.join(lacking.select("_key"), F.col("order_id").eqNullSafe(F.col("_key")), "left_semi")


def orders_without_items_by_status(orders: DataFrame, order_items: DataFrame) -> DataFrame:
    """How many orders lack items per status, most first; a missing status is left out."""
    return (
        orders_without_items(orders.select("order_id", "order_status"), order_items)
        .filter(F.col("order_status").isNotNull())
        .groupBy("order_status")
        .agg(F.count(F.lit(1)).alias("orders"))
        .orderBy(F.desc("orders"), "order_status")
    )


def review_profile(reviews: DataFrame) -> DataFrame:
    """Rows, distinct reviews, distinct reviewed orders and missing scores.

    The distinct counts are separate aggregates: together they would multiply every row.
    """
    orders = reviews.agg(F.count_distinct("order_id").alias("n"))
    ids = reviews.agg(F.count_distinct("review_id").alias("n"))
    return reviews.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(_missing("review_score")).alias("missing_scores"),
    ).select(
        "row_count",
        ids.scalar().alias("distinct_reviews"),
        orders.scalar().alias("distinct_orders"),
        "missing_scores",
    )


def reviews_per_order(reviews: DataFrame) -> DataFrame:
    """How many orders have one review, two reviews and so on."""
    return (
        reviews.filter(F.col("order_id").isNotNull())
        .groupBy("order_id")
        .agg(F.count(F.lit(1)).alias("reviews"))
        .groupBy("reviews")
        .agg(F.count(F.lit(1)).alias("orders"))
        .orderBy("reviews")
    )


def _as_whole_text(name: str, dtype: T.DataType) -> Column:
    """A value as text that does not depend on how an engine prints numbers and times."""
    value = F.col(name)
    if isinstance(dtype, T.BooleanType):
        value = value.cast("int")
    elif isinstance(dtype, T.TimestampNTZType):
        value = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{name}`)")
    elif isinstance(dtype, T.DoubleType):
        value = F.floor(value * 1000)
    elif isinstance(dtype, T.DecimalType):
        value = (value * 10**dtype.scale).cast("decimal(38,0)")
    return value.cast("string")


def table_contents(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Per column the rows, the known values and a digest: the sum of 32 bits of each value's MD5.

    The digest depends on all values of the column, whatever their order. One pass per table,
    combined on the map side.
    """
    reports = []
    for table, df in tables.items():
        texts = {f.name: _as_whole_text(f.name, f.dataType) for f in df.schema.fields}
        bits = {name: F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") for name, text in texts.items()}
        totals = [F.count(F.lit(1)).alias("_rows")]
        for i, name in enumerate(texts):
            totals += [F.count(F.col(name)).alias(f"_known_{i}"), _or_zero(F.sum(bits[name])).alias(f"_digest_{i}")]
        columns = [
            F.struct(F.lit(name).alias("column_name"), F.col(f"_known_{i}").alias("known"), F.col(f"_digest_{i}").alias("digest"))
            for i, name in enumerate(texts)
        ]
        one = df.agg(*totals).select(F.lit(table).alias("table_name"), F.col("_rows").alias("row_count"), F.explode(F.array(*columns)).alias("c"))
        reports.append(one.select("table_name", "row_count", "c.*"))
    return _stack(reports)


def layout_census(raw: Mapping[str, DataFrame]) -> DataFrame:
    """Per timestamp column that is still text, and known layout, the texts that can be read. One pass per table."""
    reports = []
    for table, df in raw.items():
        columns = [n for n, t in COLUMN_TYPES[table].items() if isinstance(t, T.TimestampNTZType) and dict(df.dtypes).get(n) == "string"]
        if not columns:
            continue
        pairs = [(column, layout) for column in columns for layout in LAYOUTS]
        totals = df.agg(*(F.count(parse_timestamp(F.col(c), layout)).alias(f"_n{i}") for i, (c, layout) in enumerate(pairs)))
        found = [
            F.struct(F.lit(c).alias("column_name"), F.lit(layout).alias("layout"), F.col(f"_n{i}").alias("readable")) for i, (c, layout) in enumerate(pairs)
        ]
        reports.append(totals.select(F.lit(table).alias("table_name"), F.explode(F.array(*found)).alias("c")).select("table_name", "c.*"))
    return _stack(reports) if reports else None


def chosen_layouts(raw: Mapping[str, DataFrame], declared: Mapping[str, Mapping[str, str]] | None = None) -> dict[str, dict[str, str]]:
    """The layout of every timestamp column: the one declared, else the one that reads most of its texts.

    Of two that read as many, the one known first is taken. The report that is collected has a row per column and layout.
    """
    chosen: dict[str, dict[str, str]] = {}
    best: dict[tuple[str, str], int] = {}
    report = layout_census(raw)
    rank = {layout: i for i, layout in enumerate(LAYOUTS)}
    for row in sorted(report.collect() if report is not None else [], key=lambda r: rank[r["layout"]]):
        place = (row["table_name"], row["column_name"])
        if row["readable"] > best.get(place, -1):
            best[place] = row["readable"]
            chosen.setdefault(row["table_name"], {})[row["column_name"]] = row["layout"]
    for table, columns in (declared or {}).items():
        chosen.setdefault(table, {}).update(columns)
    return chosen


def cast_losses(raw: Mapping[str, DataFrame], layouts: Mapping[str, Mapping[str, str]] | None = None) -> DataFrame:
    """Per typed column of the delivered tables the values that are present, and how many are no such value.

    A value is lost if it cannot be read as the declared type, or only by rounding; timestamps must
    have the layout of their column, the usual one unless ``layouts`` names another. One pass per table.
    """
    reports = []
    for table, df in raw.items():
        given = {f.name: f.dataType for f in df.schema.fields}
        columns = [name for name in COLUMN_TYPES[table] if name in given]
        if not columns:
            continue
        own = (layouts or {}).get(table, {})
        totals = []
        for i, name in enumerate(columns):
            is_lost = lost(F.col(name), given[name], COLUMN_TYPES[table][name], own.get(name, USUAL_LAYOUT))
            totals += [F.count(F.col(name)).alias(f"_present_{i}"), F.count_if(is_lost).alias(f"_lost_{i}")]
        rows = [
            F.struct(F.lit(name).alias("column_name"), F.col(f"_present_{i}").alias("present"), F.col(f"_lost_{i}").alias("lost"))
            for i, name in enumerate(columns)
        ]
        one = df.agg(*totals).select(F.lit(table).alias("table_name"), F.explode(F.array(*rows)).alias("c"))
        reports.append(one.select("table_name", "c.*"))
    return _stack(reports)


#: Share of a column's timestamps that may be unreadable before a run stops.
UNREADABLE_SHARE = 0.1


def check_cast_losses(report: DataFrame, unreadable_share: float = UNREADABLE_SHARE) -> None:
    """Raise ``DataQualityError`` if values are lost.

    That is any text that should be a number and is none, or has too many digits or decimals, and more than
    ``unreadable_share`` of the timestamps of a column. Fewer unreadable timestamps are tolerated; the report counts them.
    """
    strict = reduce(or_, [F.col("table_name").eqNullSafe(t) & F.col("column_name").isin(*c) for t, c in STRICT_COLUMNS.items()])
    times = {(t, c) for t, columns in COLUMN_TYPES.items() for c, kind in columns.items() if isinstance(kind, T.TimestampNTZType)}
    is_time = reduce(or_, [(F.col("table_name") == t) & (F.col("column_name") == c) for t, c in sorted(times)])
    too_many = is_time & (F.col("lost") > F.col("present") * F.lit(float(unreadable_share)))
    broken = report.filter(((F.col("lost") > 0) & strict) | too_many).orderBy("table_name", "column_name").collect()
    if broken:
        raise DataQualityError("; ".join(f"{r['table_name']}.{r['column_name']}: {r['lost']} of {r['present']} texts unreadable" for r in broken))


def unique_key_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Per primary key the rows that repeat an earlier key; NULLs repeat each other."""
    return _stack(
        [
            tables[table]
            .groupBy(key)
            .agg((F.count(F.lit(1)) - 1).alias("_extra"))
            .agg(_or_zero(F.sum("_extra")).alias("violations"))
            .select(
                F.lit(f"{table}.{key} is unique").alias("rule"),
                "violations",
                (F.col("violations") == 0).alias("passed"),
            )
            for table, key in PRIMARY_KEYS.items()
        ]
    )


def foreign_key_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Per enforced reference the child rows without parent."""
    return orphan_counts(tables, ENFORCED_FOREIGN_KEYS).select(
        F.concat_ws(" ", F.concat_ws(".", "child_table", "key_column"), F.lit("exists in"), "parent_table").alias(
            "rule"
        ),
        F.col("orphans").alias("violations"),
        (F.col("orphans") == 0).alias("passed"),
    )


def validate(tables: Tables) -> None:
    """Raise ``DataQualityError`` naming every broken rule. The reports have seven rows."""
    named = tables.as_dict()
    report = unique_key_report(named).unionByName(foreign_key_report(named))
    broken = report.filter(~F.col("passed")).orderBy("rule").collect()
    if broken:
        raise DataQualityError("; ".join(f"{row['rule']}: {row['violations']} violations" for row in broken))
