"""The marketplace model over the TPC-H-like test tables.

The test tables have no lifecycle timestamps, reviews or categories; they are derived from
the keys by whole-number arithmetic, row by row. Dates are moved by 22 years, so that the
default calendar ranges of the analyses cut through the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.functions import delivery
from marketlens.functions.text import missing_to_null
from marketlens.operators.clean import UNKNOWN_CATEGORY, clean_order_items, clean_orders
from marketlens.schema import (
    APPROVED,
    CARRIER,
    DELIVERED,
    ESTIMATED,
    MONEY,
    ORDER_TIMESTAMPS,
    PURCHASED,
    REVIEW_TIMESTAMPS,
    RawTables,
    Tables,
)

# Fixed value: days from 1995-01-01 to 2017-01-01.
SHIFT_DAYS = 8036
# Brands without a translation.
UNTRANSLATED = ("Brand#7", "Brand#13")


# Declared types of the columns used, so that opening a table needs no look into its files.
COLUMNS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp_ntz",
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_shipdate timestamp_ntz"
    ),
    "customer": "c_custkey bigint, c_nationkey int",
    "nation": "n_nationkey int, n_name string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int",
    "supplier": "s_suppkey bigint",
    "events": "event_id bigint, ts timestamp_ntz, event_type string, value double, props string",
}


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.schema(COLUMNS[table]).parquet(f"{sf_dir}/{table}.parquet")


# Every column may use those above it; ``key`` is the order key.
ORDER_COLUMNS = (
    "o_orderkey AS order_id",
    "o_orderkey AS customer_id",
    f"CASE WHEN key % 1009 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN '{delivery.STATUS_DELIVERED}' "
    f"WHEN o_orderstatus = 'O' THEN 'shipped' ELSE '{delivery.STATUS_CANCELED}' END AS order_status",
    f"timestampadd(SECOND, key * 7919 % 86400, day) AS {PURCHASED}",
    f"CASE WHEN key % 97 <> 0 THEN timestampadd(SECOND, key * 104729 % 172800, {PURCHASED}) END AS {APPROVED}",
    f"CASE WHEN o_orderstatus <> 'P' AND key % 89 <> 0 THEN "
    f"timestampadd(SECOND, key * 15485863 % 432000, coalesce({APPROVED}, {PURCHASED})) END AS {CARRIER}",
    f"CASE WHEN o_orderstatus = 'F' AND key % 50 <> 7 THEN timestampadd(SECOND, key * 32452843 % 1900800, "
    f"coalesce({CARRIER}, {APPROVED}, {PURCHASED})) END AS {DELIVERED}",
    f"CASE WHEN key % 113 <> 0 THEN timestampadd(DAY, 10 + key % 20, day) END AS {ESTIMATED}",
)


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders")
    day = f"timestampadd(DAY, {SHIFT_DAYS}, o_orderdate) AS day"
    return orders.selectExpr("*", "o_orderkey AS key", day).selectExpr(*ORDER_COLUMNS)


def raw_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One customer record per order; a person is a customer key with one of eight tails."""
    records = _read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS customer_id",
        "o_custkey AS c_custkey",
        "concat(o_custkey, '-', o_orderkey % 8) AS customer_unique_id",
    )
    nation = _read(spark, sf_dir, "nation").selectExpr("n_nationkey AS c_nationkey", "n_name AS customer_state")
    states = _read(spark, sf_dir, "customer").join(nation, "c_nationkey")
    return records.join(states, "c_custkey").select("customer_id", "customer_unique_id", "customer_state")


def raw_order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers repeat within an order of the test data, so the item key is not unique."""
    return _read(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS order_id",
        "l_linenumber AS order_item_id",
        "l_partkey AS product_id",
        "l_suppkey AS seller_id",
        f"timestampadd(DAY, {SHIFT_DAYS}, l_shipdate) AS shipping_limit_date",
        f"CAST(l_extendedprice AS {MONEY.simpleString()}) AS price",
        f"CAST(l_quantity AS {MONEY.simpleString()}) AS freight_value",
    )


def raw_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    described = key % 61 != 0
    return _read(spark, sf_dir, "part").select(
        key.alias("product_id"),
        F.when(described, F.col("p_brand")).alias("product_category_name"),
        F.when(described, F.length("p_name")).alias("product_name_lenght"),
        F.when(described, F.length("p_type")).alias("product_description_lenght"),
        F.when(key % 499 != 1, F.col("p_size")).alias("product_weight_g"),
    )


def raw_sellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("seller_id"))


def _english(brand: Column) -> Column:
    return F.concat(F.lit("cat_"), F.substring_index(brand, "#", -1))


def raw_category_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand = F.col("p_brand")
    return (
        _read(spark, sf_dir, "part")
        .filter(~brand.isin(*UNTRANSLATED))
        .select(brand.alias("product_category_name"))
        .distinct()
        .withColumn("product_category_name_english", _english(F.col("product_category_name")))
    )


def raw_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    return _read(spark, sf_dir, "events").select(
        key.alias("review_id"),
        (key - (key % 3) * (key % 2)).alias("order_id"),
        F.when(key % 101 != 0, (1 + F.floor("value") % 5).cast("int")).alias("review_score"),
        F.concat(F.col("event_type"), F.lit('\nsays "'), F.col("props"), F.lit('", twice')).alias(
            "review_comment_message"
        ),
        F.col("ts").alias("review_creation_date"),
        F.timestamp_add("DAY", F.lit(1), F.col("ts")).alias("review_answer_timestamp"),
    )


def raw_tables(spark: SparkSession, sf_dir: str) -> RawTables:
    return RawTables(
        orders=lambda: raw_orders(spark, sf_dir),
        customers=lambda: raw_customers(spark, sf_dir),
        order_items=lambda: raw_order_items(spark, sf_dir),
        products=lambda: raw_products(spark, sf_dir),
        sellers=lambda: raw_sellers(spark, sf_dir),
        reviews=lambda: raw_reviews(spark, sf_dir),
        category_translation=lambda: raw_category_translation(spark, sf_dir),
    )


def _as_text(moment: Column) -> Column:
    return F.substring(moment.cast("string"), 1, 19)


def _order_texts(orders: DataFrame) -> DataFrame:
    key = F.col("order_id")
    texts = {c: _as_text(F.col(c)) for c in ORDER_TIMESTAMPS}
    texts[CARRIER] = (
        F.when(key % 41 == 0, F.lit("junk"))
        .when(key % 43 == 0, F.substring(texts[CARRIER], 1, 10))
        .when(key % 47 == 0, F.lit("NA"))
        .otherwise(texts[CARRIER])
    )
    return orders.withColumns(texts)


def _item_texts(items: DataFrame) -> DataFrame:
    limit = _as_text(F.col("shipping_limit_date"))
    impossible = F.lit("2017-02-30 10:00:00")
    return items.withColumn("shipping_limit_date", F.when(F.col("order_id") % 53 == 0, impossible).otherwise(limit))


def delivered_texts(raw: RawTables) -> RawTables:
    """The raw tables as a file would deliver them: timestamps as text, some of them unreadable."""
    return raw.replacing(
        orders=lambda: _order_texts(raw.orders),
        order_items=lambda: _item_texts(raw.order_items),
        reviews=lambda: raw.reviews.withColumns({c: _as_text(F.col(c)) for c in REVIEW_TIMESTAMPS}),
    )


def in_other_layouts(texts: RawTables) -> RawTables:
    """The same texts, with the timestamps of each table in another layout; what is no timestamp stays as it is."""

    def rewritten(df: DataFrame, names: tuple[str, ...], order: str) -> DataFrame:
        return df.withColumns({c: F.regexp_replace(c, r"^(\d{4})-(\d{2})-(\d{2}) (\d{2}:\d{2}:\d{2})$", order) for c in names})

    return texts.replacing(
        orders=lambda: rewritten(texts.orders, ORDER_TIMESTAMPS, "$3/$2/$1 $4"),
        order_items=lambda: rewritten(texts.order_items, ("shipping_limit_date",), "$2/$3/$1 $4"),
        reviews=lambda: rewritten(texts.reviews, REVIEW_TIMESTAMPS, "$1-$2-$3T$4"),
    )


def damaged_texts(raw: RawTables) -> RawTables:
    """The same with prices and scores that are no such numbers."""
    texts = delivered_texts(raw)
    order, review = F.col("order_id"), F.col("review_id")
    price = F.col("price").cast("string")
    price = F.when(order % 59 == 0, F.lit("12,50")).when(order % 61 == 0, F.lit("1.239")).when(order % 67 == 0, F.lit("99999999999.00")).otherwise(price)
    score = F.when(review % 71 == 0, F.lit("five")).otherwise(F.col("review_score").cast("string"))
    damaged = texts.replacing(
        order_items=lambda: texts.order_items.withColumn("price", price),
        reviews=lambda: texts.reviews.withColumn("review_score", score),
    )
    return RawTables(**{name: missing_to_null(df) for name, df in damaged.as_dict().items()})


def processed_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand = F.col("product_category_name")
    return raw_products(spark, sf_dir).select(
        "product_id",
        brand,
        F.col("product_name_lenght").alias("product_name_length"),
        F.col("product_description_lenght").alias("product_description_length"),
        "product_weight_g",
        F.when(~brand.isin(*UNTRANSLATED), _english(brand))
        .otherwise(F.lit(UNKNOWN_CATEGORY))
        .alias("product_category"),
    )


def processed_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The cleaned tables as a published copy would hold them, without any join or action.

    ``clean_tables(raw_tables(..))`` gives the same rows; there the category needs a join.
    """
    return Tables(
        orders=lambda: clean_orders(raw_orders(spark, sf_dir)),
        customers=lambda: raw_customers(spark, sf_dir),
        order_items=lambda: clean_order_items(raw_order_items(spark, sf_dir)),
        products=lambda: processed_products(spark, sf_dir),
        sellers=lambda: raw_sellers(spark, sf_dir),
        reviews=lambda: raw_reviews(spark, sf_dir),
    )
