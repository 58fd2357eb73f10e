"""Profiling and validation on hand-made rows."""

import pytest
from pyspark.sql import functions as F
from build import item, order, row_dicts, rows, tables

from marketlens.operators import quality
from marketlens.operators.quality import DataQualityError, validate


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_duplicates_and_missing_values_treat_null_as_equal(spark):
    df = frame(spark, [(1, None), (1, None), (2, "x")], "a int, b string")
    profile = row_dicts(quality.profile_tables({"t": df}))
    assert profile == [
        {"table_name": "t", "row_count": 3, "column_count": 2, "duplicate_rows": 1, "missing_cells": 2, "missing_columns": 1}
    ]
    assert rows(quality.profile_missing({"t": df})) == [("t", 3, 2, 1, "b", 2)]


def test_profile_of_complete_and_of_empty_tables(spark):
    full = frame(spark, [(1,)], "a int")
    empty = frame(spark, [], "a int, b int")
    assert sorted(rows(quality.profile_missing({"full": full, "empty": empty}))) == [
        ("empty", 0, 2, 0, None, 0),
        ("full", 1, 1, 0, None, 0),
    ]
    assert sorted(rows(quality.profile_shape({"full": full, "empty": empty}))) == [
        ("empty", 0, 2, "a,b"),
        ("full", 1, 1, "a"),
    ]


def test_key_counts_ignore_null_in_single_keys_but_not_in_the_item_key(spark):
    items = frame(spark, [("1", None), ("1", None), ("1", 2)], "order_id string, order_item_id int")
    one = frame(spark, [("a",), ("a",), (None,)], "order_id string")
    named = {
        "orders": one,
        "customers": one.withColumnRenamed("order_id", "customer_id"),
        "products": one.withColumnRenamed("order_id", "product_id"),
        "sellers": one.withColumnRenamed("order_id", "seller_id"),
        "order_items": items,
    }
    got = {r["table_name"]: (r["row_count"], r["distinct_keys"]) for r in row_dicts(quality.key_uniqueness(named))}
    assert got == {"orders": (3, 1), "customers": (3, 1), "products": (3, 1), "sellers": (3, 1), "order_items": (3, 2)}


@pytest.mark.parametrize(("parents", "expected"), [(["a"], 3), (["a", None], 2)])
def test_null_child_key_is_an_orphan_without_a_null_parent(spark, parents, expected):
    child = frame(spark, [("a",), ("b",), ("b",), (None,)], "k string")
    parent = frame(spark, [(p,) for p in parents], "k string")
    report = quality.orphan_counts({"c": child, "p": parent}, (("c", "k", "p"),))
    assert rows(report) == [("c", "k", "p", expected)]


def test_null_counts_by_status_leaves_out_orders_without_status(spark):
    t = tables(spark, orders=[order("a"), order("b", status=None), order("c", approved="2017-01-01 01:00:00")])
    assert rows(quality.null_counts_by_status(t.orders)) == [("delivered", 1, 2, 2)]


def test_orders_without_items(spark):
    t = tables(
        spark,
        orders=[order("a"), order("b", status="canceled"), order("c", status="canceled"), order("d", status=None)],
        items=[item("a", "1.00")],
    )
    lacking = quality.orders_without_items(t.orders, t.order_items)
    assert sorted(r["order_id"] for r in lacking.collect()) == ["b", "c", "d"]
    assert rows(quality.orders_without_items_by_status(t.orders, t.order_items)) == [("canceled", 2)]


def test_review_profile_and_histogram(spark):
    t = tables(spark, reviews=[("r1", "a", 1), ("r2", "a", None), ("r2", "b", 5), ("r3", None, 2)])
    assert rows(quality.review_profile(t.reviews)) == [(4, 3, 2, 1)]
    assert rows(quality.reviews_per_order(t.reviews)) == [(1, 1), (2, 1)]


def test_entity_counts_ignore_null(spark):
    t = tables(
        spark,
        orders=[order("a"), order("b")],
        items=[item("a", "1.00"), item("a", "2.00", product=None)],
        customers=[("c1", "u1", "X"), ("c2", "u1", "X"), ("c3", None, "Y")],
    )
    assert rows(quality.entity_counts(t.as_dict())) == [
        ("customer records", 3),
        ("real customers", 1),
        ("orders", 2),
        ("orders with items", 1),
        ("products sold", 1),
        ("active sellers", 1),
    ]


def good(spark, **changed):
    parts = {
        "orders": [order("a")],
        "items": [item("a", "1.00")],
        "customers": [("c-a", "u", "X")],
        "products": [("p1", "toys")],
        "sellers": ["s1"],
        **changed,
    }
    return tables(spark, **parts)


def test_valid_tables_pass(spark):
    validate(good(spark))


@pytest.mark.parametrize(
    ("changed", "message"),
    [
        ({"orders": [order("a"), order("a")]}, "orders.order_id is unique: 1"),
        ({"sellers": ["s1", None, None]}, "sellers.seller_id is unique: 1"),
        ({"items": [item("a", "1.00", seller="s9")]}, "order_items.seller_id exists in sellers: 1"),
        ({"items": [item("z", "1.00"), item("z", "1.00", number=2)]}, "order_items.order_id exists in orders: 2"),
        ({"items": [item("a", "1.00", product=None)]}, "order_items.product_id exists in products: 1"),
    ],
)
def test_broken_rules_are_named(spark, changed, message):
    with pytest.raises(DataQualityError, match=message):
        validate(good(spark, **changed))


def test_customers_of_orders_are_profiled_but_not_enforced(spark):
    t = good(spark, customers=[("someone else", "u", "X")])
    validate(t)
    orphans = {r["child_table"] + "." + r["key_column"]: r["orphans"] for r in row_dicts(quality.orphan_counts(t.as_dict()))}
    assert orphans["orders.customer_id"] == 1


def test_unreadable_money_and_scores_are_reported_and_stop_the_run(spark):
    texts = [("o1", "1", "10.50", "1.00"), ("o2", "1", "12,50", "1"), ("o3", "x", "1.239", None), ("o4", "1", "99999999999.00", "2.5")]
    items = spark.createDataFrame(texts, "order_id string, order_item_id string, price string, freight_value string")
    reviews = spark.createDataFrame([("r1", "5", "junk"), ("r2", "five", "2018-01-01 00:00:00")], "review_id string, review_score string, review_creation_date string")
    report = quality.cast_losses({"order_items": items, "reviews": reviews})
    assert sorted(map(tuple, report.collect())) == [
        ("order_items", "freight_value", 3, 0),
        ("order_items", "order_item_id", 4, 1),
        ("order_items", "price", 4, 3),
        ("reviews", "review_creation_date", 2, 1),
        ("reviews", "review_score", 2, 1),
    ]
    with pytest.raises(quality.DataQualityError, match="order_items.price: 3 of 4"):
        quality.check_cast_losses(report)
    quality.check_cast_losses(report.where("column_name = 'review_creation_date'"))


def duplicate_table(spark):
    """Copies, rows that differ only in where a null is, and rows that occur once."""
    data = [("a", None, 1)] * 3 + [(None, "a", 1)] * 2 + [(None, None, None)] * 2 + [(f"t{i}", "x" * 50, i) for i in range(40)] + [("", "a", 1)]
    return spark.createDataFrame(data, "t string, `a.b` string, _h1 int").repartition(5)


@pytest.mark.parametrize("hashes", ["own", "all alike", "few places"])
def test_duplicates_are_compared_whole(spark, monkeypatch, hashes):
    if hashes == "all alike":
        monkeypatch.setattr(quality, "_row_hashes", lambda df: {"_h1": F.lit(7).cast("long"), "_h2": F.lit(7).cast("long")})
    elif hashes == "few places":
        monkeypatch.setattr(quality, "BITMAP_PLACES", 4)
    found = quality.profile_missing({"t": duplicate_table(spark), "none": duplicate_table(spark).limit(0)})
    assert sorted(map(repr, rows(found.select("table_name", "row_count", "duplicate_rows", "column_name", "missing_count")))) == sorted(
        map(repr, [("t", 48, 4, "t", 4), ("t", 48, 4, "a.b", 5), ("t", 48, 4, "_h1", 2), ("none", 0, 0, None, 0)])
    )


def test_rows_that_occur_once_are_not_shuffled_whole(spark):
    plan = quality._duplicate_rows(duplicate_table(spark))._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    whole = [line for line in exchanges if "_c0" in line]
    assert len(whole) == 1 and any("_h1" in line and "_h2" in line and "_c" not in line for line in exchanges)
    below = plan[plan.index(whole[0]) :]
    assert "partial_count" in below.splitlines()[1] and below.index("BroadcastHashJoin") < below.index("BroadcastExchange")


def test_orphans_and_orders_without_items_with_null_and_hot_ids(spark):
    hot = [(7, i) for i in range(500)]
    items = frame(spark, [*hot, (None, 1), (None, 2), (9, 1)], "order_id int, order_item_id int")
    for parents, orphans, lacking in (([1, 7, 7, 7], 3, [1]), ([None, 9, 9, 2, 2], 500, [2, 2]), ([], 503, [])):
        orders = frame(spark, [(p, "x") for p in parents], "order_id int, order_status string")
        (got,) = rows(quality._orphans({"orders": orders, "order_items": items}, "order_items", "order_id", "orders"))
        assert got == (orphans,)
        assert sorted(r[0] for r in rows(quality.orders_without_items(orders, items))) == lacking


def test_orphans_need_one_exchange_of_keys(spark):
    items = frame(spark, [(1, "a")], "order_id int, other string")
    plan = quality._orphans({"orders": items, "order_items": items}, "order_items", "order_id", "orders")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "partial_sum" in plan
