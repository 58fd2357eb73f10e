"""Rules of the analyses and marts on hand-made rows, and identities between them."""

import datetime as dt
from decimal import Decimal

import pytest
from build import item, order, row_dicts, rows, tables, values
from pyspark.sql import functions as F

from marketlens.functions import delivery
from marketlens.operators import grains
from marketlens.plans import business, experience, fulfillment, marts, operations
from marketlens.sources import testdata


@pytest.fixture(scope="module")
def sample(spark, small_dir):
    return testdata.processed_tables(spark, small_dir)


def monthly_tables(spark):
    months = {"2017-01": 1, "2017-02": 2, "2017-04": 3, "2018-09": 1}
    orders, items = [], []
    for month, count in months.items():
        for n in range(count):
            order_id = f"{month}-{n}"
            orders.append(order(order_id, f"{month}-10 12:00:00"))
            items += [item(order_id, "10.00"), item(order_id, "5.00", number=2)]
    orders.append(order("no items", "2017-04-01 00:00:00"))
    orders.append(order("canceled", "2017-04-01 00:00:00", status="canceled"))
    items.append(item("canceled", "99.00"))
    return tables(spark, orders=orders, items=items)


def test_growth_compares_with_the_previous_month_that_exists(spark):
    got = rows(business.mom_growth(monthly_tables(spark)))
    assert [(r[0], r[1], r[3]) for r in got] == [
        (dt.date(2017, 2, 1), 2, Decimal("100.00")),
        (dt.date(2017, 4, 1), 3, Decimal("50.00")),
        (dt.date(2018, 9, 1), 1, Decimal("-66.67")),
    ]


def test_mart_cuts_before_and_analysis_after_growth(spark):
    t = monthly_tables(spark)
    mart = {r["month"]: r for r in row_dicts(marts.monthly_business(t, start=dt.datetime(2017, 2, 1)))}
    assert mart[dt.date(2017, 2, 1)]["order_mom_pct"] is None
    assert dt.date(2018, 9, 1) not in mart
    analysis = {r["month"]: r for r in row_dicts(business.mom_growth(t))}
    assert analysis[dt.date(2017, 2, 1)]["order_mom_pct"] == Decimal("100.00")


def test_unknown_month_stands_last(spark):
    t = tables(
        spark,
        orders=[order("a", "2017-01-10 00:00:00"), order("b", None), order("c", None), order("d", "2017-02-10 00:00:00")],
        items=[item(o, "1.00") for o in "abcd"],
    )
    got = rows(marts.monthly_business(t, start=None, end=None).select("month", "order_mom_pct"))
    expected = {dt.date(2017, 1, 1): None, dt.date(2017, 2, 1): Decimal("0.00"), None: Decimal("100.00")}
    assert dict(got) == expected
    assert values(business.monthly(t), "month") == [dt.date(2017, 1, 1), dt.date(2017, 2, 1), None]


def test_orders_without_items_do_not_count_as_sales(spark):
    t = monthly_tables(spark)
    (overview,) = row_dicts(business.delivered_overview(t))
    assert overview == {
        "delivered_orders": 7,
        "merchandise_gmv": Decimal("105.00"),
        "freight_revenue": Decimal("14.00"),
        "gross_order_value": Decimal("119.00"),
        "merchandise_aov": Decimal("15.00"),
    }
    (kpis,) = row_dicts(marts.executive_kpis(t))
    assert (kpis["total_orders"], kpis["delivered_orders"], kpis["cancellation_rate_pct"]) == (9, 7, Decimal("11.11"))


def test_two_bases_of_delivered_orders(spark):
    t = tables(
        spark,
        orders=[order("seen", delivered="2017-01-02 00:00:00"), order("unseen")],
        items=[item("seen", "1.00"), item("unseen", "2.00")],
    )
    assert values(operations.top_sellers(t), "orders") == [2]
    assert values(operations.seller_performance(t, min_orders=1), "seller_orders") == [1]


def test_order_of_two_sellers_is_late_for_both(spark):
    t = tables(
        spark,
        orders=[order("a", delivered="2017-01-09 00:00:00", estimated="2017-01-05 00:00:00")],
        items=[item("a", "1.00"), item("a", "2.00", number=2), item("a", "4.00", number=3, seller="s2")],
    )
    got = sorted(rows(operations.seller_performance(t, min_orders=1)))
    assert [r[:5] for r in got] == [
        ("s1", 1, Decimal("3.00"), 1, Decimal("100.00")),
        ("s2", 1, Decimal("4.00"), 1, Decimal("100.00")),
    ]


def test_order_counts_once_per_category(spark):
    t = tables(
        spark,
        orders=[order("a", delivered="2017-01-09 00:00:00", estimated="2017-01-05 00:00:00")],
        items=[
            item("a", "1.00", product="p1"),
            item("a", "2.00", product="p2"),
            item("a", None, product="p2"),
            item("a", "8.00", product="p3"),
            item("a", "9.00", product="gone"),
            item("a", "9.00", product=None),
        ],
        products=[("p1", "toys"), ("p2", "toys"), ("p3", "books"), (None, "none")],
    )
    got = {r["product_category"]: r for r in row_dicts(operations.top_categories(t))}
    assert set(got) == {"toys", "books"}
    assert (got["toys"]["orders"], got["toys"]["items_sold"], got["toys"]["avg_item_price"]) == (1, 3, Decimal("1.50"))
    risk = {r["product_category"]: r["merchandise_gmv"] for r in row_dicts(operations.category_performance(t, 1))}
    assert risk == {"toys": Decimal("3.00"), "books": Decimal("8.00")}


def test_shuffled_and_broadcast_categories_agree(sample):
    small = rows(grains.category_orders(sample).orderBy("order_id", "product_category"))
    large = rows(grains.category_orders(sample, shuffled=True).orderBy("order_id", "product_category"))
    assert small == large


def test_top_lists_are_cut_and_ties_ordered(spark):
    t = tables(
        spark,
        orders=[order("a")],
        items=[item("a", "1.00", seller=s) for s in ("z", "y", "x")],
    )
    assert values(operations.top_sellers(t, top=2), "seller_id") == ["x", "y"]


def test_reviews_are_averaged_per_order_first(spark):
    t = tables(
        spark,
        orders=[order(o, delivered="2017-01-02 00:00:00", estimated="2017-01-05 00:00:00") for o in "abc"],
        reviews=[("1", "a", 1), ("2", "a", 3), ("3", "b", 5), ("4", "c", None), ("5", "gone", 1)],
    )
    assert rows(experience.late_vs_review(t)) == [("On time / Early", 3, Decimal("3.50"), Decimal("33.33"))]


def test_unknown_delay_has_a_name_in_one_analysis_only(spark):
    t = tables(spark, orders=[order("a", delivered="2017-01-02 00:00:00")], reviews=[("1", "a", 4)])
    assert rows(fulfillment.bands(t)) == [("Unknown", 1, Decimal("100.00"))]
    assert rows(marts.delivery_bands(t)) == [(None, None, 1, Decimal("100.00"))]
    assert rows(experience.delay_vs_review(t)) == [(None, 1, Decimal("4.00"), Decimal("0.00"))]
    assert rows(experience.band_experience(t))[0][:3] == (None, None, "On time / Early")


def test_bands_come_in_order(sample):
    names = values(fulfillment.bands(sample), "delivery_band")
    known = [name for name, _ in delivery.BANDS]
    assert names == [n for n in known if n in names] + (["Unknown"] if "Unknown" in names else [])


def test_repeat_customers_count_persons_and_any_status(spark):
    t = tables(
        spark,
        orders=[
            order("1", customer="c1"),
            order("2", customer="c2", status="canceled"),
            order("3", customer="c3"),
            order("4", customer="nobody"),
        ],
        customers=[("c1", "ann", "X"), ("c2", "ann", "X"), ("c3", "bob", "X"), ("c4", "eve", "X")],
    )
    assert rows(experience.repeat_customers(t)) == [(2, 1, Decimal("50.00"), Decimal("1.50"))]


def test_state_thresholds_and_rates(spark):
    orders = [
        order("1", delivered="2017-01-05 00:00:00", estimated="2017-01-04 00:00:00"),
        order("2", delivered="2017-01-03 00:00:00"),
        order("3", delivered="2017-01-02 00:00:00", estimated="2017-01-04 00:00:00"),
    ]
    t = tables(spark, orders=orders, customers=[("c-1", "u", "X"), ("c-2", "v", "X"), ("c-3", "w", "Y")])
    (x,) = row_dicts(fulfillment.priority_by_state(t, min_orders=2))
    assert x == {
        "customer_state": "X",
        "delivered_orders": 2,
        "late_orders": 1,
        "late_rate_pct": Decimal("50.00"),
        "avg_actual_delivery_days": Decimal("3.00"),
        "avg_promised_days": Decimal("3.00"),
        "avg_buffer_days": Decimal("-1.00"),
    }
    assert len(rows(fulfillment.priority_by_state(t, min_orders=1))) == 2


def test_nothing_fails_without_any_row(spark):
    empty = tables(spark)
    (kpis,) = row_dicts(marts.executive_kpis(empty))
    assert kpis["merchandise_aov"] is None and kpis["cancellation_rate_pct"] is None and kpis["total_orders"] == 0
    assert rows(fulfillment.overall(empty)) == [(0, None, None, None, None)]
    assert rows(experience.repeat_customers(empty)) == [(0, None, None, None)]
    for mart in marts.MARTS.values():
        mart(empty).collect()


# ------------------------------------------------------------- identities


def same_rows(a, b):
    assert sorted(map(repr, rows(a))) == sorted(map(repr, rows(b.select(*a.columns))))


def test_marts_repeat_their_analyses(sample):
    same_rows(marts.order_status(sample), business.status_share(sample))
    same_rows(fulfillment.state_priority(sample, 1), fulfillment.priority_by_state(sample, 1))
    same_rows(operations.seller_performance(sample, 1), operations.seller_risk(sample, 1))
    same_rows(
        operations.category_performance(sample, 1).drop("merchandise_gmv"), operations.category_risk(sample, 1)
    )
    same_rows(fulfillment.stage_by_lateness(sample), fulfillment.stage_late_vs_ontime(sample))


def test_counts_add_up(sample):
    (overall,) = row_dicts(fulfillment.overall(sample))
    known = overall["delivered_orders"]
    assert sum(values(fulfillment.bands(sample), "orders")) == known
    assert sum(values(fulfillment.state_performance(sample, 0), "delivered_orders")) == known
    reviewed = sum(values(experience.late_vs_review(sample), "reviewed_orders"))
    assert sum(values(experience.delay_vs_review(sample), "reviewed_orders")) == reviewed
    assert sum(values(experience.band_experience(sample), "reviewed_orders")) == reviewed


def test_reviews_roll_up_from_band_and_lateness(sample):
    rolled = experience.band_experience(sample).groupBy("delivery_status").agg(F.sum("reviewed_orders").alias("n"))
    assert dict(rows(rolled)) == {r[0]: r[1] for r in rows(experience.late_vs_review(sample))}


def test_stages_average_back_to_all_orders(sample):
    (total,) = row_dicts(fulfillment.stages(sample))
    parts = row_dicts(fulfillment.stage_late_vs_ontime(sample))
    n = sum(p["orders"] for p in parts)
    for column, value in total.items():
        assert abs(sum(p[column] * p["orders"] for p in parts) / n - value) <= Decimal("0.01")


def test_seller_and_category_value_is_all_value(sample):
    (overview,) = row_dicts(business.delivered_overview(sample))
    by_seller = operations.top_sellers(sample, top=10**6).agg(F.sum("merchandise_gmv")).first()[0]
    by_category = operations.top_categories(sample, top=10**6).agg(F.sum("merchandise_gmv")).first()[0]
    assert by_seller == by_category == overview["merchandise_gmv"]


def test_processed_tables_equal_the_cleaned_raw_tables(spark, small_dir, sample):
    from marketlens.operators.clean import clean_tables

    cleaned = clean_tables(testdata.raw_tables(spark, small_dir)).as_dict()
    for name, df in sample.as_dict().items():
        assert set(cleaned[name].columns) == set(df.columns)
        assert df.exceptAll(cleaned[name].select(*df.columns)).isEmpty()
        assert df.count() == cleaned[name].count()


def ranked_sample(spark):
    """Four groups: B and A tie with one late order of one, C has none late, D has no promised date."""
    lateness = {"a": "2017-01-08 00:00:00", "b": "2017-01-08 00:00:00", "c": "2017-01-20 00:00:00", "d": None}
    return tables(
        spark,
        orders=[order(k, delivered="2017-01-10 00:00:00", estimated=promised) for k, promised in lateness.items()],
        customers=[(f"c-{k}", f"u-{k}", k.upper()) for k in lateness],
        items=[item(k, "5.00", product=f"p-{k}", seller=f"s-{k}") for k in reversed(lateness)],
        products=[(f"p-{k}", f"cat-{k}") for k in lateness],
        sellers=[f"s-{k}" for k in lateness],
    )


@pytest.mark.parametrize(
    "plan, column, expected",
    [
        (fulfillment.state_performance, "customer_state", ["A", "B", "C", "D"]),
        # an unknown promise comes first, the longest after it, ties by state
        (fulfillment.promise_by_state, "customer_state", ["D", "C", "A", "B"]),
        (fulfillment.priority_by_state, "customer_state", ["A", "B", "C", "D"]),
        (operations.seller_risk, "seller_id", ["s-a", "s-b", "s-c", "s-d"]),
        (operations.category_risk, "product_category", ["cat-a", "cat-b", "cat-c", "cat-d"]),
    ],
)
def test_ranked_lists_are_ordered_with_ties_and_unknown_measures(spark, plan, column, expected):
    assert [r[column] for r in row_dicts(plan(ranked_sample(spark), min_orders=1))] == expected
