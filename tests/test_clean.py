"""Cleaning rules on hand-made rows."""

import datetime as dt

import pytest
from build import order, row_dicts, rows, tables

from marketlens.functions.text import LAYOUTS, missing_to_null, parse_timestamp
from marketlens.operators import clean, quality
from marketlens.schema import DELIVERED
from pyspark.sql import functions as F


def test_late_flag_has_three_states(spark):
    t = tables(
        spark,
        orders=[
            order("late", delivered="2017-01-03 00:00:00", estimated="2017-01-01 00:00:00"),
            order("no promise", delivered="2017-01-03 00:00:00"),
            order("not delivered", estimated="2017-01-01 00:00:00"),
            order("same day", delivered="2017-01-03 22:00:00", estimated="2017-01-03 08:00:00"),
            order("early", delivered="2017-01-01 23:59:59", estimated="2017-01-03 00:00:00"),
        ],
    )
    got = {r["order_id"]: (r["delay_days"], r["is_late"]) for r in row_dicts(t.orders)}
    assert got == {
        "late": (2, True),
        "no promise": (None, False),
        "not delivered": (None, None),
        "same day": (0, False),
        "early": (-2, False),
    }


def test_status_flags_are_never_null(spark):
    t = tables(
        spark,
        orders=[order("a"), order("b", status="canceled"), order("c", status=None), order("d", status="shipped")],
    )
    flags = {r["order_id"]: (r["is_delivered"], r["is_canceled"]) for r in row_dicts(t.orders)}
    assert flags == {"a": (True, False), "b": (False, True), "c": (False, False), "d": (False, False)}


def test_durations_keep_fractions_while_delay_counts_calendar_days(spark):
    raw = spark.createDataFrame(
        [("a", dt.datetime(2017, 1, 1, 18, 0, 0, 500000), dt.datetime(2017, 1, 3, 12), dt.datetime(2017, 1, 1))],
        "order_id string, order_purchase_timestamp timestamp_ntz, order_delivered_customer_date timestamp_ntz, "
        "order_estimated_delivery_date timestamp_ntz",
    ).withColumns(
        {
            "order_status": F.lit("delivered"),
            "order_approved_at": F.lit("2017-01-01 19:30:00.500000").cast("timestamp_ntz"),
            "order_delivered_carrier_date": F.lit(None).cast("timestamp_ntz"),
        }
    )
    (row,) = row_dicts(clean.clean_orders(raw))
    assert row["delivery_days"] == 1.7499942129629629
    assert row["approval_hours"] == 1.5
    assert row["delay_days"] == 2


def test_durations_do_not_depend_on_the_session_zone(spark):
    """Clocks moved forward in New York on 2017-03-12, but the timestamps have no zone."""
    rows_in = [order("a", purchased="2017-03-12 01:00:00", delivered="2017-03-12 04:00:00")]
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        (row,) = row_dicts(tables(spark, orders=rows_in).orders)
        (gap,) = rows(spark.sql("SELECT '2017-03-12 02:30:00' AS t").select(parse_timestamp(F.col("t"))))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert row["delivery_days"] == 3 / 24
    assert gap == (dt.datetime(2017, 3, 12, 2, 30),)


def test_unreadable_timestamps_become_null(spark):
    texts = ["2017-01-01 10:00:00", "2017-01-02", "junk", "", None, "2017-02-30 10:00:00", "2017-01-01T10:00:00"]
    df = spark.createDataFrame([(x,) for x in texts], "t string").select(parse_timestamp(F.col("t")).alias("t"))
    assert [r[0] for r in df.collect()] == [dt.datetime(2017, 1, 1, 10)] + [None] * 6


def test_item_total_needs_both_amounts(spark):
    raw = spark.createDataFrame(
        [("a", "10.50", "1.25"), ("b", None, "1.00"), ("c", "2.00", "NA"), ("d", "x", "1")],
        "order_id string, price string, freight_value string",
    )
    got = {r["order_id"]: r["item_total_value"] for r in row_dicts(clean.clean_order_items(raw))}
    assert {k: None if v is None else str(v) for k, v in got.items()} == {"a": "11.75", "b": None, "c": None, "d": None}


@pytest.mark.parametrize("null_in_both", [False, True])
def test_category_is_translated_or_unknown(spark, null_in_both):
    raw = spark.createDataFrame(
        [("1", "flores", "5", "9"), ("2", "nova", "5", "9"), ("3", None, None, None)],
        "product_id string, product_category_name string, product_name_lenght string, product_description_lenght string",
    )
    names = [("flores", "flowers")] + ([(None, "no name")] if null_in_both else [])
    translation = spark.createDataFrame(names, "product_category_name string, product_category_name_english string")
    products = clean.clean_products(raw, translation)
    got = {r["product_id"]: r["product_category"] for r in row_dicts(products)}
    assert got == {"1": "flowers", "2": "unknown", "3": "no name" if null_in_both else "unknown"}
    assert {"product_name_length", "product_description_length"} <= set(products.columns)
    assert dict(products.dtypes)["product_name_length"] == "int"


def test_other_columns_pass_through(spark):
    raw = spark.createDataFrame(
        [("r1", "o1", "5", "fine", "2018-01-01 00:00:00", "junk")],
        "review_id string, order_id string, review_score string, review_comment_message string, "
        "review_creation_date string, review_answer_timestamp string",
    )
    assert rows(clean.clean_reviews(raw)) == [("r1", "o1", 5, "fine", dt.datetime(2018, 1, 1), None)]


def test_missing_texts(spark):
    df = spark.createDataFrame([("NA",), ("",), ("null",), ("nan",), ("Nan",), ("x",)], "t string")
    assert [r[0] for r in missing_to_null(df).collect()] == [None, None, None, None, "Nan", "x"]


def test_typed_timestamps_are_left_alone(spark):
    raw = tables(spark, orders=[order("a", delivered="2017-01-02 00:00:00")]).orders
    again = clean.clean_orders(raw.select(*raw.columns[:8]))
    assert rows(again.select(DELIVERED)) == rows(raw.select(DELIVERED))


def raw_like(spark, **columns):
    """Delivered reviews with the given texts as creation dates."""
    return {"reviews": spark.createDataFrame([(i, t, "2018-01-01 00:00:00") for i, t in enumerate(columns["created"])], "review_id int, review_creation_date string, review_answer_timestamp string")}


@pytest.mark.parametrize("layout", list(LAYOUTS))
def test_the_layout_of_most_texts_is_found(spark, layout):
    moments = ["2018-03-25 02:30:00", "2018-12-31 23:59:00", "2018-01-13 00:00:00"]
    day = layout == "yyyy-MM-dd"
    pattern = layout.replace("yyyy", "%Y").replace("MM", "%m").replace("dd", "%d").replace("HH", "%H").replace("mm", "%M").replace("[.SSSSSS]", ".%f").replace("ss", "%S")
    texts = [dt.datetime.fromisoformat(m).strftime(pattern) for m in moments]
    raw = raw_like(spark, created=[*texts, "junk", None, "1.1.18"])
    chosen = quality.chosen_layouts(raw)
    assert chosen == {"reviews": {"review_creation_date": layout, "review_answer_timestamp": "yyyy-MM-dd HH:mm:ss"}}
    got = [str(r["review_creation_date"]) for r in clean.clean_reviews(raw["reviews"], chosen["reviews"]).orderBy("review_id").collect()]
    assert got == [m[:10] + " 00:00:00" if day else m for m in moments] + ["None"] * 3
    (loss,) = [r for r in quality.cast_losses(raw, chosen).collect() if r["column_name"] == "review_creation_date"]
    assert (loss["present"], loss["lost"]) == (5, 2)
    with pytest.raises(quality.DataQualityError, match="review_creation_date: 2 of 5"):
        quality.check_cast_losses(quality.cast_losses(raw, chosen))
    quality.check_cast_losses(quality.cast_losses(raw, chosen), unreadable_share=0.4)


def test_a_declared_layout_is_used(spark):
    raw = raw_like(spark, created=["01/02/2018 10:00:00", "13/02/2018 10:00:00"])
    assert quality.chosen_layouts(raw)["reviews"]["review_creation_date"] == "dd/MM/yyyy HH:mm:ss"
    declared = quality.chosen_layouts(raw, {"reviews": {"review_creation_date": "MM/dd/yyyy HH:mm:ss"}})
    got = clean.clean_reviews(raw["reviews"], declared["reviews"]).orderBy("review_id").collect()
    assert [str(r["review_creation_date"]) for r in got] == ["2018-01-02 10:00:00", "None"]


def test_typed_or_empty_columns_need_no_layout(spark):
    assert quality.chosen_layouts({"reviews": spark.createDataFrame([], "review_score int, review_creation_date timestamp_ntz")}) == {}
    assert quality.chosen_layouts(raw_like(spark, created=[None]))["reviews"]["review_creation_date"] == "yyyy-MM-dd HH:mm:ss"


def test_the_quick_look_at_a_timestamp_excludes_nothing_that_its_layout_reads(spark):
    import datetime as dt

    from marketlens.functions import text

    moment = dt.datetime(2017, 10, 21, 13, 45, 59)
    for layout, (pattern, usual) in text.LAYOUTS.items():
        form = layout.replace("[.SSSSSS]", "")
        for a, b in (("yyyy", "%Y"), ("MM", "%m"), ("dd", "%d"), ("HH", "%H"), ("mm", "%M"), ("ss", "%S")):
            form = form.replace(a, b)
        full = moment.strftime(form)
        tries = [full, full + "\n", full + "\r\n", full + ".5", full + ".123456", full + ".123456\n", full + " ", " " + full, full[:-1], "", "junk", None]
        df = spark.createDataFrame([(i, t) for i, t in enumerate(tries)], "i int, t string")
        old = F.when(F.col("t").rlike(pattern), F.regexp_replace("t", pattern, usual).try_cast("timestamp_ntz"))
        got = df.select(text.parse_timestamp(F.col("t"), layout), old, text.may_have_layout(F.col("t"), layout)).collect()
        assert [r[0] for r in got] == [r[1] for r in got] and got[0][0] is not None and got[9][2] is False
