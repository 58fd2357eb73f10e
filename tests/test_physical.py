"""Physical plans: what must never appear in them, and what must."""

import re

import pytest

import __spark_entry__ as registry
from pyspark.sql import functions as F

from marketlens.sources import testdata
from marketlens.operators.facts import stage_facts
from marketlens.plans import marts, operations

ANALYSES = [n for n in registry.queries() if n.startswith(("q0", "vw_"))]
EAGER = {n for n in registry.queries() if n.startswith(("src_", "sink_"))} | set(registry.corpus_queries()[0])


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in registry.queries() if n not in EAGER])
def test_no_cross_joins_and_no_python(spark, small_dir, name):
    plan = plan_of(registry.queries()[name](spark, small_dir))
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "ArrowEval", "MapInPandas"):
        assert unwanted not in plan


@pytest.mark.parametrize("name", ANALYSES)
def test_windows_stand_above_aggregates(spark, small_dir, name):
    """A window without partitions runs in one task: only aggregated rows may reach it."""
    lines = plan_of(registry.queries()[name](spark, small_dir)).splitlines()
    for number, line in enumerate(lines):
        if re.search(r"\bWindow \[", line):
            below = lines[number + 1 : number + 7]
            assert any("HashAggregate" in each for each in below)


def test_scans_read_only_what_is_used(spark, small_dir):
    plan = plan_of(marts.monthly_business(testdata.processed_tables(spark, small_dir)))
    scanned = re.findall(r"FileScan parquet \[([^\]]*)\]", plan)
    columns = sorted(re.sub(r"#\d+L?", "", c) for c in scanned)
    assert columns == ["l_orderkey,l_extendedprice", "o_orderkey,o_orderstatus,o_orderdate"]


def test_filters_reach_the_scan_of_published_tables(spark, small_dir, tmp_path, capsys):
    from marketlens.sources import files

    files.publish(testdata.processed_tables(spark, small_dir), folder=str(tmp_path))
    published = files.read_processed(spark, str(tmp_path))
    capsys.readouterr()
    marts.monthly_business(published).explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(order_status,delivered)" in plan
    assert "GreaterThanOrEqual(order_purchase_timestamp" in plan


def test_facts_are_combined_before_every_shuffle(spark, small_dir):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = plan_of(operations.seller_performance(testdata.processed_tables(spark, small_dir)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = plan.splitlines()
    shuffled = next(n for n, line in enumerate(lines) if re.search(r"hashpartitioning\(seller_id#\d+L, order_id", line))
    assert "HashAggregate" in lines[shuffled + 1] and "partial_sum" in lines[shuffled + 1]


def test_top_list_needs_no_full_sort(spark, small_dir):
    plan = plan_of(operations.top_sellers(testdata.processed_tables(spark, small_dir)))
    assert "TakeOrderedAndProject" in plan


@pytest.mark.parametrize("name", [n for n in registry.queries() if n not in EAGER])
def test_building_a_query_runs_no_job(spark, small_dir, name):
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(f"build {name}", name)
    try:
        registry.queries()[name](spark, small_dir)
        assert list(jobs.getJobIdsForGroup(f"build {name}")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("name", ["vw_category_performance", "vw_category_performance_split"])
def test_items_are_scanned_once_for_categories(spark, small_dir, name):
    assert plan_of(registry.queries()[name](spark, small_dir)).count("l_partkey:bigint") == 1


def test_months_outside_the_range_are_not_read(spark, small_dir, tmp_path):
    t = stage_facts(testdata.processed_tables(spark, small_dir), str(tmp_path / "facts"))
    mart = marts.monthly_business(t)
    plan = plan_of(mart)
    assert re.search(r"PartitionFilters: \[[^]]*purchase_month#\d+ >= 2017-01-01", plan) and "Join" not in plan
    months = sorted(p.name.partition("=")[2] for p in (tmp_path / "facts").iterdir() if p.is_dir())
    assert "2018-09-01" in months and months[-1] > "2020"
    expected = sorted(map(repr, mart.collect()))
    # the same mart over damaged files of other months still succeeds
    for folder in (tmp_path / "facts").iterdir():
        if folder.is_dir() and not "2017-01-01" <= folder.name.partition("=")[2] < "2018-09-01":
            for file in folder.iterdir():
                file.write_bytes(b"damaged")
    again = marts.monthly_business(t.with_facts(spark.read.schema(t.facts.schema).parquet(str(tmp_path / "facts"))))
    assert sorted(map(repr, again.collect())) == expected


def test_marts_from_the_fact_read_items_once_per_grain(spark, small_dir, tmp_path):
    t = testdata.processed_tables(spark, small_dir)
    staged = stage_facts(t, str(tmp_path / "facts"))
    items = "l_extendedprice"
    reading = {name for name, mart in marts.MARTS.items() if items in plan_of(mart(staged))}
    assert reading == {"vw_seller_performance", "vw_category_performance"}
    assert reading < {name for name, mart in marts.MARTS.items() if items in plan_of(mart(t))}


def test_marts_read_orders_from_the_stored_fact(spark, small_dir, tmp_path):
    t = testdata.processed_tables(spark, small_dir)
    staged = stage_facts(t, str(tmp_path / "facts"))
    assert staged.orders.columns == t.orders.columns
    assert sorted(map(repr, staged.orders.collect())) == sorted(map(repr, t.orders.collect()))
    for name, mart in marts.MARTS.items():
        read = mart(staged)._jdf.inputFiles()
        assert not [f for f in read if f.endswith("/orders.parquet")] or "customer" in "".join(read), name


def test_a_mart_that_cannot_be_written_stops_the_run(spark, small_dir, tmp_path, monkeypatch):
    broken = lambda t: t.orders.select(F.raise_error(F.lit("no mart")).cast("int").alias("x"))
    monkeypatch.setitem(marts.MARTS, "vw_order_status", broken)
    with pytest.raises(Exception, match="no mart"):
        marts.write_marts(testdata.processed_tables(spark, small_dir), str(tmp_path / "marts"))
