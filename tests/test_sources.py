"""Files, published tables and views."""

import contextlib
import random

import pytest
from build import item, order, rows, tables
from pyspark.sql import functions as F

from marketlens.operators import clean
from marketlens.plans import marts
from marketlens.schema import LOAD_ORDER, RAW_TABLES
from marketlens.session import scratch_folder
from marketlens.sources import files, releases, testdata


@pytest.fixture(scope="module")
def sample(spark, small_dir):
    return testdata.processed_tables(spark, small_dir)


def write(path, text):
    path.write_text(text, encoding="utf-8")


def test_quoted_text_with_line_breaks_stays_one_record(spark, tmp_path):
    write(
        tmp_path / "reviews.csv",
        "review_id,order_id,review_score,review_comment_message,review_creation_date,review_answer_timestamp\n"
        'r1,o1,5,"two\nlines, ""quoted""",2018-01-01 00:00:00,2018-01-02 10:00:00\n'
        'r2,o2,NA,"",junk,null\n'
        "r3,o3,3,NaN,,2018-01-02\n",
    )
    raw = files.read_csv_table(spark, str(tmp_path / "reviews.csv"))
    got = {r["review_id"]: r for r in clean.clean_reviews(raw).collect()}
    assert got["r1"]["review_comment_message"] == 'two\nlines, "quoted"'
    assert got["r1"]["review_score"] == 5 and str(got["r1"]["review_answer_timestamp"]) == "2018-01-02 10:00:00"
    assert list(got["r2"])[2:] == [None] * 4
    assert list(got["r3"])[2:] == [3, None, None, None]


@pytest.mark.parametrize("split_bytes", [40, 1000])
def test_any_table_may_hold_line_breaks_and_bare_quotes(spark, tmp_path, split_bytes):
    write(
        tmp_path / "reviews.csv",
        'review_id,order_id,review_score,review_comment_message\nr1,o1,5,10" pipe\nr2,o2,4,ok\nr3,o3,3,"x ""y"""\nr4,o4,2,5" nail\nr5,o5,1,z\n',
    )
    write(tmp_path / "products.csv", 'product_id,product_category_name\np1,"toys\nand games"\np2,b\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", f"{split_bytes}b")
        reviews = sorted(rows(files.read_csv_table(spark, str(tmp_path / "reviews.csv"))))
        products = sorted(rows(files.read_csv_table(spark, str(tmp_path / "products.csv"))))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r[3] for r in reviews] == ['10" pipe', "ok", 'x "y"', '5" nail', "z"]
    assert products == [("p1", "toys\nand games"), ("p2", "b")]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("split_bytes", [60, 1 << 20])
def test_a_large_file_is_divided_among_tasks_whatever_its_fields_hold(spark, tmp_path, split_bytes, end):
    rng = random.Random(split_bytes)
    texts = ["", "plain", "NA", 'say ""hi""', "two\nlines", ",", "\n\n,", 'a\n"",""\nb', "über\n", '""', "x" * 90 + "\n" + "y" * 90]
    bare = ["", "z", '10" pipe', 'a "b" c', " "]
    folder = tmp_path / "reviews.csv"
    folder.mkdir()
    for part in range(3):
        fields = lambda: ",".join(f'"{rng.choice(texts)}"' if rng.random() < 0.6 else rng.choice(bare) for _ in range(3))
        records = ["id,text,note,more", *(f"{part}-{i},{fields()}" + rng.choice(["", "", end]) for i in range(20))]
        with open(folder / f"part-{part}.csv", "w", encoding="utf-8", newline="") as file:
            file.write(end.join(records) + (end if part else ""))
    whole = spark.read.csv(str(folder), multiLine=True, **files.CSV_OPTIONS)
    divided = files.read_divided(spark, str(folder), split_bytes)
    assert divided.columns == whole.columns
    assert divided.rdd.getNumPartitions() > 30 or split_bytes > 60
    assert sorted(rows(divided), key=repr) == sorted(rows(whole), key=repr) and whole.count() == 60


def test_files_above_the_bound_are_divided(spark, tmp_path, monkeypatch):
    write(tmp_path / "t.csv", 'a,b\n1,"x\ny"\n2,NA\n')
    divided = []
    monkeypatch.setattr(files, "read_divided", lambda *given, real=files.read_divided: divided.append(given) or real(*given))
    assert sorted(rows(files.read_csv_table(spark, str(tmp_path / "t.csv")))) == [("1", "x\ny"), ("2", None)] and not divided
    monkeypatch.setattr(files, "STREAM_BYTES", 10)
    assert sorted(rows(files.read_csv_table(spark, str(tmp_path / "t.csv")))) == [("1", "x\ny"), ("2", None)] and divided


def test_written_files_are_of_bounded_length(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "FILE_RECORDS", 10)
    files.write_csv_table(spark.range(95).coalesce(1), str(tmp_path / "t.csv"))
    assert len(list((tmp_path / "t.csv").glob("*.csv"))) == 10
    assert files.read_csv_table(spark, str(tmp_path / "t.csv")).count() == 95


def test_a_declared_table_is_read_by_many_tasks(spark, tmp_path):
    header = "review_id,order id,review_score,review_comment_message\n"
    lines = [f'r{i},o{i},{i % 6},"say ""{i}"", and, more"\n' if i % 3 else f"r{i},,NA,\n" for i in range(300)]
    (tmp_path / "reviews.csv").mkdir()
    write(tmp_path / "reviews.csv" / "a.csv", header + "".join(lines[:200]))
    write(tmp_path / "reviews.csv" / "b.csv", header + "".join(lines[200:]))
    path, before = str(tmp_path / "reviews.csv"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000b")
        declared = files.read_csv_table(spark, path, single_line=True)
        assert declared.rdd.getNumPartitions() >= 8
        assert declared.columns == ["review_id", "order id", "review_score", "review_comment_message"]
        assert sorted(map(repr, rows(declared))) == sorted(map(repr, rows(files.read_csv_table(spark, path))))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("text", ['"two\nlines"', '"two\na,b,lines"', "x,y", '10" pipe'])
def test_a_declared_table_with_other_records_stops_the_run(spark, tmp_path, text):
    write(tmp_path / "t.csv", f"a,b,c\n1,2,3\n4,5,{text}\n")
    declared = files.read_csv_table(spark, str(tmp_path / "t.csv"), single_line=True)
    with pytest.raises(Exception, match="in one line"):
        declared.select("a").collect()
    assert files.read_csv_table(spark, str(tmp_path / "t.csv")).count() == 2


@pytest.mark.parametrize("text", ["", "a,b\n"])
def test_a_declared_table_may_have_no_rows(spark, tmp_path, text):
    write(tmp_path / "t.csv", text)
    assert rows(files.read_csv_table(spark, str(tmp_path / "t.csv"), single_line=True)) == []


def test_delivered_files_may_have_other_names(spark, tmp_path):
    for table in RAW_TABLES:
        write(tmp_path / f"x_{table}.csv", "order_id,other\n1,a\n")
    raw = files.read_raw(spark, str(tmp_path), {t: f"x_{t}.csv" for t in RAW_TABLES})
    assert rows(raw.orders) == [("1", "a")]


def test_text_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 'say "x"\nand, y', None), ("b", None, "z")], "a string, b string, c string")
    files.write_csv_table(df, str(tmp_path / "t.csv"))
    back = files.read_csv_table(spark, str(tmp_path / "t.csv"))
    assert sorted(rows(back)) == sorted(rows(df))


@pytest.mark.parametrize("fmt", ["parquet", "csv", "orc"])
def test_processed_tables_round_trip(spark, tmp_path, fmt):
    t = tables(
        spark,
        orders=[
            order("a", delivered="2017-01-03 10:00:00", estimated="2017-01-01 00:00:00"),
            order("b", status=None, delivered="2017-01-03 10:00:00"),
            order("c", status="canceled"),
        ],
        items=[item("a", "10.50")],
        customers=[("c-a", "u", "X")],
        products=[("p1", "toys")],
        sellers=["s1"],
        reviews=[("r1", "a", 5), ("r2", "a", None)],
    )
    files.write_processed(t, str(tmp_path), fmt)
    files.write_processed(t, str(tmp_path), fmt)
    back = files.read_processed(spark, str(tmp_path), fmt)
    for name, df in t.as_dict().items():
        assert sorted(map(repr, rows(getattr(back, name).select(*df.columns)))) == sorted(map(repr, rows(df)))
    assert dict(back.orders.dtypes)["is_late"] == "boolean"
    assert sorted(map(repr, rows(back.orders.select("is_late")))) == ["(False,)", "(None,)", "(True,)"]


def test_publish_overwrites_or_appends_in_load_order(spark, tmp_path, sample):
    folder = str(tmp_path / "published")
    written = files.publish(sample, folder=folder)
    assert tuple(written) == LOAD_ORDER
    files.publish(sample, folder=folder)
    assert files.read_processed(spark, folder).orders.count() == written["orders"] == sample.orders.count()
    files.publish(sample, folder=folder, mode="append")
    assert files.read_processed(spark, folder).orders.count() == 2 * written["orders"]
    with pytest.raises(ValueError):
        files.publish(sample)


def shuffles(spark, df):
    """Exchanges of a plan in which nothing is broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan
    return [line for line in plan.splitlines() if "Exchange" in line]


def test_bucketed_tables_join_without_shuffling_facts(spark, sample):
    spark.sql("CREATE DATABASE IF NOT EXISTS market")
    written = files.publish(sample, database="market", buckets=4)
    published = files.read_published(spark, "market")
    assert {name: df.count() for name, df in published.as_dict().items()} == written
    mart = marts.MARTS["vw_seller_performance"]
    (exchange,) = shuffles(spark, mart(published))
    assert "hashpartitioning(seller_id" in exchange
    assert sorted(map(repr, rows(mart(published)))) == sorted(map(repr, rows(mart(sample))))


def test_tables_with_a_heavy_bucket_are_not_bucketed(spark, sample):
    hot = sample.replacing(order_items=sample.order_items.withColumn("order_id", F.expr("if(price > 0, 1L, order_id)")))
    assert files.buckets_balance(sample.order_items, "order_id", 8)
    assert not files.buckets_balance(hot.order_items, "order_id", 8)
    spark.sql("CREATE DATABASE IF NOT EXISTS heavy")
    written = files.publish(hot, database="heavy", buckets=8)
    assert [buckets_of(spark, "heavy", name) for name in ("orders", "order_items")] == [8, None]
    assert written["order_items"] == sample.order_items.count()


def buckets_of(spark, database, name):
    release = releases.read_pointer(spark, files.database_folder(spark, database))
    return files.stored_buckets(spark, files.stored_table(release, database, name))


def contents(spark, database):
    return {n: spark.table(f"{database}.{n}").count() for n in LOAD_ORDER}


@pytest.mark.parametrize("heavy_first", [False, True])
def test_appending_keeps_the_buckets_of_the_table(spark, sample, heavy_first):
    heavy = sample.replacing(order_items=sample.order_items.withColumn("order_id", F.expr("if(price > 0, 1L, order_id)")))
    first, second = (heavy, sample) if heavy_first else (sample, heavy)
    database = f"mixed_{int(heavy_first)}"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    written = files.publish(first, database=database, buckets=8)
    with pytest.warns(UserWarning, match="order_items") if heavy_first else contextlib.nullcontext():
        files.publish(second, database=database, mode="append", buckets=8)
    assert contents(spark, database) == {n: 2 * rows for n, rows in written.items()}
    assert buckets_of(spark, database, "order_items") == (None if heavy_first else 8)


@pytest.mark.parametrize("mode", ["overwrite", "append"])
@pytest.mark.parametrize("to_folder", [False, True])
def test_a_failed_publish_changes_nothing_and_can_be_repeated(spark, sample, tmp_path, mode, to_folder):
    database = f"safe_{mode}"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    target = {"folder": str(tmp_path / "out")} if to_folder else {"database": database, "buckets": 4}

    def stored():
        back = files.read_processed(spark, target["folder"]) if to_folder else files.read_published(spark, database)
        return {name: df.count() for name, df in back.as_dict().items()}

    written = files.publish(sample, **target)
    broken = F.when(F.col("price") > 0, F.raise_error(F.lit("broken batch"))).otherwise(F.col("price"))
    bad = sample.replacing(order_items=sample.order_items.withColumn("price", broken.cast("decimal(12,2)")))
    with pytest.raises(Exception, match="broken batch"):
        files.publish(bad, mode=mode, **target)
    assert stored() == written
    strange = sample.replacing(order_items=sample.order_items.withColumn("price", F.lit("x")))
    if mode == "append":
        with pytest.raises(ValueError, match="order_items"):
            files.publish(strange, mode=mode, **target)
    assert stored() == written
    files.publish(sample, mode=mode, **target)
    assert stored() == {n: (2 if mode == "append" else 1) * rows for n, rows in written.items()}


def published(spark, target):
    """All rows that readers of the six tables see."""
    back = files.read_published(spark, target["database"]) if "database" in target else files.read_processed(spark, target["folder"])
    return {name: sorted(map(repr, rows(df.select(*sorted(df.columns))))) for name, df in back.as_dict().items()}


def small_batch(spark, i):
    return tables(
        spark, orders=[order(f"o{i}")], items=[item(f"o{i}", "1.00")] * i, customers=[(f"c{i}", "u", "X")], products=[(f"p{i}", "t")],
        sellers=[f"s{i}"], reviews=[(f"r{i}", f"o{i}", i)],
    )


#: Functions that publishing goes through, how often they are called before they fail, and whether the switch comes before.
STEPS = [
    (files, "store_batch", 0, False),
    (files, "store_batch", 3, False),
    (files, "store_batch", 5, False),
    (releases, "switch_pointer", 0, False),
    (files, "refresh_views", 0, True),
    (files, "remove_old_generations", 0, True),
]


@pytest.mark.parametrize(("mode", "to_folder"), [("overwrite", True), ("append", False)])
def test_a_failure_between_any_two_steps_leaves_one_whole_release(spark, tmp_path, monkeypatch, mode, to_folder):
    spark.sql("CREATE DATABASE IF NOT EXISTS steps")
    target = {"folder": str(tmp_path / "out")} if to_folder else {"database": "steps", "buckets": 2}
    files.publish(small_batch(spark, 1), **target)
    seen, expected = published(spark, target), small_batch(spark, 2)
    whole = {n: sorted((seen[n] if mode == "append" else []) + [repr(r) for r in rows(df.select(*sorted(df.columns)))]) for n, df in expected.as_dict().items()}
    for module, name, before, switched in STEPS:
        if to_folder and name == "refresh_views":
            continue
        calls, real = [], getattr(module, name)

        def failing(*args, calls=calls, real=real, before=before, **kwargs):
            calls.append(1)
            if len(calls) > before:
                raise OSError("lost")
            return real(*args, **kwargs)

        with monkeypatch.context() as patch:
            patch.setattr(module, name, failing)
            # a batch that is listed already has nothing left to fail
            with pytest.raises(OSError, match="lost") if mode == "overwrite" or name != "remove_old_generations" else contextlib.nullcontext():
                files.publish(expected, mode=mode, batch="second", **target)
        assert published(spark, target) == (whole if switched else seen), (name, before)
    files.publish(expected, mode=mode, batch="second", **target)
    assert published(spark, target) == whole
    if not to_folder:
        files.refresh_views(spark, "steps")
        assert contents(spark, "steps") == {name: len(found) for name, found in whole.items()}


@pytest.mark.parametrize("to_folder", [True, False])
def test_the_same_append_twice_adds_nothing(spark, tmp_path, to_folder):
    spark.sql("CREATE DATABASE IF NOT EXISTS ledger")
    target = {"folder": str(tmp_path / "out")} if to_folder else {"database": "ledger"}
    files.publish(small_batch(spark, 1), **target)
    added = files.publish(small_batch(spark, 2), mode="append", batch="2024-01", **target)
    once = published(spark, target)
    assert added["order_items"] == 2 and len(once["order_items"]) == 3
    assert files.publish(small_batch(spark, 2), mode="append", batch="2024-01", **target) == dict.fromkeys(LOAD_ORDER, 0)
    assert published(spark, target) == once
    release = releases.read_pointer(spark, str(tmp_path / "out") if to_folder else files.database_folder(spark, "ledger"))
    assert release.ids[1:] == ["2024-01"] and release.batches[1].rows == added
    with pytest.raises(ValueError, match="batch id"):
        files.publish(small_batch(spark, 2), mode="append", batch="../x", **target)
    files.publish(small_batch(spark, 2), mode="append", batch="2024-02", **target)
    assert len(published(spark, target)["order_items"]) == 5


def test_readers_of_the_generation_before_finish_and_older_ones_go(spark, tmp_path):
    folder = str(tmp_path / "out")
    files.publish(small_batch(spark, 1), folder=folder)
    opened = files.read_processed(spark, folder)
    files.publish(small_batch(spark, 2), folder=folder)
    assert opened.order_items.count() == 1
    files.publish(small_batch(spark, 2), folder=folder)
    assert len(releases.folders_in(spark, folder)) == 2


def test_other_batches_are_not_read(spark, tmp_path):
    folder, sample = str(tmp_path / "out"), small_batch(spark, 1)
    files.publish(sample, folder=folder)
    release = releases.read_pointer(spark, folder)
    files.store_batch(sample.orders, release, "orders", "stray", database=None, folder=folder, buckets=None)
    assert files.read_processed(spark, folder).orders.count() == sample.orders.count()
    assert releases.BATCH not in files.read_processed(spark, folder).orders.columns
    named = sample.replacing(orders=sample.orders.withColumn(releases.BATCH, F.lit("x")))
    with pytest.raises(ValueError, match=releases.BATCH):
        files.publish(named, folder=folder)


def test_views_are_replaced_and_readable_by_name(spark, sample):
    assert marts.register_views(sample) == list(marts.MARTS)
    assert marts.register_views(sample) == list(marts.MARTS)
    assert len(marts.MARTS) == 12
    by_name = spark.sql("SELECT order_status, orders FROM vw_order_status ORDER BY orders DESC LIMIT 1")
    assert rows(by_name) == rows(marts.order_status(sample).orderBy("orders", ascending=False).limit(1).select("order_status", "orders"))


def test_marts_can_be_materialised(spark, sample, tmp_path):
    marts.write_marts(sample, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/vw_executive_kpis").count() == 1


def test_scratch_folder_is_the_shared_one(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    a, b = scratch_folder(spark, "x"), scratch_folder(spark, "x")
    assert a.startswith(base) and a != b
