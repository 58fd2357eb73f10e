"""Analyses and marts when one key of every kind holds a third of the rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry

NAMES = [n for n in registry.queries() if n.startswith(("q0", "vw_", "orphan", "key_", "profile_t", "assert"))]
TABLES = ("nation", "customer", "supplier", "part", "orders", "lineitem", "events")
SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2kb",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1kb",
}


def third(column, value):
    """The column with a third of its rows, chosen by a hash of the row, set to one value."""
    return F.when(F.pmod(F.xxhash64("*", F.lit(column)), F.lit(3)) == 0, F.lit(value)).otherwise(F.col(column))


@pytest.fixture(scope="module")
def skewed_dir(spark, small_dir, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("skewed"))
    read = {t: spark.read.parquet(f"{small_dir}/{t}.parquet") for t in TABLES}
    delivered = read["orders"].filter("o_orderstatus = 'F' AND o_orderkey % 50 <> 7").agg(F.min("o_orderkey")).first()[0]
    hot = {
        "orders": {"o_custkey": 7},
        "lineitem": {"l_orderkey": delivered, "l_partkey": 11, "l_suppkey": 3},
        "events": {"event_id": 3},
    }
    for table, df in read.items():
        columns = {c: third(c, value).cast("bigint") for c, value in hot.get(table, {}).items()}
        (df.withColumns(columns) if columns else df).write.parquet(f"{folder}/{table}.parquet")
    return folder


@pytest.fixture(scope="module")
def duck(skewed_dir):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{skewed_dir}/{table}.parquet/*.parquet'")
    return con


@pytest.fixture
def eager_splitting(spark):
    """No broadcasts, and every partition above two kilobytes counts as skewed."""
    before = {key: spark.conf.get(key, None) for key in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_a_third_of_the_rows_is_hot(duck):
    for table, column in (("lineitem", "l_orderkey"), ("lineitem", "l_partkey"), ("orders", "o_custkey")):
        share = f"SELECT max(n) / sum(n) FROM (SELECT count(*) AS n FROM {table} GROUP BY {column})"
        assert duck.execute(share).fetchone()[0] > 0.3


@pytest.mark.parametrize("name", NAMES)
def test_skewed_results_equal_the_sql(spark, eager_splitting, duck, skewed_dir, name):
    df = registry.queries()[name](spark, skewed_dir)
    ours = [tuple(r) for r in df.select(*sorted(df.columns)).collect()]
    result = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    by_name = sorted(range(len(columns)), key=columns.__getitem__)
    assert sorted(map(repr, ours)) == sorted(repr(tuple(r[i] for i in by_name)) for r in result.fetchall())
