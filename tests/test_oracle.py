"""Every registered query against its SQL on the same parquet tables."""

import duckdb
import pytest

import __spark_entry__ as registry

TABLES = "region nation customer supplier part orders lineitem events".split()
LLM, LLM_SQL = registry.corpus_queries()
QUERIES = {n: q for n, q in registry.queries().items() if n not in LLM}  # those have tests of their own


@pytest.fixture(scope="module")
def duck(small_dir):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small_dir}/{table}.parquet'")
    return con


def test_every_query_has_an_oracle():
    assert set(registry.oracle_sql()) - set(LLM_SQL) == set(QUERIES)


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_sql(spark, duck, small_dir, name):
    df = QUERIES[name](spark, small_dir)
    ours = [tuple(r) for r in df.select(*sorted(df.columns)).collect()]
    result = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    by_name = sorted(range(len(columns)), key=columns.__getitem__)
    theirs = [tuple(r[i] for i in by_name) for r in result.fetchall()]
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(repr, ours)) == sorted(map(repr, theirs))


def test_entry_returns_rows(spark):
    assert registry.entry(spark).count() > 0
