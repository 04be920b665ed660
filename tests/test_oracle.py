"""Every query with SQL against DuckDB on the smallest tables; the driver does the same on larger ones."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from chronoloom.plans.registry import QUERIES, SQL

DATA = os.environ.get("CHRONOLOOM_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def key(row):
    return tuple((v is None, str(v)) for v in row)


def same(spark, duck, query, sql):
    df = query(spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    said = duck.sql(sql)
    assert sorted(said.columns) == columns
    at = [said.columns.index(c) for c in columns]
    want = sorted((tuple(r[k] for k in at) for r in said.fetchall()), key=key)
    assert got == want


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    same(spark, duck, QUERIES[name], SQL[name])


def test_registered():
    assert set(SQL) <= set(QUERIES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["k", "baseline", "mae", "rmse", "smape", "n", "skill"]
