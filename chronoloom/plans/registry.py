"""Queries by name, each with SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import shape

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql:
            SQL[key] = sql
        return fn

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small configured table, in one partition."""
    return spark.createDataFrame(rows, schema).coalesce(1)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, ts, y, event_id): events as sub-hourly rows of one series for each type."""
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("k"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("y"), "event_id")


def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, ts, y): hourly means of events."""
    return shape.resample(events(spark, sf_dir), ["k"], mean=shape.exact_mean)


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, ts, y): orders' daily totals for each priority."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("k"), F.col("o_orderdate").cast("timestamp").alias("ts"), "o_totalprice")
    return o.groupBy("k", "ts").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("y"))


def text(ts: str | F.Column) -> F.Column:
    """A timestamp as text, the same in both engines."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


#: The same bases for SQL.
E = "e AS (SELECT event_type AS k, ts, value AS y, event_id FROM events)"
H = E + ", h AS (SELECT k, date_trunc('hour', ts) AS ts, CAST(sum(CAST(y AS DECIMAL(18,2))) AS DOUBLE) / count(y) AS y FROM e GROUP BY 1, 2)"
D = "d AS (SELECT o_orderpriority AS k, CAST(o_orderdate AS TIMESTAMP) AS ts, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS y FROM orders GROUP BY 1, 2)"
T = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def sql_text(column: str) -> str:
    return T.format(f"CAST({column} AS TIMESTAMP)")


def r7(c: F.Column | str) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 7) + 0.0


def sql_mean(x: str) -> str:
    """A mean as it is compared: to 7 decimals, and never minus zero."""
    return f"(round(avg({x}), 7) + 0.0)"


#: Added before rounding to 7 decimals where means of few decimals can lie just between two, so that a last bit doesn't decide.
HALF = 1.3e-8
