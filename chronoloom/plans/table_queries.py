"""Queries of summaries over written results, and of the streaming forms."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import metrics
from ..operators import crossval, evaluation
from ..session import shared_dir
from ..sources.sinks import VersionedTable
from ..streaming import hourly
from .evaluation_queries import CORE, P, rounded, scored
from .registry import E, H, events, hours, query, r7, read, sql_mean, sql_text, text


def _folder(spark) -> str:
    """A new folder in the one that driver and executors share."""
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


@query(f"WITH {E}, g AS (SELECT k, date_trunc('hour', ts) AS t, avg(y) AS y FROM e GROUP BY 1, 2) SELECT k, {sql_text('t')} AS ts, round(y, 8) AS y FROM g WHERE t + INTERVAL 1 HOUR <= (SELECT max(ts) FROM e) - INTERVAL 2 HOUR")
def streaming_hourly(spark, sf):
    """Events as a stream: means of the hours that the watermark has closed, upserted into a versioned table."""
    at = _folder(spark)
    stream = hourly.events(spark, sf, read(spark, sf, "events").schema, "events.parquet").withColumnsRenamed({"event_type": "k", "value": "y"})
    means = hourly.hourly_mean(stream, ["k"])
    table = VersionedTable(spark, f"{at}/table", means.schema)
    hourly.upserted(means, table, ["k", "ts"], f"{at}/offsets").awaitTermination()
    return table.read().select("k", text("ts").alias("ts"), F.round("y", 8).alias("y"))


@query(f"WITH {P} SELECT k AS model_name, count(*) AS n, {sql_mean("p")} AS mean, min(p) AS min, max(p) AS max FROM a GROUP BY k")
def model_summary(spark, sf):
    return scored(spark, sf).groupBy(F.col("k").alias("model_name")).agg(F.count("*").alias("n"), r7(metrics.mean("p")).alias("mean"), F.min("p").alias("min"), F.max("p").alias("max"))


@query(f"WITH {P}, c AS (SELECT k, {CORE} FROM a GROUP BY k) SELECT *, rank() OVER (ORDER BY mae, k) AS place FROM c")
def compare_reports(spark, sf):
    """One row for each report, best first."""
    out = rounded(evaluation.scores(scored(spark, sf), ["k"]))
    return out.withColumn("place", F.rank().over(Window.orderBy("mae", "k")).cast("long"))  # a row a series


@query(f"WITH {H}, n AS (SELECT k, CAST(ts AS DATE) AS day, count(*) AS n FROM h GROUP BY 1, 2), g AS (SELECT k, min(day) AS a FROM n GROUP BY k) SELECT t.k, strftime(t.day - 1, '%Y-%m-%d') AS day, CAST(coalesce((SELECT sum(n) FROM n WHERE n.k = t.k AND n.day < t.day - 1 AND n.day >= t.day - 8), 0) AS BIGINT) AS n_train, t.n AS n_test FROM n t JOIN g USING (k) WHERE t.day - 1 >= a AND (t.day - 1 - a) % 2 = 0 AND t.n >= 20 AND coalesce((SELECT sum(n) FROM n WHERE n.k = t.k AND n.day < t.day - 1 AND n.day >= t.day - 8), 0) >= 100")
def backtest_sliding(spark, sf):
    """Backtest days with a train window of 7 days."""
    out = crossval.backtest_days(hours(spark, sf), ["k"], 2, 1, 7, 100, 20)
    return out.select("k", F.date_format("day", "yyyy-MM-dd").alias("day"), "n_train", "n_test")


@query("SELECT c_mktsegment AS k, c_custkey AS id, c_acctbal AS v FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 0 ORDER BY v DESC, id LIMIT 20")
def optional_filters(spark, sf):
    """A reader whose filters are there only if asked for, newest first, n at most."""
    from ..sources import series

    c = read(spark, sf, "customer").select(F.col("c_mktsegment").alias("k"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"))
    return series.between(c, None, None, k="BUILDING", id=None).where("v >= 0").orderBy(F.desc("v"), "id").limit(20)


@query(f"WITH {E} SELECT DISTINCT k, CAST(year(ts) AS BIGINT) AS year, strftime(max(ts), '%Y%m%d_%H%M%S') AS version FROM e GROUP BY 1, 2")
def distinct_versions(spark, sf):
    from ..functions import scalars

    return events(spark, sf).groupBy("k", F.year("ts").cast("long").alias("year")).agg(scalars.version_of(F.max("ts")).alias("version"))
