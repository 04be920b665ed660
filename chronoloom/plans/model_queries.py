"""Queries that train models, all series at once and by the operators' presets: rows only where trees have no SQL, SQL for what they are trained on."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics, scalars
from ..operators import boosting, comparison, crossval, features, joins, prediction, search, series_models, validation, windows
from .registry import E, H, HALF, events, hours, query, r7, sql_text, text
from .series_queries import ERR, errors, matrix, r9

W = "(PARTITION BY k ORDER BY ts)"


def _features(df) -> list[str]:
    return features.model_columns([c for c in df.columns if c not in ("k", "ts", "y", "err", "tso", "fold", "role")])


@query()
def gbt_forecast(spark, sf):
    """A boosted model of each series, stopped early and scored on its last 100 hours."""
    m = windows.tail_split(matrix(spark, sf), ["k"], 100)
    names = _features(m.drop("is_validation"))
    models = boosting.fit_all(m, ["k"], names, check="is_validation")
    got = boosting.predict_all(m.where("is_validation"), models, ["k"], names)
    return got.groupBy("k").agg(*[c.alias(n) for n, c in metrics.bundle().items()])


@query()
def feature_importance(spark, sf):
    """The ten columns of each series' model with the most gain."""
    m = matrix(spark, sf)
    return boosting.importance(boosting.fit_all(m, ["k"], _features(m)), ["k"], _features(m)).where("place <= 10").drop("trial")


@query()
def ts_cv_forecast(spark, sf):
    """Out-of-fold forecasts of all series over expanding folds."""
    m = matrix(spark, sf)
    got = boosting.out_of_fold(crossval.time_series_split(m, ["k"], 3), ["k"], _features(m))
    return got.groupBy("k", "fold").agg(metrics.mae().alias("mae"), F.count("*").alias("n"))


@query()
def algorithms_compared(spark, sf):
    """The three presets on the same folds of all series, the best first."""
    m = matrix(spark, sf)
    folds = crossval.time_series_split(m, ["k"], 3)
    got = boosting.out_of_fold(folds, ["k"], _features(m), trials=list(boosting.PRESETS.values()))
    out = got.groupBy("k", "trial").agg(metrics.mae().alias("mae")).withColumn("algorithm", F.get(F.array(*map(F.lit, boosting.PRESETS)), F.col("trial")))
    return windows.top(out.drop("trial"), ["k"], [F.col("mae"), F.col("algorithm")], 3)


@query()
def cascade_oof(spark, sf):
    """Every series explained by out-of-fold forecasts of what the others come to and of its own next day."""
    m = matrix(spark, sf)
    ahead = m.select("k", (F.col("ts") - F.expr("interval 24 hours")).alias("ts"), F.col("y").alias("renewable"))
    m = m.withColumn("load", F.col("x")).join(ahead, ["k", "ts"], "left")
    base = [c for c in _features(m) if c not in ("load", "renewable", "x")]
    _, out, _ = series_models.cascade_all(m, ["k"], base, ["load", "renewable"])
    return out.select("k", text("ts").alias("ts"), "y", "cascade_load", "cascade_renewable", "cascade_residual")


@query()
def tso_corrected(spark, sf):
    """An external forecast of each series, corrected by its foreseen error; series with too few errors before have none."""
    e = errors(spark, sf)
    got = series_models.corrected_all(e, ["k"], [*_features(e), "tso"], "2024-01-24", least=300)
    return got.select("k", text("ts").alias("ts"), "y", "tso", "corrected")


@query()
def feature_elim(spark, sf):
    """Backward elimination of features, each series by itself."""
    m = matrix(spark, sf)
    return series_models.eliminate_all(crossval.time_series_split(m, ["k"], 3), ["k"], _features(m), params={"rounds": 60})


@query()
def parzen_search(spark, sf):
    """The best parameters of each series after 20 trials."""
    m = matrix(spark, sf)
    got = search.search_all(crossval.time_series_split(m, ["k"], 3), ["k"], _features(m), trials=20, rounds=50)
    return got.where("best").select("k", "trial", "params", "loss")


FOLDS = """z AS (SELECT k, max(ts) AS z, min(ts) AS a FROM h GROUP BY k HAVING floor(epoch(max(ts) - min(ts)) / 86400) - 3 * 3 >= 16),
f AS (SELECT k, CAST(3 - b AS INT) AS fold, a, z - (b * 3 + 3) * INTERVAL 1 DAY - INTERVAL 1 DAY AS t FROM z, range(3) v(b))"""


@query(f"WITH {H}, {FOLDS} SELECT f.k, fold, count(*) AS n_train, {sql_text('max(h.ts)')} AS last, round(avg(h.y), 7) AS mean FROM f JOIN h ON h.k = f.k AND h.ts >= a AND h.ts < t GROUP BY 1, 2")
def walk_forward_models(spark, sf):
    """What the models of all series and walk-forward folds are trained on, read off the models themselves: without trees a model is its mean."""
    h = hours(spark, sf)
    folds = crossval.walk_forward_folds(h, ["k"], folds=3, test_days=3, gap_days=1, least_days=16)
    rows = crossval.in_folds(h, folds, ["k"]).where("role = 'train'").withColumn("hour", F.hour("ts"))
    models = boosting.fit_all(rows, ["k", "fold"], ["hour"], trials=[{"rounds": 0}])
    last = rows.groupBy("k", "fold").agg(F.max("ts").alias("last"))
    return models.join(last, ["k", "fold"]).select("k", "fold", F.col("n").alias("n_train"), text("last").alias("last"), r7("base").alias("mean"))


@query()
def walk_forward_trained(spark, sf):
    """Boosted models of all series and folds, trained in one job, judged fold by fold against the week before."""
    m = joins.offset_lookup(matrix(spark, sf), ["k"], 168, "base")
    folds = crossval.walk_forward_folds(m, ["k"], folds=3, test_days=2, gap_days=1, least_days=6)
    return validation.by_fold(validation.trained_all(m, folds, ["k"], [c for c in _features(m) if c != "base"]), ["k"], "base")


# prediction as of a moment

AS_OF = "2024-01-24 14:00:00"
#: Series that aren't there, or lack their late hours, fall back.
PAST = f"""{H}, n AS (SELECT * FROM h WHERE NOT (k = 'signup' AND hour(ts) >= 20) AND ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-25'),
g AS (SELECT *, y + 240 AS t FROM n),
m AS (SELECT *, lag(y, 24) OVER {W} AS l1, lag(y, 168) OVER {W} AS l7, lag(y, 336) OVER {W} AS l14, avg(y) OVER (PARTITION BY k ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS m24 FROM g),
q AS (SELECT * FROM m WHERE l14 IS NOT NULL),
last AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY k, hour(ts) ORDER BY ts DESC) = 1),
mean AS (SELECT k, avg(y) AS m FROM q GROUP BY k),
w AS (SELECT k, date_trunc('hour', ts) AS ts, arg_max(y + 250, event_id) AS t FROM e WHERE date_trunc('day', ts) - ((event_id % 3) * INTERVAL 6 HOUR) <= TIMESTAMP '{AS_OF}' AND event_id % 7 > 0 AND ts >= TIMESTAMP '2024-01-25' GROUP BY 1, 2)"""


@query(f"""WITH {PAST}, x AS (SELECT k, horizon, TIMESTAMP '2024-01-24 00:00:00' + (horizon * 24 + r) * INTERVAL 1 HOUR AS ts FROM (SELECT DISTINCT k FROM h UNION SELECT 'nobody'), (VALUES (1), (2)) d(horizon), range(24) v(r)),
z AS (SELECT x.k, x.horizon, x.ts, l1, l7, l14, m24, last.k IS NOT NULL AS has, CASE WHEN last.k IS NOT NULL THEN coalesce(w.t, last.t) END AS t, CASE WHEN last.k IS NULL THEN coalesce(mean.m, 0.0) END AS fallback FROM x LEFT JOIN last ON last.k = x.k AND hour(last.ts) = hour(x.ts) LEFT JOIN mean ON mean.k = x.k LEFT JOIN w ON w.k = x.k AND w.ts = x.ts)
SELECT k, horizon, {sql_text('ts')} AS ts, l1, l7, l14, round(m24 + {HALF}, 7) AS m24, CASE WHEN has THEN CAST(hour(ts) AS BIGINT) END AS hour, CASE WHEN has THEN CAST(isodow(ts) - 1 AS BIGINT) END AS day_of_week, CASE WHEN has THEN CAST(isodow(ts) >= 6 AS BIGINT) END AS is_weekend,
round(t, 7) AS temperature_2m_k, round(t - 273.15, 7) AS temperature_c, CASE WHEN k = 'click' AND t IS NOT NULL THEN round(greatest(0.0, 18 - (t - 273.15)), 7) END AS heating_degree, round(fallback, 7) AS fallback FROM z""")
def predict_frame(spark, sf):
    """The rows to forecast, one and two days ahead, for every series and one without a past: features of the same hour, the target's calendar, the latest
    weather known by then, and fallbacks."""
    h = hours(spark, sf)
    past = prediction.known(h.where("not (k = 'signup' and hour(ts) >= 20)"), AS_OF, prediction.LOOKBACK).withColumn("temperature_2m_k", F.col("y") + 240)
    load = F.col("k") == "click"
    frame, names = prediction.frame_of(past, ["k"], ["temperature_2m_k"], load)
    e = events(spark, sf).where("event_id % 7 > 0")
    run = F.date_trunc("day", "ts") - F.make_dt_interval(hours=(F.col("event_id") % 3 * 6).cast("int"))
    runs = e.where(run <= F.lit(AS_OF).cast("timestamp")).groupBy("k", F.date_trunc("hour", "ts").alias("ts")).agg(F.max_by(F.col("y") + 250, "event_id").alias("temperature_2m_k"))
    keys = h.select("k").distinct().union(spark.range(1).select(F.lit("nobody")))
    start = F.date_trunc("day", F.lit(AS_OF).cast("timestamp")) + F.make_dt_interval(days="horizon")
    targets = keys.withColumn("horizon", F.explode(F.array(F.lit(1), F.lit(2)))).select("k", "horizon", F.explode(F.sequence(start, start + F.expr("interval 23 hours"), F.expr("interval 1 hour"))).alias("ts"))
    got = prediction.assemble(frame, targets, ["k"], names, runs, load=load)
    calendar = [F.col(c).cast("long").alias(c) for c in ("hour", "day_of_week", "is_weekend")]
    return got.select("k", "horizon", text("ts").alias("ts"), F.col("y_lag_1d").alias("l1"), F.col("y_lag_7d").alias("l7"), F.col("y_lag_14d").alias("l14"), r7(F.col("y_roll_24h_mean") + HALF).alias("m24"), *calendar, *[r7(c).alias(c) for c in ("temperature_2m_k", "temperature_c", "heating_degree", "fallback")])


@query()
def predicted_days(spark, sf):
    """Forecasts of every series one and two days ahead, by models of its past."""
    h = hours(spark, sf)
    past = prediction.known(h, AS_OF)
    models, names = prediction.trained(past, ["k"], validation_rows=48)
    start = F.date_trunc("day", F.lit(AS_OF).cast("timestamp")) + F.make_dt_interval(days="horizon")
    targets = h.select("k").distinct().withColumn("horizon", F.explode(F.array(F.lit(1), F.lit(2)))).select("k", "horizon", F.explode(F.sequence(start, start + F.expr("interval 23 hours"), F.expr("interval 1 hour"))).alias("ts"))
    got = prediction.predicted(past, models, names, targets, ["k"], AS_OF)
    return got.withColumn("horizon_hours", scalars.horizon_hours(F.col("ts"), F.lit(AS_OF).cast("timestamp"))).withColumn("ts", text("ts"))


# backtest with retraining

RETRAIN = f"""{ERR}, s AS (SELECT k, CAST(ts AS DATE) AS day, count(*) AS n_test, count(l) AS u FROM (SELECT *, lag(err, 24) OVER {W} AS l FROM e2) GROUP BY 1, 2),
r AS (SELECT k, day, n_test, coalesce(sum(n_test) OVER v, 0) AS n_train, coalesce(sum(u) OVER v, 0) AS u FROM s WINDOW v AS (PARTITION BY k ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
d AS (SELECT k, day, n_test, CAST(n_train AS BIGINT) AS n_train, (row_number() OVER (PARTITION BY k ORDER BY day) - 1) // 5 AS epoch FROM r WHERE day >= DATE '2024-01-08' AND n_train >= 120 AND u >= 60 AND n_test >= 12)"""


def _retraining(spark, sf):
    e = errors(spark, sf)
    return e, validation.retraining_days(e, ["k"], "2024-01-08", 5, 12, 120, 60, "err_lag_1d")


@query(f"WITH {RETRAIN} SELECT k, strftime(day, '%Y-%m-%d') AS day, n_test, n_train, epoch, strftime(min(day) OVER (PARTITION BY k, epoch), '%Y-%m-%d') AS until FROM d")
def retrain_membership(spark, sf):
    """Which day is forecast by which model, and what it may have learnt from."""
    _, days = _retraining(spark, sf)
    return days.select("k", F.date_format("day", "yyyy-MM-dd").alias("day"), "n_test", "n_train", F.col("epoch").cast("long").alias("epoch"), F.date_format("until", "yyyy-MM-dd").alias("until"))


@query(f"""WITH {RETRAIN}, b AS (SELECT k, epoch, min(day) AS until FROM d GROUP BY 1, 2), p AS (SELECT b.k, b.epoch, avg(err) AS p FROM b JOIN e2 ON e2.k = b.k AND e2.ts < b.until GROUP BY 1, 2),
t AS (SELECT e2.k, d.day, e2.y, tso, greatest(0.0, tso + p) AS fixed FROM e2 JOIN d ON d.k = e2.k AND d.day = CAST(e2.ts AS DATE) JOIN p ON p.k = d.k AND p.epoch = d.epoch),
u AS (SELECT k, 'tso_raw' AS model, day, y, tso AS p FROM t UNION ALL SELECT k, 'tso_corrected', day, y, fixed FROM t)
SELECT k, model, strftime(day, '%Y-%m-%d') AS day, round(avg(abs(p - y)), 7) AS mae, round(sqrt(avg((p - y) * (p - y))), 7) AS rmse, round(avg(p - y), 7) + 0.0 AS bias, count(*) AS n FROM u GROUP BY GROUPING SETS ((k, model, day), (k, model))""")
def retrain_bias(spark, sf):
    """The backtest with models that are a mean error each: raw and corrected scores by day and over all."""
    e, days = _retraining(spark, sf)
    out = validation.correction_backtest(e, days, ["k"], ["hour"], params={"rounds": 0})
    return out.select("k", "model", F.date_format("day", "yyyy-MM-dd").alias("day"), *[r7(c).alias(c) for c in ("mae", "rmse", "bias")], "n")


@query()
def retrain_backtest(spark, sf):
    """The backtest with trees, of all series and epochs in one job."""
    e, days = _retraining(spark, sf)
    names = [c for c in _features(e) if not c.startswith("err_roll")] + ["tso"]  # trailing errors hold the row itself
    return validation.correction_backtest(e, days, ["k"], names).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


# which features are better

POISSON = " + ".join(f"CASE WHEN u >= {s!r} THEN 1 ELSE 0 END" for s in comparison.STEPS)


@query(f"""WITH {H}, l AS (SELECT h.k, CAST(h.ts AS DATE) AS day, abs(a.y - h.y) AS a, abs(b.y - h.y) - abs(a.y - h.y) AS d FROM h JOIN h a ON a.k = h.k AND a.ts = h.ts - INTERVAL 24 HOUR JOIN h b ON b.k = h.k AND b.ts = h.ts - INTERVAL 168 HOUR),
s AS (SELECT k, day, sum(d) AS s, count(*) AS n FROM l GROUP BY 1, 2),
u AS (SELECT *, CAST('0x' || substr(md5(strftime(day, '%Y-%m-%d') || '|' || CAST(draw AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM s, range(200) r(draw)),
m AS (SELECT k, draw, sum(w * s) / nullif(sum(w * n), 0) AS m FROM (SELECT *, {POISSON} AS w FROM u) GROUP BY 1, 2), i AS (SELECT k, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY k),
t AS (SELECT k, avg(a) AS mae_a, avg(a + d) AS mae_b, avg(d) AS mean, count(*) AS n, count(DISTINCT day) AS blocks FROM l GROUP BY k)
SELECT k, n, blocks, round(mae_a, 7) AS mae_a, round(mae_b, 7) AS mae_b, round(mean / mae_a * 100, 7) AS change_pct, round(mean, 7) AS mean, round(low, 7) AS low, round(high, 7) AS high, CASE WHEN high < 0 THEN 'b' WHEN low > 0 THEN 'a' ELSE 'neither' END AS better FROM t JOIN i USING (k)""")
def ab_baselines(spark, sf):
    """Yesterday's hour against last week's, on the hours that have both, with intervals of drawn days."""
    h = joins.offset_lookup(joins.offset_lookup(hours(spark, sf), ["k"], 24, "a"), ["k"], 168, "b").withColumn("day", F.to_date("ts"))
    out = comparison.paired(h, ["k"], "a", "b", "day")
    return out.withColumns({c: r7(c) for c in ("mae_a", "mae_b", "change_pct", "mean", "low", "high")})


@query()
def ab_feature_sets(spark, sf):
    """Models without and with what the other series come to, on the same out-of-fold rows of all series."""
    m = matrix(spark, sf)
    names = _features(m)
    return comparison.feature_sets(crossval.time_series_split(m, ["k"], 3), ["k"], [c for c in names if c != "x"], names)
