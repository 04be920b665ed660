"""Queries of the metrics, breakdowns, tests, cross-validation and control operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics, scalars
from ..operators import control, crossval, evaluation, joins, windows
from ..sources import series
from .registry import D, E, H, HALF, days, events, hours, local, query, r7, read, sql_mean, sql_text, text
from .series_queries import S, of, r9, regular

W = "(PARTITION BY k ORDER BY ts)"
#: Forecasts to be scored: persistence at 24 h, the mean of the same hour, and the truth a week before.
P = H + """, a AS (SELECT h.k, h.ts, h.y, b.y AS p FROM h JOIN h b ON h.k = b.k AND b.ts = h.ts - INTERVAL 24 HOUR)"""
B = H + """, w AS (SELECT x.k, x.ts, avg(z.y) AS weekly FROM h x LEFT JOIN h z ON x.k = z.k AND hour(x.ts) = hour(z.ts) AND z.ts >= x.ts - INTERVAL 192 HOUR AND z.ts < x.ts - INTERVAL 24 HOUR GROUP BY 1, 2),
b AS (SELECT h.k, h.ts, h.y, q.y AS persistence, w.weekly FROM h LEFT JOIN h q ON h.k = q.k AND q.ts = h.ts - INTERVAL 24 HOUR JOIN w ON w.k = h.k AND w.ts = h.ts)"""


def scored(spark, sf):
    return joins.offset_lookup(hours(spark, sf), ["k"], 24, "p").dropna(subset=["p"])


def with_baselines(spark, sf):
    h = joins.offset_lookup(hours(spark, sf), ["k"], 24, "persistence")
    return joins.same_hour_mean(h, ["k"], "weekly", hours=24)


MAE, BIAS = sql_mean("abs(p - y)"), sql_mean("p - y")


def rounded(df, digits: int = 7, *, skip=()):
    return df.withColumns({n: r7(n) if digits == 7 else F.round(n, digits) for n, t in df.dtypes if t == "double" and n not in skip})


@query(f"""WITH {B}, u AS (SELECT k, y, 'persistence' AS baseline, persistence AS p FROM b WHERE persistence IS NOT NULL UNION ALL SELECT k, y, 'weekly', weekly FROM b WHERE weekly IS NOT NULL),
s AS (SELECT k, baseline, avg(abs(p - y)) AS mae, sqrt(avg((p - y) * (p - y))) AS rmse, 100 * avg(abs(p - y) / ((abs(y) + abs(p)) / 2 + 1e-8)) AS smape, count(*) AS n FROM u GROUP BY 1, 2)
SELECT s.k, s.baseline, round(mae, 7) AS mae, round(rmse, 7) AS rmse, round(smape, 7) AS smape, n, round(1 - mae / nullif(f.base, 0), 7) AS skill FROM s LEFT JOIN (SELECT k, mae AS base FROM s WHERE baseline = 'persistence') f USING (k)""")
def beats_persistence(spark, sf):
    """Which series beats persistence, and by how much: scores of two baselines and the skill of each against persistence."""
    s = evaluation.baseline_scores(with_baselines(spark, sf), ["k"], ["persistence", "weekly"])
    base = s.where("baseline = 'persistence'").select("k", F.col("mae").alias("base"))
    out = s.join(base, "k", "left").withColumn("skill", metrics.skill(F.col("mae"), F.col("base")))
    return rounded(out.select("k", "baseline", "mae", "rmse", "smape", "n", "skill"))


CORE = f"{MAE} AS mae, round(sqrt(avg((p - y) * (p - y))), 7) AS rmse, round(100 * avg(CASE WHEN abs(y) > 1 THEN abs((p - y) / y) END), 7) AS mape, round(100 * avg(abs(p - y) / ((abs(y) + abs(p)) / 2 + 1e-8)), 7) AS smape, {BIAS} AS bias, count(*) AS n"


@query(f"WITH {P} SELECT k, {CORE} FROM a GROUP BY k")
def metric_core(spark, sf):
    return rounded(evaluation.scores(scored(spark, sf), ["k"]))


@query(f"WITH {P} SELECT k, round(100 * avg(CASE WHEN abs(y) > 10 THEN abs((p - y) / y) END), 7) AS mape_10, round(100 * avg(CASE WHEN abs(y) > 1e-8 THEN abs((p - y) / y) END), 6) AS mape_eps, round(100 * avg(abs((p - y) / CASE WHEN y = 0 THEN 1 ELSE y END)), 6) AS mape_unit, round(100 * avg(abs((p - y) / nullif(y, 0))), 6) AS mape_plain FROM a GROUP BY k")
def metric_mape_thr(spark, sf):
    out = scored(spark, sf).groupBy("k").agg(metrics.mape(floor=10.0).alias("mape_10"), metrics.mape(floor=1e-8).alias("mape_eps"), metrics.mape_unit().alias("mape_unit"), metrics.mape_plain().alias("mape_plain"))
    return rounded(out, 6, skip=("mape_10",)).withColumn("mape_10", r7("mape_10"))


@query(f"WITH {P} SELECT k, round(100 * avg(2 * abs(p - y) / (abs(y) + abs(p) + 1e-8)), 7) AS smape FROM a GROUP BY k")
def metric_smape_eps(spark, sf):
    return rounded(scored(spark, sf).groupBy("k").agg(metrics.smape_whole().alias("smape")))


@query(f"WITH {P}, n AS (SELECT *, abs(y - lag(y, 24) OVER {W}) AS naive FROM a) SELECT k, round(avg(abs(p - y)) / nullif(avg(naive), 0), 9) AS mase FROM n GROUP BY k")
def metric_mase(spark, sf):
    return rounded(evaluation.scaled_error(scored(spark, sf), ["k"]), 9)


@query(f"WITH {P}, n AS (SELECT k, sign(y - lag(y) OVER {W}) = sign(p - lag(p) OVER {W}) AS same FROM a) SELECT k, round(100 * avg(CAST(same AS DOUBLE)), 9) AS directional FROM n GROUP BY k")
def metric_direction(spark, sf):
    return rounded(evaluation.directional(scored(spark, sf), ["k"]), 9)


PEAK = "hour(ts) IN (8, 9, 10, 11, 17, 18, 19, 20)"


@query(f"WITH {P}, m AS (SELECT k, avg(CASE WHEN {PEAK} THEN abs(p - y) END) AS i, avg(CASE WHEN NOT {PEAK} THEN abs(p - y) END) AS o, 100 * avg(CASE WHEN {PEAK} AND abs(y) > 1 THEN abs((p - y) / y) END) AS pm FROM a GROUP BY k) SELECT k, round(i + {HALF}, 7) AS peak_mae, round(o + {HALF}, 7) AS offpeak_mae, round(pm, 7) AS peak_mape, CASE WHEN i > 0 AND o > 0 THEN round(i / o, 7) END AS peak_ratio FROM m")
def metric_peak(spark, sf):
    out = scored(spark, sf).withColumn("hour", F.hour("ts"))
    out = out.groupBy("k").agg(*[c.alias(n) for n, c in metrics.peak("hour").items()])
    return rounded(out.withColumns({c: F.col(c) + HALF for c in ("peak_mae", "offpeak_mae")}))


@query(f"WITH {B}, m AS (SELECT k, avg(abs(weekly - y)) AS x, avg(abs(persistence - y)) AS z FROM b WHERE weekly IS NOT NULL AND persistence IS NOT NULL GROUP BY k) SELECT k, round(1 - x / nullif(z, 0), 9) AS skill, round(CASE WHEN z = 0 THEN 0.0 ELSE 1 - x / z END, 9) AS skill_or_zero FROM m")
def metric_skill(spark, sf):
    b = with_baselines(spark, sf).dropna(subset=["weekly", "persistence"])
    m = b.groupBy("k").agg(metrics.mae("y", "weekly").alias("x"), metrics.mae("y", "persistence").alias("z"))
    return m.select("k", r9(metrics.skill(F.col("x"), F.col("z"))).alias("skill"), r9(metrics.skill_or_zero(F.col("x"), F.col("z"))).alias("skill_or_zero"))


QS = (0.1, 0.5, 0.9)
QUANTILES = E + ", q AS (SELECT k, unnest([0.1, 0.5, 0.9])::DOUBLE AS q, unnest([quantile_cont(y, 0.1), quantile_cont(y, 0.5), quantile_cont(y, 0.9)]) AS pred FROM e GROUP BY k)"


def quantiles(spark, sf):
    e = events(spark, sf)
    pick = F.explode(F.arrays_zip(F.array(*map(F.lit, QS)).alias("q"), F.col("v").alias("pred")))
    return e, e.groupBy("k").agg(F.percentile("y", F.array(*map(F.lit, QS))).alias("v")).select("k", pick.alias("z")).select("k", F.col("z.q").alias("q"), F.col("z.pred").alias("pred"))


@query(f"WITH {QUANTILES} SELECT e.k, q, {sql_mean("CASE WHEN y >= pred THEN q * (y - pred) ELSE (q - 1) * (y - pred) END")} AS pinball FROM e JOIN q USING (k) GROUP BY 1, 2")
def metric_pinball(spark, sf):
    e, q = quantiles(spark, sf)
    return rounded(e.join(F.broadcast(q), "k").groupBy("k", "q").agg(metrics.pinball(F.col("q"), "y", "pred").alias("pinball")), 7, skip=("q",))  # q: a few rows a series


@query(f"""WITH {QUANTILES}, s AS (SELECT e.k, event_id, q, (q - CAST(y <= pred AS DOUBLE)) ** 2 AS h FROM e JOIN q USING (k)),
n AS (SELECT *, lead(q) OVER v AS q2, lead(h) OVER v AS h2 FROM s WINDOW v AS (PARTITION BY k, event_id ORDER BY q)), r AS (SELECT k, event_id, sum((q2 - q) / 2 * (h + h2)) AS c FROM n GROUP BY 1, 2) SELECT k, round(avg(c), 9) AS crps FROM r GROUP BY k""")
def metric_crps(spark, sf):
    e, q = quantiles(spark, sf)
    return rounded(evaluation.crps(e.join(F.broadcast(q), "k"), ["k"], ["event_id"]), 9)


def losses(spark, sf):
    b = with_baselines(spark, sf).dropna(subset=["weekly", "persistence"])
    return b.select("k", "ts", (F.abs(F.col("weekly") - F.col("y"))).alias("loss_a"), F.abs(F.col("persistence") - F.col("y")).alias("loss_b"))


@query(f"""WITH {B}, d AS (SELECT k, ts, abs(weekly - y) - abs(persistence - y) AS d FROM b WHERE weekly IS NOT NULL AND persistence IS NOT NULL), m AS (SELECT *, avg(d) OVER (PARTITION BY k) AS m FROM d),
g AS (SELECT *, (d - m) * (d - m) AS g0, (d - m) * (lag(d) OVER {W} - m) AS g1 FROM m), v AS (SELECT k, count(*) AS n, avg(d) AS md, (avg(g0) + 2 * avg(g1)) / count(*) AS v FROM g GROUP BY k)
SELECT k, n, round(md, 7) AS mean_diff, round(CASE WHEN v > 0 THEN md / sqrt(v) ELSE 0.0 END, 6) AS statistic, v > 0 AS conclusive FROM v""")
def dm_statistic(spark, sf):
    out = evaluation.dm_statistic(losses(spark, sf), ["k"], 2)
    return out.withColumns({"mean_diff": r7("mean_diff"), "statistic": F.round("statistic", 6)})


@query()
def dm_test(spark, sf):
    """With p values, which neither engine has a function for."""
    return evaluation.dm_test(losses(spark, sf), ["k"], 2)


@query(f"WITH {P} SELECT k, CAST(hour(ts) AS BIGINT) AS hour, {CORE}, {sql_mean("y")} AS mean_actual, {sql_mean("p")} AS mean_pred FROM a GROUP BY 1, 2")
def hourly_breakdown(spark, sf):
    return rounded(evaluation.hourly(scored(spark, sf), ["k"]).withColumn("hour", F.col("hour").cast("long")))


SEASON = "CASE WHEN month(ts) IN (12, 1, 2) THEN 'winter' WHEN month(ts) <= 5 THEN 'spring' WHEN month(ts) <= 8 THEN 'summer' ELSE 'autumn' END"
DAYS = D + ", g AS (SELECT a.k, a.ts, a.y / 1000 AS y, b.y / 1000 AS p, c.y / 1000 AS base FROM d a JOIN d b ON a.k = b.k AND b.ts = a.ts - INTERVAL 7 DAY LEFT JOIN d c ON a.k = c.k AND c.ts = a.ts - INTERVAL 1 DAY)"


def daily(spark, sf):
    d = days(spark, sf).withColumn("y", F.col("y") / 1000)
    d = joins.offset_lookup(d, ["k"], 168, "p")
    return joins.offset_lookup(d, ["k"], 24, "base").dropna(subset=["p"])


@query(f"WITH {DAYS} SELECT k, {SEASON} AS season, round(avg(abs(p - y)), 5) AS mae, round(sqrt(avg((p - y) * (p - y))), 5) AS rmse, count(*) AS n, round(1 - avg(CASE WHEN base IS NOT NULL THEN abs(p - y) END) / nullif(avg(CASE WHEN base IS NOT NULL THEN abs(base - y) END), 0), 8) AS skill FROM g GROUP BY 1, 2")
def seasonal_breakdown(spark, sf):
    out = evaluation.seasonal(daily(spark, sf), ["k"], "base")
    return out.withColumns({"mae": F.round("mae", 5), "rmse": F.round("rmse", 5), "skill": F.round("skill", 8)})


@query(f"""WITH {P}, x AS (SELECT k, p - y AS e FROM a), m AS (SELECT k, avg(e) AS m, stddev_pop(e) AS s FROM x GROUP BY k), z AS (SELECT x.k, e, (e - m) AS c, s FROM x JOIN m USING (k))
SELECT k, {sql_mean("e")} AS mean, round(any_value(s), 7) AS std, round(quantile_cont(e, 0.05), 7) AS p5, round(quantile_cont(e, 0.25), 7) AS p25, round(quantile_cont(e, 0.5), 7) AS median, round(quantile_cont(e, 0.75), 7) AS p75, round(quantile_cont(e, 0.95), 7) AS p95,
round(CASE WHEN any_value(s) = 0 THEN 0.0 ELSE avg(c * c * c) / power(any_value(s), 3) END, 7) AS skew, round(CASE WHEN any_value(s) = 0 THEN 0.0 ELSE avg(c * c * c * c) / power(any_value(s), 4) - 3 END, 7) AS kurtosis, round(max(e), 7) AS max, round(min(e), 7) AS min FROM z GROUP BY k""")
def error_distribution(spark, sf):
    return rounded(evaluation.error_distribution(scored(spark, sf), ["k"]))


@query(f"WITH {P} SELECT k, q, count(*) AS n, true AS within FROM a, (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95])::DOUBLE AS q) GROUP BY 1, 2")
def error_quantiles(spark, sf):
    """Quantiles of errors from sketches of single days, put together, and whether each one's true rank is as near as promised."""
    s = scored(spark, sf)
    got = evaluation.error_quantiles(evaluation.error_sketches(s.withColumn("day", F.to_date("ts")), ["k", "day"]), ["k"])
    e = s.select("k", (F.col("p") - F.col("y")).alias("e"))
    ranks = e.join(got, "k").groupBy("k", "q", "n").agg(F.avg((F.col("e") <= F.col("value")).cast("double")).alias("high"), F.avg((F.col("e") < F.col("value")).cast("double")).alias("low"))  # five quantiles a series
    within = (F.col("low") - evaluation.RANK_ERROR <= F.col("q")) & (F.col("q") <= F.col("high") + evaluation.RANK_ERROR)
    return ranks.select("k", "q", "n", within.alias("within"))


@query(f"WITH {P}, x AS (SELECT k, strftime(ts, '%Y-%m-%d') AS day, y, p FROM a) SELECT k, day, {CORE} FROM x GROUP BY GROUPING SETS ((k, day), (k))")
def daily_rollup(spark, sf):
    return rounded(evaluation.daily_and_total(scored(spark, sf).withColumn("day", F.date_format("ts", "yyyy-MM-dd")), ["k"]))


@query(f"WITH {B}, u AS (SELECT k, y, 'persistence' AS baseline, persistence AS p FROM b WHERE persistence IS NOT NULL UNION ALL SELECT k, y, 'weekly', weekly FROM b WHERE weekly IS NOT NULL) SELECT k, baseline, {CORE} FROM u GROUP BY 1, 2")
def baseline_scoreboard(spark, sf):
    return rounded(evaluation.baseline_scores(with_baselines(spark, sf), ["k"], ["persistence", "weekly"]))


@query(f"WITH {B} SELECT k, {sql_mean("abs(persistence - y)")} AS persistence, {sql_mean("abs(weekly - y)")} AS weekly FROM b GROUP BY k")
def type_pivot(spark, sf):
    s = evaluation.baseline_scores(with_baselines(spark, sf), ["k"], ["persistence", "weekly"])
    return rounded(s.groupBy("k").pivot("baseline", ["persistence", "weekly"]).agg(F.avg("mae")))


@query("SELECT l_returnflag, round(corr(CAST(l_quantity AS DOUBLE), CAST(l_extendedprice AS DOUBLE)), 9) AS r FROM lineitem GROUP BY 1")
def corr_by_type(spark, sf):
    return read(spark, sf, "lineitem").groupBy("l_returnflag").agg(r9(F.corr(F.col("l_quantity").cast("double"), F.col("l_extendedprice").cast("double"))).alias("r"))


@query("WITH f AS (SELECT l_returnflag AS k, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem), c AS (SELECT k, regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM f GROUP BY k) SELECT k, round(avg(abs(y - (i + s * x))), 6) AS mae, round((avg(abs(y - 38)) - avg(abs(y - (i + s * x)))) / avg(abs(y - 38)) * 100, 6) AS improvement FROM f JOIN c USING (k) GROUP BY k")
def ols_mae(spark, sf):
    f = read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("k"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    c = f.groupBy("k").agg(F.regr_slope("y", "x").alias("s"), F.regr_intercept("y", "x").alias("i"))
    e, base = F.avg(F.abs(F.col("y") - (F.col("i") + F.col("s") * F.col("x")))), F.avg(F.abs(F.col("y") - 38))
    return rounded(f.join(F.broadcast(c), "k").groupBy("k").agg(e.alias("mae"), (F.try_divide(base - e, base) * 100).alias("improvement")), 6)  # c: a row a series


@query(f"WITH {B}, m AS (SELECT k, avg(abs(persistence - y)) AS p, avg(abs(weekly - y)) AS w FROM b GROUP BY k) SELECT count(*) AS n, round(avg(CAST((p - w) / nullif(p, 0) * 100 > 0 AS DOUBLE)), 9) AS share_improved FROM m")
def improvement_share(spark, sf):
    m = with_baselines(spark, sf).groupBy("k").agg(metrics.mae("y", "persistence").alias("p"), metrics.mae("y", "weekly").alias("w"))
    return m.agg(F.count("*").alias("n"), r9(F.avg((F.try_divide(F.col("p") - F.col("w"), F.col("p")) * 100 > 0).cast("double"))).alias("share_improved"))


@query(f"WITH {H}, l AS (SELECT DISTINCT k, r AS hour FROM h, range(24) v(r)), q AS (SELECT k, hour(ts) AS hour, arg_max(y, ts) AS y FROM h WHERE hour(ts) < 20 GROUP BY 1, 2), m AS (SELECT k, avg(y) AS m FROM h GROUP BY k) SELECT l.k, CAST(l.hour AS BIGINT) AS hour, round(coalesce(q.y, m.m), 9) AS p FROM l LEFT JOIN q ON q.k = l.k AND q.hour = l.hour JOIN m ON m.k = l.k")
def recent_mean_fallback(spark, sf):
    h = hours(spark, sf)
    last = windows.last_per_hour(h.where(F.hour("ts") < 20), ["k"]).select("k", "hour", "y")
    every = h.groupBy("k").agg(F.avg("y").alias("m")).withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    return every.join(last, ["k", "hour"], "left").select("k", F.col("hour").cast("long").alias("hour"), r9(F.coalesce("y", "m")).alias("p"))


@query(f"WITH {H}, m AS (SELECT hour(ts) AS hour, avg(abs(p - y) / y) * 100 AS mape FROM (SELECT h.ts, h.y, b.y AS p FROM h JOIN h b ON h.k = b.k AND b.ts = h.ts - INTERVAL 24 HOUR WHERE h.y > 1) GROUP BY 1) SELECT * FROM (SELECT 'best' AS side, CAST(hour AS BIGINT) AS hour, round(mape, 7) AS mape FROM m ORDER BY mape, hour LIMIT 3) UNION ALL SELECT * FROM (SELECT 'worst', CAST(hour AS BIGINT), round(mape, 7) FROM m ORDER BY mape DESC, hour LIMIT 3)")
def topk_hours(spark, sf):
    m = evaluation.hourly(scored(spark, sf).where("y > 1"), []).select(F.col("hour").cast("long").alias("hour"), "mape")
    best = m.orderBy(F.asc_nulls_last("mape"), "hour").limit(3).withColumn("side", F.lit("best"))
    worst = m.orderBy(F.desc_nulls_last("mape"), "hour").limit(3).withColumn("side", F.lit("worst"))
    return rounded(best.unionByName(worst))


LOC = """v AS (SELECT l_returnflag AS c, l_linestatus AS t, CASE WHEN l_linenumber <= 4 THEN 'candidate' ELSE 'production' END AS location, CAST(avg(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) AS skill, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) / 1000 AS mae FROM lineitem WHERE NOT (l_returnflag = 'R' AND l_linenumber > 4) GROUP BY 1, 2, 3)"""
LOC = LOC.replace("CAST(avg(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE)", "CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / count(*)")
BOTH = LOC + ", b AS (SELECT x.c, x.t, x.skill AS candidate_skill, x.mae AS candidate_mae, z.skill AS production_skill, z.mae AS production_mae FROM (SELECT * FROM v WHERE location = 'candidate') x LEFT JOIN (SELECT * FROM v WHERE location = 'production') z USING (c, t))"


def located(spark, sf):
    li = read(spark, sf, "lineitem").where("not (l_returnflag = 'R' and l_linenumber > 4)")
    mean = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double") / F.count("*")
    place = F.when(F.col("l_linenumber") <= 4, "candidate").otherwise("production").alias("location")
    return li.groupBy(F.col("l_returnflag").alias("c"), F.col("l_linestatus").alias("t"), place).agg(mean("l_discount").alias("skill"), (mean("l_extendedprice") / 1000).alias("mae"))


@query(f"WITH {BOTH} SELECT c, t, round(candidate_skill, 9) AS candidate_skill, round(production_skill, 9) AS production_skill, round(coalesce(nullif(candidate_skill, 0), 0) - coalesce(nullif(production_skill, 0), 0), 9) AS skill_diff, round(coalesce(nullif(candidate_mae, 0), 0) - coalesce(nullif(production_mae, 0), 0), 7) AS mae_diff FROM b")
def compare_locations(spark, sf):
    out = control.compare(located(spark, sf), ["c", "t"], ["skill", "mae"])
    return out.select("c", "t", r9("candidate_skill").alias("candidate_skill"), r9("production_skill").alias("production_skill"), r9("skill_diff").alias("skill_diff"), r7("mae_diff").alias("mae_diff"))


@query(f"WITH {BOTH}, r AS (SELECT c, t, CASE WHEN candidate_skill <= 0 THEN 'below_minimum' WHEN production_skill IS NULL THEN 'first_deployment' WHEN candidate_skill - production_skill > 0 THEN 'improved' ELSE 'not_better' END AS reason FROM b) SELECT c, t, reason IN ('first_deployment', 'improved') AS promoted, reason FROM r")
def auto_promote(spark, sf):
    return control.promote(control.compare(located(spark, sf), ["c", "t"], ["skill", "mae"]), ["c", "t"])


@query(f"WITH {BOTH}, o AS (SELECT c, t, (candidate_skill - production_skill) / nullif(abs(production_skill), 0) * 100 AS improvement, candidate_skill FROM b WHERE candidate_skill > 0) SELECT c, t, round(improvement, 7) AS improvement, round(coalesce(nullif(improvement, 0), nullif(candidate_skill, 0), 0), 7) AS order_value, row_number() OVER (ORDER BY coalesce(nullif(improvement, 0), nullif(candidate_skill, 0), 0) DESC, c, t) AS place FROM o")
def promotion_candidates(spark, sf):
    out = control.candidates(control.compare(located(spark, sf), ["c", "t"], ["skill", "mae"]), ["c", "t"]).withColumn("all", F.lit(1))
    out = windows.top(out, ["all"], [F.desc("order_value"), F.col("c"), F.col("t")], 1000)
    return out.select("c", "t", r7("improvement").alias("improvement"), r7("order_value").alias("order_value"), F.col("place").cast("long").alias("place"))


@query(f"WITH {B}, m AS (SELECT k, 1 - avg(abs(weekly - y)) / nullif(avg(abs(persistence - y)), 0) AS skill FROM b WHERE weekly IS NOT NULL AND persistence IS NOT NULL GROUP BY k) SELECT k, round(skill, 9) AS skill FROM m ORDER BY skill DESC, k LIMIT 3")
def topk_skill(spark, sf):
    b = with_baselines(spark, sf).dropna(subset=["weekly", "persistence"])
    m = b.groupBy("k").agg(metrics.skill(metrics.mae("y", "weekly"), metrics.mae("y", "persistence")).alias("skill"))
    return rounded(m.orderBy(F.desc("skill"), "k").limit(3), 9)


@query(f"WITH {E} SELECT k, CAST(floor((epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(max(ts))) / 3600) AS BIGINT) AS hours, CASE WHEN hours < 24 THEN 'healthy' WHEN hours < 48 THEN 'warning' ELSE 'critical' END AS status FROM e GROUP BY k")
def freshness_status(spark, sf):
    now = F.unix_seconds(F.lit("2024-01-31 00:00:00").cast("timestamp"))
    out = events(spark, sf).groupBy("k").agg(F.floor((now - F.unix_seconds(F.max("ts"))) / 3600).alias("hours"))
    return out.withColumn("status", scalars.freshness(F.col("hours")))


@query(f"WITH {H} SELECT k, count(*) AS n, round(count(*) * 100.0::DOUBLE / 720, 1) AS coverage_pct FROM h GROUP BY k")
def coverage_pct(spark, sf):
    h = hours(spark, sf)
    return h.groupBy("k").agg(F.count("*").alias("n"), F.round(F.count("*").cast("double") * 100 / 720, 1).alias("coverage_pct"))


@query(f"WITH {H}, c AS (SELECT count(*) AS n FROM h GROUP BY k), s AS (SELECT CASE WHEN n >= 700 THEN 0 WHEN n >= 600 THEN 1 ELSE 2 END AS r FROM c) SELECT ['healthy', 'warning', 'critical'][CAST(max(r) + 1 AS INT)] AS overall, CAST(max(r) AS BIGINT) AS exit_code, count(*) AS checks FROM s")
def health_rollup(spark, sf):
    c = hours(spark, sf).groupBy("k").agg(F.count("*").alias("n"))
    checks = c.select(F.concat(F.lit("coverage_"), "k").alias("check"), F.when(F.col("n") >= 700, "healthy").when(F.col("n") >= 600, "warning").otherwise("critical").alias("status"))
    return control.health(checks).withColumn("exit_code", F.col("exit_code").cast("long"))


# tables that are written

@query("SELECT * FROM (SELECT conv_id, 1 AS slot, role, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1)")
def upsert_latest(spark, sf):
    c = read(spark, sf, "conversations").select("conv_id", F.lit(1).alias("slot"), "role", "turn")
    old, new = c.where("turn % 2 = 0"), c.where("turn % 2 = 1")
    old = control.upsert(old.limit(0), old, ["conv_id", "slot"], ["turn"])
    late = new.join(old.select("conv_id", F.col("turn").alias("t")), "conv_id", "left").where("t is null or turn > t").drop("t")
    return control.upsert(old, late, ["conv_id", "slot"], ["turn"])


@query(f"WITH {S}, z AS (SELECT k, ts, CASE WHEN k IN ('click', 'view') THEN 0.0 ELSE coalesce(y, 0.0) END AS y FROM f) SELECT k, count(*) AS n FROM z WHERE NOT (k = 'click') GROUP BY k")
def guard_all_zero(spark, sf):
    z = regular(spark, sf).withColumn("y", F.when(F.col("k").isin("click", "view"), 0.0).otherwise(F.coalesce("y", F.lit(0.0))))
    return control.not_all_zero(z, ["k"], "y", F.col("k").isin("click", "purchase")).groupBy("k").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, coalesce(CASE WHEN p_size > 25 THEN p_brand END, 'xgboost') AS model_name FROM part")
def migrate_coalesce(spark, sf):
    from ..sources import sinks

    return sinks.migrated(read(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") > 25, F.col("p_brand")).alias("model_name")))


DEP = """t AS (SELECT o_custkey AS k, o_orderkey AS version, strftime(o_orderdate, '%Y-%m-%d') AS "at", row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)"""


def deployments(spark, sf):
    """Each customer's orders as deployments: all but the last two inactive, the one before the last active, the last new."""
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("version"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("at"), "o_orderdate")
    o = windows.top(o, ["k"], [F.desc("o_orderdate"), F.desc("version")], 1 << 30)
    table = o.where("place > 1").select("k", "version", "at", F.when(F.col("place") == 2, "active").otherwise("inactive").alias("status"), F.lit(None).cast("long").alias("previous_version"))
    return table, o.where("place = 1").select("k", "version", "at")


@query(f"""WITH {DEP} SELECT k, version, "at", CASE WHEN n = 1 THEN 'active' ELSE 'inactive' END AS status, CASE WHEN n = 1 THEN lead(version) OVER (PARTITION BY k ORDER BY n) END AS previous_version FROM t""")
def scd2_deploy(spark, sf):
    table, new = deployments(spark, sf)
    return control.deploy(table, new, ["k"]).select("k", "version", "at", "status", "previous_version")


@query(f"WITH {DEP}, c AS (SELECT k, count(*) AS c FROM t GROUP BY k) SELECT k, version, CASE WHEN c = 1 THEN 'active' WHEN n = 1 THEN 'rolled_back' WHEN n = 2 THEN 'active' ELSE 'inactive' END AS status FROM t JOIN c USING (k)")
def scd2_rollback(spark, sf):
    table, new = deployments(spark, sf)
    return control.rollback(control.deploy(table, new, ["k"]), ["k"]).select("k", "version", "status")


@query("SELECT conv_id, arg_max(role, turn) AS status, arg_max(CASE WHEN role = 'user' THEN length(text) END, CASE WHEN role = 'user' THEN turn END) AS size FROM conversations GROUP BY conv_id")
def run_log_state(spark, sf):
    log = read(spark, sf, "conversations").select("conv_id", "turn", F.col("role").alias("status"), F.when(F.col("role") == "user", F.length("text").cast("long")).alias("size"))
    return control.state(log, ["conv_id"], "turn", ["status", "size"])


@query("SELECT conv_id, list_sort(list(DISTINCT role)) AS locations, count(CASE WHEN role = 'user' THEN 1 END) AS history_count FROM conversations GROUP BY conv_id")
def registry_locations(spark, sf):
    c = read(spark, sf, "conversations").select("conv_id", F.when(F.col("role") == "user", "history").otherwise(F.col("role")).alias("location"))
    back = F.transform("locations", lambda x: F.when(x == "history", "user").otherwise(x))
    return control.locations(c, ["conv_id"]).withColumn("locations", F.sort_array(back))


# cross-validation

FOLDS = D + ", z AS (SELECT k, min(ts) AS a, max(ts) AS z FROM d GROUP BY k), f AS (SELECT k, 6 - i AS fold, a, z - i * INTERVAL 30 DAY AS e, z - (i + 1) * INTERVAL 30 DAY AS s, z - (i + 1) * INTERVAL 30 DAY - INTERVAL 2 DAY AS t FROM z, range(6) v(i) WHERE date_diff('day', a, z) - 180 >= 180)"


@query(f"WITH {FOLDS} SELECT f.k, CAST(fold AS BIGINT) AS fold, CASE WHEN ts BETWEEN s AND e THEN 'test' ELSE 'train' END AS role, count(*) AS n, {sql_text('min(ts)')} AS first, {sql_text('max(ts)')} AS last FROM f JOIN d ON d.k = f.k AND (ts BETWEEN s AND e OR (ts >= a AND ts < t)) GROUP BY 1, 2, 3")
def walk_forward_counts(spark, sf):
    d = days(spark, sf)
    rows = crossval.in_folds(d, crossval.walk_forward_folds(d, ["k"]), ["k"])
    return rows.groupBy("k", F.col("fold").cast("long").alias("fold"), "role").agg(F.count("*").alias("n"), text(F.min("ts")).alias("first"), text(F.max("ts")).alias("last"))


@query(f"WITH {D}, r AS (SELECT k, row_number() OVER {W} - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM d), f AS (SELECT *, n - (5 - g + 1) * (n // 6) AS first, n // 6 AS size FROM r, range(1, 6) v(g)) SELECT k, CAST(g AS BIGINT) AS fold, CASE WHEN i < first THEN 'train' ELSE 'test' END AS role, count(*) AS n FROM f WHERE i < first + size GROUP BY 1, 2, 3")
def ts_split_counts(spark, sf):
    rows = crossval.time_series_split(days(spark, sf), ["k"], 5)
    return rows.groupBy("k", F.col("fold").cast("long").alias("fold"), "role").agg(F.count("*").alias("n"))


@query(f"WITH {H}, n AS (SELECT k, CAST(ts AS DATE) AS day, count(*) AS n FROM h GROUP BY 1, 2), a AS (SELECT k, min(day) AS a, max(day) AS z FROM n GROUP BY k), g AS (SELECT k, a, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(z AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM a) SELECT g.k, strftime(g.day, '%Y-%m-%d') AS day, strftime(g.day + 1, '%Y-%m-%d') AS target, CAST(coalesce((SELECT sum(n) FROM n WHERE n.k = g.k AND n.day < g.day), 0) AS BIGINT) AS n_train, t.n AS n_test FROM g JOIN n t ON t.k = g.k AND t.day = g.day + 1 WHERE (g.day - a) % 3 = 0 AND t.n >= 20 AND coalesce((SELECT sum(n) FROM n WHERE n.k = g.k AND n.day < g.day), 0) >= 200")
def backtest_membership(spark, sf):
    out = crossval.backtest_days(hours(spark, sf), ["k"], 3, 1, None, 200, 20)
    return out.select("k", F.date_format("day", "yyyy-MM-dd").alias("day"), F.date_format("target", "yyyy-MM-dd").alias("target"), "n_train", "n_test")


@query(f"WITH {H}, r AS (SELECT k, CAST(ts AS DATE) AS day, ts, y, row_number() OVER (PARTITION BY k, CAST(ts AS DATE) ORDER BY ts) AS place, count(*) OVER (PARTITION BY k, CAST(ts AS DATE)) AS n FROM h), j AS (SELECT a.k, a.day, a.y, b.y AS p FROM r a JOIN r b ON a.k = b.k AND a.day = b.day + 7 AND a.place = b.place WHERE a.n >= 20 AND b.n >= 20) SELECT k, strftime(day, '%Y-%m-%d') AS day, {MAE} AS mae, round(sqrt(avg((p - y) * (p - y))), 7) AS rmse, count(*) AS n FROM j GROUP BY 1, 2")
def persistence_backtest(spark, sf):
    j = joins.by_ordinal(hours(spark, sf), ["k"], 7)
    return rounded(j.groupBy("k", F.date_format("day", "yyyy-MM-dd").alias("day")).agg(metrics.mae().alias("mae"), metrics.rmse().alias("rmse"), F.count("*").alias("n")))


@query(f"WITH {H}, r AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY ts DESC) - 1 AS b FROM h), f AS (SELECT * FROM r, range(3) v(g)) SELECT k, CAST(g AS BIGINT) AS fold, CASE WHEN b >= (g + 1) * 100 THEN 'train' ELSE 'test' END AS role, count(*) AS n FROM f WHERE b >= g * 100 GROUP BY 1, 2, 3")
def tail_fold_counts(spark, sf):
    rows = crossval.tail_folds(hours(spark, sf), ["k"], 100, 3)
    return rows.groupBy("k", F.col("fold").cast("long").alias("fold"), "role").agg(F.count("*").alias("n"))


@query()
def evaluation_report(spark, sf):
    """Nested reports as JSON."""
    return evaluation.report(scored(spark, sf), ["k"]).select("k", "json")
