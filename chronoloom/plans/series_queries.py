"""Queries of the scan, shaping, join, window and feature operators, on the bindings of `registry`."""

from __future__ import annotations

from math import pi

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars
from ..operators import control, features, joins, shape, windows
from ..sources import series
from .registry import D, E, H, HALF, days, events, hours, local, query, r7, read, sql_text, text

W = "(PARTITION BY k ORDER BY ts)"


def r9(c):
    return F.round(c, 9)


# scans

@query("SELECT event_id, event_type AS k, value AS y FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'")
def scan_range_quality(spark, sf):
    e = read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return series.between(e, "2024-01-05", "2024-01-12", "ts", event_type="click").select("event_id", F.col("event_type").alias("k"), F.col("value").alias("y"))


@query("SELECT p_partkey, CASE WHEN p_size > 10 THEN CAST(p_size AS DOUBLE) END + p_retailprice AS total FROM part")
def scan_sum_cols(spark, sf):
    p = read(spark, sf, "part")
    return p.select("p_partkey", (F.when(F.col("p_size") > 10, F.col("p_size").cast("double")) + F.col("p_retailprice")).alias("total"))


@query(f"WITH {E}, r AS (SELECT k, CAST(ts AS DATE) AS day, event_id // 10 AS run, event_id FROM e) SELECT k, strftime(day, '%Y-%m-%d') AS day, run, event_id FROM r WHERE run = (SELECT max(s.run) FROM r s WHERE s.k = r.k AND s.day = r.day)")
def latest_run_subquery(spark, sf):
    r = events(spark, sf).select("k", F.to_date("ts").alias("day"), F.floor(F.col("event_id") / 10).alias("run"), "event_id")
    return joins.latest_run(r, ["k", "day"], "run").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(f"WITH {E} SELECT k, {sql_text('date_trunc(' + chr(39) + 'hour' + chr(39) + ', ts)')} AS hour, arg_max(y, event_id) AS y, max(event_id) AS event_id FROM e GROUP BY 1, 2")
def latest_row_per_hour(spark, sf):
    e = events(spark, sf).withColumn("hour", F.date_trunc("hour", "ts"))
    return joins.latest_by(e, ["k", "hour"], "event_id", ["y", "event_id"]).withColumn("hour", text("hour"))


@query(f"WITH {E} SELECT k, {sql_text('max(ts)')} AS latest FROM e GROUP BY k")
def latest_ts_by_key(spark, sf):
    return series.latest(events(spark, sf), ["k"], "ts").withColumn("latest", text("latest"))


@query(f"WITH {E}, a AS (SELECT CAST(ts AS DATE) AS day, event_id, 1 AS source FROM e WHERE k = 'purchase' AND day(ts) % 2 = 0), b AS (SELECT CAST(ts AS DATE) AS day, event_id, 2 AS source FROM e WHERE k = 'view') SELECT strftime(day, '%Y-%m-%d') AS day, event_id, source FROM (SELECT * FROM a UNION ALL SELECT * FROM b WHERE day NOT IN (SELECT day FROM a))")
def priority_fallback(spark, sf):
    e = events(spark, sf).select("k", F.to_date("ts").alias("day"), "event_id", F.dayofmonth("ts").alias("d"))
    first = e.where("k = 'purchase' and d % 2 = 0").select("day", "event_id", F.lit(1).alias("source"))
    second = e.where("k = 'view'").select("day", "event_id", F.lit(2).alias("source"))
    return joins.with_fallback(first, second, ["day"]).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("SELECT c_custkey AS id, c_acctbal AS v, 'customer' AS type FROM customer UNION ALL SELECT s_suppkey, s_acctbal, 'supplier' FROM supplier UNION ALL SELECT p_partkey, p_retailprice, 'part' FROM part")
def union_tagged_actuals(spark, sf):
    pick = lambda t, i, v: read(spark, sf, t).select(F.col(i).alias("id"), F.col(v).alias("v"))
    return series.tagged_union({"customer": pick("customer", "c_custkey", "c_acctbal"), "supplier": pick("supplier", "s_suppkey", "s_acctbal"), "part": pick("part", "p_partkey", "p_retailprice")})


@query("SELECT p_partkey, p_type AS model_name FROM part WHERE p_type LIKE '%BRASS%' OR p_type LIKE 'PROMO%'")
def like_models(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", F.col("p_type").alias("model_name"))
    return series.named_like(p, "%BRASS%").union(series.named_like(p, "PROMO%")).distinct()


@query(f"WITH {E} SELECT k, count(*) AS n, {sql_text('min(ts)')} AS first, {sql_text('max(ts)')} AS last FROM e GROUP BY k")
def inventory_minmax(spark, sf):
    return series.inventory(events(spark, sf), ["k"]).withColumns({"first": text("first"), "last": text("last")})


@query("""WITH z AS (SELECT n_nationkey, n_regionkey, count(c_custkey) AS weight FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2),
p AS (SELECT c_nationkey AS n_nationkey, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS v FROM customer GROUP BY 1)
SELECT n_regionkey, round(sum(weight * v) / sum(weight), 6) AS v, count(v) AS n_points FROM p JOIN z USING (n_nationkey) GROUP BY 1""")
def zone_weighted_mean(spark, sf):
    c, n = read(spark, sf, "customer"), read(spark, sf, "nation")
    zones = n.join(c, c["c_nationkey"] == n["n_nationkey"], "left").groupBy("n_nationkey", "n_regionkey").agg(F.count("c_custkey").alias("weight"))
    points = c.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(shape.exact_mean(F.col("c_acctbal")).alias("v"))
    return series.zone_mean(points, zones, ["n_regionkey"], ["n_nationkey"], "v").withColumn("v", F.round("v", 6))


@query(f"WITH {E} SELECT k, round(avg(CASE WHEN y > 100 THEN 1.0 ELSE 0.0 END), 9) AS share FROM e GROUP BY k HAVING avg(CASE WHEN y > 100 THEN 1.0 ELSE 0.0 END) >= 0.132")
def sufficiency_gate(spark, sf):
    e = events(spark, sf).withColumn("y", F.col("y") - 100)
    return series.sufficient(e, ["k"], 0.132).withColumn("share", r9("share"))


@query(f"WITH {D} SELECT k, {sql_text('ts')} AS ts, y FROM d WHERE k IN (SELECT k FROM d GROUP BY k HAVING count(*) >= 100)")
def minimum_size(spark, sf):
    return series.large_enough(days(spark, sf), ["k"], 100).withColumn("ts", text("ts"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN strftime(CAST(o_orderdate AS TIMESTAMP) + (o_orderkey % 24) * INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') END AS ts FROM orders")
def mixed_timestamps(spark, sf):
    """Times of orders, written in three ways (plain, in UTC, two hours ahead of it) and one that says nothing."""
    o = read(spark, sf, "orders")
    ts = o.o_orderdate.cast("timestamp") + F.make_dt_interval(hours=(F.col("o_orderkey") % 24).cast("int"))
    plain, ahead = F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.date_format(ts + F.expr("interval 2 hours"), "yyyy-MM-dd'T'HH:mm:ss")
    kind = F.col("o_orderkey") % 4
    written = F.when(kind == 0, plain).when(kind == 1, F.concat(plain, F.lit("+00:00"))).when(kind == 2, F.concat(ahead, F.lit("+02:00"))).otherwise("no time")
    return o.select("o_orderkey", text(scalars.parse_timestamp(written)).alias("ts"))


# shaping

@query(f"WITH {H} SELECT k, {sql_text('ts')} AS ts, y FROM h")
def resample_hour(spark, sf):
    return hours(spark, sf).withColumn("ts", text("ts"))


@query(f"WITH {E} SELECT k, {sql_text('date_trunc(' + chr(39) + 'hour' + chr(39) + ', ts)')} AS hour, event_id, y FROM e QUALIFY row_number() OVER (PARTITION BY k, date_trunc('hour', ts) ORDER BY ts DESC, event_id DESC) = 1")
def dedupe_keep_last(spark, sf):
    e = events(spark, sf).withColumn("hour", F.date_trunc("hour", "ts"))
    return shape.keep_last(e, ["k", "hour"], [F.col("ts"), F.col("event_id")]).select("k", text("hour").alias("hour"), "event_id", "y")


S = H + ", s AS (SELECT k, unnest(generate_series(a, z, INTERVAL 1 HOUR)) AS ts FROM (SELECT k, min(ts) AS a, max(ts) AS z FROM h GROUP BY k)), f AS (SELECT s.k, s.ts, h.y FROM s LEFT JOIN h ON s.k = h.k AND s.ts = h.ts)"


def regular(spark, sf):
    return shape.regular(hours(spark, sf), ["k"])


@query(f"WITH {S} SELECT k, {sql_text('ts')} AS ts FROM f WHERE y IS NULL")
def spine_gaps(spark, sf):
    return regular(spark, sf).where("y is null").select("k", text("ts").alias("ts"))


@query(f"WITH {S} SELECT k, {sql_text('ts')} AS ts, coalesce(last_value(y IGNORE NULLS) OVER (PARTITION BY k ORDER BY ts ROWS UNBOUNDED PRECEDING), 0.0) AS y FROM f")
def ffill(spark, sf):
    return shape.forward_fill(regular(spark, sf), ["k"], ["y"], default=0.0).withColumn("ts", text("ts"))


@query(f"WITH {S}, g AS (SELECT k, ts, CASE WHEN hour(ts) >= 6 THEN y END AS y FROM f) SELECT k, {sql_text('ts')} AS ts, coalesce(last_value(y IGNORE NULLS) OVER (PARTITION BY k ORDER BY ts ROWS UNBOUNDED PRECEDING), first_value(y IGNORE NULLS) OVER (PARTITION BY k ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS y FROM g")
def ffill_bfill(spark, sf):
    g = regular(spark, sf).withColumn("y", F.when(F.hour("ts") >= 6, F.col("y")))
    return shape.fill_both(g, ["k"], ["y"]).withColumn("ts", text("ts"))


@query(f"""WITH {S}, i AS (SELECT *, row_number() OVER {W} AS i FROM f),
b AS (SELECT *, last_value(CASE WHEN y IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY k ORDER BY ts ROWS UNBOUNDED PRECEDING) AS pi, last_value(y IGNORE NULLS) OVER (PARTITION BY k ORDER BY ts ROWS UNBOUNDED PRECEDING) AS pv,
first_value(CASE WHEN y IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY k ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ni, first_value(y IGNORE NULLS) OVER (PARTITION BY k ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv FROM i)
SELECT k, {sql_text('ts')} AS ts, round(CASE WHEN y IS NOT NULL THEN y WHEN ni > pi THEN pv + (nv - pv) * (i - pi) / (ni - pi) ELSE pv END, 9) AS y FROM b""")
def interp_linear(spark, sf):
    return shape.interpolate(regular(spark, sf), ["k"], "y").select("k", text("ts").alias("ts"), r9("y").alias("y"))


@query(f"WITH {S}, g AS (SELECT k, ts, y, y AS radiation FROM f) SELECT k, {sql_text('ts')} AS ts, coalesce(radiation, 0.0) AS radiation, coalesce(last_value(y IGNORE NULLS) OVER (PARTITION BY k ORDER BY ts ROWS UNBOUNDED PRECEDING), first_value(y IGNORE NULLS) OVER (PARTITION BY k ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS y FROM g")
def typed_fill(spark, sf):
    g = regular(spark, sf).withColumn("radiation", F.col("y"))
    return shape.typed_fill(g, ["k"], ["radiation"], ["y"]).select("k", text("ts").alias("ts"), "radiation", "y")


@query(f"""WITH {H}, w AS (SELECT k, unnest(generate_series(TIMESTAMP '2024-01-20 00:00:00', TIMESTAMP '2024-01-20 23:00:00', INTERVAL 1 HOUR)) AS ts FROM (SELECT DISTINCT k FROM h)),
l AS (SELECT k, arg_max(y, ts) AS y FROM h WHERE ts < TIMESTAMP '2024-01-20' GROUP BY k)
SELECT w.k, {sql_text('w.ts')} AS ts, CASE WHEN h.ts IS NULL THEN l.y ELSE h.y END AS y, CASE WHEN h.ts IS NULL THEN 1 ELSE 0 END AS synthetic, hour(w.ts) AS hour FROM w LEFT JOIN h ON h.k = w.k AND h.ts = w.ts LEFT JOIN l ON l.k = w.k""")
def future_covariates(spark, sf):
    out = shape.future_rows(hours(spark, sf), ["k"], ["y"], F.lit("2024-01-20 00:00:00").cast("timestamp"))
    return out.select("k", text("ts").alias("ts"), "y", "synthetic", F.hour("ts").cast("long").alias("hour"))


@query(f"WITH {H} SELECT k, {sql_text('ts')} AS ts, CASE WHEN ts < TIMESTAMP '2024-01-25' THEN y END AS y, CASE WHEN ts >= TIMESTAMP '2024-01-25' THEN 0.0::DOUBLE END AS err FROM h")
def with_placeholders(spark, sf):
    h = hours(spark, sf)
    cut = F.lit("2024-01-25").cast("timestamp")
    out = shape.with_targets(h.where(F.col("ts") < cut), h.where(F.col("ts") >= cut).select("k", "ts"), {"err": 0.0})
    return out.select("k", text("ts").alias("ts"), "y", "err")


# joins

def of(h, k, name="y"):
    return h.where(F.col("k") == k).select("ts", F.col("y").alias(name))


@query(f"WITH {H} SELECT {sql_text('a.ts')} AS ts, a.y AS y, b.y AS x FROM (SELECT * FROM h WHERE k = 'click') a LEFT JOIN (SELECT * FROM h WHERE k = 'purchase') b USING (ts)")
def join_left_cov(spark, sf):
    h = hours(spark, sf)
    return of(h, "click").join(of(h, "purchase", "x"), "ts", "left").withColumn("ts", text("ts"))


@query(f"WITH {H} SELECT {sql_text('a.ts')} AS ts, a.y AS y, b.y AS tso, a.y - b.y AS tso_error FROM (SELECT * FROM h WHERE k = 'click') a JOIN (SELECT * FROM h WHERE k = 'view') b USING (ts)")
def join_inner_fc(spark, sf):
    h = hours(spark, sf)
    return of(h, "click").join(of(h, "view", "tso"), "ts").select(text("ts").alias("ts"), "y", "tso", (F.col("y") - F.col("tso")).alias("tso_error"))


@query(f"WITH {H} SELECT {sql_text('ts')} AS ts, max(CASE WHEN k = 'click' THEN y END) AS a, max(CASE WHEN k = 'view' THEN y END) AS b, max(CASE WHEN k = 'purchase' THEN y END) AS c, 0.0::DOUBLE AS d FROM h WHERE k IN ('click', 'view', 'purchase') GROUP BY ts")
def join_full_fold(spark, sf):
    h = hours(spark, sf)
    return joins.full_fold([of(h, "click", "a"), of(h, "view", "b"), of(h, "purchase", "c")], ["ts"]).withColumn("d", F.lit(0.0)).withColumn("ts", text("ts"))


@query(f"WITH {H} SELECT {sql_text('ts')} AS ts, y FROM h WHERE k = 'click' AND ts IN (SELECT ts FROM h WHERE k = 'view')")
def join_semi(spark, sf):
    h = hours(spark, sf)
    return of(h, "click").join(of(h, "view"), "ts", "left_semi").withColumn("ts", text("ts"))


@query(f"WITH {H} SELECT {sql_text('ts')} AS ts, y FROM h WHERE k = 'click' AND ts NOT IN (SELECT ts FROM h WHERE k = 'view')")
def join_anti(spark, sf):
    h = hours(spark, sf)
    return of(h, "click").join(of(h, "view"), "ts", "left_anti").withColumn("ts", text("ts"))


@query("SELECT n_nationkey, n_name, coalesce(v, 0.0) AS v FROM nation LEFT JOIN (SELECT c_nationkey, arg_min(c_acctbal, c_custkey) AS v FROM customer WHERE c_acctbal > 9000 GROUP BY 1) ON c_nationkey = n_nationkey")
def lookup_first(spark, sf):
    c = read(spark, sf, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_acctbal").alias("v"), "c_custkey")
    return joins.lookup_first(read(spark, sf, "nation").select("n_nationkey", "n_name"), c, ["n_nationkey"], [F.col("c_custkey")]).select("n_nationkey", "n_name", "v")


def _lookup_sql(hours_back: int) -> str:
    return f"WITH {H} SELECT a.k, {sql_text('a.ts')} AS ts, a.y, b.y AS p FROM h a LEFT JOIN h b ON a.k = b.k AND b.ts = a.ts - INTERVAL {hours_back} HOUR"


@query(_lookup_sql(48))
def offset_lookup_persistence(spark, sf):
    return joins.offset_lookup(hours(spark, sf), ["k"], 48, "p").select("k", text("ts").alias("ts"), "y", "p")


@query(_lookup_sql(120))
def offset_lookup_seasonal(spark, sf):
    return joins.seasonal_lookup(hours(spark, sf), ["k"], 48, "p").select("k", text("ts").alias("ts"), "y", "p")


@query(_lookup_sql(168))
def offset_lookup_weekday(spark, sf):
    return joins.seasonal_lookup(hours(spark, sf), ["k"], 48, "p", weekday_aligned=True).select("k", text("ts").alias("ts"), "y", "p")


@query(f"WITH {H} SELECT a.k, {sql_text('a.ts')} AS ts, round(avg(b.y), 9) AS p FROM h a LEFT JOIN h b ON a.k = b.k AND hour(a.ts) = hour(b.ts) AND b.ts >= a.ts - INTERVAL 216 HOUR AND b.ts < a.ts - INTERVAL 48 HOUR GROUP BY 1, 2")
def interval_weekly_avg(spark, sf):
    return joins.same_hour_mean(hours(spark, sf), ["k"], "p").select("k", text("ts").alias("ts"), r9("p").alias("p"))


@query(f"""WITH {H}, r AS (SELECT k, CAST(ts AS DATE) AS day, ts, y, row_number() OVER (PARTITION BY k, CAST(ts AS DATE) ORDER BY ts) AS place, count(*) OVER (PARTITION BY k, CAST(ts AS DATE)) AS n FROM h)
SELECT a.k, {sql_text('a.ts')} AS ts, a.y AS y, b.y AS p, a.place AS place FROM r a JOIN r b ON a.k = b.k AND a.day = b.day + 7 AND a.place = b.place WHERE a.n >= 20 AND b.n >= 20""")
def day_ordinal_align(spark, sf):
    return joins.by_ordinal(hours(spark, sf), ["k"], 7).select("k", text("ts").alias("ts"), "y", "p", F.col("place").cast("long").alias("place"))


@query(f"""WITH {H}, m AS (SELECT 'h' || CAST(g AS VARCHAR) AS model, a.k, a.ts, abs(b.y - a.y) AS loss FROM h a JOIN (VALUES (24), (48), (168)) v(g) ON true JOIN h b ON a.k = b.k AND b.ts = a.ts - g * INTERVAL 1 HOUR)
SELECT a.model AS a, b.model AS b, count(*) AS n, round(avg(a.loss - b.loss), 9) AS diff FROM m a JOIN m b ON a.k = b.k AND a.ts = b.ts AND a.model < b.model GROUP BY 1, 2 HAVING count(DISTINCT CAST(a.ts AS DATE)) >= 10""")
def pairwise_models(spark, sf):
    h = hours(spark, sf)
    m = series.tagged_union({f"h{g}": joins.offset_lookup(h, ["k"], g, "p").dropna(subset=["p"]) for g in (24, 48, 168)})
    m = m.select("k", "ts", F.to_date("ts").alias("day"), F.col("type").alias("model"), F.abs(F.col("p") - F.col("y")).alias("loss"))
    return joins.pairs_of_models(m, "model", ["k", "ts"], 10).groupBy("a", "b").agg(F.count("*").alias("n"), r9(F.avg(F.col("loss_a") - F.col("loss_b"))).alias("diff"))


WORK = "w AS (SELECT n_name AS country, c_mktsegment AS type, horizon FROM nation, (SELECT DISTINCT c_mktsegment FROM customer), (VALUES (1), (2)) h(horizon))"
#: Which runner takes what: two by lists, one for all, one that is switched off.
TAKES = [("builtin", ["all"], ["all"], True), ("tso", ["FRANCE", "GERMANY"], ["BUILDING"], True), ("night", ["all"], ["MACHINERY"], True), ("off", ["all"], ["all"], False)]


def work(spark, sf):
    """Every nation with every market segment, one and two days ahead."""
    types = read(spark, sf, "customer").select(F.col("c_mktsegment").alias("type")).distinct()
    return read(spark, sf, "nation").select(F.col("n_name").alias("country")).crossJoin(types).crossJoin(local(spark, [(1,), (2,)], "horizon int"))


@query(f"WITH {WORK} SELECT * FROM w")
def worklist_cross(spark, sf):
    return work(spark, sf)


@query(f"WITH {WORK} SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_name = country AND c_mktsegment = type AND c_acctbal > 9950)")
def skiplist_anti(spark, sf):
    """Without the items on a list, of those that a rich customer stands for."""
    c = read(spark, sf, "customer").where("c_acctbal > 9950").join(read(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return joins.skipped(work(spark, sf), c.select(F.col("n_name").alias("country"), F.col("c_mktsegment").alias("type")), ["country", "type"])


@query(f"WITH {WORK} SELECT w.*, r.name FROM w JOIN (VALUES {', '.join(f'({name!r}, {cs}, {ts}, {str(on).lower()})' for name, cs, ts, on in TAKES)}) r(name, cs, ts, enabled) ON enabled AND (list_contains(cs, 'all') OR list_contains(cs, country)) AND (list_contains(ts, 'all') OR list_contains(ts, type))")
def runner_theta(spark, sf):
    runners = local(spark, TAKES, "name string, countrys array<string>, types array<string>, enabled boolean")
    return joins.applicable(work(spark, sf), runners).select("country", "type", "horizon", "name")


@query(f"WITH {H}, c AS (SELECT a.ts, a.y AS tso, CASE WHEN hour(a.ts) < 12 THEN b.y - 300 END AS error FROM (SELECT * FROM h WHERE k = 'click') a LEFT JOIN (SELECT * FROM h WHERE k = 'view') b USING (ts)) SELECT {sql_text('ts')} AS ts, 'tso_raw' AS model, tso AS value FROM c UNION ALL SELECT {sql_text('ts')}, 'tso_corrected', greatest(0.0, tso + error) FROM c WHERE error IS NOT NULL")
def raw_and_corrected(spark, sf):
    h = hours(spark, sf)
    fix = of(h, "view", "error").where(F.hour("ts") < 12).withColumn("error", F.col("error") - 300)
    return joins.raw_and_corrected(of(h, "click", "tso"), fix, ["ts"]).withColumn("ts", text("ts"))


@query("SELECT DISTINCT c_nationkey AS n FROM customer INTERSECT SELECT DISTINCT s_nationkey FROM supplier")
def intersect_keys(spark, sf):
    return read(spark, sf, "customer").select(F.col("c_nationkey").alias("n")).intersect(read(spark, sf, "supplier").select("s_nationkey"))


@query(f"WITH {H} SELECT strftime(d, '%Y-%m-%d') AS day FROM (SELECT CAST(ts AS DATE) AS d FROM h WHERE k = 'click' INTERSECT SELECT CAST(ts AS DATE) FROM h WHERE k = 'view' INTERSECT SELECT CAST(ts AS DATE) FROM h WHERE k = 'purchase')")
def intersect_days(spark, sf):
    h = hours(spark, sf)
    day = lambda k: h.where(F.col("k") == k).select(F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return day("click").intersect(day("view")).intersect(day("purchase"))


@query(f"WITH {H} SELECT {sql_text('ts')} AS ts FROM (SELECT ts FROM h WHERE k = 'click' EXCEPT SELECT ts FROM h WHERE k = 'purchase')")
def except_hours(spark, sf):
    h = hours(spark, sf)
    return of(h, "click").select("ts").subtract(of(h, "purchase").select("ts")).select(text("ts").alias("ts"))


# windows

@query(f"WITH {H} SELECT k, {sql_text('ts')} AS ts, lag(y, 24) OVER {W} AS y_lag_1d, lag(y, 168) OVER {W} AS y_lag_7d, lag(y, 336) OVER {W} AS y_lag_14d FROM h")
def lag_days(spark, sf):
    return windows.lags(hours(spark, sf), ["k"], [1, 7, 14]).drop("y").withColumn("ts", text("ts"))


def _rolling_sql(w: int) -> str:
    over = f"OVER (PARTITION BY k ORDER BY ts ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
    return f"WITH {H} SELECT k, {sql_text('ts')} AS ts, round(avg(y) {over} + {HALF}, 7) AS y_roll_{w}h_mean, round(stddev_samp(y) {over}, 7) AS y_roll_{w}h_std, min(y) {over} AS y_roll_{w}h_min, max(y) {over} AS y_roll_{w}h_max FROM h"


def _rolling(spark, sf, w: int):
    out = windows.trailing(hours(spark, sf), ["k"], [w]).drop("y").withColumn("ts", text("ts"))
    return out.withColumns({f"y_roll_{w}h_mean": r7(F.col(f"y_roll_{w}h_mean") + HALF), f"y_roll_{w}h_std": r7(f"y_roll_{w}h_std")})


query(_rolling_sql(24), "rolling_24")(lambda spark, sf: _rolling(spark, sf, 24))
query(_rolling_sql(168), "rolling_168")(lambda spark, sf: _rolling(spark, sf, 168))

#: Each series beside a forecast of it: the mean of the others in the hour, which isn't there where they have no value.
ERR = H + ", c AS (SELECT k, ts, y, CAST(sum(CAST(y AS DECIMAL(28,12))) OVER (PARTITION BY ts) - CAST(y AS DECIMAL(28,12)) AS DOUBLE) / nullif(count(*) OVER (PARTITION BY ts) - 1, 0) AS tso FROM h), e2 AS (SELECT k, ts, y, tso, y - tso AS err FROM c WHERE tso IS NOT NULL)"


def beside_others(spark, sf):
    """(k, ts, y, tso, others): every series' hours with the mean and the sum of the other series'."""
    w = Window.partitionBy("ts")
    y = F.col("y").cast("decimal(28,12)")
    others = (F.sum(y).over(w) - y).cast("double")
    return hours(spark, sf).withColumns({"others": others, "tso": others / F.nullif(F.count("*").over(w) - 1, F.lit(0))})


def errors(spark, sf):
    """Every series with its features of the forecast's errors."""
    return features.error_features(beside_others(spark, sf).where("tso is not null").drop("others"), ["k"])


@query(f"WITH {ERR} SELECT k, {sql_text('ts')} AS ts, round(err, 7) + 0.0 AS err, round(lag(err, 24) OVER {W}, 7) + 0.0 AS err_lag_1d, round(lag(err, 48) OVER {W}, 7) + 0.0 AS err_lag_2d, round(lag(err, 168) OVER {W}, 7) + 0.0 AS err_lag_7d FROM e2")
def err_lags(spark, sf):
    return errors(spark, sf).select("k", text("ts").alias("ts"), *[r7(c).alias(c) for c in ("err", "err_lag_1d", "err_lag_2d", "err_lag_7d")])


@query(f"WITH {ERR} SELECT k, {sql_text('ts')} AS ts, round(avg(err) OVER a + {HALF}, 7) + 0.0 AS m24, round(coalesce(stddev_samp(err) OVER a, 0.0), 6) AS s24, round(avg(err) OVER b + {HALF}, 7) + 0.0 AS m168, round(avg(tso) OVER a + {HALF}, 7) AS t24 FROM e2 WINDOW a AS (PARTITION BY k ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), b AS (PARTITION BY k ORDER BY ts ROWS BETWEEN 167 PRECEDING AND CURRENT ROW)")
def err_rolling_incl(spark, sf):
    return errors(spark, sf).select("k", text("ts").alias("ts"), r7(F.col("err_roll_24h_mean") + HALF).alias("m24"), F.round("err_roll_24h_std", 6).alias("s24"), r7(F.col("err_roll_168h_mean") + HALF).alias("m168"), r7(F.col("tso_roll_24h_mean") + HALF).alias("t24"))


@query(f"WITH {H} SELECT k, CAST(hour(ts) AS BIGINT) AS hour, {sql_text('max(ts)')} AS ts, arg_max(y, ts) AS y FROM h GROUP BY 1, 2")
def last_per_hour(spark, sf):
    return windows.last_per_hour(hours(spark, sf), ["k"]).select("k", F.col("hour").cast("long").alias("hour"), text("ts").alias("ts"), "y")


@query(f"WITH {H} SELECT k, {sql_text('ts')} AS ts, row_number() OVER (PARTITION BY k ORDER BY ts DESC) <= 100 AND count(*) OVER (PARTITION BY k) > 100 AS is_validation FROM h")
def tail_split(spark, sf):
    return windows.tail_split(hours(spark, sf), ["k"], 100).select("k", text("ts").alias("ts"), "is_validation")


@query(f"WITH {H}, n AS (SELECT k, CAST(ts AS DATE) AS day, count(*) AS n FROM h GROUP BY 1, 2) SELECT k, strftime(day, '%Y-%m-%d') AS day, n, (row_number() OVER (PARTITION BY k ORDER BY day) - 1) // 7 AS epoch FROM n WHERE n >= 20")
def retrain_epochs(spark, sf):
    n = hours(spark, sf).groupBy("k", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return windows.epochs(n, ["k"], 7, 20).select("k", F.date_format("day", "yyyy-MM-dd").alias("day"), "n", F.col("epoch").cast("long").alias("epoch"))


@query(f"WITH {H} SELECT k, block, count(*) AS n, {sql_text('min(ts)')} AS first FROM (SELECT *, (row_number() OVER {W} - 1) // 24 AS block FROM h) GROUP BY 1, 2")
def rolling_blocks(spark, sf):
    return windows.blocks(hours(spark, sf), ["k"], 24).groupBy("k", F.col("block").cast("long").alias("block")).agg(F.count("*").alias("n"), text(F.min("ts")).alias("first"))


@query("SELECT conv_id, turn, role, place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS place FROM conversations) WHERE place <= 5")
def history_keep5(spark, sf):
    return control.keep_newest(read(spark, sf, "conversations"), ["conv_id"], "turn").select("conv_id", "turn", "role", F.col("place").cast("long").alias("place"))


# features

CALENDAR = "CAST(hour(ts) AS BIGINT) AS hour, CAST(isodow(ts) - 1 AS BIGINT) AS day_of_week, CAST(day(ts) AS BIGINT) AS day_of_month, CAST(month(ts) AS BIGINT) AS month, CAST(dayofyear(ts) AS BIGINT) AS day_of_year, CAST(isodow(ts) >= 6 AS BIGINT) AS is_weekend"


@query(f"WITH {H} SELECT k, {sql_text('ts')} AS ts, {CALENDAR} FROM h")
def calendar_features(spark, sf):
    h = hours(spark, sf)
    return h.select("k", text("ts").alias("ts"), *[c.cast("long").alias(n) for n, c in scalars.calendar("ts").items()])


def _cycle(name: str, expr: str, period: int) -> str:
    return f"round(sin({2 * pi!r} * ({expr}) / {period}), 9) + 0.0 AS {name}_sin, round(cos({2 * pi!r} * ({expr}) / {period}), 9) + 0.0 AS {name}_cos"


@query(f"WITH {H} SELECT k, {sql_text('ts')} AS ts, {_cycle('hour', 'hour(ts)', 24)}, {_cycle('dow', 'isodow(ts) - 1', 7)}, {_cycle('month', 'month(ts)', 12)} FROM h")
def cyclical(spark, sf):
    return hours(spark, sf).select("k", text("ts").alias("ts"), *[(r9(c) + 0.0).alias(n) for n, c in scalars.cyclical("ts").items()])


HOLIDAY = ("2023-12-25", "2024-01-01", "2024-01-11", "2024-01-16", "2024-01-23")
HOL = "o AS (SELECT unnest([" + ", ".join(f"DATE '{d}'" for d in HOLIDAY) + "]) AS day), dd AS (SELECT DISTINCT k, CAST(ts AS DATE) AS day FROM e)"


def _with_holidays(spark, sf):
    table = local(spark, [("X", d) for d in HOLIDAY], "country string, holiday string").withColumn("holiday", F.to_date("holiday"))
    rows = events(spark, sf).select("k", F.date_trunc("day", "ts").alias("ts")).distinct().withColumn("country", F.lit("X"))
    return features.holiday_features(rows, table)


@query(f"WITH {E}, {HOL} SELECT dd.k, strftime(dd.day, '%Y-%m-%d') AS day, CAST(max(CAST(o.day = dd.day AS INT)) AS BIGINT) AS is_holiday, coalesce(min(CASE WHEN o.day > dd.day AND o.day - dd.day <= 7 THEN o.day - dd.day END), 7) AS days_to_holiday, coalesce(min(CASE WHEN o.day < dd.day AND dd.day - o.day <= 7 THEN dd.day - o.day END), 7) AS days_from_holiday FROM dd, o GROUP BY 1, 2")
def holiday_distance(spark, sf):
    return _with_holidays(spark, sf).select("k", F.date_format("ts", "yyyy-MM-dd").alias("day"), *[F.col(c).cast("long").alias(c) for c in ("is_holiday", "days_to_holiday", "days_from_holiday")])


@query(f"WITH {E}, {HOL} SELECT dd.k, strftime(dd.day, '%Y-%m-%d') AS day, CAST(max(CAST((isodow(dd.day) = 5 AND o.day = dd.day - 1) OR (isodow(dd.day) = 1 AND o.day = dd.day + 1) AS INT)) AS BIGINT) AS is_bridge_day FROM dd, o GROUP BY 1, 2")
def bridge_day(spark, sf):
    return _with_holidays(spark, sf).select("k", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("is_bridge_day").cast("long").alias("is_bridge_day"))


@query(f"WITH {H}, t AS (SELECT k, ts, y + 30 - 273.15 AS c FROM h) SELECT k, {sql_text('ts')} AS ts, round(c, 9) AS temperature_c, round(greatest(0.0, 18.0 - c), 9) AS heating_degree, round(greatest(0.0, c - 18.0), 9) AS cooling_degree FROM t")
def degree_days(spark, sf):
    h = hours(spark, sf).withColumn("temperature_2m_k", F.col("y") + 30)
    return features.weather_features(h).select("k", text("ts").alias("ts"), *[r9(c).alias(c) for c in ("temperature_c", "heating_degree", "cooling_degree")])


def matrix(spark, sf):
    """The training frame of all types' hours, explained by the others' sum in the hour."""
    return features.feature_matrix(beside_others(spark, sf).select("k", "ts", "y", F.col("others").alias("x")), ["k"], ["x"])


@query(f"""WITH {H}, g AS (SELECT k, ts, y, CAST(sum(CAST(y AS DECIMAL(28,12))) OVER (PARTITION BY ts) - CAST(y AS DECIMAL(28,12)) AS DOUBLE) AS x FROM h),
m AS (SELECT *, lag(y, 24) OVER {W} AS l1, lag(y, 168) OVER {W} AS l7, lag(y, 336) OVER {W} AS l14, round(avg(y) OVER (PARTITION BY k ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) + {HALF}, 7) AS m24, round(avg(y) OVER (PARTITION BY k ORDER BY ts ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING) + {HALF}, 7) AS m168,
round(stddev_samp(y) OVER (PARTITION BY k ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING), 7) AS s24, min(y) OVER (PARTITION BY k ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS low24, max(y) OVER (PARTITION BY k ORDER BY ts ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING) AS high168 FROM g)
SELECT k, {sql_text('ts')} AS ts, y, round(x, 7) + 0.0 AS x, l1, l7, l14, m24, m168, s24, low24, high168, {CALENDAR}, {_cycle('hour', 'hour(ts)', 24)}, {_cycle('dow', 'isodow(ts) - 1', 7)}, {_cycle('month', 'month(ts)', 12)} FROM m WHERE l14 IS NOT NULL AND l7 IS NOT NULL AND l1 IS NOT NULL""")
def feature_matrix(spark, sf):
    m = matrix(spark, sf)
    names = {"y_lag_1d": "l1", "y_lag_7d": "l7", "y_lag_14d": "l14", "y_roll_24h_min": "low24", "y_roll_168h_max": "high168"}
    means = {"y_roll_24h_mean": "m24", "y_roll_168h_mean": "m168"}
    calendar, cycles = list(scalars.calendar("ts")), list(scalars.cyclical("ts"))
    return m.select("k", text("ts").alias("ts"), "y", r7("x").alias("x"), *[F.col(c).alias(n) for c, n in names.items()], *[r7(F.col(c) + HALF).alias(n) for c, n in means.items()], r7("y_roll_24h_std").alias("s24"), *[F.col(c).cast("long").alias(c) for c in calendar], *[(r9(F.col(c)) + 0.0).alias(c) for c in cycles])
