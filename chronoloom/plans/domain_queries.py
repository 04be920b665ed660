"""Queries of the domain scans: events, written as tables of the domain's schemas, read back through `sources.series`."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import control, crossval, jobs, joins, validation
from ..sources import series, sinks
from .registry import E, H, events, hours, local, query, r7, read, sql_mean, sql_text, text
from .table_queries import _folder

#: Event types as countries. Others have none.
COUNTRIES = {"click": "BE", "view": "DE", "purchase": "FR"}
SQL_COUNTRY = "CASE k " + " ".join(f"WHEN '{k}' THEN '{c}'" for k, c in COUNTRIES.items()) + " END"

#: The same tables in SQL.
X = f"{E}, x AS (SELECT {SQL_COUNTRY} AS country_code, k, ts, y, event_id, CASE WHEN event_id % 10 = 0 THEN 'estimated' ELSE 'actual' END AS quality FROM e WHERE {SQL_COUNTRY} IS NOT NULL)"
WEATHER = "w AS (SELECT country_code, date_trunc('hour', ts) AS ts, date_trunc('day', ts) - ((event_id % 3) * INTERVAL 6 HOUR) AS run, y + 200 AS temperature_2m_k, y / 500 AS relative_humidity_2m_frac, CASE WHEN country_code = 'FR' AND day(ts) % 2 = 0 THEN 'actual' ELSE 'forecast' END AS quality FROM x)"


def _country():
    return F.coalesce(*[F.when(F.col("k") == k, c) for k, c in COUNTRIES.items()])


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).withColumn("country_code", _country()).where(F.col("country_code").isNotNull()).withColumn("data_quality", F.when(F.col("event_id") % 10 == 0, "estimated").otherwise("actual")).withColumnRenamed("ts", "timestamp_utc")


def _energy(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    e = _rows(spark, sf)
    key = ["country_code", "timestamp_utc", "data_quality"]
    parts = {"solar_mw": F.col("y"), "wind_onshore_mw": F.col("y") * 2, "wind_offshore_mw": F.lit(None).cast("double"), "hydro_run_mw": F.when(F.col("event_id") % 4 > 0, F.col("y")), "hydro_reservoir_mw": F.col("y") + 1, "biomass_mw": F.lit(7.0), "total_renewable_mw": F.col("y") * 3}
    return {
        "energy_load": e.select(*key, (F.col("y") * 10).alias("load_mw")),
        "energy_price": e.select(*key, (F.col("y") - 50).alias("price_eur_mwh")),
        "energy_renewable": e.select(*key, *[c.alias(n) for n, c in parts.items()]),
    }


def _weather(spark: SparkSession, sf: str) -> DataFrame:
    e = _rows(spark, sf)
    run = F.date_trunc("day", "timestamp_utc") - F.make_dt_interval(hours=(F.col("event_id") % 3 * 6).cast("int"))
    columns = {c: F.lit(0.0) for c in series.WEATHER} | {"temperature_2m_k": F.col("y") + 200, "relative_humidity_2m_frac": F.col("y") / 500}
    quality = F.when((F.col("country_code") == "FR") & (F.dayofmonth("timestamp_utc") % 2 == 0), "actual").otherwise("forecast")
    return e.select("country_code", F.date_trunc("hour", "timestamp_utc").alias("timestamp_utc"), quality.alias("data_quality"), run.alias("forecast_run_time"), *[c.alias(n) for n, c in columns.items()])


def _forecasts(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    h = hours(spark, sf).withColumn("country_code", _country()).where(F.col("country_code").isNotNull()).withColumnRenamed("ts", "target_timestamp_utc")
    return {
        "energy_load_forecast": h.select("country_code", "target_timestamp_utc", F.when(F.hour("target_timestamp_utc") % 5 == 0, "week_ahead").otherwise("day_ahead").alias("forecast_type"), (F.col("y") * 10 + 3).alias("forecast_value_mw")),
        "energy_generation_forecast": h.select("country_code", "target_timestamp_utc", F.col("y").alias("solar_mw"), (F.col("y") + 1).alias("wind_onshore_mw"), (F.col("y") + 2).alias("wind_offshore_mw"), (F.col("y") + 3).alias("total_forecast_mw")),
    }


def _at(spark: SparkSession, tables: dict[str, DataFrame]) -> str:
    root = f"{_folder(spark)}-{uuid.uuid4().hex[:6]}"
    for name, df in tables.items():
        df.write.parquet(f"{root}/{name}.parquet")
    return root


def _of(kind: str, expression: str, quality: bool) -> None:
    sql = f"WITH {X} SELECT country_code, {sql_text('ts')} AS ts, {expression} AS y FROM x WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-09'" + (" AND quality = 'actual'" if quality else "")

    @query(sql, f"energy_{kind}")
    def run(spark, sf):
        root = _at(spark, _energy(spark, sf))
        return series.energy(spark, root, kind, None, "2024-01-03", "2024-01-09").withColumn("ts", text("ts"))


for _kind, _expression, _quality in (("load", "y * 10", True), ("price", "y - 50", True), ("renewable", "y * 3", True), ("solar", "y", False), ("wind_onshore", "y * 2", False), ("wind_offshore", "CAST(NULL AS DOUBLE)", False), ("hydro_total", "CASE WHEN event_id % 4 > 0 THEN y END + (y + 1)", False), ("biomass", "7.0::DOUBLE", False)):
    _of(_kind, _expression, _quality)


@query(f"WITH {X}, {WEATHER} SELECT country_code, {sql_text('ts')} AS ts, {sql_text('run')} AS run, temperature_2m_k, relative_humidity_2m_frac FROM w WHERE quality = 'actual' AND country_code = 'FR' AND ts >= TIMESTAMP '2024-01-02'")
def weather_actual(spark, sf):
    root = _at(spark, {"weather_data": _weather(spark, sf)})
    got = series.weather(spark, root, "FR", "2024-01-02", columns=["temperature_2m_k", "relative_humidity_2m_frac"])
    return got.select("country_code", text("ts").alias("ts"), text("forecast_run_time").alias("run"), "temperature_2m_k", "relative_humidity_2m_frac")


@query(f"""WITH {X}, {WEATHER}, f AS (SELECT *, CAST(ts AS DATE) AS day FROM w WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-06'),
l AS (SELECT * FROM f WHERE quality = 'forecast' QUALIFY run = max(run) OVER (PARTITION BY country_code, day)),
a AS (SELECT f.* FROM f WHERE quality = 'actual' AND NOT EXISTS (SELECT 1 FROM l WHERE l.country_code = f.country_code AND l.day = f.day))
SELECT country_code, {sql_text('ts')} AS ts, {sql_text('run')} AS run, temperature_2m_k FROM (SELECT * FROM l UNION ALL SELECT * FROM a)""")
def weather_latest_run(spark, sf):
    """The latest run of each country's days; measured weather where a day has no forecast."""
    root = _at(spark, {"weather_data": _weather(spark, sf)})
    return series.latest_weather(spark, root, "2024-01-02", "2024-01-06").select("country_code", text("ts").alias("ts"), text("forecast_run_time").alias("run"), "temperature_2m_k")


@query(f"WITH {X} SELECT country_code, {sql_text('ts')} AS ts, y AS wind FROM x WHERE country_code = 'DE' AND event_id % 2 = 0")
def weather_multipoint(spark, sf):
    e = _rows(spark, sf)
    rows = e.select("country_code", "timestamp_utc", F.when(F.col("event_id") % 2 == 0, "wind_onshore").otherwise("solar").alias("forecast_type"), F.col("y").alias("wind"))
    return series.multipoint(spark, _at(spark, {"weather_data_multipoint": rows}), "wind_onshore", "DE").select("country_code", text("ts").alias("ts"), "wind")


@query(f"WITH {X}, {WEATHER} SELECT country_code, {sql_text('ts')} AS ts, {sql_text('run')} AS run, temperature_2m_k FROM w WHERE quality = 'forecast' AND run = TIMESTAMP '2024-01-04 18:00:00' AND ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-09'")
def weather_of_a_run(spark, sf):
    """All hours of one given run."""
    root = _at(spark, {"weather_data": _weather(spark, sf)})
    got = series.weather_run(spark, root, "2024-01-02", "2024-01-09", "2024-01-04 18:00:00", columns=["temperature_2m_k"])
    return got.select("country_code", text("ts").alias("ts"), text("forecast_run_time").alias("run"), "temperature_2m_k")


@query(f"WITH {X}, {WEATHER} SELECT type, name, count(*) AS n, round(avg(v), 7) AS mean FROM (SELECT CASE WHEN name = 'temperature_2m_k' THEN ['load', 'price', 'hydro_total', 'biomass'] WHEN name = 'relative_humidity_2m_frac' THEN ['load'] ELSE ['price', 'renewable', 'wind_onshore', 'wind_offshore'] END AS types, name, v FROM (SELECT 'temperature_2m_k' AS name, temperature_2m_k AS v FROM w UNION ALL SELECT 'relative_humidity_2m_frac', relative_humidity_2m_frac FROM w UNION ALL SELECT 'wind_speed_100m_ms', 0.0 FROM w)), (SELECT unnest(['load', 'price', 'renewable', 'solar', 'wind_onshore', 'wind_offshore', 'hydro_total', 'biomass']) AS type) WHERE list_contains(types, type) GROUP BY 1, 2")
def columns_by_type(spark, sf):
    """What each series type learns from, of the columns that are there."""
    w = _weather(spark, sf).select("temperature_2m_k", "wind_speed_100m_ms", "relative_humidity_2m_frac")
    rows = [w.unpivot([], series.weather_columns(kind, w.columns), "name", "v").withColumn("type", F.lit(kind)) for kind in jobs.TYPES if series.weather_columns(kind, w.columns)]
    return reduce(DataFrame.unionByName, rows).groupBy("type", "name").agg(F.count("*").alias("n"), r7(F.avg("v")).alias("mean"))


ZONES = [(c, p, w) for c, lot in (("BE", (0.5, 0.5, 0.0)), ("DE", (0.2, 0.3, 0.5)), ("FR", (1.0, 2.0, 4.0))) for p, w in enumerate(lot)]


@query(f"""WITH {X}, h AS (SELECT country_code, date_trunc('hour', ts) AS ts, avg(y * 10) AS y FROM x WHERE quality = 'actual' GROUP BY 1, 2),
p AS (SELECT country_code, date_trunc('hour', ts) AS ts, event_id % 4 AS point, CASE WHEN event_id % 9 > 0 THEN y + 200 END AS t FROM x), z AS (SELECT * FROM (VALUES {', '.join(f"('{c}', {p}, {w!r}::DOUBLE)" for c, p, w in ZONES)}) z(country_code, point, weight)),
m AS (SELECT country_code, ts, sum(weight * t) / nullif(sum(CASE WHEN t IS NOT NULL THEN weight END), 0) AS t, count(DISTINCT point) AS n_points FROM p JOIN z USING (country_code, point) GROUP BY 1, 2)
SELECT country_code, {sql_text('ts')} AS ts, round(y, 7) AS y, round(t, 7) AS temperature_2m_k, n_points FROM h LEFT JOIN m USING (country_code, ts)""")
def training_frame_multipoint(spark, sf):
    """Hourly load of all countries with the weather of their zones, weighted."""
    root = _at(spark, _energy(spark, sf))
    points = _rows(spark, sf).select("country_code", F.col("timestamp_utc").alias("ts"), (F.col("event_id") % 4).cast("int").alias("point"), F.when(F.col("event_id") % 9 > 0, F.col("y") + 200).alias("temperature_2m_k"))
    got = series.training_multipoint(series.energy(spark, root, "load"), points, local(spark, ZONES, "country_code string, point int, weight double"), ["temperature_2m_k"])
    return got.select("country_code", text("ts").alias("ts"), r7("y").alias("y"), r7("temperature_2m_k").alias("temperature_2m_k"), "n_points")


@query(f"""WITH {X}, h AS (SELECT country_code, date_trunc('hour', ts) AS ts, CAST(sum(CAST(y * 10 AS DECIMAL(28,10))) AS DOUBLE) / count(*) AS y FROM x WHERE quality = 'actual' GROUP BY 1, 2),
w AS (SELECT country_code, date_trunc('hour', ts) AS ts, min(y + 200) AS t FROM x WHERE event_id % 5 > 1 GROUP BY 1, 2)
SELECT country_code, {sql_text('ts')} AS ts, round(y, 7) AS y, t AS temperature_2m_k FROM h LEFT JOIN w USING (country_code, ts)""")
def training_frame(spark, sf):
    """Hourly load with the weather of the hour."""
    root = _at(spark, _energy(spark, sf) | {"weather_data": _rows(spark, sf).where("event_id % 5 > 1").groupBy("country_code", F.date_trunc("hour", "timestamp_utc").alias("timestamp_utc")).agg(F.min(F.col("y") + 200).alias("temperature_2m_k")).withColumns({"data_quality": F.lit("actual"), "forecast_run_time": F.lit(None).cast("timestamp")})})
    got = series.training(series.energy(spark, root, "load"), series.weather(spark, root, columns=["temperature_2m_k"]))
    return got.select("country_code", text("ts").alias("ts"), F.round("y", 7).alias("y"), "temperature_2m_k")


F_ = f"{H}, f AS (SELECT {SQL_COUNTRY} AS country_code, ts, y FROM h WHERE {SQL_COUNTRY} IS NOT NULL)"


@query(f"WITH {F_} SELECT country_code, {sql_text('ts')} AS ts, y * 10 + 3 AS tso FROM f WHERE hour(ts) % 5 <> 0 AND country_code = 'DE' AND ts >= TIMESTAMP '2024-01-02' AND ts <= TIMESTAMP '2024-01-05'")
def tso_load_forecast(spark, sf):
    """Both ends of the span are in it."""
    root = _at(spark, _forecasts(spark, sf))
    return series.tso_load(spark, root, "day_ahead", "DE", "2024-01-02", "2024-01-05").withColumn("ts", text("ts"))


def _generation(kind: str, expression: str) -> None:
    @query(f"WITH {F_} SELECT country_code, {sql_text('ts')} AS ts, {expression} AS tso FROM f", f"tso_generation_{kind}")
    def run(spark, sf):
        return series.tso_generation(spark, _at(spark, _forecasts(spark, sf)), kind).withColumn("ts", text("ts"))


for _kind, _expression in (("solar", "y"), ("wind_onshore", "y + 1"), ("wind_offshore", "y + 2"), ("biomass", "y + 3")):
    _generation(_kind, _expression)


@query(f"""WITH {X}, a AS (SELECT country_code, date_trunc('hour', ts) AS ts, avg(y * 10) AS y FROM x WHERE quality = 'actual' GROUP BY 1, 2), g AS (SELECT k, date_trunc('hour', ts) AS ts, CAST(sum(CAST(y AS DECIMAL(18,2))) AS DOUBLE) / count(y) AS y FROM e GROUP BY 1, 2),
t AS (SELECT {SQL_COUNTRY} AS country_code, ts, y * 10 + 3 AS tso FROM g WHERE {SQL_COUNTRY} IS NOT NULL AND hour(ts) % 5 <> 0)
SELECT country_code, {sql_text('ts')} AS ts, round(a.y, 7) AS y, round(tso, 7) AS tso, round(a.y - tso, 7) AS tso_error FROM a JOIN t USING (country_code, ts)""")
def tso_beside_actual(spark, sf):
    root = _at(spark, _energy(spark, sf) | _forecasts(spark, sf))
    got = series.tso_beside_actual(series.energy(spark, root, "load"), series.tso_load(spark, root))
    return got.select("country_code", text("ts").alias("ts"), *[F.round(c, 7).alias(c) for c in ("y", "tso", "tso_error")])


@query(f"""WITH {F_}, p AS (SELECT country_code, date_trunc('hour', ts) AS ts, arg_max(y - 50, ts) AS price FROM (SELECT {SQL_COUNTRY} AS country_code, ts, y FROM e WHERE {SQL_COUNTRY} IS NOT NULL) GROUP BY 1, 2)
SELECT country_code, {sql_text('coalesce(p.ts, f.ts)')} AS ts, price, y * 10 + 3 AS tso, 0.0::DOUBLE AS gas FROM p FULL JOIN (SELECT * FROM f WHERE hour(ts) % 5 <> 0) f USING (country_code, ts)""")
def covariate_frame(spark, sf):
    """Price and load forecast joined in full, the last row of an hour, and 0 for a column that neither has."""
    root = _at(spark, _energy(spark, sf) | _forecasts(spark, sf))
    price = series.energy(spark, root, "price", quality=None).withColumnRenamed("y", "price")
    return series.covariates([price, series.tso_load(spark, root)], ["gas"]).select("country_code", text("ts").alias("ts"), "price", "tso", "gas")


@query(f"""WITH {X}, a AS (SELECT country_code, date_trunc('hour', ts) AS ts, avg(y * 10) AS y FROM x WHERE quality = 'actual' GROUP BY 1, 2), g AS (SELECT k, date_trunc('hour', ts) AS ts, CAST(sum(CAST(y AS DECIMAL(18,2))) AS DOUBLE) / count(y) AS y FROM e GROUP BY 1, 2)
SELECT country_code, {sql_text('ts')} AS ts, round(a.y - (g.y * 10 + 3), 7) AS tso_error FROM a JOIN (SELECT {SQL_COUNTRY} AS country_code, ts, y FROM g WHERE hour(ts) % 5 <> 0) g USING (country_code, ts) WHERE ts >= TIMESTAMP '2024-01-12 09:00:00' AND ts < TIMESTAMP '2024-01-20 09:00:00'""")
def recent_errors(spark, sf):
    """Errors of the last eight days before a moment, of all countries."""
    root = _at(spark, _energy(spark, sf) | _forecasts(spark, sf))
    got = series.recent_errors(series.energy(spark, root, "load"), series.tso_load(spark, root), "2024-01-20 09:00:00")
    return got.select("country_code", text("ts").alias("ts"), r7("tso_error").alias("tso_error"))


@query(f"""WITH {X}, h AS (SELECT k, date_trunc('hour', ts) AS ts, CAST(sum(CAST(y AS DECIMAL(18,2))) AS DOUBLE) / count(y) AS y FROM e GROUP BY 1, 2), f AS (SELECT {SQL_COUNTRY} AS item_id, ts, y FROM h WHERE {SQL_COUNTRY} IS NOT NULL),
p AS (SELECT country_code AS item_id, date_trunc('hour', ts) AS ts, arg_max(y - 50, ts) AS target FROM x WHERE quality = 'actual' AND ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-20' GROUP BY 1, 2), l AS (SELECT item_id, ts, y * 10 + 3 AS load_forecast FROM f WHERE hour(ts) % 5 <> 0)
SELECT p.item_id, {sql_text('p.ts')} AS ts, target, load_forecast FROM p LEFT JOIN l ON l.ts = p.ts AND l.item_id = p.item_id""")
def fine_tune_frame(spark, sf):
    """Targets of all items with what was known ahead, for fine-tuning a sequence model."""
    root = _at(spark, _energy(spark, sf) | _forecasts(spark, sf))
    price = series.energy(spark, root, "price", None, "2024-01-02", "2024-01-20")
    known = series.tso_load(spark, root).withColumnRenamed("tso", "load_forecast")
    got = series.fine_tuning(price, [known], "country_code")
    return got.select("item_id", text("ts").alias("ts"), "target", "load_forecast")


@query("""WITH r AS (SELECT c_nationkey AS run, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS requested FROM customer GROUP BY 1)
SELECT run, requested, unnest(string_split(requested, ',')) AS item FROM r""")
def requested_items(spark, sf):
    """Lists kept as comma-joined text, and read back one item a row."""
    c = read(spark, sf, "customer").select(F.col("c_nationkey").alias("run"), F.col("c_mktsegment").alias("item")).distinct()
    joined = c.groupBy("run").agg(control.comma_joined("item").alias("requested"))
    return control.comma_split(joined, "requested", "item")


FOLDS = f"""{H}, z AS (SELECT k, max(ts) AS z, min(ts) AS a FROM h GROUP BY k HAVING floor(epoch(max(ts) - min(ts)) / 86400) - 3 * 4 >= 10),
f AS (SELECT k, CAST(3 - b AS INT) AS fold, a, z - (b * 4 + 4) * INTERVAL 1 DAY AS t0, z - (b * 4) * INTERVAL 1 DAY AS t1 FROM z, range(3) v(b)),
p AS (SELECT f.k, f.fold, h.ts, h.y, q.y AS p, s.y AS base FROM f JOIN h ON h.k = f.k AND h.ts BETWEEN t0 AND t1 JOIN h q ON q.k = h.k AND q.ts = h.ts - INTERVAL 48 HOUR LEFT JOIN h s ON s.k = h.k AND s.ts = h.ts - INTERVAL 168 HOUR)"""


@query(f"WITH {FOLDS} SELECT k, fold, count(*) AS n, {sql_mean('abs(p - y)')} AS mae, round(1 - avg(CASE WHEN base IS NOT NULL THEN abs(p - y) END) / avg(abs(base - y)), 9) AS skill FROM p GROUP BY 1, 2")
def walk_forward_validated(spark, sf):
    """Persistence, judged fold by fold against the week before; see validation.validate for models that are trained."""
    got = _validated(spark, sf)
    return got.select("k", "fold", "n", r7("mae").alias("mae"), F.round("skill", 9).alias("skill"))


@query(f"WITH {FOLDS}, g AS (SELECT k, fold, 1 - avg(CASE WHEN base IS NOT NULL THEN abs(p - y) END) / avg(abs(base - y)) AS skill FROM p GROUP BY 1, 2), m AS (SELECT k, avg(skill) AS mean_skill, count(*) AS folds FROM g GROUP BY k) SELECT p.k, any_value(folds) AS folds, count(*) AS n, {sql_mean('abs(p - y)')} AS mae, round(any_value(mean_skill), 9) AS mean_skill FROM p JOIN m USING (k) GROUP BY p.k")
def walk_forward_summary(spark, sf):
    """Metrics over all test rows of a series, and the mean of its folds' skills."""
    rows = _tested(spark, sf)
    out = validation.summary(rows, ["k"], "base")
    return out.select("k", "folds", "n", r7("mae").alias("mae"), F.round("mean_skill", 9).alias("mean_skill"))


def _tested(spark, sf):
    h = hours(spark, sf)
    folds = crossval.walk_forward_folds(h, ["k"], folds=3, test_days=4, gap_days=1, least_days=10)
    h = joins.offset_lookup(joins.offset_lookup(h, ["k"], 48, "p"), ["k"], 168, "base")
    return validation.tested(h.where("p is not null"), folds, ["k"])


def _validated(spark, sf):
    return validation.by_fold(_tested(spark, sf), ["k"], "base")


@query(f"WITH {E} SELECT event_id, CAST(greatest(1, floor((epoch(ts) - epoch(TIMESTAMP '2024-01-10 00:30:00')) / 3600)) AS BIGINT) AS horizon_hours FROM e")
def horizons(spark, sf):
    now = F.lit("2024-01-10 00:30:00").cast("timestamp")
    return events(spark, sf).select("event_id", scalars.horizon_hours(F.col("ts"), now).cast("long").alias("horizon_hours"))


@query("SELECT c_custkey, coalesce(nullif(c_acctbal, 0) > 1000, false) AS unreliable FROM customer")
def unreliable_mape(spark, sf):
    c = read(spark, sf, "customer")
    return c.select("c_custkey", scalars.unreliable(F.nullif(F.col("c_acctbal"), F.lit(0.0))).alias("unreliable"))


@query("SELECT c_nationkey, c_mktsegment, count(*) AS n, round(count(*) * 100.0 / 24, 1) AS coverage_pct FROM customer GROUP BY 1, 2")
def forecast_coverage(spark, sf):
    got = control.coverage(read(spark, sf, "customer"), ["c_nationkey", "c_mktsegment"], 24)
    return got.withColumn("coverage_pct", F.col("coverage_pct").cast("double"))


@query("WITH r AS (SELECT DISTINCT l_returnflag AS c, l_suppkey AS t, CASE l_linenumber WHEN 1 THEN 'production' WHEN 2 THEN 'legacy' ELSE 'candidate' END AS location, CAST(l_orderkey AS VARCHAR) AS version FROM lineitem) SELECT c, t, location, version FROM r WHERE location <> 'candidate' QUALIFY row_number() OVER (PARTITION BY c, t ORDER BY CASE location WHEN 'production' THEN 0 ELSE 1 END, version DESC) = 1")
def version_to_load(spark, sf):
    place = F.when(F.col("l_linenumber") == 1, "production").when(F.col("l_linenumber") == 2, "legacy").otherwise("candidate")
    r = read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("c"), F.col("l_suppkey").alias("t"), place.alias("location"), F.col("l_orderkey").cast("string").alias("version")).distinct()
    return control.load_version(r, ["c", "t"])


TYPES = ("load", "price", "solar")
HISTORY = f"{F_}, y AS (SELECT country_code, forecast_type, ts, y * CASE forecast_type WHEN 'load' THEN 10 WHEN 'price' THEN 2 ELSE 1 END AS y FROM f, (SELECT unnest(['load', 'price', 'solar']) AS forecast_type))"


def _history(spark, sf):
    """Three types of series for each country."""
    h = hours(spark, sf).withColumn("country_code", _country()).where(F.col("country_code").isNotNull())
    scaled = {"load": F.col("y") * 10, "price": F.col("y") * 2, "solar": F.col("y") * 1}
    types = F.explode(F.array(*[F.struct(F.lit(t).alias("forecast_type"), c.alias("y")) for t, c in scaled.items()])).alias("t")
    return h.select("country_code", "ts", types).select("country_code", "t.forecast_type", "ts", "t.y")


@query(f"""WITH {HISTORY}, w AS (SELECT country_code, forecast_type, horizon, TIMESTAMP '2024-01-20' + (horizon * 24 + h) * INTERVAL 1 HOUR AS ts FROM (SELECT unnest(['BE', 'DE', 'FR']) AS country_code), (SELECT unnest(['load', 'price', 'solar']) AS forecast_type), (VALUES (1), (2)) d(horizon), range(24) r(h))
SELECT w.country_code, w.forecast_type, {sql_text('w.ts')} AS ts, CAST(epoch(w.ts - TIMESTAMP '2024-01-20 06:00:00') // 3600 AS BIGINT) AS horizon_hours, y AS forecast_value, 'persistence' AS model_name FROM w JOIN y ON y.country_code = w.country_code AND y.forecast_type = w.forecast_type AND y.ts = w.ts - horizon * INTERVAL 24 HOUR""")
def daily_forecasts(spark, sf):
    """The daily job for all countries and types, two days ahead, by a runner that works and one that fails; stored and read back."""

    def failing(history, hours):
        raise RuntimeError("no such model")

    work = jobs.work_list(spark, sorted(COUNTRIES.values()), list(TYPES), [1, 2])
    table = sinks.tables(spark, _folder(spark))["forecasts"]
    jobs.run_all(_history(spark, sf), work, lambda rows: sinks.save_forecasts(table, rows), "2024-01-20 06:00:00", {"persistence": jobs.persistence, "failing": failing})
    return table.read().select("country_code", "forecast_type", text("target_timestamp_utc").alias("ts"), F.col("horizon_hours").cast("long").alias("horizon_hours"), "forecast_value", "model_name")


@query()
def daily_boosted(spark, sf):
    """The same job by boosted models of all series."""
    work = jobs.work_list(spark, sorted(COUNTRIES.values()), list(TYPES), [1, 2])
    runner = lambda h, w: jobs.boosted(h, w, validation_rows=48)
    got = jobs.forecasts(_history(spark, sf), work, {"boosted": runner}, "2024-01-24 06:00:00")
    return got.select("country_code", "forecast_type", text("target_timestamp_utc").alias("ts"), "horizon_hours", "forecast_value", "model_name")


@query(f"""WITH {HISTORY}, w AS (SELECT DISTINCT country_code, forecast_type FROM y WHERE forecast_type <> 'solar' UNION SELECT 'IT', 'load'), n AS (SELECT country_code, forecast_type, count(*) AS n FROM y WHERE ts < TIMESTAMP '2024-01-25' GROUP BY 1, 2)
SELECT w.country_code, w.forecast_type, CASE WHEN n >= 500 THEN 'completed' ELSE 'skipped' END AS status, CASE WHEN n IS NULL THEN 'no data' WHEN n < 500 THEN 'insufficient data' END AS reason, coalesce(n, 0) AS rows FROM w LEFT JOIN n USING (country_code, forecast_type)""")
def train_all_report(spark, sf):
    """The training job's report: which series were trained, and why not the others."""
    work = jobs.work_list(spark, sorted(COUNTRIES.values()), ["load", "price"]).unionByName(jobs.work_list(spark, ["IT"], ["load"]))
    report, _, _ = jobs.train_all(_history(spark, sf), work, "2024-01-24 06:00:00", least_rows=500, validation_rows=48, params={"rounds": 20})
    return report.select("country_code", "forecast_type", "status", "reason", "rows")


@query()
def train_all_losses(spark, sf):
    """The training job's losses beside persistence's, of all series."""
    work = jobs.work_list(spark, sorted(COUNTRIES.values()), list(TYPES))
    report, _, _ = jobs.train_all(_history(spark, sf), work, "2024-01-24 06:00:00", least_rows=500, validation_rows=48)
    return report
