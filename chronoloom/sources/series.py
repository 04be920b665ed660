"""Scans of the domain tables: typed, filtered by key, quality and time so that all of it reaches the Parquet scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import joins, shape

#: Series type -> (table, value column). Fixed values.
VALUES = {
    "load": ("energy_load", "load_mw"),
    "price": ("energy_price", "price_eur_mwh"),
    "renewable": ("energy_renewable", "total_renewable_mw"),
    "solar": ("energy_renewable", "solar_mw"),
    "wind_onshore": ("energy_renewable", "wind_onshore_mw"),
    "wind_offshore": ("energy_renewable", "wind_offshore_mw"),
    "hydro_total": ("energy_renewable", ("hydro_run_mw", "hydro_reservoir_mw")),
    "biomass": ("energy_renewable", "biomass_mw"),
}
WEATHER = ["temperature_2m_k", "relative_humidity_2m_frac", "wind_speed_10m_ms", "wind_speed_100m_ms", "shortwave_radiation_wm2", "direct_radiation_wm2", "diffuse_radiation_wm2"]
#: Weather columns that a series type learns from. Fixed values.
WEATHER_OF = {
    "load": ["temperature_2m_k", "relative_humidity_2m_frac"],
    "price": ["temperature_2m_k", "wind_speed_100m_ms", "shortwave_radiation_wm2"],
    "renewable": ["shortwave_radiation_wm2", "direct_radiation_wm2", "diffuse_radiation_wm2", "wind_speed_100m_ms", "wind_speed_10m_ms"],
    "solar": ["shortwave_radiation_wm2", "direct_radiation_wm2", "diffuse_radiation_wm2"],
    "wind_onshore": ["wind_speed_100m_ms", "wind_speed_10m_ms"],
    "wind_offshore": ["wind_speed_100m_ms", "wind_speed_10m_ms"],
    "hydro_total": ["temperature_2m_k"],
    "biomass": ["temperature_2m_k"],
}
#: Forecast columns by series type; any other type reads the total. Fixed values.
GENERATION = {"solar": "solar_mw", "wind_onshore": "wind_onshore_mw", "wind_offshore": "wind_offshore_mw"}


def value_of(kind: str) -> Column:
    """The value column of a series type; a sum is null where a part is."""
    if kind not in VALUES:
        raise ValueError(f"no series type {kind!r}; there are {', '.join(VALUES)}")
    name = VALUES[kind][1]
    return F.col(name) if isinstance(name, str) else reduce(lambda a, b: a + b, map(F.col, name))


def between(df: DataFrame, start: str | None, end: str | None, ts: str = "timestamp_utc", **equal) -> DataFrame:
    """Rows in [start, end) whose columns equal the given values; what isn't given doesn't filter."""
    if start is not None:
        df = df.where(F.col(ts) >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.where(F.col(ts) < F.lit(end).cast("timestamp"))
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def energy(spark: SparkSession, root: str, kind: str, country: str | None = None, start: str | None = None, end: str | None = None, quality: str | None = "actual") -> DataFrame:
    """(country_code, ts, y) of a series type. The parts of the renewable table are read whatever their quality."""
    df = spark.read.parquet(f"{root}/{VALUES[kind][0] if kind in VALUES else value_of(kind)}.parquet")
    parts = VALUES[kind][0] == "energy_renewable" and kind != "renewable"
    return between(df, start, end, country_code=country, data_quality=None if parts else quality).select("country_code", F.col("timestamp_utc").alias("ts"), value_of(kind).alias("y"))


def history(spark: SparkSession, root: str, types: list[str], countries: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """(country_code, forecast_type, ts, y): hourly means of several series types under each other."""
    each = [energy(spark, root, kind, None, start, end) for kind in types]
    chosen = [e if countries is None else e.where(F.col("country_code").isin(countries)) for e in each]
    return reduce(DataFrame.unionByName, [shape.resample(e, ["country_code"]).withColumn("forecast_type", F.lit(kind)) for kind, e in zip(types, chosen, strict=True)])


def weather(spark: SparkSession, root: str, country: str | None = None, start: str | None = None, end: str | None = None, quality: str = "actual", columns: list[str] = WEATHER) -> DataFrame:
    df = between(spark.read.parquet(f"{root}/weather_data.parquet"), start, end, country_code=country, data_quality=quality)
    return df.select("country_code", F.col("timestamp_utc").alias("ts"), "forecast_run_time", *columns)


def latest_weather(spark: SparkSession, root: str, start: str, end: str, country: str | None = None) -> DataFrame:
    """Forecast weather of each country's and day's latest run; days without any have measured weather instead."""
    rows = weather(spark, root, country, start, end, "forecast").withColumn("day", F.to_date("ts"))
    actual = weather(spark, root, country, start, end, "actual").withColumn("day", F.to_date("ts"))
    return joins.with_fallback(joins.latest_run(rows, ["country_code", "day"], "forecast_run_time"), actual, ["country_code", "day"])


def weather_run(spark: SparkSession, root: str, start: str, end: str, run: str | None = None, country: str | None = None, columns: list[str] = WEATHER) -> DataFrame:
    """Forecast weather as one run gave it; without `run`, as each country's latest run for these hours did."""
    rows = weather(spark, root, country, start, end, "forecast", columns)
    if run is not None:
        return rows.where(F.col("forecast_run_time") == F.lit(run).cast("timestamp"))
    return joins.latest_run(rows, ["country_code"], "forecast_run_time")


def weather_columns(kind: str, there: list[str], derived: tuple[str, ...] = ("temperature_c", "heating_degree", "cooling_degree")) -> list[str]:
    """Of the columns that are there those that a series type learns from, in the type's order; what is derived from the temperature comes along, degrees of
    heating and cooling for loads only."""
    if kind not in WEATHER_OF:
        raise ValueError(f"no series type {kind!r}; there are {', '.join(WEATHER_OF)}")
    also = [c for c in derived if c in there and (kind == "load" or "degree" not in c)]
    return [c for c in WEATHER_OF[kind] if c in there] + (also if "temperature_2m_k" in WEATHER_OF[kind] else [])


def recent_errors(actual: DataFrame, tso: DataFrame, as_of: str, days: int = 8) -> DataFrame:
    """Truth beside the external forecast, and its error, of the `days` before `as_of`: what a correction needs of the past. Filters reach both scans."""
    until = F.lit(as_of).cast("timestamp")
    near = lambda df: df.where((F.col("ts") >= until - F.make_dt_interval(days=F.lit(days))) & (F.col("ts") < until))
    return tso_beside_actual(near(actual), near(tso))


def training_multipoint(energy_rows: DataFrame, points: DataFrame, zones: DataFrame, columns: list[str], most_zones: int = 10_000) -> DataFrame:
    """Hourly means of the target with the weather of its country, weighted over the points of `zones` (country_code, point, weight): of each column over the
    points that have a value in the hour. `zones` is broadcast up to `most_zones` rows, more are joined by shuffle."""
    table = F.broadcast(zones) if zones.limit(most_zones + 1).count() <= most_zones else zones
    w = lambda c: F.when(F.col(c).isNotNull(), F.col("weight"))
    hours = points.withColumn("ts", F.date_trunc("hour", "ts")).join(table, ["country_code", "point"])
    means = hours.groupBy("country_code", "ts").agg(*[F.try_divide(F.sum(w(c) * F.col(c)), F.sum(w(c))).alias(c) for c in columns], F.count_distinct("point").alias("n_points"))
    return shape.resample(energy_rows, ["country_code"]).join(means, ["country_code", "ts"], "left")


def multipoint(spark: SparkSession, root: str, kind: str, country: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    df = between(spark.read.parquet(f"{root}/weather_data_multipoint.parquet"), start, end, country_code=country, forecast_type=kind)
    return df.withColumnRenamed("timestamp_utc", "ts")


def training(energy_rows: DataFrame, weather_rows: DataFrame) -> DataFrame:
    """Hourly means of the target with the weather of the hour, null where there is none."""
    return shape.resample(energy_rows, ["country_code"]).join(weather_rows.drop("forecast_run_time"), ["country_code", "ts"], "left")


def tso_load(spark: SparkSession, root: str, horizon: str = "day_ahead", country: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """An external load forecast; both ends of the span are in it."""
    df = spark.read.parquet(f"{root}/energy_load_forecast.parquet").where(F.col("forecast_type") == horizon)
    df = between(df, start, None, "target_timestamp_utc", country_code=country)
    if end is not None:
        df = df.where(F.col("target_timestamp_utc") <= F.lit(end).cast("timestamp"))
    return df.select("country_code", F.col("target_timestamp_utc").alias("ts"), F.col("forecast_value_mw").alias("tso"))


def tso_generation(spark: SparkSession, root: str, kind: str) -> DataFrame:
    df = spark.read.parquet(f"{root}/energy_generation_forecast.parquet")
    return df.select("country_code", F.col("target_timestamp_utc").alias("ts"), F.col(GENERATION.get(kind, "total_forecast_mw")).alias("tso"))


def tso_beside_actual(actual: DataFrame, tso: DataFrame) -> DataFrame:
    """Hourly truth beside the forecast, and its error."""
    both = shape.resample(actual, ["country_code"]).join(tso, ["country_code", "ts"]).dropna(subset=["y", "tso"])
    return both.withColumn("tso_error", F.col("y") - F.col("tso"))


def covariates(frames: list[DataFrame], columns: list[str], keys: list[str] = ["country_code"]) -> DataFrame:  # noqa: B006
    """Hourly frames joined in full, one row an hour each (the last), and 0 for columns that none has."""
    floored = [shape.keep_last(f.withColumn("__t", F.col("ts")).withColumn("ts", F.date_trunc("hour", "ts")), [*keys, "ts"], [F.col("__t")]).drop("__t") for f in frames]
    out = joins.full_fold(floored, [*keys, "ts"])
    return out.withColumns({c: F.lit(0.0) for c in columns if c not in out.columns})


def fine_tuning(target: DataFrame, known: list[DataFrame], key: str = "country_code") -> DataFrame:
    """(item_id, ts, target, known columns): hourly targets, an hour's last, beside what was known ahead; only rows that have a target."""
    hourly = lambda f: shape.keep_last(f.withColumn("__t", F.col("ts")).withColumn("ts", F.date_trunc("hour", "ts")), [key, "ts"], [F.col("__t")]).drop("__t")
    rows = reduce(lambda a, b: a.join(hourly(b), [key, "ts"], "left"), known, hourly(target.where(F.col("y").isNotNull())))
    return rows.withColumnsRenamed({key: "item_id", "y": "target"})


def zone_mean(points: DataFrame, zones: DataFrame, by: list[str], on: list[str], value: str) -> DataFrame:
    """The mean of points by their zones' weights, over the weights of points that have a value, and how many those are."""
    w = F.when(F.col(value).isNotNull(), F.col("weight"))
    return points.join(zones, on).groupBy(*by).agg(F.try_divide(F.sum(w * F.col(value)), F.sum(w)).alias(value), F.count(value).alias("n_points"))


def latest(df: DataFrame, by: list[str], ts: str = "timestamp_utc") -> DataFrame:
    return df.groupBy(*by).agg(F.max(ts).alias("latest"))


def named_like(forecasts: DataFrame, pattern: str) -> DataFrame:
    return forecasts.where(F.col("model_name").like(pattern))


def tagged_union(frames: dict[str, DataFrame]) -> DataFrame:
    """Frames under each other, each row with its frame's name as type."""
    return reduce(lambda a, b: a.unionByName(b), [f.withColumn("type", F.lit(name)) for name, f in frames.items()])


def inventory(df: DataFrame, by: list[str], ts: str = "ts") -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"))


def sufficient(df: DataFrame, by: list[str], least: float | Column, y: str = "y") -> DataFrame:
    """Groups of which a share of `least` at least is over zero; null counts as not."""
    return df.groupBy(*by).agg(F.avg(F.coalesce((F.col(y) > 0).cast("double"), F.lit(0.0))).alias("share")).where(F.col("share") >= least)


def large_enough(df: DataFrame, by: list[str], rows: int) -> DataFrame:
    """The rows of groups that have `rows` of them; only counts are shuffled."""
    return df.join(df.groupBy(*by).agg(F.count("*").alias("__n")).where(F.col("__n") >= rows).select(*by), by, "left_semi")
