"""Rows to forecast, put together as of a moment: what was known then, and nothing later, for all series and horizons at once and by joins only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics, scalars
from . import boosting, features, joins, windows

#: Days of history that the features of a forecast are taken from: the longest lag and a week.
LOOKBACK = 21
#: Calendar columns that are those of the target, not of the row that the others come from. Fixed values.
OF_TARGET = ("hour", "day_of_week", "month", "is_weekend", "hour_sin", "hour_cos", "dow_sin", "dow_cos", "month_sin", "month_cos")


def known(history: DataFrame, as_of: str, days: int | None = None, ts: str = "ts") -> DataFrame:
    """The rows up to the end of as_of's day, of the last `days` before it."""
    day = F.to_date(F.lit(as_of))
    rows = history.where(F.col(ts) < F.date_add(day, 1).cast("timestamp"))
    return rows if days is None else rows.where(F.col(ts) >= F.date_sub(day, days).cast("timestamp"))


def weather_known(forecasts: DataFrame, as_of: str, keys: list[str], columns: list[str], run: str = "forecast_run_time", ts: str = "ts") -> DataFrame:
    """For each key and hour the forecast of the latest run that had been made by then."""
    rows = forecasts.where(F.col(run) <= F.lit(as_of).cast("timestamp"))
    return joins.latest_by(rows, [*keys, ts], run, columns)


def assemble(frame: DataFrame, targets: DataFrame, keys: list[str], columns: list[str], weather: DataFrame | None = None, weather_keys: list[str] | None = None, load: Column | None = None, ts: str = "ts", y: str = "y", temperature: str = "temperature_2m_k") -> DataFrame:
    """`targets` (keys, ts and more) with the feature columns of each hour, and `fallback`.

    Features are those of the frame's last row of the same hour of day; then calendar columns become the target's own, weather columns those of the hour's
    forecast where there is one (its nulls leave what was there), and what follows from the temperature is worked out again, degrees of heating and
    cooling for series that `load` marks. Where a series has no row of that hour, `fallback` is the mean of its y in the frame, and 0 where it has no rows.
    """
    hour = F.hour(ts)
    last = frame.groupBy(*keys, hour.alias("__hour")).agg(F.max_by(F.struct(*columns), ts).alias("__last"))
    recent = frame.groupBy(*keys).agg(metrics.mean(y).alias("__recent"))
    out = targets.withColumn("__hour", hour).join(last, [*keys, "__hour"], "left").join(recent, keys, "left")
    out = out.select(*targets.columns, *[F.col("__last")[c].alias(c) for c in columns], F.when(F.col("__last").isNull(), F.coalesce("__recent", F.lit(0.0))).alias("fallback"))
    calendar = scalars.calendar(ts) | scalars.cyclical(ts)
    there = F.col("fallback").isNull()
    out = out.withColumns({c: F.when(there, calendar[c]) for c in OF_TARGET if c in columns})
    if weather is None:
        return out
    on = [*(weather_keys or keys), ts]
    ahead = [c for c in weather.columns if c not in on and c in columns]
    out = out.join(weather.select(*on, F.lit(True).alias("__told"), *[F.col(c).alias(f"__{c}") for c in weather.columns if c not in on]), on, "left")
    out = out.withColumns({c: F.when(there, F.coalesce(F.col(f"__{c}"), F.col(c))) for c in ahead})
    if temperature in weather.columns:
        again = there & F.col("__told") & F.col(f"__{temperature}").isNotNull()
        celsius = scalars.kelvin_to_celsius(F.col(f"__{temperature}"))
        degrees = scalars.degree_days(celsius)
        marked = F.lit(False) if load is None else load
        new = {"temperature_c": F.when(again, celsius)} | {c: F.when(again & marked, x) for c, x in degrees.items()}
        out = out.withColumns({c: F.coalesce(x, F.col(c)) for c, x in new.items() if c in columns})
    return out.drop("__told", *[f"__{c}" for c in weather.columns if c not in on])


def frame_of(history: DataFrame, keys: list[str], covariates: list[str], load: Column | None = None, temperature: str = "temperature_2m_k") -> tuple[DataFrame, list[str]]:
    """The feature matrix of all series and the columns to train on. A temperature among the covariates adds degrees, those of heating and cooling only
    where `load` holds."""
    m = features.feature_matrix(history, keys, covariates)
    if temperature in covariates:
        m = features.weather_features(m, temperature)
        if load is not None:
            m = m.withColumns({c: F.when(load, F.col(c)) for c in ("heating_degree", "cooling_degree")})
    names = features.model_columns([c for c, t in m.dtypes if c not in (*keys, "ts", "y") and t in ("double", "int", "bigint", "float")])
    return m, names


def trained(history: DataFrame, keys: list[str], covariates: list[str] = (), algorithm: str = "xgboost", params: dict | None = None, validation_rows: int = 720, load: Column | None = None) -> tuple[DataFrame, list[str]]:
    """Models of all series in one job, each stopped early on its last rows, and their columns."""
    m, names = frame_of(history, keys, list(covariates), load)
    rows = windows.tail_split(m, keys, validation_rows)
    return boosting.fit_all(rows, keys, names, trials=[params or {}], algorithm=algorithm, check="is_validation"), names


def predicted(history: DataFrame, models: DataFrame, names: list[str], targets: DataFrame, keys: list[str], as_of: str, covariates: list[str] = (), weather: DataFrame | None = None, weather_keys: list[str] | None = None, load: Column | None = None) -> DataFrame:
    """`targets` with the forecast `p` as of `as_of`: the model's on the assembled features, the fallback where there are none. Series without a model have none."""
    m, _ = frame_of(known(history, as_of, LOOKBACK), keys, list(covariates), load)
    rows = assemble(m, targets, keys, names, weather, weather_keys, load)
    out = boosting.predict_all(rows.where("fallback is null"), models, keys, names).where("p is not null").select(*targets.columns, "p")
    return out.unionByName(rows.where("fallback is not null").select(*targets.columns, F.col("fallback").alias("p")))
