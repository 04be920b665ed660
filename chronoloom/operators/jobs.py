"""The daily jobs: work lists of series and horizons, training of all of them, the runners that forecast them, and the rows to be stored."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from functools import reduce
from threading import Event

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics, scalars
from ..session import written
from . import evaluation, joins, prediction, windows

Runner = Callable[[DataFrame, DataFrame], DataFrame]
SERIES = ["country_code", "forecast_type"]
#: Types and days ahead of the jobs, and the countries of `all`. Fixed values.
TYPES = ("load", "price", "renewable", "solar", "wind_onshore", "wind_offshore", "hydro_total", "biomass")
TRAINED = ("load", "price", "solar", "wind_onshore", "wind_offshore")
HORIZONS = {"price": 2}
LIMIT = 300.0


def default_horizon(kind: str) -> int:
    return HORIZONS.get(kind, 1)


def chosen(text: str, every: tuple[str, ...], upper: bool = False) -> list[str]:
    """A command's comma list, or all of `every` for `all`."""
    if text.strip().lower() == "all":
        return list(every)
    return list(dict.fromkeys(t.strip().upper() if upper else t.strip().lower() for t in text.split(",") if t.strip()))


def work_list(spark: SparkSession, countries: list[str], types: list[str], horizons: list[int] | None = None) -> DataFrame:
    """(country_code, forecast_type, horizon): every combination; without horizons each type's own."""
    rows = [(c, t, h) for c in countries for t in types for h in (horizons or [default_horizon(t)])]
    return spark.createDataFrame(rows, "country_code string, forecast_type string, horizon int").coalesce(1)


def wanted(work: DataFrame, as_of: str) -> DataFrame:
    """(country_code, forecast_type, horizon, ts): the 24 hours of the day that lies `horizon` days after the one of `as_of`, for each row of the work list."""
    start = F.date_add(F.to_date(F.lit(as_of)), F.col("horizon")).cast("timestamp")
    hours = F.sequence(start, start + F.expr("interval 23 hours"), F.expr("interval 1 hour"))
    return work.select(*SERIES, "horizon", F.explode(hours).alias("ts"))


def persistence(history: DataFrame, hours: DataFrame) -> DataFrame:
    """The value `horizon` days earlier; hours without one get no forecast. All series at once."""
    earlier = history.select(*SERIES, F.col("ts").alias("__then"), F.col("y").alias("p"))
    then = hours.withColumn("__then", F.col("ts") - F.make_dt_interval(days="horizon"))
    return then.join(earlier, [*SERIES, "__then"]).drop("__then").where("p is not null")


def boosted(history: DataFrame, hours: DataFrame, algorithm: str = "xgboost", params: dict | None = None, covariates: tuple[str, ...] = (), weather: DataFrame | None = None, as_of: str | None = None, validation_rows: int = 720) -> DataFrame:
    """A boosted model for each series of the work list, all trained in one job, and its forecasts as of the hours' own day less the horizon.

    `weather` holds forecasts (country_code, ts, forecast_run_time, columns); of each hour the latest run that was made by `as_of` counts."""
    mine = history.join(hours.select(*SERIES).distinct(), SERIES, "left_semi").withColumn("y", F.col("y").cast("double"))
    as_of = as_of or str(hours.agg(F.min(F.col("ts") - F.make_dt_interval(days="horizon"))).first()[0])
    if as_of == "None":  # nothing to forecast
        return hours.withColumn("p", F.lit(None).cast("double"))
    load = F.col("forecast_type") == "load"
    found, names = prediction.trained(mine, SERIES, covariates, algorithm, params, validation_rows, load)
    told = None if weather is None else prediction.weather_known(weather, as_of, ["country_code"], list(covariates))
    return prediction.predicted(mine, found, names, hours, SERIES, as_of, covariates, told, ["country_code"], load)


def forecasts(history: DataFrame, work: DataFrame, runners: dict[str, Runner], as_of: str, version: str | None = None) -> DataFrame:
    """Rows of the forecasts' schema from every runner: history is (country_code, forecast_type, ts, y), and only what is before the end of as_of's day counts."""
    known, hours = prediction.known(history, as_of), wanted(work, as_of)
    each = [_rows(run(known, hours), name, as_of, version) for name, run in (runners or RUNNERS).items()]
    return reduce(DataFrame.unionByName, each)


def _rows(got: DataFrame, name: str, as_of: str, version: str | None) -> DataFrame:
    now = F.lit(as_of).cast("timestamp")
    return got.select(*SERIES, F.lit(None).cast("string").alias("renewable_type"), F.col("ts").alias("target_timestamp_utc"), now.alias("generated_at"), scalars.horizon_hours(F.col("ts"), now).alias("horizon_hours"), F.col("p").alias("forecast_value"), F.lit(name).alias("model_name"), F.lit(version).cast("string").alias("model_version"))


#: Runners that `forecasts` and `run_all` take if they are given none.
RUNNERS: dict[str, Runner] = {"persistence": persistence, "xgboost": boosted, "lightgbm": lambda h, w: boosted(h, w, "lightgbm")}


def run_all(history: DataFrame, work: DataFrame, save: Callable[[DataFrame], object], as_of: str, runners: dict[str, Runner] | None = None, limit: float = LIMIT, version: str | None = None) -> list[tuple[str, str, str | None]]:
    """Each runner on a thread of its own, with `limit` seconds; what it gives is saved. Returns (runner, status, message): completed, failed or timeout.

    A runner fails alone. Its Spark jobs carry a tag, and those of one that is late are interrupted by it; its thread is let go, and what it still gives
    isn't saved. Saving is done one runner after the other, as tables have one writer.
    """
    spark = history.sparkSession
    known, hours = prediction.known(history, as_of), wanted(work, as_of)
    threads: dict[str, tuple[InheritableThread, dict, str]] = {}
    for name, run in (runners or RUNNERS).items():
        tag, out = f"runner-{uuid.uuid4().hex}", {"done": Event()}

        def task(name: str = name, run: Runner = run, tag: str = tag, out: dict = out) -> None:
            spark.sparkContext.addJobTag(tag)
            try:
                out["rows"] = written(_rows(run(known, hours), name, as_of, version), "forecast")
            except Exception as e:  # noqa: BLE001  (a runner fails alone, whatever it raises)
                out["error"] = f"{type(e).__name__}: {e}"[:500]
            finally:
                spark.sparkContext.removeJobTag(tag)
                out["done"].set()

        threads[name] = (InheritableThread(target=task, daemon=True), out, tag)
        threads[name][0].start()
    began, log = time.monotonic(), []
    for name, (_, out, tag) in threads.items():
        if not out["done"].wait(max(0.0, began + limit - time.monotonic())):
            spark.sparkContext.cancelJobsWithTag(tag)
            log.append((name, "timeout", f"no forecasts within {limit:g} seconds"))
        elif "error" in out:
            log.append((name, "failed", out["error"]))
        else:
            try:
                save(out["rows"])
                log.append((name, "completed", None))
            except Exception as e:  # noqa: BLE001
                log.append((name, "failed", f"{type(e).__name__}: {e}"[:500]))
    return log


def train_all(history: DataFrame, work: DataFrame, as_of: str, algorithm: str = "xgboost", params: dict | None = None, covariates: tuple[str, ...] = (), least_rows: int = 1500, validation_rows: int = 720) -> tuple[DataFrame, DataFrame, list[str]]:
    """(report, models, columns) of all series of the work list, trained in one job on what was known: the report has a row for each item, with its status
    (completed, or skipped with a reason), rows, and loss on the validation rows beside persistence's there."""
    items = work.select(*SERIES).distinct()
    known = prediction.known(history, as_of).join(items, SERIES, "left_semi").withColumn("y", F.col("y").cast("double"))
    sizes = known.where("y is not null").groupBy(*SERIES).agg(F.count("*").alias("rows"))
    enough = sizes.where(F.col("rows") >= least_rows)
    mine = known.join(enough.select(*SERIES), SERIES, "left_semi")
    found, names = prediction.trained(mine, SERIES, covariates, algorithm, params, validation_rows, F.col("forecast_type") == "load")
    base = windows.tail_split(joins.offset_lookup(mine, SERIES, 48, "__p"), SERIES, validation_rows).where("is_validation")
    base = base.groupBy(*SERIES).agg(metrics.mae("y", "__p").alias("persistence_mae"))
    report = items.join(sizes, SERIES, "left").join(found.select(*SERIES, "n", "loss", F.size("begin").alias("trees")), SERIES, "left").join(base, SERIES, "left")
    reason = F.when(F.col("rows").isNull(), "no data").when(F.col("rows") < least_rows, "insufficient data").when(F.col("n").isNull(), "no rows left to train on")
    report = report.select(*SERIES, F.when(reason.isNull(), "completed").otherwise("skipped").alias("status"), reason.alias("reason"), F.coalesce("rows", F.lit(0)).alias("rows"), "trees", F.col("loss").alias("mae"), "persistence_mae", metrics.skill(F.col("loss"), F.col("persistence_mae")).alias("skill"))
    return report, found, names


def baselines_all(history: DataFrame, work: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Scores of the baselines (the value 48 hours before, that of the week before, the mean of the same hour) of all series of the work list, over the last
    `days` of what was known; one job."""
    known = prediction.known(history, as_of).join(work.select(*SERIES).distinct(), SERIES, "left_semi").withColumn("y", F.col("y").cast("double"))
    rows = joins.same_hour_mean(joins.offset_lookup(joins.offset_lookup(known, SERIES, 48, "persistence"), SERIES, 168, "seasonal"), SERIES, "weekly")
    return evaluation.baseline_scores(prediction.known(rows, as_of, days), SERIES, ["persistence", "seasonal", "weekly"])
