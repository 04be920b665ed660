"""Walk-forward validation: forecasts of each fold's test span judged by fold and over all folds, for all series at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import metrics
from . import boosting, crossval, evaluation, windows


def tested(df: DataFrame, folds: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """The rows of all test spans, with their fold; for forecasts that need no training."""
    return crossval.in_folds(df, folds, keys, ts).where("role = 'test'").drop("role")


def trained(df: DataFrame, folds: DataFrame, keys: list[str], make: Callable[[], object], ts: str = "ts") -> DataFrame:
    """The rows of all test spans with a forecast `p` of a model trained on the fold's train span of the same series. `make` gives a model with `fit` and
    `predict`. Series and folds are few (a model each); their rows stay distributed. A fold without train or test rows is left out."""
    rows = crossval.in_folds(df, folds, keys, ts).cache()
    out = None
    for fold in rows.select(*keys, "fold").where("role = 'train'").distinct().intersect(rows.where("role = 'test'").select(*keys, "fold")).orderBy(*keys, "fold").collect():
        part = rows.where("fold = " + str(fold.fold))
        for k in keys:
            part = part.where(F.col(k) == fold[k])
        got = make().fit(part.where("role = 'train'"), ts).predict(part.where("role = 'test'")).drop("role")
        out = got if out is None else out.unionByName(got)
    return out if out is not None else rows.where("false").drop("role").withColumn("p", F.lit(None).cast("double"))


def _skill(base: str, y: str, p: str):
    has = F.col(base).isNotNull()
    return metrics.skill(metrics.mean(F.when(has, F.abs(F.col(p) - F.col(y)))), metrics.mean(F.abs(F.col(base) - F.col(y))))


def by_fold(rows: DataFrame, keys: list[str], base: str, y: str = "y", p: str = "p") -> DataFrame:
    """Metrics of each fold and the skill against `base` over the rows that have it."""
    return rows.groupBy(*keys, "fold").agg(*[c.alias(n) for n, c in metrics.bundle(y, p).items()], _skill(base, y, p).alias("skill"))


def summary(rows: DataFrame, keys: list[str], base: str, y: str = "y", p: str = "p") -> DataFrame:
    """Metrics over all test rows (a boundary row counts in both of its folds), the number of folds, and the mean of their skills that exist."""
    total = rows.groupBy(*keys).agg(*[c.alias(n) for n, c in metrics.bundle(y, p).items()])
    each = by_fold(rows, keys, base, y, p).groupBy(*keys).agg(F.count("*").alias("folds"), F.avg("skill").alias("mean_skill"))
    return total.join(each, keys)


def trained_all(df: DataFrame, folds: DataFrame, keys: list[str], features: list[str], params: dict | None = None, algorithm: str = "xgboost", ts: str = "ts") -> DataFrame:
    """As `trained`, with a boosted model for each series and fold, all of them trained in one job."""
    return boosting.out_of_fold(crossval.in_folds(df, folds, keys, ts), keys, features, trials=[params or {}], algorithm=algorithm, ts=ts).drop("role", "trial")


def retraining_days(df: DataFrame, keys: list[str], start: str, every: int = 30, least_day: int = 20, least_train: int = 3600, least_usable: int = 500, usable: str | None = None, ts: str = "ts") -> DataFrame:
    """(keys, day, n_test, n_train, epoch, until): the days from `start` on that have `least_day` rows and, before them, `least_train` rows, `least_usable` of
    them with a value in the column `usable`. Every `every` such days a new model is due: `epoch` numbers them, and each learns from all that is before
    `until`, its first day."""
    day = F.to_date(ts)
    daily = df.groupBy(*keys, day.alias("day")).agg(F.count("*").alias("n_test"), F.count(usable or "*").alias("__u"))
    before = Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    daily = daily.withColumns({"n_train": F.coalesce(F.sum("n_test").over(before), F.lit(0)), "__u": F.coalesce(F.sum("__u").over(before), F.lit(0))})
    due = daily.where((F.col("day") >= F.to_date(F.lit(start))) & (F.col("n_train") >= least_train) & (F.col("__u") >= least_usable)).drop("__u")
    due = windows.epochs(due, keys, every, least_day, size="n_test")
    return due.withColumn("until", F.min("day").over(Window.partitionBy(*keys, "epoch")))


def retrained(df: DataFrame, days: DataFrame, keys: list[str], features: list[str], target: str = "y", params: dict | None = None, algorithm: str = "lightgbm", ts: str = "ts") -> DataFrame:
    """The rows of all `days` with their day, epoch and the forecast `p` of their epoch's model. All models of all series are trained in one job, each on the
    prefix of its series, and all days are scored in one pass."""
    epochs = days.select(*keys, "epoch", "until").distinct()
    prefix = df.join(epochs, keys).where(F.col(ts) < F.col("until").cast("timestamp")).drop("until")
    models = boosting.fit_all(prefix, [*keys, "epoch"], features, target, trials=[params or {}], algorithm=algorithm, ts=ts)
    rows = df.withColumn("day", F.to_date(ts)).join(days.select(*keys, "day", "epoch"), [*keys, "day"])
    return boosting.predict_all(rows, models, [*keys, "epoch"], features).drop("trial")


def correction_backtest(df: DataFrame, days: DataFrame, keys: list[str], features: list[str], y: str = "y", tso: str = "tso", error: str = "err", params: dict | None = None, algorithm: str = "lightgbm", ts: str = "ts") -> DataFrame:
    """Scores by (keys, model, day), and with a null day over all: the external forecast as it came (`tso_raw`), and with the error that each day's model
    foresees put on it, 0 at least (`tso_corrected`). Both over the rows that have a model."""
    rows = retrained(df, days, keys, features, error, params, algorithm, ts).where("p is not null")
    raw, fixed = F.col(tso).cast("double"), F.greatest(F.lit(0.0), F.col(tso) + F.col("p"))
    both = F.explode(F.array(F.struct(F.lit("tso_raw").alias("model"), raw.alias("value")), F.struct(F.lit("tso_corrected").alias("model"), fixed.alias("value")))).alias("m")
    rows = rows.select(*keys, "day", F.col(y).alias("y"), both).select(*keys, "day", "y", "m.model", F.col("m.value").alias("p"))
    return evaluation.daily_and_total(rows, [*keys, "model"])
