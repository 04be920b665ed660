"""Evaluation of forecasts: scoreboards, breakdowns, scaled and directional errors, quantile scores and the Diebold-Mariano test."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from ..functions import metrics, scalars


def _agg(named: dict[str, Column]) -> list[Column]:
    return [c.alias(n) for n, c in named.items()]


def scores(df: DataFrame, by: list[str], y: str = "y", p: str = "p", floor: float | Column = 1.0) -> DataFrame:
    return df.groupBy(*by).agg(*_agg(metrics.bundle(y, p, floor)))


def daily_and_total(df: DataFrame, by: list[str], day: str = "day", y: str = "y", p: str = "p") -> DataFrame:
    """Scores for each day, and with a null day over all, in one pass."""
    sets = [[*by, day], by]
    return df.groupingSets(sets, *by, day).agg(*_agg(metrics.bundle(y, p)))


def baseline_scores(df: DataFrame, by: list[str], baselines: list[str], y: str = "y") -> DataFrame:
    """Scores of several forecast columns, each over the rows that have it."""
    rows = df.unpivot([*by, y], baselines, "baseline", "p").where(F.col("p").isNotNull())
    return rows.groupBy(*by, "baseline").agg(*_agg(metrics.bundle(y, "p")))


def hourly(df: DataFrame, by: list[str], ts: str = "ts", y: str = "y", p: str = "p") -> DataFrame:
    return df.groupBy(*by, F.hour(ts).alias("hour")).agg(*_agg(metrics.bundle(y, p)), metrics.mean(y).alias("mean_actual"), metrics.mean(p).alias("mean_pred"))


def seasonal(df: DataFrame, by: list[str], base: str, ts: str = "ts", y: str = "y", p: str = "p") -> DataFrame:
    """By season, with the skill over the rows that have a baseline."""
    has = F.col(base).isNotNull()
    model, other = metrics.mean(F.when(has, F.abs(F.col(p) - F.col(y)))), metrics.mean(F.when(has, F.abs(F.col(base) - F.col(y))))
    return df.groupBy(*by, scalars.season(ts).alias("season")).agg(metrics.mae(y, p).alias("mae"), metrics.rmse(y, p).alias("rmse"), F.count("*").alias("n"), metrics.skill(model, other).alias("skill"))


def error_distribution(df: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    return df.groupBy(*by).agg(*_agg(metrics.distribution(metrics.error(y, p))))


#: The size of a quantile sketch, and the error of its ranks: in 99 of 100 cases a quantile's true rank is off by less.
SKETCH, RANK_ERROR = 800, 0.005


def error_sketches(df: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """(by, n, sketch): a quantile sketch of each group's errors, some kilobytes whatever the number of rows. Sketches of days add up to that of a year."""
    e = metrics.number(metrics.error(y, p))
    return df.where(e.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(e, SKETCH).alias("sketch"))


def error_quantiles(sketches: DataFrame, by: list[str], at: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """(by, n, q, value) of sketches of parts, put together; see RANK_ERROR. The exact percentiles of `error_distribution` need all values of a group in one task."""
    whole = sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", SKETCH).alias("__s"))
    return whole.select(*by, "n", F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.kll_sketch_get_quantile_double("__s", F.lit(q)).alias("value")) for q in at])).alias("__q")).select(*by, "n", "__q.*")


def scaled_error(df: DataFrame, by: list[str], lag: int = 24, ts: str = "ts", y: str = "y", p: str = "p") -> DataFrame:
    """mase: the mean absolute error in units of the seasonal naive one; null if there are too few rows, or that is 0."""
    rows = df.withColumn("naive", F.abs(F.col(y) - F.lag(y, lag).over(Window.partitionBy(*by).orderBy(ts))))
    return rows.groupBy(*by).agg(F.try_divide(metrics.mae(y, p), metrics.mean("naive")).alias("mase"))


def directional(df: DataFrame, by: list[str], ts: str = "ts", y: str = "y", p: str = "p") -> DataFrame:
    """Percent of steps where truth and forecast move the same way."""
    w = Window.partitionBy(*by).orderBy(ts)
    step = lambda c: F.signum(F.col(c) - F.lag(c).over(w))
    rows = df.select(*by, (step(y) == step(p)).cast("double").alias("same"))
    return rows.groupBy(*by).agg((F.avg("same") * 100).alias("directional"))


def crps(df: DataFrame, by: list[str], row: list[str], q: str = "q", pred: str = "pred", y: str = "y") -> DataFrame:
    """Of quantile forecasts in long form: the integral over q of squared hits, by trapezoids, and its mean over rows."""
    w = Window.partitionBy(*by, *row).orderBy(q)
    hit = (F.col(q) - (F.col(y) <= F.col(pred)).cast("double")) ** 2
    steps = df.withColumn("__h", hit).withColumns({"__q": F.lead(q).over(w), "__n": F.lead("__h").over(w)})
    each = steps.groupBy(*by, *row).agg(F.sum((F.col("__q") - F.col(q)) / 2 * (F.col("__h") + F.col("__n"))).alias("crps"))
    return each.groupBy(*by).agg(metrics.mean("crps").alias("crps"))


def dm_statistic(df: DataFrame, by: list[str], horizon: int = 1, ts: str = "ts", a: str = "loss_a", b: str = "loss_b") -> DataFrame:
    """Diebold-Mariano: mean loss difference, its variance from the first `horizon` autocovariances, unweighted, and the statistic (0 for no variance)."""
    rows = df.withColumn("d", F.col(a) - F.col(b)).withColumn("m", F.avg("d").over(Window.partitionBy(*by)))
    c = F.col("d") - F.col("m")
    w = Window.partitionBy(*by).orderBy(ts)
    rows = rows.withColumns({f"g{k}": c * (F.lag("d", k).over(w) - F.col("m")) if k else c * c for k in range(horizon)})
    total = sum([2 * F.avg(f"g{k}") for k in range(1, horizon)], F.avg("g0"))
    out = rows.groupBy(*by).agg(F.count("d").alias("n"), F.avg("d").alias("mean_diff"), total.alias("__v"))
    out = out.withColumn("var", F.col("__v") / F.col("n"))
    return out.select(*by, "n", "mean_diff", F.when(F.col("var") > 0, F.col("mean_diff") / F.sqrt("var")).otherwise(0.0).alias("statistic"), (F.col("var") > 0).alias("conclusive"))


def _beta_part(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return min(1.0, max(0.0, x))
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_part(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    f = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or 1e-30)
            c = 1 + top / c or 1e-30
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f


@F.pandas_udf(DoubleType())
def two_sided_t(statistic: pd.Series, freedom: pd.Series) -> pd.Series:
    """P value of a t statistic; for the few rows of a grouped result."""
    return pd.Series([None if pd.isna(t) or v < 1 else _beta_part(v / 2, 0.5, v / (v + t * t)) for t, v in zip(statistic, freedom, strict=True)], dtype="float64")


def dm_test(df: DataFrame, by: list[str], horizon: int = 1, ts: str = "ts", a: str = "loss_a", b: str = "loss_b") -> DataFrame:
    """The statistic with its two-sided p value on n - 1 degrees of freedom, stars, and which side is better."""
    out = dm_statistic(df, by, horizon, ts, a, b)
    p = F.when(F.col("conclusive"), two_sided_t("statistic", (F.col("n") - 1).cast("double"))).otherwise(1.0)
    out = out.withColumn("p_value", p).withColumn("stars", scalars.stars(F.col("p_value")))
    better = F.when(F.col("p_value") >= 0.05, "no difference").when(F.col("statistic") < 0, "first").otherwise("second")
    return out.withColumn("better", F.when(F.col("conclusive"), better).otherwise("inconclusive"))


def report(df: DataFrame, by: list[str], ts: str = "ts", y: str = "y", p: str = "p") -> DataFrame:
    """One row for each group with its scores, error distribution and hourly breakdown nested, as JSON on demand."""
    parts = scores(df, by, y, p).select(*by, F.struct("mae", "rmse", "mape", "smape", "bias", "n").alias("overall"))
    d = error_distribution(df, by, y, p)
    spread = d.select(*by, F.struct(*[c for c in d.columns if c not in by]).alias("errors"))
    h = hourly(df, by, ts, y, p)
    hours = h.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("hour", "mae", "rmse", "n"))).alias("hours"))
    out = parts.join(spread, by).join(hours, by)
    return out.withColumn("json", F.to_json(F.struct("overall", "errors", "hours")))
