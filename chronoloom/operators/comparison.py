"""Which of two sets of features is better: paired losses on the same out-of-fold rows, and how sure their difference is."""

from __future__ import annotations

from math import exp, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics
from . import boosting

#: The distribution function of a Poisson variable of mean 1; beyond the last step lie one in 10^10.
STEPS = [sum(exp(-1) / factorial(k) for k in range(n + 1)) for n in range(13)]


def weight(*parts: Column) -> Column:
    """A Poisson draw of mean 1 that belongs to the given values: the same on any machine, in any order."""
    u = F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return sum((F.when(u >= s, 1).otherwise(0) for s in STEPS), F.lit(0))


def interval(df: DataFrame, by: list[str], block: str, value: str = "d", draws: int = 200, level: float = 0.95) -> DataFrame:
    """(by, n, blocks, mean, low, high): the mean of `value` and its bootstrap interval. Whole blocks (days, say) are drawn, as neighbouring hours err alike.

    Each draw gives each block a Poisson weight, which is what drawing blocks with replacement comes to when there are many. Blocks are added up first, so
    the draws multiply blocks and not rows."""
    sums = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(block).alias("__b")).agg(F.sum(value).alias("__s"), F.count(value).alias("__n"))
    drawn = sums.withColumn("__draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("__w", weight(F.col("__b"), F.col("__draw")))
    means = drawn.groupBy(*by, "__draw").agg(F.try_divide(F.sum(F.col("__w") * F.col("__s")), F.sum(F.col("__w") * F.col("__n"))).alias("__m"))
    side = (1 - level) / 2
    ends = means.groupBy(*by).agg(F.percentile("__m", F.lit(side)).alias("low"), F.percentile("__m", F.lit(1 - side)).alias("high"))
    whole = sums.groupBy(*by).agg(F.sum("__n").alias("n"), F.count("*").alias("blocks"), (F.sum("__s") / F.sum("__n")).alias("mean"))
    return whole.join(ends, by) if by else whole.crossJoin(ends)


def paired(rows: DataFrame, by: list[str], a: str, b: str, block: str, y: str = "y", draws: int = 200, level: float = 0.95) -> DataFrame:
    """(by, n, blocks, mae_a, mae_b, change_pct, mean, low, high, better): two forecasts on the rows that have both. mean is the loss of b less that of a;
    b is better where the interval lies below 0, a where it lies above."""
    rows = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(y).isNotNull())
    losses = rows.withColumns({"__a": F.abs(F.col(a) - F.col(y)), "__d": F.abs(F.col(b) - F.col(y)) - F.abs(F.col(a) - F.col(y))})
    means = losses.groupBy(*by).agg(metrics.mean("__a").alias("mae_a"))
    out = interval(losses, by, block, "__d", draws, level).join(means, by)
    out = out.withColumn("mae_b", F.col("mae_a") + F.col("mean")).withColumn("change_pct", F.try_divide("mean", "mae_a") * 100)
    return out.select(*by, "n", "blocks", "mae_a", "mae_b", "change_pct", "mean", "low", "high", F.when(F.col("high") < 0, "b").when(F.col("low") > 0, "a").otherwise("neither").alias("better"))


def feature_sets(rows: DataFrame, keys: list[str], a: list[str], b: list[str], y: str = "y", params: dict | None = None, algorithm: str = "lightgbm", block: Column | None = None, ts: str = "ts", draws: int = 200) -> DataFrame:
    """`paired` for models on two sets of columns. `rows` have fold and role: membership is given once, so both sets are trained and judged on the same
    rows; the models of all series, folds and sets are trained in one job."""
    got = boosting.out_of_fold(rows, keys, [a, b], y, [params or {}] * 2, algorithm, ts)
    side = lambda k: F.max(F.when(F.col("trial") == k, F.col("p")))
    both = got.groupBy(*keys, "fold", F.col(ts).alias("ts"), F.col(y).alias("y")).agg(side(0).alias("a"), side(1).alias("b"))
    both = both.withColumn("block", block if block is not None else F.to_date("ts"))
    return paired(both, keys, "a", "b", "block", "y", draws)
