"""Shaping of time series: resampling, deduplication, regular spines and fills. `keys` names the series; all series are worked on at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def exact_mean(y: Column, scale: int = 2) -> Column:
    """The mean of numbers with `scale` decimals, free of rounding in the sum, so that it doesn't depend on how rows are dealt."""
    return F.sum(y.cast(f"decimal(18,{scale})")).cast("double") / F.count(y)


def resample(df: DataFrame, keys: list[str], ts: str = "ts", y: str = "y", unit: str = "hour", mean=F.avg) -> DataFrame:
    """The mean of y for each key and hour (or other unit); hours without a value aren't there."""
    out = df.groupBy(*keys, F.date_trunc(unit, ts).alias(ts)).agg(F.when(F.count(y) > 0, mean(F.col(y))).alias(y))
    return out.where(F.col(y).isNotNull())


def keep_last(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """One row for each `by`: the last in `order`, which must end in something unique."""
    place = Window.partitionBy(*by).orderBy(*[c.desc() for c in order])
    return df.withColumn("__n", F.row_number().over(place)).where("__n = 1").drop("__n")


def spine(df: DataFrame, keys: list[str], ts: str = "ts", step: str = "1 hour") -> DataFrame:
    """Every step from a key's first to its last timestamp."""
    ends = df.groupBy(*keys).agg(F.min(ts).alias("a"), F.max(ts).alias("z"))
    return ends.select(*keys, F.explode(F.sequence("a", "z", F.expr(f"interval {step}"))).alias(ts))


def regular(df: DataFrame, keys: list[str], ts: str = "ts", step: str = "1 hour") -> DataFrame:
    """The series on its spine, null where there was no row."""
    return spine(df, keys, ts, step).join(df, [*keys, ts], "left")


def _before(keys: list[str], ts: str):
    return Window.partitionBy(*keys).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)


def _after(keys: list[str], ts: str):
    return Window.partitionBy(*keys).orderBy(ts).rowsBetween(0, Window.unboundedFollowing)


def forward_fill(df: DataFrame, keys: list[str], columns: list[str], ts: str = "ts", default: float | None = None) -> DataFrame:
    filled = {c: F.last(c, ignorenulls=True).over(_before(keys, ts)) for c in columns}
    return df.withColumns(filled if default is None else {c: F.coalesce(x, F.lit(default)) for c, x in filled.items()})


def fill_both(df: DataFrame, keys: list[str], columns: list[str], ts: str = "ts") -> DataFrame:
    """Forward fill, and backward for what is before the first value."""
    return df.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(_before(keys, ts)), F.first(c, ignorenulls=True).over(_after(keys, ts))) for c in columns})


def interpolate(df: DataFrame, keys: list[str], column: str, ts: str = "ts") -> DataFrame:
    """Linear by row position; what is before the first value stays null, what is after the last takes it."""
    row = F.row_number().over(Window.partitionBy(*keys).orderBy(ts))
    known = F.struct(F.col("__i").alias("i"), F.col(column).alias("v"))
    here = F.when(F.col(column).isNotNull(), known)
    df = df.withColumn("__i", row)
    df = df.withColumns({"__p": F.last(here, ignorenulls=True).over(_before(keys, ts)), "__n": F.first(here, ignorenulls=True).over(_after(keys, ts))})
    p, n = F.col("__p"), F.col("__n")
    between = p.v + (n.v - p.v) * (F.col("__i") - p.i) / F.when(n.i > p.i, n.i - p.i)
    value = F.coalesce(F.col(column), between, p.v)
    return df.withColumn(column, F.when(p.isNotNull(), value)).drop("__i", "__p", "__n")


def typed_fill(df: DataFrame, keys: list[str], zero: list[str], fill: list[str], ts: str = "ts") -> DataFrame:
    """Columns that are zero where nothing was measured (radiation at night), and others filled from their neighbours."""
    return fill_both(df.fillna(0.0, zero), keys, fill, ts)


def future_rows(df: DataFrame, keys: list[str], columns: list[str], start: Column, hours: int = 24, ts: str = "ts") -> DataFrame:
    """`hours` rows a key from `start`: the rows there are, and for missing hours each column's last known value before."""
    wanted = df.select(*keys).distinct().select(*keys, F.explode(F.sequence(start, start + F.expr(f"interval {hours - 1} hours"), F.expr("interval 1 hour"))).alias(ts))
    known = df.where(F.col(ts) >= start).join(wanted, [*keys, ts], "left_semi").select(*keys, ts, *columns)
    last = df.where(F.col(ts) < start).groupBy(*keys).agg(*[F.max_by(c, ts).alias(c) for c in columns])
    missing = wanted.join(known, [*keys, ts], "left_anti").join(last, keys, "left").select(*keys, ts, *columns)
    return known.withColumn("synthetic", F.lit(0)).unionByName(missing.withColumn("synthetic", F.lit(1)))


def with_targets(history: DataFrame, targets: DataFrame, placeholder: dict[str, float]) -> DataFrame:
    """History and rows to forecast in one frame, the latter with placeholders, so that features of both come from one pass."""
    return history.unionByName(targets.withColumns({c: F.lit(v) for c, v in placeholder.items()}), allowMissingColumns=True)
