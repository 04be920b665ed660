"""Temporal cross-validation: which rows train and test in which fold. Folds are small tables that rows are joined to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def walk_forward_folds(df: DataFrame, keys: list[str], folds: int = 6, test_days: int = 30, gap_days: int = 2, least_days: int = 180, ts: str = "ts") -> DataFrame:
    """(keys, fold, train_start, train_end, test_start, test_end), from the last timestamp backwards; keys with too short a history have none.

    Test spans hold both of their ends, so a boundary row is tested in two folds; train spans leave out their end.
    """
    ends = df.groupBy(*keys).agg(F.min(ts).alias("a"), F.max(ts).alias("z"))
    days = F.floor((F.unix_seconds("z") - F.unix_seconds("a")) / 86400)
    ends = ends.where(days - folds * test_days >= least_days)
    back = ends.select(*keys, "a", "z", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("__back"))
    day = lambda n: F.make_dt_interval(days=n)
    back = back.withColumn("test_end", F.col("z") - day(F.col("__back") * test_days)).withColumn("test_start", F.col("test_end") - day(F.lit(test_days)))
    return back.select(*keys, (folds - F.col("__back")).cast("int").alias("fold"), F.col("a").alias("train_start"), (F.col("test_start") - day(F.lit(gap_days))).alias("train_end"), "test_start", "test_end")


def in_folds(df: DataFrame, folds: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Rows with the folds that use them, and as what. The folds of a key are few; the join is by key."""
    role = F.when(F.col(ts).between(F.col("test_start"), F.col("test_end")), "test").when((F.col(ts) >= F.col("train_start")) & (F.col(ts) < F.col("train_end")), "train")
    return df.join(folds, keys).withColumn("role", role).where(F.col("role").isNotNull()).drop("train_start", "train_end", "test_start", "test_end")


def time_series_split(df: DataFrame, keys: list[str], k: int = 5, ts: str = "ts") -> DataFrame:
    """Rows with fold (1 to k) and role: each fold tests n // (k + 1) rows and trains on all before them."""
    rows = df.withColumns({"__i": F.row_number().over(Window.partitionBy(*keys).orderBy(ts)) - 1, "__n": F.count("*").over(Window.partitionBy(*keys))})
    rows = rows.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(k))))
    size = F.floor(F.col("__n") / (k + 1)).cast("int")
    first = F.col("__n") - (k - F.col("fold") + 1) * size
    role = F.when(F.col("__i") < first, "train").when(F.col("__i") < first + size, "test")
    return rows.withColumn("role", role).where(F.col("role").isNotNull()).drop("__i", "__n")


def backtest_days(df: DataFrame, keys: list[str], step: int, horizon: int, window: int | None, least_train: int, least_test: int, ts: str = "ts") -> DataFrame:
    """(keys, day, target, n_train, n_test): forecast days every `step` days, the day they forecast, and their rows; train rows are all before the day, or
    those of the `window` days before it. Counts come from running sums over days, so rows and days are never crossed."""
    daily = df.groupBy(*keys, F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))
    ends = daily.groupBy(*keys).agg(F.min("day").alias("a"), F.max("day").alias("z"))
    every = ends.select(*keys, "a", F.explode(F.sequence("a", "z", F.expr("interval 1 day"))).alias("day"))
    full = every.join(daily, [*keys, "day"], "left").fillna(0, ["n"])
    w = Window.partitionBy(*keys).orderBy("day")
    before = w.rowsBetween(Window.unboundedPreceding if window is None else -window, -1)
    full = full.withColumns({"n_train": F.coalesce(F.sum("n").over(before), F.lit(0)), "n_test": F.lead("n", horizon).over(w), "target": F.date_add("day", horizon)})
    on = F.pmod(F.date_diff("day", "a"), F.lit(step)) == 0
    return full.where(on & (F.col("n_train") >= least_train) & (F.col("n_test") >= least_test)).select(*keys, "day", "target", "n_train", "n_test")


def tail_folds(df: DataFrame, keys: list[str], size: int, folds: int, ts: str = "ts") -> DataFrame:
    """Rows with fold and role: fold f tests the f-th last `size` rows and trains on all before."""
    rows = df.withColumn("__b", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(ts))) - 1)
    rows = rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    role = F.when(F.col("__b") >= (F.col("fold") + 1) * size, "train").when(F.col("__b") >= F.col("fold") * size, "test")
    return rows.withColumn("role", role).where(F.col("role").isNotNull()).drop("__b")
