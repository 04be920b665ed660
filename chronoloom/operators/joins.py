"""Joins of time series: offset lookups, same-hour means, alignment by place in the day, latest runs, theta joins with small tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def offset_lookup(df: DataFrame, keys: list[str], hours: int, name: str, ts: str = "ts", y: str = "y") -> DataFrame:
    """y of the same key `hours` earlier by time (not by rows), null where there is no such row."""
    earlier = df.select(*keys, (F.col(ts) + F.expr(f"interval {hours} hours")).alias(ts), F.col(y).alias(name))
    return df.join(earlier, [*keys, ts], "left")


def same_hour_mean(df: DataFrame, keys: list[str], name: str, hours: int = 48, days: int = 7, ts: str = "ts", y: str = "y") -> DataFrame:
    """The mean of y at the same hour of day in the `days` before the forecast is made, `hours` before the row. A range window; no band join."""
    w = Window.partitionBy(*keys, F.hour(ts)).orderBy(F.unix_seconds(F.col(ts))).rangeBetween(-(hours * 3600 + days * 86400), -(hours * 3600 + 1))
    return df.withColumn(name, F.avg(y).over(w))


def seasonal_lookup(df: DataFrame, keys: list[str], hours: int, name: str, ts: str = "ts", y: str = "y", weekday_aligned: bool = False) -> DataFrame:
    """y of a week before, seen from `hours` ahead: 168 - hours before the row, or the same weekday's with weekday_aligned."""
    return offset_lookup(df, keys, 168 if weekday_aligned else 168 - hours, name, ts, y)


def full_fold(frames: list[DataFrame], on: list[str]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, on, "full"), frames)


def lookup_first(left: DataFrame, right: DataFrame, on: list[str], order: list[Column], default: float = 0.0) -> DataFrame:
    """Left join with the first row of each key on the right; nulls of its numbers become `default`."""
    place = Window.partitionBy(*on).orderBy(*order)
    first = right.withColumn("__n", F.row_number().over(place)).where("__n = 1").drop("__n")
    return left.join(first, on, "left").fillna(default, [c for c in right.columns if c not in on])


def latest_run(df: DataFrame, keys: list[str], run: str) -> DataFrame:
    """The rows of each key's latest run. One pass: the maximum comes along in a window."""
    return df.withColumn("__run", F.max(run).over(Window.partitionBy(*keys))).where(F.col(run) == F.col("__run")).drop("__run")


def latest_by(df: DataFrame, keys: list[str], run: str, columns: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), run).alias("__x")).select(*keys, "__x.*")


def with_fallback(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of `first`; those of `second` for keys of which `first` has none at all."""
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti"))


def by_ordinal(df: DataFrame, keys: list[str], days: int, least: int = 20, ts: str = "ts", y: str = "y") -> DataFrame:
    """Rows beside the row with the same place in the day `days` before; both days need `least` rows."""
    day = [*keys, "day"]
    rows = df.select(*keys, F.to_date(ts).alias("day"), ts, y)
    rows = rows.withColumns({"place": F.row_number().over(Window.partitionBy(*day).orderBy(ts)), "size": F.count("*").over(Window.partitionBy(*day))}).where(F.col("size") >= least).drop("size")
    before = rows.select(*keys, F.date_add("day", days).alias("day"), "place", F.col(y).alias("p"))
    return rows.join(before, [*day, "place"])


def pairs_of_models(df: DataFrame, model: str, on: list[str], least_days: int, day: str = "day", loss: str = "loss") -> DataFrame:
    """Losses of each pair of models on the rows both have, for pairs with `least_days` common days."""
    a = df.select(*on, day, F.col(model).alias("a"), F.col(loss).alias("loss_a"))
    b = df.select(*on, day, F.col(model).alias("b"), F.col(loss).alias("loss_b"))
    both = a.join(b, [*on, day]).where("a < b")
    enough = both.groupBy("a", "b").agg(F.count_distinct(day).alias("days")).where(F.col("days") >= least_days)
    return both.join(F.broadcast(enough.select("a", "b")), ["a", "b"], "left_semi")  # as many rows as pairs of models


def applicable(work: DataFrame, runners: DataFrame) -> DataFrame:
    """Work items with each enabled runner whose lists hold their country and type, or say `all`. Both are small configured tables."""
    fits = [F.array_contains(f"{c}s", "all") | F.expr(f"array_contains({c}s, {c})") for c in ("country", "type")]
    return work.crossJoin(runners.where("enabled")).where(fits[0] & fits[1])


def skipped(work: DataFrame, skip: DataFrame, on: list[str]) -> DataFrame:
    return work.join(skip, on, "left_anti")


def raw_and_corrected(tso: DataFrame, corrections: DataFrame, on: list[str]) -> DataFrame:
    """Two rows a forecast: as it came, and corrected (clipped at 0) where there is a correction."""
    both = tso.join(corrections, on, "left")
    rows = F.array(F.struct(F.lit("tso_raw").alias("model"), F.col("tso").alias("value")), F.struct(F.lit("tso_corrected").alias("model"), F.greatest(F.lit(0.0), F.col("tso") + F.col("error")).alias("value")))
    return both.select(*on, F.col("error").isNotNull().alias("__has"), F.explode(rows).alias("r")).where("__has or r.model = 'tso_raw'").select(*on, "r.model", "r.value")
