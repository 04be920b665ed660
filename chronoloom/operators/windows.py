"""Row windows: lags, trailing statistics, tails, epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _w(keys: list[str], ts: str):
    return Window.partitionBy(*keys).orderBy(ts)


def lags(df: DataFrame, keys: list[str], days: list[int], ts: str = "ts", y: str = "y", per_day: int = 24) -> DataFrame:
    """{y}_lag_{d}d: y so many rows earlier; by rows, so a gap shifts it."""
    return df.withColumns({f"{y}_lag_{d}d": F.lag(y, per_day * d).over(_w(keys, ts)) for d in days})


STATS = ("mean", "std", "min", "max")


def _part(centre: str, over) -> Column:
    """Count, mean and sum of squared deviations of __v, as distances from a value that is one of them; and the extremes."""
    d = F.col("__v") - F.col(centre)
    return F.struct(F.count("__v").over(over).alias("n"), F.col(centre).alias("c"), F.avg(d).over(over).alias("m"), (F.var_pop(d).over(over) * F.count("__v").over(over)).alias("s"), F.min("__v").over(over).alias("min"), F.max("__v").over(over).alias("max"))


def _merged(a: Column, b: Column) -> dict[str, Column]:
    """The statistics of two parts together; either may be null or empty."""
    has_a, has_b = F.coalesce(a.n, F.lit(0)) > 0, F.coalesce(b.n, F.lit(0)) > 0
    both, n = has_a & has_b, F.when(has_a, a.n).otherwise(0) + F.when(has_b, b.n).otherwise(0)
    shift = (b.c - a.c) + (b.m - a.m)
    mean = F.when(both, a.c + (a.m + shift * (b.n / n))).when(has_a, a.c + a.m).when(has_b, b.c + b.m)
    squares = F.when(both, a.s + b.s + shift * shift * (a.n * (b.n / n))).when(has_a, a.s).when(has_b, b.s)
    return {"mean": mean, "std": F.when(n > 1, F.sqrt(squares / (n - 1))), "min": F.least(a["min"], b["min"]), "max": F.greatest(a["max"], b["max"])}


def _rolled(df: DataFrame, keys: list[str], widths: list[int], ts: str, y: str, stats: tuple[str, ...], skip: int) -> DataFrame:
    """{y}_roll_{w}h_{stat} over the w rows that end `skip` rows before a row.

    Rows are cut into blocks of w; a window is the end of one block and the beginning of the next, and both are running aggregates, so a row's cost doesn't
    grow with w. Deviations are taken from the block's own first and last values, which belong to what they measure: nothing cancels, however large
    values are beside their spread, and nothing is cut off, however small they are (down to spreads of 1e-150, whose squares a double still holds).
    """
    row = Window.partitionBy(*keys).orderBy("__i")
    out = df.withColumns({"__i": F.row_number().over(_w(keys, ts)) - 1, "__v": F.nanvl(F.col(y).cast("double"), F.lit(None).cast("double"))})
    for w in widths:
        block = [*keys, F.floor(F.col("__i") / w)]
        ahead, back = (Window.partitionBy(*block).orderBy(order).rowsBetween(Window.unboundedPreceding, 0) for order in (F.asc("__i"), F.desc("__i")))
        out = out.withColumn("__f", F.first("__v", ignorenulls=True).over(ahead)).withColumn("__head", _part("__f", ahead)).drop("__f")
        out = out.withColumn("__f", F.first("__v", ignorenulls=True).over(back)).withColumn("__tail", _part("__f", back)).drop("__f")
        one_block = (F.col("__i") - skip) % w == w - 1
        out = out.withColumns({"__a": F.when(~one_block, F.lag("__tail", w - 1 + skip).over(row)), "__b": F.lag("__head", skip).over(row)})
        got = _merged(F.col("__a"), F.col("__b"))
        out = out.withColumns({f"{y}_roll_{w}h_{s}": got[s] for s in stats}).drop("__head", "__tail", "__a", "__b")
    return out.drop("__i", "__v")


def trailing(df: DataFrame, keys: list[str], widths: list[int], ts: str = "ts", y: str = "y", stats: tuple[str, ...] = STATS) -> DataFrame:
    """{y}_roll_{w}h_{stat} over the w rows before a row, itself left out. Nulls and NaN don't count; one value has no deviation."""
    return _rolled(df, keys, widths, ts, y, stats, 1)


def trailing_inclusive(df: DataFrame, keys: list[str], widths: list[int], ts: str = "ts", y: str = "y", stats: tuple[str, ...] = ("mean", "std")) -> DataFrame:
    """Over the w rows up to and with a row; a missing deviation is 0."""
    out = _rolled(df, keys, widths, ts, y, stats, 0)
    return out.fillna(0.0, [f"{y}_roll_{w}h_std" for w in widths]) if "std" in stats else out


def last_per_hour(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """The last row of each hour of day."""
    rows = df.withColumn("hour", F.hour(ts))
    place = Window.partitionBy(*keys, "hour").orderBy(F.desc(ts))
    return rows.withColumn("__n", F.row_number().over(place)).where("__n = 1").drop("__n")


def tail_split(df: DataFrame, keys: list[str], rows: int, ts: str = "ts") -> DataFrame:
    """is_validation: the last `rows` rows of a key, none if it has no more than that."""
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(ts)))
    size = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn("is_validation", (back <= rows) & (size > rows))


def epochs(days: DataFrame, keys: list[str], every: int, least: int, day: str = "day", size: str = "n") -> DataFrame:
    """Eligible days (of `least` rows) with the number of the model that serves them; a new one is trained every `every` of them."""
    return days.where(F.col(size) >= least).withColumn("epoch", F.floor((F.row_number().over(_w(keys, day)) - 1) / every).cast("int"))


def blocks(df: DataFrame, keys: list[str], size: int, ts: str = "ts") -> DataFrame:
    return df.withColumn("block", F.floor((F.row_number().over(_w(keys, ts)) - 1) / size).cast("int"))


def top(df: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of each `by`; Spark drops others before the shuffle."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= most)
