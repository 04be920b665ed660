"""The control plane: versioned tables, deployments, promotion, run logs, health. `as_of` is always an argument; nothing reads the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars

FORECAST_KEY = ["country_code", "forecast_type", "target_timestamp_utc", "horizon_hours", "model_name", "generated_at"]


def upsert(table: DataFrame, rows: DataFrame, key: list[str], order: list[str] = ()) -> DataFrame:
    """The table with `rows` put in by key: new rows win over old ones, among themselves the last in `order`."""
    both = table.withColumn("__new", F.lit(0)).unionByName(rows.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    place = Window.partitionBy(*key).orderBy(F.desc("__new"), *[F.desc(c) for c in order])
    return both.withColumn("__n", F.row_number().over(place)).where("__n = 1").drop("__n", "__new")


def not_all_zero(rows: DataFrame, by: list[str], value: str, guarded: Column) -> DataFrame:
    """Rows without the guarded groups in which every value is zero or null."""
    alive = F.max(F.coalesce(F.abs(value), F.lit(0.0))).over(Window.partitionBy(*by)) > 0
    return rows.withColumn("__ok", alive).where(F.col("__ok") | ~guarded).drop("__ok")


def deploy(table: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """A new active version for each key in `new` (key, version, at): the one before becomes inactive and is remembered."""
    active = table.where("status = 'active'").groupBy(*key).agg(F.max_by("version", "at").alias("previous_version"))
    old = table.join(new.select(*key).distinct().withColumn("__k", F.lit(True)), key, "left")
    old = old.withColumn("status", F.when(F.col("__k") & (F.col("status") == "active"), "inactive").otherwise(F.col("status"))).drop("__k")
    rows = new.join(active, key, "left").withColumn("status", F.lit("active"))
    return old.unionByName(rows, allowMissingColumns=True)


def rollback(table: DataFrame, key: list[str]) -> DataFrame:
    """For each key the active version becomes rolled_back, and all inactive rows of its previous version become active; keys without one stay as they are."""
    back = table.where("status = 'active' and previous_version is not null").select(*key, F.col("previous_version").alias("__p")).distinct()
    rows = table.join(back, key, "left")
    status = F.when(F.col("__p").isNull(), F.col("status")).when(F.col("status") == "active", "rolled_back").when((F.col("status") == "inactive") & (F.col("version") == F.col("__p")), "active").otherwise(F.col("status"))
    return rows.withColumn("status", status).drop("__p")


def state(events: DataFrame, key: list[str], order: str, columns: list[str]) -> DataFrame:
    """The latest state of each run from its log of events; a null in a later event doesn't hide an earlier value."""
    filled = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns]
    return events.groupBy(*key).agg(*filled)


def keep_newest(versions: DataFrame, key: list[str], version: str, most: int = 5) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(version)))
    return versions.withColumn("place", place).where(F.col("place") <= most)


def compare(evaluations: DataFrame, key: list[str], measures: list[str], location: str = "location") -> DataFrame:
    """Candidate beside production for each key, with differences; a measure missing or 0 counts as 0."""
    side = lambda name: evaluations.where(F.col(location) == name).select(*key, *[F.col(m).alias(f"{name}_{m}") for m in measures])
    both = side("candidate").join(side("production"), key, "left")
    return both.withColumns({f"{m}_diff": scalars.or_default(F.col(f"candidate_{m}"), 0.0) - scalars.or_default(F.col(f"production_{m}"), 0.0) for m in measures})


def promote(both: DataFrame, key: list[str], least: float = 0.0, least_gain: float = 0.0) -> DataFrame:
    """(key, promoted, reason) from candidate_skill and production_skill: the candidate's must be over `least`; without production it goes first, else it
    must gain more than `least_gain`."""
    c, p = F.coalesce("candidate_skill", F.lit(0.0)), F.col("production_skill")
    reason = F.when(c <= least, "below_minimum").when(p.isNull(), "first_deployment").when(c - p > least_gain, "improved").otherwise("not_better")
    out = both.withColumn("reason", reason)
    return out.select(*key, F.col("reason").isin("first_deployment", "improved").alias("promoted"), "reason")


def candidates(both: DataFrame, key: list[str]) -> DataFrame:
    """Keys whose candidate has skill, with the gain in percent of production's, and the rank by gain, or skill where there is none."""
    p = F.nullif("production_skill", F.lit(0.0))
    out = both.where("candidate_skill > 0").withColumn("improvement", F.try_divide(F.col("candidate_skill") - p, F.abs(p)) * 100)
    by = F.coalesce(F.nullif("improvement", F.lit(0.0)), F.nullif("candidate_skill", F.lit(0.0)), F.lit(0.0))
    return out.withColumn("order_value", by)


def health(checks: DataFrame) -> DataFrame:
    """The overall status of (check, status) rows: the worst counts, checks of the database don't."""
    rank = F.when(F.col("status") == "critical", 2).when(F.col("status") == "warning", 1).otherwise(0)
    worst = F.max(F.when(F.col("check") != "database", rank))
    code = F.coalesce(worst, F.lit(0))
    return checks.agg(F.element_at(F.array(F.lit("healthy"), F.lit("warning"), F.lit("critical")), code + 1).alias("overall"), code.alias("exit_code"), F.count("*").alias("checks"))


def locations(registry: DataFrame, key: list[str]) -> DataFrame:
    """Where each key's models are, and how many versions are kept."""
    return registry.groupBy(*key).agg(F.sort_array(F.collect_set("location")).alias("locations"), F.count(F.when(F.col("location") == "history", 1)).alias("history_count"))


def load_version(registry: DataFrame, key: list[str]) -> DataFrame:
    """The row to load for each key: production, else legacy."""
    order = F.when(F.col("location") == "production", 0).when(F.col("location") == "legacy", 1)
    rows = registry.withColumn("__o", order).where("__o is not null")
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy("__o", F.desc("version")))).where("__n = 1").drop("__n", "__o")


def coverage(forecasts: DataFrame, by: list[str], expected: int) -> DataFrame:
    return forecasts.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.count("*") * 100.0 / expected, 1).alias("coverage_pct"))


def comma_joined(column: str) -> Column:
    """A group's distinct values as one text, in order; null for a group without any."""
    return F.array_join(F.sort_array(F.collect_set(column)), ",")


def comma_split(df: DataFrame, column: str, name: str) -> DataFrame:
    """A row for each item of a comma-joined text; none for null or empty ones."""
    return df.where(F.length(column) > 0).withColumn(name, F.explode(F.split(column, ",")))
