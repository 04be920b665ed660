"""Sinks: versioned Parquet tables with keyed upserts, CSV and JSON exports, text reports of small results."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import control

KINDS = {"string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "long": T.LongType(), "timestamp": T.TimestampType(), "boolean": T.BooleanType()}


def columns(text: str) -> T.StructType:
    return T.StructType([T.StructField(name, KINDS[kind]) for name, kind in (c.split() for c in text.split(", "))])


FORECASTS = columns("id long, country_code string, forecast_type string, renewable_type string, target_timestamp_utc timestamp, generated_at timestamp, horizon_hours int, forecast_value double, model_name string, model_version string")
EVALUATIONS = columns("country_code string, forecast_type string, model_version string, evaluation_date string, mae double, rmse double, mape double, smape double, mase double, directional_accuracy double, skill_vs_persistence double, skill_vs_seasonal double, skill_vs_tso double, training_samples int, test_samples int, evaluation_periods string, is_baseline boolean, model_location string, created_at timestamp")
DEPLOYMENTS = columns("id long, country_code string, forecast_type string, version string, at timestamp, deployed_by string, previous_version string, deployment_reason string, status string, mae_at_deployment double, mape_at_deployment double, skill_score_at_deployment double, created_at timestamp")
RUNS = columns("id long, run_timestamp timestamp, run_type string, trigger_source string, status string, countries_requested string, countries_completed string, types_requested string, types_completed string, forecasts_generated int, execution_time_seconds double, error_message string, log_file_path string, created_at timestamp")


class VersionedTable:
    """A Parquet table whose versions are lists of folders. A write makes new folders, and then a new file `v<n>.json` names those of version n: it is
    written aside and renamed into place, so readers see whole versions only, and a crash in between leaves the version before. A version being read is
    never overwritten. One writer at a time; a second one that makes the same version fails.

    With `partition_by`, upserts rewrite only the partitions that new rows touch and take the others over from the version before."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, partition_by: tuple[str, ...] = ()) -> None:
        self.spark, self.path, self.schema, self.partition_by = spark, path.rstrip("/"), schema, partition_by

    def _fs(self, name: str = ""):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        top, fs = self._fs()
        names = [x.getPath().getName() for x in fs.listStatus(top)] if fs.exists(top) else []
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json") and n[1:-5].isdigit())

    def version(self) -> int:
        return max(self.versions(), default=0)

    def _folders(self, version: int) -> list[dict]:
        """[{"path": folder within the table, "values": its partition's values or None}]"""
        lines = self.spark.read.text(f"{self.path}/v{version}.json", wholetext=True).first()[0]
        return json.loads(lines)

    def read(self, version: int | None = None) -> DataFrame:
        n = self.version() if version is None else version
        return self._frame(self._folders(n) if n else [])

    def _frame(self, folders: list[dict]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f['path']}" for f in folders])

    def _commit(self, n: int, folders: list[dict]) -> int:
        aside, fs = self._fs(f"_v{n}-{uuid.uuid4().hex}.json")
        stream = fs.create(aside, True)
        stream.write(bytearray(json.dumps(folders).encode()))
        stream.close()
        if not fs.rename(aside, self._fs(f"v{n}.json")[0]):
            raise RuntimeError(f"version {n} of {self.path} is there already")
        return n

    def _typed(self, df: DataFrame) -> DataFrame:
        return df.select(*[F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema])

    def _written(self, df: DataFrame, n: int) -> list[dict]:
        """Folders of `df`'s rows; one for each partition. The partitions' columns are in the files as well."""
        folder = f"data-{n}-{uuid.uuid4().hex}"
        if not self.partition_by:
            df.write.parquet(f"{self.path}/{folder}")
            return [{"path": folder, "values": None}]
        named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"p_{c}") for c in self.partition_by]
        df.select("*", F.sha2(F.concat_ws("\x1f", *named), 256).alias("part_")).repartition("part_").write.partitionBy("part_").parquet(f"{self.path}/{folder}")
        top, fs = self._fs(folder)
        return [{"path": f"{folder}/{x.getPath().getName()}", "values": x.getPath().getName().split("=", 1)[1]} for x in fs.listStatus(top) if x.isDirectory()]

    def write(self, df: DataFrame) -> int:
        n = self.version() + 1
        return self._commit(n, self._written(self._typed(df), n))

    def upsert(self, rows: DataFrame, key: list[str], order: list[str] = ()) -> int:
        """Rows of the same key are replaced. The key must hold the columns of `partition_by`, so that a row stays in its partition."""
        if not self.partition_by:
            return self.write(control.upsert(self.read(), rows, key, order))
        if missing := set(self.partition_by) - set(key):
            raise ValueError(f"partitioned by {', '.join(sorted(missing))}, which the key leaves out")
        n = self.version() + 1
        old = self._folders(n - 1) if n > 1 else []
        rows = self._typed(rows)
        named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"p_{c}") for c in self.partition_by]
        touched = {r[0] for r in rows.select(F.sha2(F.concat_ws("\x1f", *named), 256)).distinct().collect()}  # a row a partition
        stay, change = [f for f in old if f["values"] not in touched], [f for f in old if f["values"] in touched]
        return self._commit(n, stay + self._written(self._typed(control.upsert(self._frame(change), rows, key, order)), n))

    def keep(self, versions: int) -> None:
        """Remove all but the newest versions, and the folders that none of these reads. Not while someone reads an older one."""
        every = self.versions()
        gone, kept = every[:-versions], every[-versions:]
        needed = {f["path"] for v in kept for f in self._folders(v)}
        old = {f["path"] for v in gone for f in self._folders(v)}
        for name in [*(f"v{v}.json" for v in gone), *sorted(old - needed)]:
            p, fs = self._fs(name)
            fs.delete(p, True)


def save_evaluation(table: VersionedTable, rows: DataFrame) -> int:
    """Upsert evaluations by series, version and date; the key and the mean absolute error must be there."""
    need = {"country_code", "forecast_type", "model_version", "evaluation_date", "mae"}
    if missing := need - set(rows.columns):
        raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
    return table.upsert(rows, ["country_code", "forecast_type", "model_version", "evaluation_date"])


def tables(spark: SparkSession, root: str) -> dict[str, VersionedTable]:
    """The tables that a job writes, each made with no rows where there is none yet; forecasts are partitioned by country and type."""
    out = {
        "forecasts": VersionedTable(spark, f"{root}/forecasts", FORECASTS, ("country_code", "forecast_type")),
        "model_evaluations": VersionedTable(spark, f"{root}/model_evaluations", EVALUATIONS),
        "deployed_models": VersionedTable(spark, f"{root}/deployed_models", DEPLOYMENTS),
        "forecast_runs": VersionedTable(spark, f"{root}/forecast_runs", RUNS),
    }
    for t in out.values():
        if not t.version():
            t.write(spark.createDataFrame([], t.schema))
    return out


def save_forecasts(table: VersionedTable, rows: DataFrame) -> int:
    """Upsert forecasts; groups of load and price that are zero throughout are kept out, and missing columns are an error."""
    need = {"country_code", "forecast_type", "target_timestamp_utc", "generated_at", "horizon_hours", "forecast_value", "model_name"}
    if missing := need - set(rows.columns):
        raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
    guarded = F.col("forecast_type").isin("load", "price")
    return table.upsert(control.not_all_zero(rows, ["country_code", "forecast_type"], "forecast_value", guarded), control.FORECAST_KEY)


def migrated(old: DataFrame, name: str = "xgboost") -> DataFrame:
    """Forecasts of an older layout, with a model name where there was none."""
    return old.withColumn("model_name", F.coalesce("model_name", F.lit(name)) if "model_name" in old.columns else F.lit(name))


def to_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def to_json(df: DataFrame, path: str, mape: str | None = None) -> None:
    """JSON lines; with `mape`, a flag tells whether it can be relied on (up to 1000 percent)."""
    if mape:
        df = df.withColumn("mape_reliable", ~F.coalesce(F.col(mape) > 1000, F.lit(False)))
    df.write.mode("overwrite").json(path)


def markdown(df: DataFrame, most: int = 200) -> str:
    """A small result as a Markdown table; more rows than `most` are an error, since a report is no place for them."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report holds {most} rows at most")
    show = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = [df.columns, ["---"] * len(df.columns), *[[show(v) for v in r] for r in rows]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)
