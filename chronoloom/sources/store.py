"""A store of models by series: folders named by what is in them, and a versioned table that says which of them is candidate, production or history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .sinks import VersionedTable, columns

SERIES = ["country_code", "forecast_type"]
STATE = columns("country_code string, forecast_type string, location string, content string, version string, at timestamp")
KEEP = 5


class ModelStore:
    """Models of many series, each a row of a table whose columns are SERIES and the model's own.

    A model lies in a folder that is named by the digest of its row, so the same model is stored once and none is ever changed. Where it is used stands in
    the state, a `VersionedTable` whose versions are renamed into place: all series of a call change at once or, after a crash, not at all. Folders that no
    state names, left by a crash or by promotions, are removed by `collect`. Every operation takes any number of series in one job.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.state = VersionedTable(spark, f"{self.root}/state", STATE)

    def _rows(self, location: str | None = None) -> DataFrame:
        rows = self.state.read()
        return rows if location is None else rows.where(F.col("location") == location)

    def exists(self, location: str = "production") -> DataFrame:
        """The series with a model there, and its version."""
        return self._rows(location).select(*SERIES, "version", "at", "content")

    def versions(self) -> DataFrame:
        """(series, location, version, at) of all that is kept."""
        return self._rows().drop("content")

    def save(self, models: DataFrame, version: str, at: str, location: str = "candidate") -> int:
        """Store models of any number of series, one each, in place of what is at `location`: candidate, production or legacy."""
        if location not in ("candidate", "production", "legacy"):
            raise ValueError("location: candidate, production or legacy")
        digest = F.sha2(F.to_json(F.struct(*[F.col(c) for c in models.columns])), 256)
        rows = models.withColumn("content", digest)
        # a folder for each model, written before any state names it
        rows.write.mode("append").partitionBy("content").parquet(f"{self.root}/content")
        new = self._read().join(rows.select("content").distinct(), "content", "left_semi").select(*SERIES, "content").distinct()
        new = new.select(*SERIES, F.lit(location).alias("location"), "content", F.lit(version).alias("version"), F.lit(at).cast("timestamp").alias("at"))
        old = self._rows().join(new.select(*SERIES, "location"), [*SERIES, "location"], "left_anti")
        return self.state.write(old.unionByName(new))

    def _read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/content")

    def load(self, location: str = "production", fallback: str | None = "legacy") -> DataFrame:
        """The models at a location, with their version; of series that have none there, those at `fallback`."""
        rows = self._rows(location)
        if fallback:
            rows = rows.unionByName(self._rows(fallback).join(rows.select(*SERIES), SERIES, "left_anti"))
        return self._read().dropDuplicates(["content"]).join(rows.select("content", "version", "location"), "content").drop("content")

    def _kept(self, rows: DataFrame) -> DataFrame:
        """The newest KEEP of each series' history, and all else."""
        place = F.row_number().over(Window.partitionBy(*SERIES, "location").orderBy(F.desc("at"), F.desc("version"), "content"))
        return rows.withColumn("__n", place).where((F.col("location") != "history") | (F.col("__n") <= KEEP)).drop("__n")

    def _moved(self, rows: DataFrame, to: Column, drop: str) -> int:
        return self.state.write(self._kept(rows.withColumn("location", to).drop(drop)))

    def promote(self, series: DataFrame) -> int:
        """Of each series in `series` that has a candidate: it becomes production, and what was production history, of which KEEP are kept."""
        able = self._rows("candidate").join(series.select(*SERIES).distinct(), SERIES, "left_semi").select(*SERIES, F.lit(True).alias("__able"))
        rows = self._rows().join(able, SERIES, "left")
        move = F.coalesce("__able", F.lit(False))
        to = F.when(move & (F.col("location") == "candidate"), "production").when(move & (F.col("location") == "production"), "history").otherwise(F.col("location"))
        return self._moved(rows, to, "__able")

    def rollback(self, series: DataFrame) -> int:
        """Of each series in `series` the newest version in history becomes production again, or the one named in its column `version`; what was production
        becomes history. Series without such a version stay as they are."""
        asked = series.select(*SERIES, (F.col("version") if "version" in series.columns else F.lit(None).cast("string")).alias("__v")).distinct()
        past = self._rows("history").join(asked, SERIES).where(F.col("__v").isNull() | (F.col("__v") == F.col("version")))
        back = past.groupBy(*SERIES).agg(F.max_by(F.struct("content", "version"), F.struct("at", "version", "content")).alias("__back"))
        rows = self._rows().join(back, SERIES, "left")
        chosen = (F.col("location") == "history") & (F.struct("content", "version") == F.col("__back"))
        to = F.when(F.col("__back").isNull(), F.col("location")).when(chosen, "production").when(F.col("location") == "production", "history").otherwise(F.col("location"))
        return self._moved(rows, to, "__back")

    def collect(self) -> int:
        """Remove the folders of models that the present state doesn't name, and all older states; how many folders went. Not while someone saves."""
        named = {r.content for r in self._rows().select("content").distinct().collect()}  # a few for each series
        top = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/content")
        fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        gone = 0
        for x in fs.listStatus(top) if fs.exists(top) else []:
            name = x.getPath().getName()
            if name.startswith("content=") and name.removeprefix("content=") not in named:
                fs.delete(x.getPath(), True)
                gone += 1
        self.state.keep(1)
        return gone
