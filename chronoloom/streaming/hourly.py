"""Structured Streaming forms: hourly means behind a watermark, deduplication of late repeats, and keyed upserts of each batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.sinks import VersionedTable


def events(spark: SparkSession, path: str, schema, glob: str = "*.parquet") -> DataFrame:
    """New Parquet files of a folder as a stream, ts as a timestamp."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def hourly_mean(stream: DataFrame, keys: list[str], late: str = "2 hours", ts: str = "ts", y: str = "y") -> DataFrame:
    """Means of closed hours; rows later than `late` don't count."""
    w = stream.withWatermark(ts, late).groupBy(*keys, F.window(ts, "1 hour")).agg(F.avg(y).alias(y))
    return w.select(*keys, F.col("window.start").alias(ts), y)


def once(stream: DataFrame, key: list[str], late: str = "2 hours", ts: str = "ts") -> DataFrame:
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def upserted(stream: DataFrame, table: VersionedTable, key: list[str], checkpoint: str) -> StreamingQuery:
    """All that is there now, batch by batch, upserted into a table; a batch that is done again changes nothing."""
    return stream.writeStream.foreachBatch(lambda batch, _: table.upsert(batch, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
