"""Sharding by weighted rendezvous hashing: each key goes to the shard that wins its draw, so one more shard takes rows only into itself.

Draws come from MD5 of key and shard, as 52 bits u; a shard of weight w scores -ln(u) / w and the least score wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written


def score(key: F.Column, shard: F.Column, weight: F.Column | None = None) -> F.Column:
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", shard.cast("string"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("double")
    draw = -F.log((bits + 0.5) / float(1 << 52))
    return draw if weight is None else draw / weight


def best(key: F.Column, weights: list[float], first: int = 0) -> F.Column:
    """struct(score, shard) of the winner among shards first, first + 1, ..."""
    shards = F.sequence(F.lit(first), F.lit(first + len(weights) - 1))
    table = F.array(*map(F.lit, map(float, weights)))
    equal = len(set(weights)) == 1
    return F.array_min(F.transform(shards, lambda s: F.struct(score(key, s, F.lit(float(weights[0])) if equal else F.get(table, s - first)).alias("score"), s.alias("shard"))))


def assign(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text", weights: list[float] | None = None, grown_weight: float = 1.0) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard): every row's shard among `shards`, its gapless place there, and its shard with one more.

    Size is the UTF-8 bytes of the text (none for null) and 16. A null key is one key of its own. Rows that share a key share a shard, whatever their
    number. Slots: rows are numbered within the tasks that hold them, and each task's numbers start where those of the tasks before it end, so no
    shard is ever gathered or sorted in one task. The rows (without text) are first written to the shared folder, so that tasks keep their rows.
    """
    weights = [1.0] * shards if weights is None else weights
    if len(weights) != shards or min(weights) <= 0:
        raise ValueError("weights: one positive number for each shard")
    rows = docs.select(docs[key].alias(key), (F.coalesce(F.octet_length(docs[text]), F.lit(0)).cast("long") + 16).alias("size"), F.crc32(F.coalesce(docs[text].cast("binary"), F.lit(b""))).alias("text_crc32"))
    won, more = best(F.col(key), weights), best(F.col(key), [grown_weight], shards)
    rows = rows.withColumn("won", won).withColumn("more", more)
    rows = rows.select(key, "size", "text_crc32", F.col("won.shard").alias("shard"), F.when(F.col("more.score") < F.col("won.score"), F.lit(shards)).otherwise(F.col("won.shard")).alias("grown_shard"), F.spark_partition_id().alias("part"))
    rows = written(rows, "shards")
    place = F.row_number().over(Window.partitionBy("part", "shard").orderBy(F.col(key).asc_nulls_first(), "text_crc32", "size"))
    counts = rows.groupBy("part", "shard").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("part", "shard", before.alias("start"))
    placed = rows.withColumn("place", place).join(starts, ["part", "shard"])
    return placed.select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("place") - 1).cast("long").alias("slot"), "grown_shard")
