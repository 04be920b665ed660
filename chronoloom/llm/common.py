"""What the text operators share: table access, components, and intermediate tables that survive a lost executor."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`; one of our own only where that is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="chronoloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written as a Parquet table in the shared folder and read again: later work restarts from there, also after executors are lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*frames: DataFrame) -> None:
    """Delete tables made by `written`, once nothing reads them any more."""
    for df in frames:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Return freed memory to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def freeing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` for mapInArrow, giving its memory back at the end of a task: Python workers are reused and lie idle beside those of the next stage."""

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def parts_of(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each number in `part`, and the places where it stands, in order."""
    order = np.argsort(part, kind="stable")
    sorted_ = part[order]
    begins = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(part) else np.zeros(0, int)
    for a, z in zip(begins.tolist(), [*begins[1:].tolist(), len(part)], strict=True) if len(part) else ():
        yield int(sorted_[a]), order[a:z]


def utf8(column: str = "text") -> F.Column:
    """The UTF-8 bytes of a text, none for null."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


#: Edges that one task may join; beyond this many the rounds of `_stars` do it.
FEW = 4 << 20


def forest(x: np.ndarray, y: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Join the components of nodes 0 to n - 1 by edges (x, y): `label`, the least node of each one's component so far, is brought up to date. Returns the
    places of the edges that were needed, a spanning forest of what was apart."""
    used: list[np.ndarray] = []
    while True:
        a, b = label[x], label[y]
        apart = np.flatnonzero(a != b)
        if not len(apart):
            return np.concatenate(used) if used else apart
        # each component but the least takes one edge to a lesser one
        high, first = np.unique(np.maximum(a[apart], b[apart]), return_index=True)
        took = apart[first]
        label[high] = np.minimum(a[took], b[took])
        used.append(took)
        while not np.array_equal(low := label[label], label):
            label[:] = low


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's edges as stars: (node, least node it is connected to here)."""
    parts = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches]
    if not parts:
        return
    nodes, at = np.unique(np.concatenate(parts, 1), return_inverse=True)
    at = at.reshape(2, -1)
    label = np.arange(len(nodes))
    forest(at[0], at[1], label)
    for k in range(0, len(nodes), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[k : k + (1 << 16)]), pa.array(nodes[label[k : k + (1 << 16)]])], ["node", "component"])


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Connected components of an edge list of longs: (node, component), component = smallest node reachable.

    Each partition first joins its own edges. If few are left, one task joins these; else rounds over all executors do.
    """
    form = "node long, component long"
    stars = written(edges.select(F.col(left).cast("long").alias("u"), F.col(right).cast("long").alias("v")).mapInArrow(_joined, form), "stars")
    if stars.count() <= FEW:
        return stars.coalesce(1).mapInArrow(_joined, form)
    return _stars(stars)


def _stars(edges: DataFrame, left: str = "node", right: str = "component") -> DataFrame:
    """The same by large-star and small-star rounds (Kiveris et al. 2014): each is a grouping without collected groups, so a node with very many edges
    stays a sum over tasks; O(log^2 n) rounds, each one written out."""
    now = written(edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u <> v").distinct(), "edges")
    while True:
        # large star: each larger neighbour of a node is tied to the smallest one of node and neighbours
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: each smaller neighbour, and the node itself, is tied to the smallest neighbour
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new = written(small, "edges")
        same = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() == new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        forget(now)
        now = new
        if same:
            break
    alone = edges.select(F.col(left).alias("node"), F.col(left).alias("component")).where(F.col(left) == F.col(right)).distinct().join(now.select(F.col("u").alias("node")), "node", "left_anti")
    tops = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops).unionByName(alone.join(tops.select("node"), "node", "left_anti"))
