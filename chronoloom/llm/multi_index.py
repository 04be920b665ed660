"""Nearest neighbours by an inverted multi-index: the halves of vectors are quantised apart, so K + K centroids make K * K cells.

Every row is entered in its cell. A query visits cells by the sum of its halves' squared distances to the two centroids, from a heap, until these hold
a share of all rows; all entries of these cells are then measured exactly. How large a share, is read off the fit sample: the one that would have found
FOUND of the sample's own nearest neighbours. (In all rows the neighbours are closer than in the sample, so more of them are found.)
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import forget, freeing, written
from .vectors import dimension, finite, matrix, pieces

#: Rows that centroids and the share are fitted on, those of the least hashes; queries among them; rounds of k-means; most centroids for a half.
FIT_ROWS, FIT_QUERIES, ROUNDS, MOST = 16_384, 256, 12, 256
#: The share of the sample's neighbours that the visited cells must have held.
FOUND = 0.97
#: Bytes of queries that are sent to tasks at a time; entries and queries that a task measures at a time.
QUERY_BYTES, ENTRIES, ASKED = 4 << 20, 512, 1024


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows of a to rows of b, rounded as sums of products are."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T), 0)


def centroids(rows: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """k-means; a centroid that loses all its rows takes the row that is farthest from its own."""
    r = np.random.default_rng(seed)
    at = rows[r.permutation(len(rows))[:k]].copy()
    for _ in range(ROUNDS):
        far = _apart(rows, at)
        own = far.argmin(1)
        size = np.bincount(own, minlength=len(at))
        sums = np.zeros_like(at)
        np.add.at(sums, own, rows)
        at[size > 0] = sums[size > 0] / size[size > 0, None]
        for lost, row in zip(np.flatnonzero(size == 0), np.argsort(-far.min(1), kind="stable"), strict=False):
            at[lost] = rows[row]
    return at


class Cells:
    """Two sets of centroids, and which cells a query visits."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        self.left, self.right = left, right

    def halves(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = self.left.shape[1]
        return _apart(rows[:, :h], self.left), _apart(rows[:, h:], self.right)

    def of(self, rows: np.ndarray) -> np.ndarray:
        a, b = self.halves(rows)
        return a.argmin(1) * len(self.right) + b.argmin(1)

    def reach(self, a: np.ndarray, b: np.ndarray, counts: np.ndarray, least: float) -> float:
        """The summed distance at which the cells visited so far hold `least` rows, infinite if all of them don't: pairs come from a heap, and each one's
        neighbours in the two orders go in."""
        i, j = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        heap, had, seen = [(float(a[i[0]] + b[j[0]]), 0, 0)], {0}, 0
        far = heap[0][0]
        while heap and seen < least:
            far, x, y = heapq.heappop(heap)
            seen += int(counts[i[x], j[y]])
            for nx, ny in ((x + 1, y), (x, y + 1)):
                if nx < len(i) and ny < len(j) and nx * len(j) + ny not in had:
                    had.add(nx * len(j) + ny)
                    heapq.heappush(heap, (float(a[i[nx]] + b[j[ny]]), nx, ny))
        return far * (1 + 1e-9) if seen >= least else np.inf  # tasks may round sums otherwise


def fit(sample: np.ndarray, k: int, nearest: int = 10) -> tuple[Cells, float]:
    """The cells, and the share of rows that a query must visit."""
    h = sample.shape[1] // 2
    cells = Cells(centroids(sample[:, :h], min(k, len(sample))), centroids(sample[:, h:], min(k, len(sample)), 2))
    if len(sample) <= nearest + 1:
        return cells, 1.0
    own, asked = cells.of(sample), np.arange(0, len(sample), max(1, len(sample) // FIT_QUERIES))
    wide = len(cells.right)
    counts = np.bincount(own, minlength=len(cells.left) * wide)
    a, b = cells.halves(sample[asked])
    far = _apart(sample[asked], sample)
    far[np.arange(len(asked)), asked] = np.inf
    needed = []
    for q in range(len(asked)):
        order = np.argsort((a[q][:, None] + b[q]).ravel(), kind="stable")
        before = np.empty(len(order))
        before[order] = np.cumsum(counts[order])
        needed.append(before[own[np.argpartition(far[q], nearest)[:nearest]]])
    return cells, float(np.quantile(np.concatenate(needed), FOUND)) / len(sample)


def _best(asked: np.ndarray, apart: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest for each of `asked`, ties to the smaller id."""
    order = np.lexsort((ids, apart, asked))
    asked, apart, ids = asked[order], apart[order], ids[order]
    first = np.flatnonzero(np.concatenate([[True], asked[1:] != asked[:-1]])) if len(asked) else np.zeros(0, int)
    place = np.arange(len(asked)) - np.repeat(first, np.diff(np.append(first, len(asked))))
    return asked[place < k], apart[place < k], ids[place < k]


class _Scan:
    """What one task knows of a block of queries: the k nearest of the entries it has seen, for each."""

    def __init__(self, cells: Cells, ids: np.ndarray, rows: np.ndarray, reach: np.ndarray, k: int):
        self.cells, self.ids, self.rows, self.reach, self.k = cells, ids, rows, reach, k
        self.a, self.b = cells.halves(rows)
        self.size = (rows * rows).sum(1)
        self.limit = np.full(len(ids), np.inf)
        self.found = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))

    def see(self, cell: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Measure entries, which lie in the order of their cells, for the queries that visit these."""
        size, wide = (rows * rows).sum(1), len(self.cells.right)
        kinds, at = np.unique(cell, return_inverse=True)
        visits = self.a[:, kinds // wide] + self.b[:, kinds % wide] <= self.reach[:, None]
        asking = np.flatnonzero(visits.any(1))
        for lo in range(0, len(asking), ASKED):
            q = asking[lo : lo + ASKED]
            with np.errstate(all="ignore"):
                near = self.size[q, None] + size - 2 * (self.rows[q] @ rows.T)
                near[np.isnan(near)] = -np.inf
                near[~visits[q][:, at] | (self.ids[q, None] == ids)] = np.inf
                # what may be among the k nearest of these entries and of those before, rounding allowed for
                limit = np.minimum(self.limit[q], np.partition(near, self.k - 1, 1)[:, self.k - 1] if near.shape[1] > self.k else np.inf)
                limit = np.minimum(limit + 1e-11 * (self.size[q] + size.max()), np.finfo(float).max)
                i, j = np.nonzero(near <= limit[:, None])
            for s in range(0, len(i), 1 << 16):
                self._measure(q[i[s : s + (1 << 16)]], ids, rows, j[s : s + (1 << 16)])

    def _measure(self, asked: np.ndarray, ids: np.ndarray, rows: np.ndarray, at: np.ndarray) -> None:
        with np.errstate(over="ignore"):
            apart = np.sqrt(((self.rows[asked] - rows[at]) ** 2).sum(1))
            self.found = _best(*map(np.concatenate, zip(self.found, (asked, apart, ids[at]), strict=True)), self.k)
            asked, apart, _ = self.found
            last = np.flatnonzero(np.append(asked[1:] != asked[:-1], True)) if len(asked) else asked
            full = last[np.bincount(asked, minlength=len(self.ids))[asked[last]] == self.k]
            self.limit[asked[full]] = apart[full] ** 2


def _entered(cells: Cells, d: int):
    @freeing
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (piece for whole in batches for piece in pieces(whole, d)):
            cell = cells.of(matrix(b.column(1), d).astype(np.float64))
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), b.column(0), b.column(1)], ["cell", "id", "vector"])

    return task


def _reached(cells: Cells, d: int, counts: np.ndarray, least: float):
    @freeing
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (piece for whole in batches for piece in pieces(whole, d)):
            a, z = cells.halves(matrix(b.column(1), d).astype(np.float64))
            far = [cells.reach(x, y, counts, least) for x, y in zip(a, z, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(far, pa.float64())], ["id", "vector", "reach"])

    return task


def search(df: DataFrame, asks: Callable[[Column], Column], k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows nearest to each row that fulfils the condition `asks` on its key, by Euclidean distance in
    double precision, nearest first, ties to the smaller key; a query's own row isn't among them.

    Rows whose key or vector is null, whose vector is zero or holds a null or an infinite entry, or has another length than the commonest, take no part.
    Of rows that share a key the one with the least vector counts. Fewer candidates than k give all of them; an empty table gives none. Other columns
    aren't read. Equal vectors share a cell: a cell is no group of rows that one task holds, rows lie where they were read, and queries go to them.

    Queries, any number of them, are sent to tasks in blocks of QUERY_BYTES, one pass over the entries each. Fitted on FIT_ROWS rows, a documented bound:
    the centroids and the share of rows to visit. All rows are entered and can be found.
    """
    spark = df.sparkSession
    rows = df.select(df[key].cast("long").alias("id"), df[vector].alias("vector")).where("id is not null").where(finite(F.col("vector")) & F.exists("vector", lambda c: c != 0))
    rows = written(rows.groupBy("id").agg(F.min("vector").alias("vector")), "vectors")
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d = dimension(rows)
    if not d:
        return none
    rows = rows.where(F.size("vector") == d)
    n = rows.count()
    sample = np.array([r.vector for r in rows.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).collect()], dtype=np.float64)
    cells, share = fit(sample, int(np.clip(round((n / 32) ** 0.5), 1, MOST)), k)
    kind = rows.schema["vector"].dataType.simpleString()
    entries = written(rows.mapInArrow(_entered(cells, d), f"cell int, id long, vector {kind}").sortWithinPartitions("cell"), "entries")
    counts = np.zeros(len(cells.left) * len(cells.right), np.int64)
    for cell, size in entries.groupBy("cell").count().collect():  # as many rows as cells
        counts[cell] = size
    counts = counts.reshape(len(cells.left), -1)
    queries = written(entries.where(asks(F.col("id"))).select("id", "vector").mapInArrow(_reached(cells, d, counts, max(share * n, k + 1)), f"id long, vector {kind}, reach double"), "asked")
    blocks = max(1, -(-queries.count() * 8 * d // QUERY_BYTES))
    found = []
    for block in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).toArrow()
        if not part.num_rows:
            continue
        sent = spark.sparkContext.broadcast((part["id"].to_numpy(), matrix(part["vector"].combine_chunks(), d).astype(np.float64), part["reach"].to_numpy()))

        @freeing
        def task(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            scan = None
            for b in batches:
                scan = scan or _Scan(cells, *sent.value, k)
                for piece in pieces(b, 1, ENTRIES):
                    scan.see(piece.column(0).to_numpy(), piece.column(1).to_numpy(), matrix(piece.column(2), d).astype(np.float64))
            if scan:
                asked, apart, ids = scan.found
                yield pa.RecordBatch.from_arrays([pa.array(scan.ids[asked]), pa.array(ids), pa.array(apart)], ["query_id", "vec_id", "score"])

        near = entries.mapInArrow(task, "query_id long, vec_id long, score double")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
        found.append(written(near.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "found"))
        sent.unpersist()
    forget(rows, entries, queries)
    return reduce(DataFrame.unionByName, found) if found else none
