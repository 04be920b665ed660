"""Whitening of embeddings: the leading components of their covariance by block Lanczos, and every vector's coordinates on them in units of deviations.

Vectors become integers first, so their sums, means and deviations are exact. The covariance V is never formed: a pass over the rows gives XtXv for a block
of directions v, from rows that are centred before they are multiplied. Each task adds up its rows, sums of tasks are added up by executors, and the driver
holds nothing but the basis, a vector's length wide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeing, written
from .vectors import dimension, finite, matrix, pieces

SCALE, OFFSET = 1024, 100_000
#: Entries from here on have no exact double among their integers.
FAR = float(1 << 40)
#: Components with less than this share of the first one's variance can't be told from none in double precision.
LEAST = 1e-11
BLOCK = 16


def lanczos(multiply: Callable[[np.ndarray], np.ndarray], d: int, want: int, block: int = BLOCK, tolerance: float = 1e-12, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The `want` largest eigenvalues of a symmetric positive operator on d dimensions, falling, and their unit eigenvectors as columns.

    `multiply` applies the operator to a block of columns. Each new block is made orthogonal to the whole basis, twice. Where it breaks down (the basis can't
    grow in some direction), random directions restart it. It ends when the residuals |Vu - eu| of all wanted pairs are under `tolerance` of the largest
    eigenvalue, or when the basis is complete. A block is at least as wide as `want`: it finds as many copies of an eigenvalue as it has columns.
    """
    block = max(block, want)
    r = np.random.default_rng(seed)
    basis, image = np.zeros((d, 0)), np.zeros((d, 0))
    fresh = np.linalg.qr(r.standard_normal((d, min(block, d))))[0]
    while True:
        got = multiply(fresh)
        basis, image = np.hstack([basis, fresh]), np.hstack([image, got])
        small = basis.T @ image
        values, at = np.linalg.eigh((small + small.T) / 2)
        values, at = values[::-1][:want], at[:, ::-1][:, :want]
        left = np.linalg.norm(image @ at - basis @ at * values, axis=0)
        room = d - basis.shape[1]
        if not room or (len(values) >= min(want, d) and left.max() <= tolerance * values[0]):
            return values, basis @ at
        for _ in range(2):
            got = got - basis @ (basis.T @ got)
        found, size, _ = np.linalg.svd(got, full_matrices=False)
        keep = found[:, size > 1e-10 * max(values[0], np.finfo(float).tiny)][:, :room]
        fresh = np.hstack([keep, r.standard_normal((d, min(block, room) - keep.shape[1]))]) if keep.shape[1] < min(block, room) else keep
        for _ in range(2):
            fresh = np.linalg.qr(fresh - basis @ (basis.T @ fresh))[0]


def _summed(rows: DataFrame, d: int, run: Callable[[np.ndarray], np.ndarray], size: int, kind: str = "double") -> np.ndarray:
    """`run` over the rows in blocks, its results (`size` numbers) added up: by tasks, then by executors; the driver gets `size` numbers."""
    whole = np.int64 if kind == "long" else np.float64

    @freeing
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, whole)
        for b in batches:
            for piece in pieces(b, d):
                total += run(matrix(piece.column(0), d))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["place", "value"])

    out = np.zeros(size, whole)
    for place, value in rows.select("x").mapInArrow(task, f"place int, value {kind}").groupBy("place").agg(F.sum("value").alias("value")).collect():
        out[place] = value
    return out


def _exact(x: np.ndarray, n: int, floor: np.ndarray, rest: np.ndarray) -> list[int | None]:
    """Each row's sum of (n * x - S)^2, in whole numbers; S is n * floor + rest. None where no long holds it."""
    near = x - floor
    most = n * int(np.abs(near).max(initial=0)) + n
    if most * most * max(1, x.shape[1]) < 1 << 63:
        return ((n * near - rest) ** 2).sum(1).tolist()
    return [s if s < 1 << 63 else None for s in ((near.astype(object) * n - rest.astype(object)) ** 2).sum(1).tolist()]


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 8, block: int = BLOCK) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): for every row and leading component, numbered from 1.

    An entry c counts as x = floor(1024 * c) + 100000. n rows with sums S: deviation is the row's sum of (n * x - S)^2, exact; whitened its coordinate on the
    component in units of the component's deviation; explained the component's share of all variance; identity_error the largest entry by which the
    covariance of `whitened`, measured over all rows, differs from the identity.

    Rows whose vector is null or holds a null or an infinite entry are left out, and so are, as nothing can be added to them, vectors of another length
    than the commonest and those with an entry of 2^40 or more. Null keys, repeated keys and repeated rows stay, each a row of its own; other columns aren't
    read. Without variance (one row, equal rows, an empty table or empty vectors) there are no components and so no rows; components with under 1e-11 of
    the first one's variance don't count. A deviation that no long can hold is null. A component's largest entry is positive.
    """
    kind = df.schema[key].dataType.simpleString()
    form = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    numbers = df.select(df[key].alias("key"), df[vector].alias("vector")).where(finite(F.col("vector"))).where(F.forall("vector", lambda c: F.abs(c) < FAR))
    x = F.transform("vector", lambda c: F.floor(c.cast("double") * float(SCALE)).cast("long") + OFFSET)
    rows = written(numbers.select("key", x.alias("x")), "whole")
    d = dimension(rows, "x")
    none = df.sparkSession.createDataFrame([], form)
    if not d:
        return none
    rows = rows.where(F.size("x") == d)
    # sums of high and low halves, so that no sum of longs overflows
    halves = _summed(rows, d, lambda m: np.concatenate([[len(m)], (m >> 26).sum(0), (m & ((1 << 26) - 1)).sum(0)]), 1 + 2 * d, "long")
    n, sums = int(halves[0]), [(int(h) << 26) + int(lo) for h, lo in zip(halves[1 : d + 1], halves[d + 1 :], strict=True)]
    floor, rest = np.array([s // n for s in sums]), np.array([s % n for s in sums])

    def centred(m: np.ndarray) -> np.ndarray:
        return (m - floor) - rest / n

    # in float: the share of variance needs no more; the rows' own deviations are exact
    trace = _summed(rows, d, lambda m: np.array([(centred(m) ** 2).sum()]), 1)[0] / n
    if not trace > 0:
        return none

    def multiply(q: np.ndarray) -> np.ndarray:
        def run(m: np.ndarray) -> np.ndarray:
            c = centred(m)
            return (c.T @ (c @ q)).ravel()

        return _summed(rows, d, run, q.size).reshape(q.shape) / n

    values, at = lanczos(multiply, d, min(components, d), block)
    k = int((values > LEAST * values[0]).sum())
    values, at = values[:k], at[:, :k]
    at = at * np.sign(at[np.abs(at).argmax(0), np.arange(k)])
    onto = at / np.sqrt(values)

    def moments(m: np.ndarray) -> np.ndarray:
        w = centred(m) @ onto
        return np.concatenate([w.sum(0), (w.T @ w).ravel()])

    seen = _summed(rows, d, moments, k + k * k) / n
    error = float(np.abs(seen[k:].reshape(k, k) - np.outer(seen[:k], seen[:k]) - np.eye(k)).max())
    shares = values / trace

    @freeing
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (piece for whole in batches for piece in pieces(whole, d)):
            m = matrix(b.column(1), d)
            r = len(m)
            each = np.repeat(np.arange(r), k)
            off = pa.array(_exact(m, n, floor, rest), pa.int64())
            cols = [b.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), r)), pa.array(np.full(r * k, n)), off.take(pa.array(each)), pa.array((centred(m) @ onto).ravel()), pa.array(np.tile(shares, r)), pa.array(np.full(r * k, error))]
            yield pa.RecordBatch.from_arrays(cols, [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(emit, form)
