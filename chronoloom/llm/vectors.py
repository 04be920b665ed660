"""What the operators on embedding vectors share: which rows count, and vectors of Arrow batches as matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its entries are numbers."""
    return F.coalesce(F.forall(vector, lambda c: F.coalesce((F.abs(c) < float("inf")) & ~F.isnan(c), F.lit(False))), F.lit(False))


def dimension(rows: DataFrame, vector: str = "vector") -> int:
    """The commonest length of the vectors, the longer one of two; 0 for an empty table."""
    first = rows.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return first[0].d if first else 0


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """Lists of d numbers each, without nulls, as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def pieces(batch: pa.RecordBatch, d: int, entries: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about so many entries."""
    step = max(1, entries // max(1, d))
    for k in range(0, batch.num_rows, step):
        yield batch.slice(k, step)
