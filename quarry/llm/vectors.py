"""What the operators on embeddings share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(embedding: Column) -> Column:
    """Neither null, empty nor zero, and without null or non-finite components."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def dimension(vectors: DataFrame) -> int:
    """The commonest length of the usable vectors (the smaller one of equals); others take no part."""
    rows = vectors.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows[0].d if rows else 0


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column without nulls as an array of doubles."""
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)
