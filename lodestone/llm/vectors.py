"""What the vector operators share: which vectors take part, and bounded samples."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows whose vector is not null, not zero and without null or
    non-finite components. If lengths differ, the commonest takes part (of equally
    common ones the longest)."""
    v = F.col(vector_col)
    rows = vectors.select(F.col(id_col).alias("id"), v.cast("array<double>").alias("v"))
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("v").isNotNull() & F.col("id").isNotNull() & whole & F.exists("v", lambda x: x != 0))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("v") == F.lit(lengths["d"] if lengths else 0))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of one length as a two-dimensional array."""
    n = len(column)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(n, -1).astype(np.float64) if n else np.zeros((0, 0))


def sample_matrix(rows: DataFrame, most: int) -> np.ndarray:
    """At most about ``most`` distinct (id, v), picked by their hash."""
    got = hash_sample(rows, ["id", "v"], most).select("v").toArrow()
    return matrix(got["v"])
