"""Integer vectors of embeddings."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONG = np.iinfo(np.int64)


def usable(vector: str) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & finite, F.lit(False))


def scaled(vector: str, scale: int = 256) -> Column:
    """floor(scale * entry) of every entry; beyond the range of a long, its end."""
    return F.transform(vector, lambda v: F.floor(v.cast("double") * scale).cast("bigint"))


def one_size(df: DataFrame, vector: str) -> int | None:
    """How many entries all vectors have; None without any. Raises ValueError where they differ."""
    least, most = df.agg(F.min(F.size(vector)), F.max(F.size(vector))).first()
    if least != most:
        raise ValueError(f"vectors of {least} to {most} entries")
    return least


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows of a list column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).reshape(len(column), size)


def largest(x: np.ndarray) -> int:
    """The largest absolute value, also of the least long."""
    return max(int(x.max()), -int(x.min())) if x.size else 0
