"""Column functions over embedding vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def norm(vector: Column) -> Column:
    squares = F.aggregate(
        vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")
    )
    return F.sqrt(squares)


def l2_normalize(vector: Column) -> Column:
    """Vector of length one; a zero vector stays zero."""
    length = norm(vector)
    return F.transform(
        vector, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(F.lit(0.0))
    )


def rows_of(vectors: pa.Array) -> np.ndarray:
    """Matrix of a list column without nulls; all lists must have the same size."""
    count = len(vectors)
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(vectors.offsets.to_numpy())
    if count and (sizes != sizes[0]).any():
        raise ValueError("vectors differ in dimension")
    return flat.reshape(count, -1) if count else np.zeros((0, 0))


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision; zero rows stay zero."""
    matrix = np.asarray(matrix, dtype=np.float64)
    lengths = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    return matrix / np.where(lengths > 0, lengths, 1.0)[:, None]


@F.arrow_udf(T.DoubleType())
def cosine(a: pa.Array, b: pa.Array) -> pa.Array:
    """Row-wise cosine; 0 when a vector is zero, null when one is missing."""
    present = np.asarray(a.is_valid()) & np.asarray(b.is_valid())
    out = np.full(len(a), np.nan)
    if present.any():
        mask = pa.array(present)
        left, right = unit_rows(rows_of(a.filter(mask))), unit_rows(rows_of(b.filter(mask)))
        if left.shape != right.shape:
            raise ValueError("vectors differ in dimension")
        out[present] = np.einsum("ij,ij->i", left, right)
    return pa.array(out, mask=~present)
