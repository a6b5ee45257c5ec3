"""Shared by the two operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """Rows (vec_id, v array<double>) whose vector takes part, and its dimension.

    Null or empty vectors, zero vectors, those with a null or non-finite component
    and those of another length than the commonest one take no part.
    """
    v = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"),
                       F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    sound = v.where(F.coalesce((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (
        F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False)))
    top = sound.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dims = top[0].d if top else 0
    return sound.where(F.size("v") == dims), dims


def matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """A list column without nulls as a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(-1, dims)


def lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32),
                                    pa.array(m.ravel().astype(np.float64)))
