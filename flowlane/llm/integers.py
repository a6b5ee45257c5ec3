"""Integer vectors for the two exact searches: rows that take part, exact inner products,
and blocks of rows packed into one binary cell each."""

from __future__ import annotations

import io
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG = np.iinfo(np.int64)


def sound(vectors: DataFrame, id_col: str, vector_col: str, *more: str) -> tuple[DataFrame, int]:
    """Rows (vec_id, v array<double>, more ...) that take part, and their dimension.

    Rows with a null id, a null or empty vector, a null or non-finite component, or
    another length than the commonest one take no part. Zero vectors do.
    """
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"),
                          F.col(f"`{vector_col}`").cast("array<double>").alias("v"), *[F.col(f"`{c}`") for c in more])
    rows = rows.where(F.col("vec_id").isNotNull() & F.coalesce((F.size("v") > 0) & F.forall(
        "v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)))
    top = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dims = top[0].d if top else 0
    return rows.where(F.size("v") == dims), dims


def quantised(m: np.ndarray, scale: float = 256) -> np.ndarray:
    """floor(scale * x) of every component, as whole doubles; beyond a double's range its
    largest number."""
    with np.errstate(over="ignore"):
        return np.nan_to_num(np.floor(m * scale))


def products(q: np.ndarray, x: np.ndarray, most: float | None = None) -> np.ndarray:
    """Exact inner products of the rows of ``q`` with those of ``x``, whole doubles both,
    as longs. Those beyond a long come out as its end. ``most``: the largest component of
    ``x``, where known.

    Sums below 2^53 are exact in doubles in any order; larger ones are taken in
    Python's integers.
    """
    if not q.size or not x.size:
        return np.zeros((len(q), len(x)), np.int64)
    if np.abs(q).max() * (np.abs(x).max() if most is None else most) * q.shape[1] < 2.0 ** 53:
        return (q @ x.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(q) @ whole(x).T, int(LONG.min), int(LONG.max)).astype(np.int64)


def pack(**arrays: np.ndarray) -> bytes:
    with io.BytesIO() as f:
        np.savez(f, **arrays)
        return f.getvalue()


def unpack(cell: pa.Scalar) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(cell.as_buffer())) as f:
        return {n: f[n] for n in f.files}


def narrow(m: np.ndarray) -> np.ndarray:
    """Whole doubles in the smallest type that holds them all."""
    most = np.abs(m).max(initial=0)
    return m.astype(next((t for t in (np.int8, np.int16, np.int32) if most <= np.iinfo(t).max), np.float64))


def lots(rows: int, size: int) -> int:
    return max(1, math.ceil(rows / size))


def dealt(n: int, salt: int = 0):
    """A column dealing rows into ``n`` lots, rows of one id or one vector as well."""
    return F.pmod(F.xxhash64("vec_id", "v", F.monotonically_increasing_id(), F.lit(salt)), F.lit(n)).cast("int")


def meet(blocks: DataFrame, n_blocks: int, queries: DataFrame, n_lots: int, compare, schema: str) -> DataFrame:
    """``compare(block's arrays, lot's arrays)``, an Arrow table of ``schema``, of every
    block (block, cell) with every lot of queries (lot, cell). A task holds one of each."""
    key = ["block", "lot"]
    blocks = blocks.select("block", F.explode(F.sequence(F.lit(0), F.lit(n_lots - 1))).alias("lot"), "cell")
    queries = queries.select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), "lot", "cell")

    def both(a: pa.Table, b: pa.Table) -> pa.Table:
        # a lot that the deal left empty has no row
        return compare(unpack(a["cell"][0]), unpack(b["cell"][0])) if len(a) and len(b) else empty

    empty = pa.table({n: pa.array([], {"long": pa.int64(), "int": pa.int32()}[t])
                      for n, t in (f.split() for f in schema.split(", "))})
    return blocks.groupBy(*key).cogroup(queries.groupBy(*key)).applyInArrow(both, schema)
