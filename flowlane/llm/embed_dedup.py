"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors are brought to unit length and rotated to the principal axes, largest
variance first. Tiles are quantile ranges of the first axis; two tiles whose
ranges lie further apart than the largest distance a link allows are never
compared. Two tiles that meet are compared a block of axes at a time: the product
of the axes seen so far plus the product of the two suffix norms bounds the
cosine, and a pair is left as soon as that bound is below the threshold. What
remains is decided by the cosine in double precision.

Equal vectors are one node with a count, so a vector that very many rows share
costs no more than one. A tile pair returns counts and a spanning forest, never
its pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlane.llm.common import components, forest, written
from flowlane.llm.vectors import matrix, usable

STEPS = (8, 16, 32)   # numbers of leading axes after which the bound is tested
SLACK = 1e-4          # of the bounds, which are in single precision


def second_moments(vectors: DataFrame, dims: int) -> np.ndarray:
    """Sum over all unit vectors of their outer product: dims x dims numbers."""

    def run(batches):
        total = np.zeros((dims, dims))
        for b in batches:
            u = unit(matrix(b.column(0), dims))
            total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims * dims)), pa.array(total.ravel())], names=["k", "x"])

    rows = vectors.select("v").mapInArrow(run, "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(dims * dims)
    for r in rows:
        out[r.k] = r.x
    return out.reshape(dims, dims)


def principal_axes(moments: np.ndarray) -> np.ndarray:
    """Orthonormal columns, largest second moment first."""
    return np.linalg.eigh(moments)[1][:, ::-1]


def unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)  # squares of very large or small values stay finite
    return m / np.linalg.norm(m, axis=1, keepdims=True)


class Side:
    """One tile: unit vectors, and their leading axes with suffix norms appended."""

    def __init__(self, m: np.ndarray, axes: np.ndarray):
        self.u = unit(m)
        z = self.u @ axes
        tail = np.sqrt(np.maximum(np.cumsum(z[:, ::-1] ** 2, axis=1)[:, ::-1], 0))
        self.z = z.astype(np.float32)
        self.tail = np.pad(tail, ((0, 0), (0, 1))).astype(np.float32)
        self.steps = [k for k in STEPS if k < z.shape[1]] or [z.shape[1]]
        k = self.steps[0]
        self.lead = np.hstack([self.z[:, :k], self.tail[:, k:k + 1]])


def linked(a: Side, b: Side, first: int, last: int, threshold: float) -> np.ndarray:
    """Whether each of rows ``first`` to ``last`` of ``a`` links with each row of ``b``."""
    rough = threshold - SLACK
    mask = a.lead[first:last] @ b.lead.T >= rough
    if np.count_nonzero(mask) > 0.05 * mask.size:
        # dense: one product for all is cheaper than pair by pair
        return a.u[first:last] @ b.u.T >= threshold
    i, j = np.nonzero(mask)
    so_far, begin = np.einsum("ij,ij->i", a.z[first + i, :a.steps[0]], b.z[j, :a.steps[0]]), a.steps[0]
    for k in a.steps[1:]:
        so_far = so_far + np.einsum("ij,ij->i", a.z[first + i, begin:k], b.z[j, begin:k])
        near = so_far + a.tail[first + i, k] * b.tail[j, k] >= rough
        i, j, so_far, begin = i[near], j[near], so_far[near], k
    out = np.zeros(mask.shape, bool)
    out[i, j] = np.einsum("ij,ij->i", a.u[first + i], b.u[j]) >= threshold
    return out


def compare(a: Side, b: Side | None, copies_a: np.ndarray, copies_b: np.ndarray | None, threshold: float,
            block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """(links, root) of each row of ``a`` and then of ``b``; ``b`` None: ``a`` with itself."""
    n = len(a.u)
    m = 0 if b is None else len(b.u)
    links = np.zeros(n + m, np.int64)
    root = np.arange(n + m)
    for first in range(0, n, block):
        last = min(first + block, n)
        hit = linked(a, a if b is None else b, first, last, threshold)
        if b is None:
            hit[np.arange(last - first), np.arange(first, last)] = False
            links[first:last] += hit @ copies_a
        else:
            links[first:last] += hit @ copies_b
            links[n:] += copies_a[first:last] @ hit
        shift = 0 if b is None else n
        cols = root[shift:shift + hit.shape[1]]
        i, j = np.nonzero(hit & (root[first:last, None] != cols[None, :]))
        if len(i):
            root = forest(n + m, [(root[first + i], root[shift + j])])[root]  # forest of the roots so far
    return links, root


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, tile: int = 4096,
                    id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links (other rows with cosine >=
    ``threshold``), component_id (smallest vec_id reachable), kept.

    Null, empty and zero vectors, vectors with null or non-finite components and
    those of another length than the commonest link with nothing: 0 links, their
    own component, kept. Rows that repeat a vector link with each other. A null id
    takes part; its component is the smallest known id reachable, and it is kept
    only where ids say so (never). Other columns are not read; an empty table gives
    no rows.
    """
    every = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"),
                           F.col(f"`{vector_col}`").alias("embedding"))
    sound, dims = usable(every, "vec_id", "embedding")
    if not dims:
        return _finished(every.select("vec_id"), None)
    nodes = written(sound.groupBy("v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
                    .withColumn("node", F.monotonically_increasing_id()), "vectors")
    axes = principal_axes(second_moments(nodes, dims))

    def first_axis(batches):
        for b in batches:
            z = unit(matrix(b.column(0), dims)) @ axes[:, 0]
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[1:], pa.array(z)], names=[*b.schema.names, "z"])

    placed = nodes.select("v", "copies", "node").mapInArrow(first_axis, "v array<double>, copies long, node long, z double")
    # vectors equal on the axis are dealt apart by a jitter far below the reach
    jitter = (F.xxhash64("node") % 1_000_000) * 1e-12
    placed = written(placed.withColumn("z", F.col("z") + jitter), "placed")
    tiles = math.ceil(placed.count() / tile)
    cuts = sorted(set(placed.approxQuantile("z", [i / tiles for i in range(1, tiles)], 0.1 / tiles))) if tiles > 1 else []
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-5
    low, high = [-math.inf, *cuts], [*cuts, math.inf]
    meets = [(t, next(k for k in range(len(low)) if high[k] >= low[t] - reach),
              next(k for k in reversed(range(len(low))) if low[k] <= high[t] + reach)) for t in range(len(low))]
    partners = vectors.sparkSession.createDataFrame(meets, "tile int, first int, last int")

    def tile_of(batches):
        for b in batches:
            t = np.searchsorted(cuts, b.column(3).to_numpy(), side="right")
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(t, pa.int32())],
                                             names=[*b.schema.names[:3], "tile"])

    dealt = (placed.mapInArrow(tile_of, "v array<double>, copies long, node long, tile int").join(partners, "tile")
             .select("v", "copies", "node", "tile", F.explode(F.sequence("first", "last")).alias("other"))
             .withColumns({"a": F.least("tile", "other"), "b": F.greatest("tile", "other")}))

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        side = table.column("tile").to_numpy()
        here = np.argsort(side, kind="stable")
        n = int(np.count_nonzero(side == key[0].as_py()))
        node, copies = table.column("node").to_numpy()[here], table.column("copies").to_numpy()[here]
        m = matrix(table.column("v"), dims)[here]
        a = Side(m[:n], axes)
        if key[0].as_py() == key[1].as_py() or n == len(m):
            links, root = compare(a, None, copies, None, threshold) if key[0].as_py() == key[1].as_py() else (
                np.zeros(n, np.int64), np.arange(n))
        elif n == 0:
            links, root = np.zeros(len(m), np.int64), np.arange(len(m))
        else:
            links, root = compare(a, Side(m[n:], axes), copies[:n], copies[n:], threshold)
        some = np.flatnonzero(links)
        return pa.table({"node": node[some], "links": links[some], "root": node[root[some]]})

    found = written(dealt.select("a", "b", "v", "copies", "node", "tile").groupBy("a", "b")
                    .applyInArrow(meet, "node long, links long, root long"), "links")
    groups = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = (nodes.join(counted, "node", "left").join(groups, "node", "left")
             .withColumn("root", F.coalesce("root", "node")))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = known.join(least, "root").select(
        "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    tagged = every.withColumn("v", F.col("embedding").cast("array<double>")).select("vec_id", "v")
    return _finished(tagged, known)


def _finished(rows: DataFrame, known: DataFrame | None) -> DataFrame:
    if known is None:
        rows = rows.withColumns({"n_links": F.lit(0).cast("long"), "component_id": F.col("vec_id")})
    else:
        rows = rows.join(known.withColumn("known", F.lit(True)), "v", "left").withColumns({
            "n_links": F.coalesce("n_links", F.lit(0)).cast("long"),
            "component_id": F.when(F.col("known"), F.col("component_id")).otherwise(F.col("vec_id"))})
    return rows.select("vec_id", "n_links", "component_id",
                       F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
