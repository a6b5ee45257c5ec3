"""Nearest neighbours by inner product: inverted lists scanned with adaptive
dimensions.

Each vector x gets one more component, sqrt(M^2 - |x|^2) with M the largest norm,
so that the largest inner product is the smallest distance. Lists are cells of a
k-means fitted on a bounded sample; every row is in a list. How many lists a query
probes is set by measuring, against the exact answers of some sample queries over
all rows, how many it takes to reach the wanted recall.

Inside a probed list vectors and queries are rotated at random and compared a
block of columns at a time. From the partial distance over d of D columns a test
decides whether the whole distance can be below the query's bound; a pair that
fails is abandoned. The bound starts from the query's neighbours among the sample
rows and tightens as blocks are scanned. What is left is scored by the inner
product of the original vectors in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlane.llm.common import hash_sample, ship, written
from flowlane.llm.vectors import lists, matrix, usable

COLUMNS = 16   # width of a block of rotated columns
EPSILON = 2.1  # width of the hypothesis test, in standard deviations
DENSE = 0.1    # share of the pairs of a block up to which they are looked at one by one
SLACK = 1e-5   # of the squared distances, which are in single precision


def _augmented(m: np.ndarray, most: float) -> np.ndarray:
    return np.hstack([m, np.sqrt(np.maximum(most * most - (m * m).sum(1), 0))[:, None]])


def k_means(m: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = m[rng.choice(len(m), min(k, len(m)), replace=False)].copy()
    for _ in range(rounds):
        cell = nearest(m, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, m)
        n = np.bincount(cell, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest(m: np.ndarray, centres: np.ndarray, k: int, block: int = 4096) -> np.ndarray:
    """The ``k`` nearest centres of each row, nearest first."""
    out = np.empty((len(m), k), np.int64)
    half = (centres ** 2).sum(1) / 2
    for b in range(0, len(m), block):
        far = half - m[b:b + block] @ centres.T
        out[b:b + block] = np.argsort(far, axis=1, kind="stable")[:, :k] if k > 1 else far.argmin(1)[:, None]
    return out


def rotation(dims: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k ids with the largest scores, each once at its best; ties to
    the smaller id."""
    some, m = np.arange(len(scores)), 4 * k
    while len(scores) > m:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - m)[len(scores) - m])
        if len(np.unique(ids[at])) >= k:
            some = at
            break
        m *= 4
    order = some[np.lexsort((ids[some], -scores[some]))]
    first = np.unique(ids[order], return_index=True)[1]
    return order[np.sort(first)[:k]]


def scan(q: np.ndarray, q_ids: np.ndarray, bound: np.ndarray, x: np.ndarray, x_ids: np.ndarray, most: float,
         turn: np.ndarray, k: int, block: int = 2048) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(query position, row positions, scores) of each query's best ``k`` ids, by the
    best row of each, whose score reaches its ``bound``.

    While many pairs of a block are left, a block of columns is added for all of them
    in one product; once few are, for those alone."""
    dims = turn.shape[0]
    zx = (_augmented(x, most) @ turn).astype(np.float32)
    zq = (np.hstack([q, np.zeros((len(q), 1))]) @ turn).astype(np.float32)
    size = (q * q).sum(1) + most * most
    bound = bound.copy()
    kept: list[list[np.ndarray]] = [[] for _ in q]
    ends = [*range(COLUMNS, dims, COLUMNS), dims]
    for first in range(0, len(x), block):
        part = slice(first, min(first + block, len(x)))
        reach = np.sqrt(np.maximum(size - 2 * bound, 0) + SLACK * size)
        d2 = i = j = None
        for begin, end in zip([0, *ends], ends):
            limit = _limit(reach, end, dims).astype(np.float32)
            if i is None:
                a, b = zq[:, begin:end], zx[part, begin:end]
                gap = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
                d2 = gap if d2 is None else d2 + gap
                near = d2 <= limit[:, None]
                if np.count_nonzero(near) <= DENSE * near.size or end == dims:
                    i, j = np.nonzero(near)
                    d2 = d2[i, j]
            else:
                gap = zq[i, begin:end] - zx[first + j, begin:end]
                d2 = d2 + (gap * gap).sum(1)
                near = d2 <= limit[i]
                i, j, d2 = i[near], j[near], d2[near]
            if i is not None and not len(i):
                break
        if not len(i):
            continue
        score = np.einsum("ij,ij->i", q[i], x[first + j])
        right = (score >= bound[i]) & (q_ids[i] != x_ids[first + j])
        i, j, score = i[right], j[right], score[right]
        cuts = np.searchsorted(i, np.arange(len(q) + 1))
        for p in np.flatnonzero(np.diff(cuts)):
            here = slice(cuts[p], cuts[p + 1])
            rows, values = np.concatenate([*[r for r, _ in kept[p]], first + j[here]]), np.concatenate(
                [*[v for _, v in kept[p]], score[here]])
            if len(rows) >= k:
                top = best(values, x_ids[rows], k)
                rows, values = rows[top], values[top]
                if len(top) == k:
                    bound[p] = max(bound[p], values[-1])
            kept[p] = [(rows, values)]
    return [(p, *have[0]) for p, have in enumerate(kept) if have]


def _limit(reach: np.ndarray, seen: int, dims: int) -> np.ndarray:
    """Largest partial squared distance over ``seen`` of ``dims`` rotated columns with
    which the whole one may still be within ``reach``."""
    if seen == dims:
        return reach ** 2 + 1e-9 * np.maximum(reach, 1) ** 2
    return (reach * (1 + EPSILON / math.sqrt(seen))) ** 2 * seen / dims


def search(vectors: DataFrame, k: int = 20, every: int = 20, recall: float = 0.97, per_list: int | None = None,
           sample: int = 16_384, probes_from: int = 128, chunk: int = 4096,
           id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows found of each row whose id is divisible by ``every``:
    query_id, rank, vec_id, score.

    There are as many lists as the square root of the number of rows, or one for each
    ``per_list`` rows, and 16 sample rows for each list: centres, first bounds and the
    number of probes are fitted on these, at most ``sample`` of them. ``recall`` is what
    the fitted number of probes reaches on ``probes_from`` rows beside the sample. Lists
    of more than ``chunk`` rows and their queries are dealt out in chunks, so no group
    grows with the table.

    Rows with a null id and unusable vectors (see ``vectors.usable``) take no part.
    An id that several rows have is one neighbour, with its best score; no row is a
    neighbour of a query of its own id, and a repeated query id is answered once, for
    its smallest vector. Of rows that share a vector the ``k + 1`` smallest ids are
    candidates: the others tie with them and come after.
    Ties go to the smaller id. Other columns are not read; an empty table gives no
    rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    sound, dims = usable(vectors, id_col, vector_col)
    if not dims:
        return spark.createDataFrame([], schema)
    # copies of a row count once, or a repeated one would fill samples and lists
    sound = sound.where("vec_id is not null").dropDuplicates(["vec_id", "v"])
    same = Window.partitionBy(F.xxhash64("v"), "v").orderBy("vec_id")
    asks = F.col("vec_id") % every == 0
    # one table for both: a crowd's other rows are there as queries alone
    sound = written(sound.withColumn("place", F.row_number().over(same)).where((F.col("place") <= k + 1) | asks), "distinct")
    among = sound.where(F.col("place") <= k + 1).select("vec_id", "v")
    total, most = sound.agg(F.count_if(F.col("place") <= k + 1), F.max(F.sqrt(F.aggregate(
        "v", F.lit(0.0), lambda a, x: a + x * x)))).head()
    if not total:
        return spark.createDataFrame([], schema)
    cells = max(1, min(math.ceil(total / per_list) if per_list else math.ceil(math.sqrt(total)), sample // 16))
    # the rows with the smallest hashes: the same at every partitioning
    drawn = hash_sample(among, F.xxhash64("vec_id", "v"), max(256, 16 * cells) + probes_from, "vec_id", "v").collect()
    # the last ones only measure recall, unless there are few rows altogether
    rest = drawn[-probes_from:] if len(drawn) > 2 * probes_from else drawn
    drawn = drawn[:-probes_from] if len(drawn) > 2 * probes_from else drawn
    anchors, anchor_ids = np.array([r.v for r in drawn]), np.array([r.vec_id for r in drawn])
    by_id = np.argsort(anchor_ids, kind="stable")
    one_id, starts = np.unique(anchor_ids[by_id], return_index=True)
    centres = k_means(_augmented(anchors, most), min(cells, max(1, len(anchors) // 16)))

    def assign(batches):
        for b in batches:
            cell = nearest(_augmented(matrix(b.column(1), dims), most), centres, 1)[:, 0]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32())], names=["vec_id", "v", "cell"])

    rows = written(among.mapInArrow(assign, "vec_id long, v array<double>, cell int"), "lists")
    asking = np.sort(np.unique([r.vec_id for r in rest], return_index=True)[1])[:probes_from]  # an id asks once
    probes = _probes(rows, dims, np.array([rest[i].v for i in asking]), np.array([rest[i].vec_id for i in asking]),
                     centres, most, k, recall)

    def ask(batches):
        """Each query with its lists, its best sample rows, which are candidates too, so
        that no query gets fewer than k, and the bound that these give."""
        for b in batches:
            for f in range(0, b.num_rows, 256):
                some = b.slice(f, 256)
                q, ids = matrix(some.column(1), dims), some.column(0).to_numpy()
                s = (q @ anchors.T)[:, by_id]
                id_best = np.maximum.reduceat(s, starts, axis=1)
                id_best[ids[:, None] == one_id[None, :]] = -np.inf
                n = min(k, id_best.shape[1])
                top = np.argpartition(id_best, -n, axis=1)[:, -n:]
                low = np.take_along_axis(id_best, top, axis=1).min(1) if n == k else np.full(len(q), -np.inf)
                # the product of the scan may differ in the last digits
                low = np.where(np.isfinite(low), low - 1e-9 * np.maximum(1, np.abs(low)), -1e300)
                to = nearest(np.hstack([q, np.zeros((len(q), 1))]), centres, probes)
                hits = []
                for p in range(len(q)):
                    at = by_id[np.concatenate([np.arange(a, e) for a, e in zip(
                        starts[top[p]], np.append(starts, len(by_id))[top[p] + 1], strict=True)])]
                    score = np.einsum("ij,j->i", anchors[at], q[p])
                    t = best(score, anchor_ids[at], k)
                    t = t[anchor_ids[at[t]] != ids[p]]
                    hits.append([{"vec_id": int(i), "score": float(x)} for i, x in zip(anchor_ids[at[t]], score[t], strict=True)])
                yield pa.RecordBatch.from_arrays([
                    *some.columns, pa.array(low), pa.array(list(to), pa.list_(pa.int32())), pa.array(hits, known)],
                    names=["vec_id", "v", "bound", "cells", "known"])

    known = pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.float64())]))
    queries = sound.where(asks).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = written(queries.mapInArrow(ask, "vec_id long, v array<double>, bound double, cells array<int>, "
                                            "known array<struct<vec_id:long,score:double>>"), "queries")
    to_lists = asked.select("vec_id", "v", "bound", F.explode("cells").alias("cell"))
    # cells are bounded by the sample, so the counts are a small table for all tasks
    x_lots = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("x_lots"))
    q_lots = to_lists.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("q_lots"))
    lots = F.broadcast(x_lots.join(q_lots, "cell"))
    lot = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.col(n)).cast("int")
    xs = rows.join(lots, "cell").select(
        "cell", lot("x_lots").alias("x_lot"), F.explode(F.sequence(F.lit(0), F.col("q_lots") - 1)).alias("q_lot"),
        "vec_id", "v", F.lit(None).cast("double").alias("bound"))
    qs = to_lists.join(lots, "cell").select(
        "cell", F.explode(F.sequence(F.lit(0), F.col("x_lots") - 1)).alias("x_lot"), lot("q_lots").alias("q_lot"),
        "vec_id", "v", "bound")
    turn = rotation(dims + 1)

    def compare(t: pa.Table) -> pa.Table:
        bound = t.column("bound").to_numpy()
        ids, m = t.column("vec_id").to_numpy(), matrix(t.column("v"), dims)
        ask_, have = np.flatnonzero(~np.isnan(bound)), np.flatnonzero(np.isnan(bound))
        found = scan(m[ask_], ids[ask_], bound[ask_], m[have], ids[have], most, turn, k) if len(ask_) and len(have) else []
        none = [np.empty(0, np.int64)]
        return pa.table({
            "query_id": pa.array(np.concatenate([np.full(len(r), ids[ask_[p]]) for p, r, _ in found] or none), pa.int64()),
            "vec_id": pa.array(np.concatenate([ids[have[r]] for _, r, _ in found] or none), pa.int64()),
            "score": pa.array(np.concatenate([s for _, _, s in found] or [np.empty(0)]), pa.float64())})

    hits = (xs.union(qs).groupBy("cell", "x_lot", "q_lot")
            .applyInArrow(compare, "query_id long, vec_id long, score double"))
    own = asked.select(F.col("vec_id").alias("query_id"), F.explode("known").alias("h")).select("query_id", "h.vec_id", "h.score")
    hits = hits.union(own).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _probes(rows: DataFrame, dims: int, queries: np.ndarray, ids: np.ndarray, centres: np.ndarray, most: float,
            k: int, recall: float) -> int:
    """Smallest number of probed lists with which the exact neighbours of
    ``queries`` over all rows are found to the share ``recall``."""
    turn_of = np.argsort(nearest(np.hstack([queries, np.zeros((len(queries), 1))]), centres, len(centres)), axis=1)

    def top(batches):
        keep = [(np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64)) for _ in queries]
        for b in batches:
            x_ids, cell = b.column(0).to_numpy(), b.column(2).to_numpy()
            s = matrix(b.column(1), dims) @ queries.T
            for p in range(len(queries)):
                other = np.flatnonzero(x_ids != ids[p])
                score, who, where = (np.concatenate(y) for y in zip(
                    keep[p], (s[other, p], x_ids[other], cell[other]), strict=True))
                t = best(score, who, k)
                keep[p] = score[t], who[t], where[t]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(np.arange(len(keep)), [len(s) for s, _, _ in keep]), pa.int64()),
            *[pa.array(np.concatenate(c), t) for c, t in zip(
                zip(*keep, strict=True), (pa.float64(), pa.int64(), pa.int64()), strict=True)]],
            names=["p", "score", "vec_id", "cell"])

    order = Window.partitionBy("p").orderBy(F.desc("score"), "vec_id")
    exact = (rows.mapInArrow(top, "p long, score double, vec_id long, cell long")
             .groupBy("p", "vec_id").agg(F.max("score").alias("score"), F.max_by("cell", F.struct("score", "cell")).alias("cell"))
             .withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select("p", "cell").collect())
    if not exact:
        return len(centres)
    need = np.sort([turn_of[r.p, r.cell] + 1 for r in exact])
    return int(need[min(len(need) - 1, math.ceil(recall * len(need)) - 1)])
