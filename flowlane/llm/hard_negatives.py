"""Hard negatives by coordinate pruning over length buckets.

Rows are whole-number vectors. They are dealt into buckets by length, longest first; a
bucket keeps its unit vectors and, for each coordinate, the list of its rows sorted by
that coordinate. A product of at least t with an anchor needs, in a bucket of largest
length l, a cosine of at least t / (|anchor| l). That leaves nothing of short buckets,
and of the others a feasible range of values in each coordinate. The anchor's focus
coordinates, its largest, give a range of a sorted list each; the shortest is read and
intersected with the others, and what is left is verified by the exact product.

Two searches run over the same buckets: the first finds each anchor's positives, its
best rows of the same label, the second the best rows of other labels inside the window
that each positive's score opens. The least products looked for come from a bounded
sample of the rows, so a search starts with a bound that real rows have reached.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlane.llm.common import hash_sample, ship, written
from flowlane.llm.integers import LONG, lots, meet, narrow, pack, products, quantised, sound
from flowlane.llm.vectors import lists, matrix

FOCUS = 5   # coordinates whose ranges are intersected
SLACK = 1e-5  # of the ranges, whose values are kept in single precision


def bucket(ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
    """The coordinate lists of one bucket's rows."""
    size = np.abs(x).max(axis=1, keepdims=True)
    unit = x / np.where(size > 0, size, 1)      # squares of very large values stay finite
    length = np.linalg.norm(unit, axis=1)
    unit = (unit / np.where(length > 0, length, 1)[:, None]).astype(np.float32)
    order = np.argsort(unit, axis=0, kind="stable").T.astype(np.int32)
    return {"ids": ids, "labels": labels, "x": narrow(x), "unit": unit, "order": order,
            "values": np.take_along_axis(unit.T, order, axis=1), "longest": np.array([(length * size[:, 0]).max()])}


def feasible(index: dict[str, np.ndarray], q: np.ndarray, least: int) -> np.ndarray | None:
    """Rows of the bucket whose product with ``q`` may be ``least`` or more; None: any."""
    size = np.abs(q).max()
    far = size * np.linalg.norm(q / size) * index["longest"][0] if size > 0 else 0.0
    if least <= 0 or not np.isfinite(far):
        return None
    if far * (1 + 1e-9) < least:
        return np.empty(0, np.int64)
    unit = q / size / np.linalg.norm(q / size)
    turn = np.arccos(min(1.0, least / far))     # largest angle to the anchor
    focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
    angle = np.arccos(np.clip(unit[focus], -1, 1))
    low, high = np.cos(np.minimum(np.pi, angle + turn)) - SLACK, np.cos(np.maximum(0.0, angle - turn)) + SLACK
    values = index["values"]
    ends = np.array([[np.searchsorted(values[f], a, "left"), np.searchsorted(values[f], b, "right")]
                     for f, a, b in zip(focus, low, high, strict=True)])
    first = int((ends[:, 1] - ends[:, 0]).argmin())
    rows = index["order"][focus[first], ends[first, 0]:ends[first, 1]]
    for f, a, b in zip(focus, low, high, strict=True):
        if f != focus[first] and len(rows):
            v = index["unit"][rows, f]
            rows = rows[(v >= a) & (v <= b)]
    return np.sort(rows)


class Verifier:
    """Exact products of a bucket's feasible rows."""

    def __init__(self, index: dict[str, np.ndarray]):
        self.index = index
        self.x = index["x"].astype(np.float64)
        self.most = np.abs(self.x).max(initial=0)

    def reaching(self, q: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, products) of the rows whose product with ``q`` is ``least`` or more."""
        rows = feasible(self.index, q, least)
        if rows is None or 4 * len(rows) > len(self.x):  # nearly all: as well in place
            rows = np.arange(len(self.x)) if rows is None else rows
            score = products(q[None, :], self.x, self.most)[0][rows]
        else:
            score = products(q[None, :], self.x[rows], self.most)[0]
        enough = score >= least
        return rows[enough], score[enough]


def best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to the smaller id."""
    if len(score) > 8 * k:
        some = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        return some[np.lexsort((ids[some], ~score[some]))][:k]
    return np.lexsort((ids, ~score))[:k]


def opened(score: np.ndarray, percent: int) -> np.ndarray:
    """The smallest whole number that is at least ``percent`` hundredths of each score."""
    return percent * (score // 100) - (-percent * (score % 100)) // 100


def positives(index: dict, lot: dict, k: int) -> tuple[np.ndarray, ...]:
    """(anchor, row id, product) of each anchor's best ``k`` rows of its own label."""
    seek, out = Verifier(index), []
    for own, label, least, q in zip(lot["ids"], lot["labels"], lot["least"], lot["q"].astype(np.float64), strict=True):
        rows, score = seek.reaching(q, int(least))
        same = (index["labels"][rows] == label) & (index["ids"][rows] != own)
        rows, score = rows[same], score[same]
        t = best(index["ids"][rows], score, k)
        out.append((np.full(len(t), own), index["ids"][rows[t]], score[t]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def negatives(index: dict, lot: dict, k: int) -> tuple[np.ndarray, ...]:
    """(anchor, place of the positive, row id, product) of the best ``k`` rows of other
    labels in each window (``least`` to ``high``); an absent one has least > high."""
    seek, out = Verifier(index), []
    none = np.empty(0, np.int64)
    for own, label, least, high, q in zip(lot["ids"], lot["labels"], lot["least"], lot["high"],
                                          lot["q"].astype(np.float64), strict=True):
        there = np.flatnonzero(least <= high)
        if not len(there):
            continue
        rows, score = seek.reaching(q, int(least[there].min()))
        other = (index["labels"][rows] != label) & (index["ids"][rows] != own)
        rows, score = rows[other], score[other]
        for w in there:
            inside = np.flatnonzero((score >= least[w]) & (score <= high[w]))
            t = inside[best(index["ids"][rows[inside]], score[inside], k)]
            out.append((np.full(len(t), own), np.full(len(t), w), index["ids"][rows[t]], score[t]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (none,) * 4


def mine(vectors: DataFrame, every: int = 100, n_positives: int = 5, k: int = 5, percent: int = 80, scale: float = 256,
         rows_a_bucket: int = 8192, lot: int = 512, sample: int = 4096,
         id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """For each anchor, a row whose id is divisible by ``every``, and each of its
    positives, the ``n_positives`` best other rows of its label: the ``k`` best rows of
    other labels that score from ``percent`` hundredths of the positive's score up to all
    of it. anchor_id, positive_id, rank, negative_id, positive_score, negative_score; a
    row's score is its inner product with the anchor, each component x taken as
    floor(``scale`` x); ties go to the smaller id.

    Exact: every bucket of about ``rows_a_bucket`` rows meets every lot of about ``lot``
    anchors; the sample of ``sample`` rows only gives first bounds. Rows with a null
    label and those that ``integers.sound`` leaves out take no part; labels are whole
    numbers. A repeated row is as many candidates; no row is a positive or negative of
    an anchor of its own id, and an anchor id that repeats is answered once, for its
    smallest row. Products beyond a long count as its end. Other columns are not read;
    an empty table gives no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows, dims = sound(vectors.where(F.col(f"`{label_col}`").isNotNull()), id_col, vector_col, label_col)
    if not dims:
        return spark.createDataFrame([], schema)

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = quantised(matrix(b.column(1), dims), scale)
            size = np.abs(x).max(axis=1)
            length = size * np.linalg.norm(x / np.where(size > 0, size, 1)[:, None], axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), lists(x), pa.array(length)],
                                             names=["vec_id", "label", "v", "length"])

    rows = rows.select("vec_id", "v", F.col(f"`{label_col}`").cast("long").alias("label")).mapInArrow(
        whole, "vec_id long, label long, v array<double>, length double")
    # rows of one length, copies above all, are told apart far below what a bucket's bound feels
    apart = F.shiftrightunsigned(F.xxhash64("vec_id", F.monotonically_increasing_id()), 11) * F.lit(2.0 ** -53)
    rows = written(rows.withColumn("place", F.col("length") * (1 + 1e-6 * apart) + 1e-3 * apart), "whole")
    n = rows.agg(F.count(F.lit(1)), F.count_if(F.col("vec_id") % every == 0)).head()
    if not n[1]:
        return spark.createDataFrame([], schema)
    n_buckets, n_lots = lots(n[0], rows_a_bucket), lots(n[1], lot)
    at = [i / n_buckets for i in range(1, n_buckets)]
    cuts = sorted(set(rows.approxQuantile("place", at, 0.1 / n_buckets))) if at else []
    n_buckets = len(cuts) + 1

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = len(cuts) - np.searchsorted(cuts, b.column(3).to_numpy(), side="right")  # longest first
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(at, pa.int32())], names=["vec_id", "label", "v", "block"])

    def lists_of(key: tuple, t: pa.Table) -> pa.Table:
        cell = pack(**bucket(t["vec_id"].to_numpy(), t["label"].to_numpy(), matrix(t["v"], dims)))
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "cell": pa.array([cell], pa.binary())})

    blocks = written(rows.select("vec_id", "label", "v", "place").mapInArrow(
        placed, "vec_id long, label long, v array<double>, block int")
        .groupBy("block").applyInArrow(lists_of, "block int, cell binary"), "coordinates")

    drawn = hash_sample(rows, F.xxhash64("vec_id", "v"), sample, "vec_id", "label", "v").select("vec_id", "label", "v").collect()
    s_ids, s_labels, s_x = (np.array([r[i] for r in drawn]) for i in range(3))

    def known(ids: np.ndarray, labels: np.ndarray, q: np.ndarray, same: bool) -> list[np.ndarray]:
        """For each anchor the sample's products with it, of rows that may be its
        positives (``same``) or negatives."""
        score = products(q, s_x)
        return [score[i, ((s_labels == label) == same) & (s_ids != own)]
                for i, (own, label) in enumerate(zip(ids, labels, strict=True))]

    def ask(key: tuple, t: pa.Table) -> pa.Table:
        order = np.argsort(t["vec_id"].to_numpy(), kind="stable")
        ids, labels = t["vec_id"].to_numpy()[order], t["label"].to_numpy()[order]
        q = matrix(t["v"], dims)[order]
        least = [np.partition(s, len(s) - n_positives)[len(s) - n_positives] if len(s) >= n_positives else LONG.min
                 for s in known(ids, labels, q, True)]
        cell = pack(ids=ids, labels=labels, q=narrow(q), least=np.array(least, np.int64))
        return pa.table({"lot": pa.array([key[0].as_py()], pa.int32()), "cell": pa.array([cell], pa.binary())})

    in_lot = F.pmod(F.xxhash64("vec_id"), F.lit(n_lots)).cast("int")
    anchors = written(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id")
                      .agg(F.min(F.struct("v", "label")).alias("r")).select("vec_id", "r.v", "r.label", in_lot.alias("lot")), "anchors")
    first = written(anchors.groupBy("lot").applyInArrow(ask, "lot int, cell binary"), "lots")
    hits = "anchor_id long, vec_id long, score long"

    def find_positives(a: dict, b: dict) -> pa.Table:
        return pa.table(dict(zip(("anchor_id", "vec_id", "score"), map(pa.array, positives(a, b, n_positives)), strict=True)))

    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    found = (meet(blocks, n_buckets, first, n_lots, find_positives, hits)
             .withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < n_positives))
    # at most n_positives rows of an anchor meet
    found = found.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("p"))
    found = written(found.join(anchors, F.col("anchor_id") == F.col("vec_id")).select(
        "vec_id", "v", "label", "lot", F.col("p.vec_id").alias("p_ids"), F.col("p.score").alias("p_scores")), "positives")

    def windows(key: tuple, t: pa.Table) -> pa.Table:
        ids, labels, q = t["vec_id"].to_numpy(), t["label"].to_numpy(), matrix(t["v"], dims)
        least, high = np.ones((len(ids), n_positives), np.int64), np.zeros((len(ids), n_positives), np.int64)
        for i, (s, p) in enumerate(zip(known(ids, labels, q, False), t["p_scores"].to_pylist(), strict=True)):
            high[i, :len(p)] = p
            least[i, :len(p)] = opened(high[i, :len(p)], percent)
            for w in range(len(p)):
                inside = s[(s >= least[i, w]) & (s <= high[i, w])]
                if len(inside) >= k:
                    least[i, w] = np.partition(inside, len(inside) - k)[len(inside) - k]
        cell = pack(ids=ids, labels=labels, q=narrow(q), least=least, high=high)
        return pa.table({"lot": pa.array([key[0].as_py()], pa.int32()), "cell": pa.array([cell], pa.binary())})

    second = written(found.select("vec_id", "v", "label", "p_scores", "lot").groupBy("lot")
                     .applyInArrow(windows, "lot int, cell binary"), "windows")

    def find_negatives(a: dict, b: dict) -> pa.Table:
        return pa.table({n: pa.array(c, pa.int32() if n == "place" else pa.int64()) for n, c in zip(
            ("anchor_id", "place", "vec_id", "score"), negatives(a, b, k), strict=True)})

    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), F.col("vec_id"))
    hits = (meet(blocks, n_buckets, second, n_lots, find_negatives, "anchor_id long, place int, vec_id long, score long")
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("anchor_id", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")))
    pairs = found.select(F.col("vec_id").alias("anchor_id"), F.posexplode(F.arrays_zip("p_ids", "p_scores")).alias("place", "p"))
    return hits.join(pairs, ["anchor_id", "place"]).select(
        "anchor_id", F.col("p.p_ids").alias("positive_id"), "rank", "negative_id",
        F.col("p.p_scores").alias("positive_score"), "negative_score")
