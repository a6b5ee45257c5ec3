"""Exact top-k inner products over a bit-sliced index.

Every component x counts as floor(256 x). Rows are dealt into blocks; a block keeps, for
each component, the bitmaps of the bits of its quantised values (offset and step of the
component in that block), 64 rows to a machine word. A query's weights become signed
binary digits; each digit of each component adds that component's bitmaps, complemented
for a negative digit, at the digit's place. Carry-save adders turn all of them into the
bitmaps of one sum per row.

Going down from the most significant bitmap finds the k-th largest sum. What quantising
can have changed is bounded by norms, so every row whose sum reaches the k-th less that
bound may be among the top k, and no other row can. Those rows alone are scored by their
whole integers, which decides the boundary exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlane.llm.common import ship, written
from flowlane.llm.integers import dealt, lots, meet, narrow, pack, products, quantised, sound
from flowlane.llm.vectors import matrix

SLICES = 6         # bits kept of a component
WEIGHT_BITS = 8    # bits kept of a query's weight
HITS = "query_id long, vec_id long, score long"


def bitmaps(flags: np.ndarray) -> np.ndarray:
    """Rows of flags as rows of 64-bit words, the first flag the lowest bit."""
    words = -(-flags.shape[-1] // 64)
    out = np.zeros((*flags.shape[:-1], words * 8), np.uint8)
    packed = np.packbits(flags, axis=-1, bitorder="little")
    out[..., :packed.shape[-1]] = packed
    return out.view(np.uint64)


def positions(bitmap: np.ndarray, rows: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[:rows])


def count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def slices(x: np.ndarray) -> dict[str, np.ndarray]:
    """The index of one block of whole-number rows."""
    low = x.min(0)
    span = np.maximum(x.max(0) - low, 1)
    step = 2.0 ** np.maximum(0, np.ceil(np.log2(span + 1)) - SLICES)
    code = np.clip(np.floor((x - low) / step), 0, (1 << SLICES) - 1)
    centre = low + (step - 1) / 2               # of code 0's values
    lost = np.sqrt(((x - centre - code * step) ** 2).sum(1)).max()
    reach = np.sqrt(((code - ((1 << SLICES) - 1) / 2) ** 2).sum(1)).max()
    bits = (code.astype(np.uint32).T[:, None, :] >> np.arange(SLICES, dtype=np.uint32)[None, :, None]) & 1
    return {"slices": bitmaps(bits.astype(bool)), "centre": centre, "step": step, "bounds": np.array([lost, reach])}


def digits(w: np.ndarray) -> list[tuple[int, int, int]]:
    """(component, place, sign) of the signed binary digits of whole weights, no two of
    a weight next to each other."""
    out, place, w = [], 0, w.astype(np.int64)
    while w.any():
        d = np.where(w & 1, 2 - (w & 3), 0)
        out += [(int(j), place, int(d[j])) for j in np.flatnonzero(d)]
        w, place = (w - d) >> 1, place + 1
    return out


def add(addends: dict[int, np.ndarray], words: int) -> list[np.ndarray]:
    """Bitmaps of the sum of bitmaps given by place, lowest first."""
    planes, place, carried = [], 0, np.empty((0, words), np.uint64)
    last = max(addends, default=-1)
    while place <= last or len(carried):
        have, carries = np.concatenate([addends.get(place, carried[:0]), carried]), []
        while len(have) > 2:
            third = len(have) // 3
            a, b, c = have[:third], have[third:2 * third], have[2 * third:3 * third]
            odd = a ^ b
            carries.append((a & b) | (odd & c))
            have = np.concatenate([odd ^ c, have[3 * third:]])
        if len(have) == 2:
            carries.append(have[:1] & have[1:])
            have = have[:1] ^ have[1:]
        planes.append(have[0] if len(have) else np.zeros(words, np.uint64))
        carried = np.concatenate(carries) if carries else carried[:0]
        place += 1
    return planes


def kth_largest(planes: list[np.ndarray], live: np.ndarray, k: int) -> int:
    """The k-th largest sum among the ``live`` rows, of which there are k at least."""
    value = above = 0
    for plane in reversed(planes):
        ones = live & plane
        n = count(ones)
        value <<= 1
        if above + n >= k:
            live, value = ones, value | 1
        else:
            live, above = live & ~plane, above + n
    return value


def at_least(planes: list[np.ndarray], live: np.ndarray, value: int) -> np.ndarray:
    """The ``live`` rows whose sum is ``value`` or more."""
    if value >> len(planes):
        return np.zeros_like(live)
    more, same = np.zeros_like(live), live
    for place in reversed(range(len(planes))):
        if value >> place & 1:
            same = same & planes[place]
        else:
            more, same = more | (same & planes[place]), same & ~planes[place]
    return more | same


def candidates(index: dict[str, np.ndarray], q: np.ndarray, live: np.ndarray, k: int) -> np.ndarray:
    """A bitmap of the ``live`` rows that may be among the k with the largest products
    with ``q``; all that reach the k-th product are among them."""
    if count(live) <= k:
        return live
    stack, centre, step = index["slices"], index["centre"], index["step"]
    lost, reach = index["bounds"]
    full = (1 << SLICES) - 1
    size = np.abs(q) @ (np.abs(centre) + step * full)
    if not size < 2.0 ** 62:  # a product may be beyond a long, where rows tie that do not here
        return live
    weight = q * step
    unit = max(np.abs(weight).max() / (1 << WEIGHT_BITS), np.finfo(float).tiny)
    w = np.round(weight / unit)
    by_place: dict[int, list] = {}
    for j, place, sign in digits(w):
        for s in range(SLICES):
            by_place.setdefault(place + s, []).append((j, s, sign))
    addends = {}
    for place, some in by_place.items():
        j, s, sign = np.array(some).T
        addends[place] = stack[j, s] ^ np.where(sign < 0, ~np.uint64(0), np.uint64(0))[:, None]
    planes = add(addends, len(live))
    # sum = product - constant, in units; what both roundings can add to a row's product
    error = np.linalg.norm(q) * lost + np.linalg.norm(weight - unit * w) * reach
    slack = 2 * (error * (1 + 1e-9) + 1e-9 * size) / unit + 1
    least = kth_largest(planes, live, k) - slack
    return at_least(planes, live, max(0, int(np.ceil(least))) if least > 0 else 0)


def top(block: dict[str, np.ndarray], q_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query id, row id, product) of each query's k largest products in the block, ties
    to the smaller id. Rows of a query's own id are none of them."""
    x, ids = block["x"].astype(np.float64), block["ids"]
    every = bitmaps(np.ones(len(ids), bool))
    by_id = np.argsort(ids, kind="stable")
    left, right = (np.searchsorted(ids[by_id], q_ids, side=s) for s in ("left", "right"))
    out = []
    for i, (own, row) in enumerate(zip(q_ids, q, strict=True)):
        live = every
        if left[i] < right[i]:
            other = np.ones(len(ids), bool)
            other[by_id[left[i]:right[i]]] = False
            live = bitmaps(other)
        at = positions(candidates(block, row, live, k), len(ids))
        score = products(row[None, :], x[at])[0]
        best = np.lexsort((ids[at], ~score))[:k]  # ~ turns longs around without overflow
        out.append((np.full(len(best), own), ids[at[best]], score[best]))
    return tuple(np.concatenate(c) if out else np.empty(0, np.int64) for c in zip(*out, strict=True))


def search(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256, block: int = 16_384, lot: int = 512,
           id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` rows with the largest integer inner products with each row whose id is
    divisible by ``every``: query_id, rank, vec_id, score (long).

    Exact: all rows are in blocks of about ``block`` rows, and every block meets every
    lot of about ``lot`` queries. Which rows take part: see ``integers.sound``. A repeated
    row is as many candidates; no row is a candidate of a query of its own id, and a
    query id that repeats is answered once, for its smallest vector. Ties go to the
    smaller id. Products beyond a long count as its end. Other columns are not read; an
    empty table gives no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows, dims = sound(vectors, id_col, vector_col)
    schema = "query_id long, rank int, vec_id long, score long"
    if not dims:
        return spark.createDataFrame([], schema)
    ask = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    n = rows.agg(F.count(F.lit(1)), F.count_if(F.col("vec_id") % every == 0)).head()
    n_blocks, n_lots = lots(n[0], block), lots(n[1], lot)

    def index(key: tuple, t: pa.Table) -> pa.Table:
        x = quantised(matrix(t["v"], dims), scale)
        cell = pack(ids=t["vec_id"].to_numpy(), x=narrow(x), **slices(x))
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "cell": pa.array([cell], pa.binary())})

    def together(key: tuple, t: pa.Table) -> pa.Table:
        order = np.argsort(t["vec_id"].to_numpy(), kind="stable")
        q = quantised(matrix(t["v"], dims), scale)[order]
        cell = pack(ids=t["vec_id"].to_numpy()[order], q=narrow(q))
        return pa.table({"lot": pa.array([key[0].as_py()], pa.int32()), "cell": pa.array([cell], pa.binary())})

    blocks = written(rows.withColumn("block", dealt(n_blocks)).groupBy("block")
                     .applyInArrow(index, "block int, cell binary"), "slices")
    queries = written(ask.withColumn("lot", F.pmod(F.xxhash64("vec_id"), F.lit(n_lots)).cast("int")).groupBy("lot")
                      .applyInArrow(together, "lot int, cell binary"), "queries")

    def compare(a: dict, b: dict) -> pa.Table:
        found = top(a, b["ids"], b["q"].astype(np.float64), k)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, found), strict=True)))

    hits = meet(blocks, n_blocks, queries, n_lots, compare, HITS)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
