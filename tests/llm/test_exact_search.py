"""Bit-sliced top-k and hard negatives against brute force in Python's integers."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlane.llm import bitslice, catalog, hard_negatives, integers

DIMS = 8


@pytest.fixture(scope="module")
def vectors(spark):
    """Clusters, a vector that a third of the rows share, unusable vectors, zero vectors,
    null and repeated ids and labels, and columns whose names clash."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=(12, DIMS))
    rows = []
    for i in range(600):
        b = base[i % 12] * rng.uniform(0.05, 0.6) + rng.normal(size=DIMS) * 0.02 * (i % 5)
        rows.append((i if i % 97 else None, [float(x) for x in b.astype(np.float32)], i % 7 if i % 31 else None))
    rows += [(1000 + i, rows[3][1], i % 3) for i in range(300)]
    rows += [(2000, None, 1), (2100, [], 1), (2200, [0.0] * DIMS, 1), (2250, [0.0] * DIMS, 2), (2300, [float("nan")] + [1.0] * (DIMS - 1), 1),
             (2400, [None] + [1.0] * (DIMS - 1), 1), (2500, [1.0, 2.0], 1), (2600, [float("inf")] * DIMS, 1),
             (100, rows[5][1], 4), (200, rows[200][1], rows[200][2]), (3, rows[3][1], 3), (3, rows[4][1], 2)]
    return (spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
            .withColumns({c: F.lit("x") for c in ("v", "block", "lot", "cell", "score", "rank", "place", "length")}))


def whole(r):
    e = r.embedding
    if r.vec_id is None or e is None or len(e) != DIMS or not all(x is not None and math.isfinite(x) for x in e):
        return None
    return [math.floor(256 * x) for x in e]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True))


def brute_top(rows, k, every):
    rows = [(r.vec_id, whole(r), r.embedding) for r in rows if whole(r)]
    out = []
    for i in {i for i, _, _ in rows if i % every == 0}:
        q = min((list(e), x) for j, x, e in rows if j == i)[1]
        best = sorted((-dot(q, x), j) for j, x, _ in rows if j != i)[:k]
        out += [(i, n, j, -s) for n, (s, j) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("block, lot", [(16_384, 512), (100, 4)])
def test_top_k_is_exact(vectors, block, lot):
    got = sorted(map(tuple, bitslice.search(vectors, k=6, block=block, lot=lot).collect()))
    assert got == brute_top(vectors.collect(), 6, 50)


def brute_mining(rows):
    rows = [(r.vec_id, whole(r), r.label) for r in rows if whole(r) and r.label is not None]
    out = []
    for i in {i for i, _, _ in rows if i % 100 == 0}:
        _, q, label = min((x, x, lb) for j, x, lb in rows if j == i)
        scored = sorted((-dot(q, x), j, lb) for j, x, lb in rows if j != i)
        for ps, p, _ in [s for s in scored if s[2] == label][:5]:
            inside = [s for s in scored if s[2] != label and -80 * ps <= -100 * s[0] <= -100 * ps][:5]
            out += [(i, p, n, j, -ps, -s) for n, (s, j, _) in enumerate(inside, 1)]
    return sorted(out)


@pytest.mark.parametrize("rows_a_bucket, lot, sample", [(8192, 512, 4096), (90, 2, 50)])
def test_hard_negatives_are_exact(vectors, rows_a_bucket, lot, sample):
    got = sorted(map(tuple, hard_negatives.mine(vectors, rows_a_bucket=rows_a_bucket, lot=lot, sample=sample).collect()))
    want = brute_mining(vectors.collect())
    assert got == want and len(want) > 20


def test_nothing_to_search(vectors):
    for some in (vectors.limit(0), vectors.where("vec_id in (2000, 2300)"), vectors.where("vec_id = 7")):
        assert bitslice.search(some).count() == 0
        assert hard_negatives.mine(some).count() == 0
    assert hard_negatives.mine(vectors.withColumn("label", F.lit(None).cast("int"))).count() == 0


def test_products_beyond_a_long(spark):
    rows = [(50, [1e300, -1e300], 1), (1, [1e300, 1.0], 1), (2, [1.0, 1e200], 2), (3, [1e12, 3.0], 1), (4, [1e308, -1e308], 2),
            (5, [1.7e308, 0.0], 2), (100, [-1e250, 1e15], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    ends = {i: [min(max(int(np.nan_to_num(np.floor(256 * np.float64(x)))), -10**400), 10**400) for x in v] for i, v, _ in rows}
    long = lambda n: max(-(1 << 63), min((1 << 63) - 1, n))
    want = []
    with np.errstate(over="ignore"):
        for i in (50, 100):
            best = sorted((-long(dot(ends[i], x)), j) for j, x in ends.items() if j != i)[:5]
            want += [(i, n, j, -s) for n, (s, j) in enumerate(best, 1)]
    assert sorted(map(tuple, bitslice.search(df).collect())) == want
    assert hard_negatives.mine(df).count() >= 0


@pytest.mark.parametrize("spread", [3, 60, 900, 1e6])
def test_bitmaps_keep_every_top_row(spread):
    rng = np.random.default_rng(int(spread))
    x = np.floor(rng.normal(size=(700, 24)) * spread)
    x[100:160] = x[5]
    index = bitslice.slices(x)
    live = bitslice.bitmaps(np.ones(len(x), bool))
    for q in np.floor(rng.normal(size=(20, 24)) * spread):
        kept = bitslice.positions(bitslice.candidates(index, q, live, 9), len(x))
        score = x @ q
        assert set(np.flatnonzero(score >= np.sort(score)[-9])) <= set(kept)
        assert len(kept) < len(x)


def test_bit_sliced_sums_and_selection():
    rng = np.random.default_rng(5)
    numbers = rng.integers(0, 50, (13, 200))
    addends = {s: np.array([bitslice.bitmaps((n >> s & 1).astype(bool)) for n in numbers]) for s in range(6)}
    live = bitslice.bitmaps(np.ones(200, bool))
    planes = bitslice.add(addends, len(live))
    total = numbers.sum(0)
    got = sum(np.isin(np.arange(200), bitslice.positions(p, 200)).astype(int) << i for i, p in enumerate(planes))
    assert np.array_equal(got, total)
    for k in (1, 7, 200):
        value = bitslice.kth_largest(planes, live, k)
        assert value == np.sort(total)[-k]
        assert bitslice.positions(bitslice.at_least(planes, live, value), 200).tolist() == np.flatnonzero(total >= value).tolist()
    w = rng.integers(-256, 257, 40)
    back = np.zeros(40, int)
    for j, place, sign in bitslice.digits(w):
        back[j] += sign << place
    assert np.array_equal(back, w)


def test_feasible_ranges_keep_every_row_that_reaches():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 16))
    x = np.floor(x / np.linalg.norm(x, axis=1, keepdims=True) * rng.uniform(240, 260, (500, 1)))
    x[::50] = 0
    index = hard_negatives.bucket(np.arange(500), np.zeros(500, np.int64), x)
    pruned = 0
    for q in np.floor(x[::9] * 1.1):
        score = x @ q
        for least in (-5, 0, 1, int(score.max() * 0.5), int(score.max() * 0.9), int(score.max()), int(score.max()) + 1):
            rows = hard_negatives.feasible(index, q, least)
            have = set(range(500)) if rows is None else set(rows.tolist())
            assert set(np.flatnonzero(score >= least).tolist()) <= have
            pruned += len(have) < 250
    assert pruned > 100


def test_opened_windows():
    s = np.array([0, 1, 4, 5, 7, 99, 100, 101, 12345, -7, -100, -101, (1 << 63) - 1, -(1 << 63)])
    for percent in (80, 33, 100, 0):
        assert hard_negatives.opened(s, percent).tolist() == [-(-percent * int(x) // 100) for x in s]


def test_exact_products():
    rng = np.random.default_rng(8)
    for size in (10.0, 1e7, 1e12):
        q, x = np.floor(rng.normal(size=(3, 5)) * size), np.floor(rng.normal(size=(4, 5)) * size)
        want = [[max(-(1 << 63), min((1 << 63) - 1, dot(list(map(int, a)), list(map(int, b))))) for b in x] for a in q]
        assert integers.products(q, x).tolist() == want


def test_labels_of_the_query(spark):
    """The registered query changes the label of ids divisible by 7."""
    df = spark.createDataFrame([(i, i % 10) for i in range(0, 30)] + [(35, None)], "vec_id long, label int")
    got = Counter(r.label == (r.vec_id % 10 + (r.vec_id % 7 == 0)) % 10 for r in catalog.relabelled(df).collect() if r.label is not None)
    assert got == {True: 30}
