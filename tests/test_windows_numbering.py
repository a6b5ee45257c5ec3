"""Skew-safe plans give the same answer as the straightforward ones."""

import datetime as dt
import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowlane.operators import windows as W
from flowlane.operators.numbering import global_row_number
from flowlane.operators.quantiles import exact_quantiles


def _skewed(spark, n=3000, seed=1):
    rng = np.random.default_rng(seed)
    # one location holds a third of all rows
    locs = np.where(rng.random(n) < 1 / 3, "HOT", rng.choice(["A", "B", "C", "D"], n))
    t0 = dt.datetime(2024, 1, 1)
    ts = [t0 + dt.timedelta(seconds=int(s)) for s in rng.integers(0, 30 * 86400, n)]
    pdf = pd.DataFrame({"event_id": np.arange(n), "timestamp": ts, "location": locs,
                        "traffic_volume": rng.integers(0, 1500, n).astype("int32"),
                        "avg_speed": rng.integers(5, 90, n).astype("int32"),
                        "congestion_level": np.round(rng.random(n) * 3, 2)})
    return spark.createDataFrame(pdf), pdf


def _rows(df, cols):
    return sorted(tuple(None if (isinstance(x, float) and np.isnan(x)) else
                        (round(x, 9) if isinstance(x, float) else x) for x in r)
                  for r in df.select(*cols).collect())


def test_global_row_number_matches_window(spark):
    df, _ = _skewed(spark)
    got = global_row_number(df, ["location", "timestamp", "event_id"], "rn", num_partitions=7)
    want = df.withColumn("rn", F.row_number().over(Window.orderBy("location", "timestamp", "event_id")))
    assert _rows(got, ["event_id", "rn"]) == _rows(want, ["event_id", "rn"])


@pytest.mark.parametrize("chunk", [25, 64, 1000])
def test_chunked_equals_plain(spark, chunk):
    df, _ = _skewed(spark)
    a = W.rolling_features(W.lag_features(df, strategy="plain"), strategy="plain")
    b = W.rolling_features(W.lag_features(df, strategy="chunked", chunk_rows=chunk),
                           strategy="chunked", chunk_rows=chunk)
    cols = sorted(c for c in a.columns if "_lag_" in c or "_rolling_" in c)
    assert _rows(a, ["event_id"] + cols) == _rows(b, ["event_id"] + cols)
    ta = W.congestion_trend(df, strategy="plain")
    tb = W.congestion_trend(df, strategy="chunked", chunk_rows=chunk)
    cols = ["event_id", "congestion_trend", "congestion_acceleration"]
    assert _rows(ta, cols) == _rows(tb, cols)


def test_default_plan_equals_plain(spark):
    df, _ = _skewed(spark)
    a = W.lag_features(df, lags=[1, 24], chunk_rows=50)
    b = W.lag_features(df, lags=[1, 24], strategy="plain")
    cols = ["event_id", "traffic_volume_lag_1h", "traffic_volume_lag_24h"]
    assert _rows(a, cols) == _rows(b, cols)


def test_rolling_matches_pandas_per_location(spark):
    df, pdf = _skewed(spark, n=800)
    out = W.rolling_features(df, columns=["traffic_volume"], windows=[6]).toPandas()
    p = pdf.sort_values(["location", "timestamp", "event_id"])
    g = p.groupby("location")["traffic_volume"]
    p["m"] = g.transform(lambda s: s.rolling(6, min_periods=1).mean())
    p["s"] = g.transform(lambda s: s.rolling(6, min_periods=1).std()).fillna(0)
    m = out.merge(p[["event_id", "m", "s"]], on="event_id")
    assert np.allclose(m["traffic_volume_rolling_mean_6h"], m["m"])
    assert np.allclose(m["traffic_volume_rolling_std_6h"], m["s"])


def test_frame_order_matches_pandas(spark):
    df, pdf = _skewed(spark, n=700)
    out = W.rolling_features(df, columns=["avg_speed"], windows=[3], partition_by=None,
                             chunk_rows=40).toPandas()
    p = pdf.sort_values(["timestamp", "event_id"]).copy()
    p["m"] = p["avg_speed"].rolling(3, min_periods=1).mean()
    m = out.merge(p[["event_id", "m"]], on="event_id")
    assert np.allclose(m["avg_speed_rolling_mean_3h"], m["m"])


@pytest.mark.parametrize("block_us", [None, W.HOUR_US, W.HOUR_US // 4, W.HOUR_US // 64])
def test_rolling_time_matches_bruteforce(spark, block_us):
    df, pdf = _skewed(spark, n=600)
    # duplicate instants: peers at t are inside the window, t - k h is not
    dup = pdf.iloc[:40].copy()
    dup["event_id"] += 10_000
    dup["timestamp"] = pdf["timestamp"].iloc[40:80].values
    dup["location"] = pdf["location"].iloc[40:80].values
    edge = pdf.iloc[80:100].copy()
    edge["event_id"] += 20_000
    edge["timestamp"] = pdf["timestamp"].iloc[100:120].values - np.timedelta64(3, "h")
    edge["location"] = pdf["location"].iloc[100:120].values
    pdf = pd.concat([pdf, dup, edge], ignore_index=True)
    df = spark.createDataFrame(pdf)
    out = W.rolling_time(df, columns=["traffic_volume"], hours=[3, 24],
                         block_us=block_us).toPandas()
    assert len(out) == len(pdf)
    res = {}
    for _loc, g in pdf.groupby("location"):
        t = g["timestamp"].values
        v = g["traffic_volume"].values
        for i, eid in enumerate(g["event_id"].values):
            for k in (3, 24):
                mask = (t > t[i] - np.timedelta64(k, "h")) & (t <= t[i])
                res[(eid, k)] = (v[mask].mean(), int(mask.sum()), v[mask].max(), v[mask].min())
    for _, r in out.iterrows():
        for k in (3, 24):
            mean, cnt, mx, mn = res[(r["event_id"], k)]
            assert r[f"traffic_volume_time_count_{k}h"] == cnt
            assert np.isclose(r[f"traffic_volume_time_mean_{k}h"], mean)
            assert r[f"traffic_volume_time_max_{k}h"] == mx
            assert r[f"traffic_volume_time_min_{k}h"] == mn


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    vals = np.concatenate([rng.normal(0, 1, 500), np.full(300, 2.5), rng.integers(-5, 5, 200)])
    pdf = pd.DataFrame({"x": vals, "k": np.full(len(vals), 7.0), "z": [None] * len(vals)})
    df = spark.createDataFrame(pdf, "x double, k double, z double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    for kw in ({"buckets": 16}, {}):
        q = exact_quantiles(df, ["x", "k", "z"], probs, **kw)
        assert np.allclose(q["x"], np.quantile(vals, probs))
        assert q["k"] == [7.0] * len(probs)
        assert q["z"] == [None] * len(probs)


def test_exact_quantiles_of_wide_and_odd_values(spark):
    # powers from 1e-200 to 1e200 of both signs, infinities, NaN (as null)
    odd = [1e-200, 1e200, -1e-200, -1e200, 0.0, 5e-324, 1.7e308, -1.7e308, float("inf"), float("-inf"), 1.0, 1.0]
    ids = [2 ** 60 + k for k in range(12)]
    rows = list(zip(odd + [float("nan"), None], ids + [None, 2 ** 62], strict=True))
    df = spark.createDataFrame(rows, "x double, i long")
    from flowlane.operators.quantiles import order_statistics
    got = order_statistics(df, [("x", k) for k in range(12)] + [("i", k) for k in range(13)])
    assert [got["x", k] for k in range(12)] == sorted(odd)
    assert [got["i", k] for k in range(13)] == sorted(ids) + [2 ** 62]
    rng = np.random.default_rng(4)
    wide = rng.normal(size=400) * 10.0 ** rng.integers(-200, 200, 400)
    df = spark.createDataFrame(pd.DataFrame({"x": wide}))
    assert order_statistics(df, [("x", k) for k in (0, 57, 200, 399)], 64) == {
        ("x", k): np.sort(wide)[k] for k in (0, 57, 200, 399)}


def test_bins_and_split_with_ids_beyond_2_53(spark):
    from flowlane.operators.transforms import stratified_split
    df = spark.range(1000).select((F.col("id") + 2 ** 60).alias("event_id"), F.lit(1.5).alias("congestion_level"))
    bins = W.quantile_bins(df, "congestion_level").groupBy("bin").count().collect()
    assert sorted(r["count"] for r in bins) == [100] * 10
    parts = {r["split"]: r["count"] for r in stratified_split(df).groupBy("split").count().collect()}
    assert parts == {"test": 200, "validation": 100, "train": 700}


def test_approx_switch_close_to_exact(spark):
    from flowlane.operators.quantiles import quantiles
    rng = np.random.default_rng(5)
    vals = rng.normal(10, 3, 5000)
    df = spark.createDataFrame(pd.DataFrame({"x": vals}))
    exact = quantiles(df, ["x"], [0.25, 0.5, 0.75])["x"]
    approx = quantiles(df, ["x"], [0.25, 0.5, 0.75], accuracy=10000)["x"]
    assert np.allclose(exact, np.quantile(vals, [0.25, 0.5, 0.75]))
    for p, a in zip([0.25, 0.5, 0.75], approx):
        rank = (vals <= a).mean()
        assert abs(rank - p) <= 1e-3 + 1 / 5000


def test_rolling_time_nulls_match_range_frame(spark):
    # null values are skipped by every statistic; rows without a timestamp
    # see the other untimed rows of their location (RANGE peers), as in a
    # plain RANGE frame
    df, _pdf = _skewed(spark, n=400, seed=7)
    df = df.withColumns({
        "traffic_volume": F.when(F.col("event_id") % 9 != 0, F.col("traffic_volume")),
        "timestamp": F.when(F.col("event_id") % 17 != 0, F.col("timestamp")),
    })
    got = W.rolling_time(df, columns=["traffic_volume"], hours=[3], block_us=W.HOUR_US // 4)
    e = W.epoch_micros("timestamp")
    w = Window.partitionBy("location").orderBy(e).rangeBetween(-(3 * W.HOUR_US - 1), 0)
    c = F.col("traffic_volume")
    want = df.select("event_id", F.avg(c).over(w).alias("m"), F.max(c).over(w).alias("x"),
                     F.min(c).over(w).alias("n"), F.count(c).over(w).alias("k"))
    got = got.select("event_id", F.col("traffic_volume_time_mean_3h").alias("m"),
                     F.col("traffic_volume_time_max_3h").alias("x"),
                     F.col("traffic_volume_time_min_3h").alias("n"),
                     F.col("traffic_volume_time_count_3h").alias("k"))
    assert _rows(got, ["event_id", "m", "x", "n", "k"]) == _rows(want, ["event_id", "m", "x", "n", "k"])


def test_rolling_time_of_rows_without_a_key(spark):
    df, _ = _skewed(spark, n=300, seed=9)
    null = W.rolling_time(df.withColumn("location", F.lit(None).cast("string")), ["traffic_volume"], [3])
    one = W.rolling_time(df.withColumn("location", F.lit("x")), ["traffic_volume"], [3])
    cols = ["event_id", "traffic_volume_time_mean_3h", "traffic_volume_time_count_3h", "traffic_volume_time_max_3h"]
    assert _rows(null, cols) == _rows(one, cols)


def test_time_block_fits_density(spark):
    df, pdf = _skewed(spark, n=600)
    hours = pdf["timestamp"].dt.floor("h")
    densest = int(pdf.groupby([pdf["location"], hours]).size().max())
    assert W.time_block_us(df, "location", max_block_rows=densest) == W.HOUR_US
    assert W.time_block_us(df, "location", max_block_rows=max(1, (densest - 1) // 2)) <= W.HOUR_US // 2
    # down to single instants
    assert W.time_block_us(df, "location", max_block_rows=0) == 1


def jobs_of(spark, run):
    """Spark jobs that ``run`` starts."""
    sc = spark.sparkContext
    group = f"counted {uuid.uuid4()}"
    sc.setJobGroup(group, group)
    try:
        run()
        return len(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


@pytest.fixture(scope="module")
def spread(spark):
    rng = np.random.default_rng(7)
    n = 40_000
    x = rng.normal(size=n)
    x[::3] = 0.25
    rows = [(i, float(x[i]), int(x[i] * 10), float("nan") if i % 5 == 0 else float(i % 11), (1 << 60) + i, None if i % 2 else float("inf"))
            for i in range(n)]
    return spark.createDataFrame(rows, "event_id long, x double, k int, z double, b long, e double").repartition(7).cache(), rows


@pytest.mark.parametrize("inside", [1 << 17, 3])
def test_two_scans_equal_sorting_with_and_without_refinement(spark, spread, monkeypatch, inside):
    from flowlane.operators import quantiles as Q
    df, rows = spread
    monkeypatch.setattr(Q, "INSIDE", inside)
    for c, at in (("x", 1), ("k", 2), ("z", 3), ("b", 4), ("e", 5)):
        want = sorted(r[at] for r in rows if r[at] is not None and r[at] == r[at])
        ranks = sorted({0, 1, len(want) // 4, len(want) // 2, len(want) // 2 + 1, len(want) - 1, len(want)})
        got = Q.select_ranks(df, [(c, k) for k in ranks])
        for k in ranks:
            value, below, same = got[c, k]
            if k == len(want):
                assert value is None
                continue
            assert value == want[k] and below <= k
            if same is not None:
                assert below == sum(w < want[k] for w in want) and same == want.count(want[k])


def test_a_rank_outside_its_bracket_is_still_found(spark, spread):
    from flowlane.operators import quantiles as Q
    df, rows = spread
    want = sorted(r[1] for r in rows)
    ids = sorted(r[4] for r in rows)
    n = len(want)
    got = Q.select_ranks(df, [("x", 5), ("x", n // 2 + 9), ("x", n - 2), ("b", 17)], brackets={
        ("x", 5): (2.0, 2.1), ("x", n // 2 + 9): (-9.0, -8.0), ("x", n - 2): (0.2, 0.3), ("b", 17): (ids[-2], ids[-1])})
    assert {key: v[0] for key, v in got.items()} == {
        ("x", 5): want[5], ("x", n // 2 + 9): want[n // 2 + 9], ("x", n - 2): want[n - 2], ("b", 17): ids[17]}


def test_quantiles_and_draws_take_two_jobs_and_their_stages(spark, spread):
    from flowlane.operators import profiles as P
    from flowlane.operators.transforms import fit_iqr_bounds
    df, _ = spread
    assert jobs_of(spark, lambda: P.describe(df, ["x", "k", "z", "b"])) <= 6
    assert jobs_of(spark, lambda: fit_iqr_bounds(df, ["x", "k", "z"])) <= 6
    assert jobs_of(spark, lambda: P.sample_exact(df, 5000)) <= 6


def test_uniform_brackets_hold():
    from flowlane.operators.quantiles import uniform_bracket
    rng = np.random.default_rng(1)
    for n in (1, 2, 50, 5000):
        for _ in range(40):
            u = np.sort(rng.random(n))
            for k in {0, n // 5, n - 1}:
                lo, hi = uniform_bracket(k, n)
                assert 0 <= lo <= u[k] <= hi <= 1


def test_chunks_move_full_rows_once(spark):
    """One exchange, one sort and one window node for the rows, cut or not, and no
    checkpoint of them."""
    df, _ = _skewed(spark, 2000)
    for chunk_rows in (50, 1_000_000):
        out = W.rolling_features(df, chunk_rows=chunk_rows)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(location") == 1
        assert plan.count("Window [") == 1
        assert plan.count("Sort [location") == 1
    assert W.key_cuts(df, F.col("location"), ["timestamp", "event_id"], 23, 1_000_000) is None


def test_cuts_bound_every_chunk(spark):
    df, _ = _skewed(spark, 3000)
    cuts = W.key_cuts(df, F.col("location"), ["timestamp", "event_id"], 24, 100).toPandas()
    assert (cuts.groupby("_ck")._cut.count() == cuts.groupby("_ck")._cut.max() + 1).all()
    sizes = df.groupBy("location").count().toPandas().set_index("location")["count"]
    for k, g in cuts.groupby("_ck"):
        assert len(g) == -(-sizes[k] // 100)
    out = W._apply_windows(df, [lambda spec: [("n", F.count(F.lit(1)).over(spec))]], "location", ["timestamp", "event_id"], 24,
                           chunk_rows=100)
    assert out.agg(F.max("n")).first()[0] <= 124 and out.count() == df.count()


def test_chunks_of_rows_without_key_or_time(spark):
    rows = [(i, None if i % 2 else "A", None if i % 7 == 0 else dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i // 5), float(i % 13))
            for i in range(400)]
    df = spark.createDataFrame(rows, "event_id long, location string, timestamp timestamp, traffic_volume double")
    a = W.lag_features(df, ["traffic_volume"], [1, 3], strategy="plain").orderBy("event_id").collect()
    b = W.lag_features(df, ["traffic_volume"], [1, 3], chunk_rows=20).orderBy("event_id").collect()
    assert a == b
