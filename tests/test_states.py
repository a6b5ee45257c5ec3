"""Stored partial states: merged figures equal direct ones."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from flowlane.operators import profiles as A
from flowlane.operators import states as S

COLUMNS = ["congestion_level", "traffic_volume", "avg_speed"]


def _store(obs, folder, parts=3):
    for k in range(parts):
        batch = S.partial_states(obs.where(F.col("event_id") % parts == k), COLUMNS)
        assert S.append_states(batch, folder, f"{k:04d}")
    return S.read_states(obs.sparkSession, folder)


def _same(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x.keys() == y.keys()
        for k in x:
            assert x[k] == (pytest.approx(y[k], rel=1e-9) if isinstance(y[k], float) else y[k]), k


def _rows(df, *by):
    return [r.asDict() for r in (df.orderBy(*by) if by else df).collect()]


def test_merged_states_equal_direct_figures(spark, obs001, tmpdir_path):
    states = _store(obs001, tmpdir_path)
    _same(_rows(S.band_of_states(states), "hour"), _rows(A.hourly_band(obs001), "hour"))
    _same(_rows(S.values_of_states(states), "value"), _rows(A.value_distribution(obs001), "value"))
    _same(_rows(S.summary_of_states(states)), _rows(A.summary_stats(obs001)))
    direct = {r["level"]: r["count"] for r in A.level_distribution(obs001).collect()}
    assert {r["level"]: r["count"] for r in S.levels_of_states(states).collect()} == {k: v for k, v in direct.items() if v}


def test_description_lies_in_the_sketch_bound(spark, obs001, tmpdir_path):
    exact = {r["column"]: r for r in A.describe(obs001, COLUMNS).collect()}
    got = S.describe_states(_store(obs001, tmpdir_path)).collect()
    assert {r["column"] for r in got} == set(COLUMNS)
    for r in got:
        for c in ("count", "mean", "std", "min", "max"):
            assert r[c] == pytest.approx(exact[r["column"]][c], rel=1e-9)
        values = sorted(float(v[0]) for v in obs001.select(r["column"]).collect())
        for q, p in (("q25", .25), ("q50", .5), ("q75", .75)):
            below, upto = sum(v < r[q] for v in values), sum(v <= r[q] for v in values)
            assert below / len(values) <= p + S.RANK_ERROR and upto / len(values) >= p - S.RANK_ERROR


def test_a_range_of_hours(spark, obs001, tmpdir_path):
    hour = F.date_trunc("hour", "timestamp")
    hours = sorted(r[0] for r in obs001.select(hour).distinct().collect())
    a, b = hours[len(hours) // 3], hours[2 * len(hours) // 3]
    cut = obs001.where((F.col("timestamp") >= F.lit(a)) & (F.col("timestamp") < F.lit(b)))
    states = _store(obs001, tmpdir_path).between(a, b)
    _same(_rows(S.summary_of_states(states)), _rows(A.summary_stats(cut)))
    _same(_rows(S.band_of_states(states), "hour"), _rows(A.hourly_band(cut), "hour"))


def test_deviations_do_not_cancel(spark, tmpdir_path):
    """Values far from zero, whose squares' sum has no digits left for the spread."""
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(hours=i % 5), "a", 1e9 + i % 7 * 1e-3) for i in range(500)]
    df = spark.createDataFrame(rows, "event_id long, timestamp timestamp, location string, congestion_level double")
    for k in range(2):
        S.append_states(S.partial_states(df.where(F.col("event_id") % 2 == k), ["congestion_level"]), tmpdir_path, str(k))
    got = S.describe_states(S.read_states(spark, tmpdir_path)).first()
    offsets = [v[3] - 1e9 for v in rows]
    mean = sum(offsets) / len(offsets)
    want = (sum((o - mean) ** 2 for o in offsets) / (len(offsets) - 1)) ** 0.5
    assert got["std"] == pytest.approx(want, rel=1e-3)


def test_a_batch_counts_once(spark, obs001, tmpdir_path, monkeypatch):
    with pytest.raises(FileNotFoundError):
        S.read_states(spark, tmpdir_path)
    batch = S.partial_states(obs001, COLUMNS)

    def stop(*args):
        raise RuntimeError("stopped before publishing")

    with monkeypatch.context() as m:
        m.setattr(S.published, "publish", stop)
        with pytest.raises(RuntimeError):
            S.append_states(batch, tmpdir_path, "a")
    assert S.append_states(batch, tmpdir_path, "a")
    assert not S.append_states(batch, tmpdir_path, "a")
    assert S.summary_of_states(S.read_states(spark, tmpdir_path)).first()["total_records"] == obs001.count()


def test_odd_rows(spark, tmpdir_path):
    """Nulls, NaN, rows without time or place, a column without values, no rows."""
    t = dt.datetime(2024, 1, 1, 5, 30)
    rows = [(t, "a", 1.0, None), (t, None, float("nan"), None), (None, "b", 3.0, None), (t, "a", None, None)]
    df = spark.createDataFrame(rows, "timestamp timestamp, location string, congestion_level double, avg_speed double")
    df = df.withColumn("traffic_volume", F.lit(2))
    states = S.partial_states(df, COLUMNS)
    one = S.summary_of_states(states).first()
    assert (one["total_records"], one["avg_congestion"], one["avg_speed"], one["locations"]) == (4, 2.0, None, 2)
    assert {r["column"]: r["count"] for r in S.describe_states(states).collect()} == {"congestion_level": 2, "traffic_volume": 4}
    assert S.summary_of_states(states.between(t.replace(minute=0), None)).first()["total_records"] == 3
    none = S.partial_states(df.limit(0), COLUMNS)
    assert S.summary_of_states(none).first()["total_records"] == 0 and S.describe_states(none).count() == 0
