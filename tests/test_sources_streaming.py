"""Sources / sinks round trips and streaming == batch."""

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from flowlane.operators import models as M
from flowlane.operators import transforms as T
from flowlane.schema import OBSERVATION_COLUMNS
from flowlane.sources import io
from flowlane.streaming.live import live_location_summary


def test_observation_csv_roundtrip(spark, obs001, tmpdir_path):
    path = os.path.join(tmpdir_path, "obs_csv")
    src = obs001.select(*OBSERVATION_COLUMNS)
    io.write_observations(src, path, fmt="csv", partition_by=None)
    back = io.read_observations(spark, path, fmt="csv")
    assert back.schema.names == OBSERVATION_COLUMNS
    assert back.count() == src.count()
    assert back.subtract(src).count() == 0


def test_partitioned_parquet_prunes(spark, obs001, tmpdir_path):
    path = os.path.join(tmpdir_path, "obs_pq")
    io.write_observations(obs001, path)
    df = spark.read.parquet(path).filter(F.col("location") == "Downtown")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "Downtown" in plan
    assert df.count() == obs001.filter(F.col("location") == "Downtown").count()


def test_missing_path_raises(spark, tmpdir_path):
    with pytest.raises(AnalysisException):
        io.read_observations(spark, os.path.join(tmpdir_path, "nope"), fmt="csv").count()


def test_requests_json(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "req.json")
    with open(p, "w") as f:
        json.dump({"inputs": [{"hour": 17, "traffic_volume": "850", "weather_condition": "Rainy"},
                              {"hour": "x"}]}, f)
    df = io.read_requests(spark, p)
    rows = df.orderBy("input_pos").collect()
    assert [r["model"] for r in rows] == ["ensemble", "ensemble"]
    assert rows[0]["traffic_volume"] == "850"
    bad = os.path.join(tmpdir_path, "bad.json")
    with open(bad, "w") as f:
        json.dump({"model": "xgboost"}, f)
    with pytest.raises(ValueError):
        io.read_requests(spark, bad)


def test_metrics_and_models_roundtrip(spark, obs001, tmpdir_path):
    from flowlane.plans.training import PreprocessState, train_all
    r = train_all(obs001, models=("linear_regression", "random_forest"), rf_trees=5, rf_depth=4,
                  engineer=False)
    mpath = os.path.join(tmpdir_path, "metrics")
    io.write_metrics(r.metrics, mpath, os.path.join(tmpdir_path, "report"))
    back = io.read_metrics(spark, mpath, ["linear_regression"])
    assert [x["model"] for x in back.collect()] == ["linear_regression"]
    mdir = os.path.join(tmpdir_path, "models")
    M.save_models(r.models, mdir)
    loaded = M.load_models(mdir)
    assert set(loaded) == {"linear_regression", "random_forest"}
    assert M.load_models(os.path.join(tmpdir_path, "none")) == {}
    spath = os.path.join(tmpdir_path, "pre")
    r.state.save(spath)
    st = PreprocessState.load(spark, spath)
    a = st.apply(obs001).select("event_id", "location_encoded")
    b = r.state.apply(obs001).select("event_id", "location_encoded")
    assert a.subtract(b).count() == 0
    # one bundle serves a new session
    from flowlane.plans.serving import predict
    from flowlane.plans.training import TrainingResult
    bundle = os.path.join(tmpdir_path, "bundle")
    r.save(bundle)
    again = TrainingResult.load(spark, bundle)
    assert again.features == r.features and set(again.models) == set(r.models)
    picked = obs001.limit(6).withColumn("model", F.element_at(F.array(
        F.lit("ensemble"), F.lit("random_forest"), F.lit("nothing")), (F.col("event_id") % 3 + 1).cast("int")))
    cols = ["event_id", "congestion_value", "model_used"]
    ours, theirs = (predict(picked, x.models, x.scaler, x.state.encoder, features=x.features).collect() for x in (r, again))
    assert sorted(tuple(x[c] for c in cols) for x in ours) == sorted(tuple(x[c] for c in cols) for x in theirs)
    for x in ours:
        assert x.model_used == ["ensemble", "random_forest", "nothing"][x.event_id % 3]
        if x.model_used == "random_forest":
            assert abs(x.congestion_value - min(max(x.model_predictions["random_forest"], 0), 3)) < 0.0051


def test_state_fits_columns_without_nulls(spark, obs001):
    from flowlane.plans.training import preprocess
    _, state = preprocess(obs001)
    later = obs001.limit(5).withColumn("temperature", F.lit(None).cast("double"))
    assert state.apply(later).where("temperature is null").count() == 0


def test_absent_inputs_are_left_out(spark, obs001):
    from flowlane.plans.features import with_interaction_features, with_weather_impact_score
    out = with_interaction_features(obs001.drop("precipitation", "is_weekend"))
    assert "storm_severity" not in out.columns and "rush_hour_volume" in out.columns
    scored = with_weather_impact_score(obs001.drop("precipitation", "wind_speed"))
    assert scored.where("weather_impact_score is null").count() == 0


def test_requests_numbers_and_batch_form(spark):
    from flowlane.plans.serving import normalise_requests
    df = spark.createDataFrame([("17.0", "720.5"), ("8", "x")], "hour string, traffic_volume string")
    assert [(r.hour, r.traffic_volume) for r in normalise_requests(df).collect()] == [(17, 720), (8, 500)]
    assert [r.is_rush_hour for r in normalise_requests(df, defaults=False).collect()] == [None, None]


def test_hours_without_target_are_no_candidates(spark, obs001):
    from flowlane.operators.profiles import optimal_times
    holes = obs001.withColumn("congestion_level", F.when(F.col("hour") > 3, F.col("congestion_level")))
    out = optimal_times(holes).collect()
    assert all(r.best_hour > 3 and r.worst_hour > 3 for r in out)
    assert [r.improvement_pct for r in out] == sorted((r.improvement_pct for r in out), reverse=True)


def test_stream_equals_batch(spark, tmpdir_path):
    from flowlane.sources.tables import observations
    from flowlane.streaming.live import read_observation_stream
    src = "/root/testdata/sf0.001"
    batch = live_location_summary(observations(spark, src))
    stream = read_observation_stream(spark, src)
    q = (live_location_summary(stream, watermark="100 days").writeStream.outputMode("complete")
         .format("memory").queryName("live_summary_test")
         .option("checkpointLocation", os.path.join(tmpdir_path, "ck"))
         .trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = spark.table("live_summary_test")
    cols = ["window_start", "location", "samples"]
    assert sorted(tuple(r) for r in got.select(*cols).collect()) == \
        sorted(tuple(r) for r in batch.select(*cols).collect())


def test_score_stream_writes(spark, tmpdir_path):
    from flowlane.streaming.live import read_observation_stream, score_stream
    stream = read_observation_stream(spark, "/root/testdata/sf0.001")
    q = score_stream(stream, os.path.join(tmpdir_path, "scored"), os.path.join(tmpdir_path, "ck2"))
    q.awaitTermination(120)
    from flowlane.streaming.live import read_scored
    out = read_scored(spark, os.path.join(tmpdir_path, "scored"))
    assert out.count() == 1000
    assert out.filter(~F.col("congestion_value").between(0, 3)).count() == 0


def test_stream_drops_rows_behind_watermark(spark, tmpdir_path):
    """ST1 append mode: a window is emitted once the watermark passes its end;
    rows arriving later for an already-closed window are dropped."""
    import datetime as dt
    from flowlane.sources.tables import observations_from_events
    src = os.path.join(tmpdir_path, "in")
    out = os.path.join(tmpdir_path, "out")
    ck = os.path.join(tmpdir_path, "ck_late")
    os.makedirs(src)
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    t0 = dt.datetime(2024, 1, 2)

    def write_batch(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(os.path.join(src, name))

    def run():
        ev = spark.readStream.schema(schema).parquet(os.path.join(src, "*"))
        q = (live_location_summary(observations_from_events(ev), watermark="1 hour")
             .writeStream.outputMode("append").format("parquet").option("path", out)
             .option("checkpointLocation", ck).trigger(availableNow=True).start())
        q.awaitTermination(120)

    # batch 1: hours 1 and 5 for user 0 (one location) → watermark ≈ 04:00
    write_batch("b1", [(1, t0 + dt.timedelta(hours=1, minutes=5), 0, "v", 1.0, None),
                       (2, t0 + dt.timedelta(hours=5, minutes=5), 0, "v", 1.0, None)])
    run()
    # batch 2: a late row for hour 1 (window already closed) and a row at hour 9
    write_batch("b2", [(3, t0 + dt.timedelta(hours=1, minutes=30), 0, "v", 1.0, None),
                       (4, t0 + dt.timedelta(hours=9, minutes=5), 0, "v", 1.0, None)])
    run()
    # batch 3: moves the watermark past 05:00 and 09:00 windows
    write_batch("b3", [(5, t0 + dt.timedelta(hours=20), 0, "v", 1.0, None)])
    run()
    got = {r["window_start"].hour: r["samples"] for r in spark.read.parquet(out).collect()}
    assert got[1] == 1          # the late row (event 3) was dropped
    assert got[5] == 1 and got[9] == 1
    assert 20 not in got        # still open: never emitted in append mode


@pytest.fixture(scope="module")
def bundle_result(spark, obs001):
    from flowlane.plans.training import train_all
    return train_all(obs001, models=("linear_regression", "random_forest", "xgboost"), rf_trees=4, rf_depth=3,
                     gbt_iter=3, gbt_depth=3, engineer=False)


def test_a_broken_model_is_left_out_and_reported(spark, bundle_result, tmpdir_path):
    from flowlane.plans.training import TrainingResult
    from flowlane.sources import published
    path = os.path.join(tmpdir_path, "bundle")
    assert bundle_result.save(path) == "000000000001"
    whole = TrainingResult.load(spark, path)
    assert set(whole.models) == {"linear_regression", "random_forest", "xgboost"} and whole.skipped == {}
    folder = published.read(spark, f"{path}/published", "000000000001")["folder"]
    trees = [os.path.join(d, f) for d, _, fs in os.walk(f"{folder}/models/random_forest") for f in fs if f.endswith(".parquet")]
    with open(trees[0], "r+b") as f:
        f.truncate(os.path.getsize(trees[0]) // 2)
    again = TrainingResult.load(spark, path)
    assert set(again.models) == {"linear_regression", "xgboost"} and set(again.skipped) == {"random_forest"}
    report = {}
    assert set(M.load_models(f"{folder}/models", report)) <= {"linear_regression", "xgboost", "random_forest"}
    state = [os.path.join(d, f) for d, _, fs in os.walk(f"{folder}/scaler") for f in fs if f.endswith(".parquet")]
    with open(state[0], "r+b") as f:
        f.truncate(10)
    with pytest.raises(ValueError):
        TrainingResult.load(spark, path)


def test_a_save_that_stops_before_publishing_changes_nothing(spark, bundle_result, tmpdir_path):
    from flowlane.plans.training import TrainingResult
    from flowlane.sources import published
    path = os.path.join(tmpdir_path, "bundle2")
    with pytest.raises(FileNotFoundError):
        TrainingResult.load(spark, path)
    bundle_result.save(path)
    bundle_result.write(f"{path}/versions/half")   # and the writer is gone
    assert TrainingResult.load(spark, path).version == "000000000001"
    assert bundle_result.save(path) == "000000000002"
    assert TrainingResult.load(spark, path).version == "000000000002"
    assert not published.publish(spark, f"{path}/published", "000000000002", {"folder": "other"})
    assert published.read(spark, f"{path}/published", "000000000002")["folder"] != "other"


def test_scored_batches_count_once_committed(spark, bundle_result, tmpdir_path):
    from flowlane.sources import published
    from flowlane.sources.tables import observations_from_events
    from flowlane.streaming.live import read_scored, score_stream
    src, sink, ck, bundle = (os.path.join(tmpdir_path, n) for n in ("in3", "sink3", "ck3", "bundle3"))
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert read_scored(spark, sink) is None

    def run(part, check=ck):
        if part is not None:
            events.where(F.col("event_id") % 2 == part).write.mode("append").parquet(src)
        stream = observations_from_events(spark.readStream.schema(events.schema).parquet(src))
        score_stream(stream, sink, check, bundle=bundle).awaitTermination(120)

    run(0)                               # no version yet: the heuristic
    bundle_result.save(bundle)
    run(1)                               # the version published since
    out = read_scored(spark, sink)
    assert out.count() == 1000
    assert {(r.batch_id, r.n) for r in out.groupBy("batch_id").agg(F.max(F.size("model_predictions")).alias("n")).collect()} == {(0, 0), (1, 3)}
    # a folder without a commit is not read; a committed batch that is replayed changes nothing
    out.limit(5).write.parquet(f"{sink}/data/000000000007-stopped")
    run(None, os.path.join(tmpdir_path, "ck3-new"))
    assert read_scored(spark, sink).count() == 1000
    assert published.names(spark, f"{sink}/commits") == ["000000000000", "000000000001"]


def test_rejected_lines_name_their_reason(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "bad.csv")
    good = "2024-01-01 08:00:00,8,0,1,1,0,0,1,Downtown,0,1.5,50.0,0.0,3.0,100,30,1.25"
    lines = [",".join(OBSERVATION_COLUMNS), good, good.replace("1.5", "warm"), good + ",9", good.replace(",50.0", ""),
             good.replace("08:00:00", "late").replace("100", "1e"), good.replace("1.5", "").replace("50.0", "NaN")]
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")
    rows, rejects = io.read_observations_checked(spark, path)
    assert [(r.temperature, r.humidity) for r in rows.orderBy(F.col("temperature").desc()).collect()] == [(1.5, 50.0), (None, None)]
    got = sorted((r.reason, r.line) for r in rejects.collect())
    assert got == sorted([("value: temperature", lines[2]), ("fields", lines[3]), ("fields", lines[4]),
                          ("value: timestamp traffic_volume", lines[5])])
    assert all(r.file.endswith("bad.csv") for r in rejects.collect())


def test_a_hot_location_is_split_into_bounded_files(spark, tmpdir_path):
    import glob
    path = os.path.join(tmpdir_path, "hot")
    obs = spark.range(30_000).select(F.col("id").alias("event_id"), F.when(F.col("id") % 3 == 0, "HOT").otherwise(
        F.concat(F.lit("c"), F.col("id") % 20)).alias("location"), F.rand(1).alias("x"), F.rand(2).alias("y")).repartition(16)
    io.write_observations(obs, path, max_records=4000)
    files = {os.path.basename(d): glob.glob(f"{d}/*.parquet") for d in glob.glob(f"{path}/location=*")}
    assert len(files["location=HOT"]) >= 3 and all(len(f) == 1 for k, f in files.items() if "HOT" not in k)
    assert all(spark.read.parquet(f).count() <= 4000 for fs in files.values() for f in fs)
    assert spark.read.parquet(path).count() == 30_000


def test_stream_that_stops_half_way_goes_on(spark, tmpdir_path):
    """Two runs from one checkpoint append what one run over the same arrivals does."""
    import datetime as dt
    from flowlane.sources.tables import observations_from_events
    from flowlane.streaming.live import summarise_arrivals
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    t0 = dt.datetime(2024, 1, 2)
    parts = [[(1, 1), (2, 5)], [(3, 1), (4, 3), (5, 9)], [(6, 6), (7, 20)]]

    def run(name, stops):
        base = os.path.join(tmpdir_path, name)
        for k, part in enumerate(parts):
            spark.createDataFrame([(i, t0 + dt.timedelta(hours=h), 0, "v", 1.0, None) for i, h in part], schema).write.mode(
                "append").parquet(f"{base}/in")
            if k in stops:
                stream = spark.readStream.schema(schema).parquet(f"{base}/in")
                summarise_arrivals(observations_from_events(stream), f"{base}/out", f"{base}/ck")
        return sorted((r.window_start.hour, r.samples) for r in spark.read.parquet(f"{base}/out").collect())

    assert run("each", {0, 1, 2}) == [(1, 1), (5, 1), (9, 1)]      # 3, 4 and 6 come behind the watermark
    assert run("last", {2}) == [(1, 2), (3, 1), (5, 1), (6, 1), (9, 1)]


def test_fits_run_at_once(spark):
    import threading
    from flowlane.plans.training import at_once
    met = threading.Barrier(2)

    def fit(n):
        met.wait(30)  # broken if the other has not begun
        return spark.range(n).count()
    assert at_once(spark, {"a": lambda: fit(3), "b": lambda: fit(5)}) == {"a": 3, "b": 5}
    assert at_once(spark, {}) == {}

    def fails():
        raise ValueError("no rows")
    with pytest.raises(ValueError, match="no rows"):
        at_once(spark, {"a": fails})
