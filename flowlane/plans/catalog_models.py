"""Model, ensemble, scoring and streaming-shaped queries (registered on import)."""

from __future__ import annotations

import uuid
from functools import lru_cache

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import models as M
from ..operators import profiles as A
from ..operators import states as S
from ..operators.windows import epoch_micros
from ..schema import OBSERVATION_COLUMNS, TARGET
from ..session import ensure_checkpoint_dir
from ..sources.io import read_observations_checked
from ..sources.tables import observations, observations_from_events
from ..streaming.live import live_location_summary, summarise_arrivals
from .catalog import _label_sql, _r6, _with_obs, register
from .catalog_features import HEURISTIC_SQL


@register("regression_metrics", _with_obs(f"""
SELECT round_even(avg(abs(y - p)), 4) AS MAE, round_even(avg((y - p) * (y - p)), 4) AS MSE,
  round_even(sqrt(avg((y - p) * (y - p))), 4) AS RMSE,
  round_even(1 - avg((y - p) * (y - p)) / var_pop(y), 4) AS R2,
  round_even(avg(CASE WHEN CAST(round_even(p, 0) AS INT) = CAST(trunc(y) AS INT) THEN 1.0 ELSE 0.0 END), 4) AS Accuracy
FROM (SELECT congestion_level AS y, {HEURISTIC_SQL} AS p FROM obs)"""))
def q_regression_metrics(spark, sf):
    df = observations(spark, sf).withColumn("prediction", C.congestion_heuristic())
    return M.regression_metrics(df, "congestion_level", "prediction")


def _pred_cols():
    """Deterministic stand-in predictions derived from the table (the M5/M6
    blend and M8 confidence only see prediction columns)."""
    e = F.col("event_id")
    return {
        "random_forest": F.col("congestion_level") * 0.9 + 0.1,
        "xgboost": C.congestion_heuristic(),
        "linear_regression": F.when(e % 5 == 0, F.lit(None)).otherwise(C.hourly_multiplier() * 1.5),
        "lstm": F.when(e % 4 == 0, F.lit(None)).otherwise(F.col("traffic_volume") / 500.0),
    }


_PRED_SQL = f"""preds AS (
  SELECT event_id, congestion_level * 0.9 + 0.1 AS rf, {HEURISTIC_SQL} AS xgb,
    CASE WHEN event_id % 5 = 0 THEN NULL ELSE 1.5 * CAST(CASE WHEN is_weekend <> 0 THEN
      CASE WHEN hour BETWEEN 8 AND 11 THEN 0.7 WHEN hour BETWEEN 12 AND 17 THEN 0.8
           WHEN hour BETWEEN 18 AND 22 THEN 0.6 ELSE 0.2 END
      ELSE CASE WHEN hour BETWEEN 7 AND 9 THEN 1.0 + 0.2 * sin(pi() * (hour - 7) / 2)
                WHEN hour BETWEEN 10 AND 15 THEN 0.6 + 0.1 * sin(pi() * (hour - 10) / 5)
                WHEN hour BETWEEN 16 AND 19 THEN 1.0 + 0.2 * sin(pi() * (hour - 16) / 3)
                WHEN hour BETWEEN 20 AND 23 THEN 0.4 ELSE 0.1 END END AS DOUBLE) END AS lin,
    CASE WHEN event_id % 4 = 0 THEN NULL ELSE traffic_volume / 500.0 END AS lstm
  FROM obs)"""


@register("ensemble_training", _with_obs("""
SELECT event_id, round(rf * (0.30 / 0.90) + xgb * (0.35 / 0.90) + (traffic_volume / 500.0) * (0.25 / 0.90), 6)
  AS ensemble_prediction FROM obs JOIN preds USING (event_id)""", _PRED_SQL))
def q_ensemble_training(spark, sf):
    df = observations(spark, sf)
    p = _pred_cols()
    p["lstm"] = F.col("traffic_volume") / 500.0  # training form: all test predictions present
    return df.select("event_id", F.round(M.ensemble_training(p), 6).alias("ensemble_prediction"))


_ENS_SQL = """
blend AS (
  SELECT *, (CASE WHEN rf IS NOT NULL THEN CAST(0.30 AS DOUBLE) ELSE 0 END + CASE WHEN xgb IS NOT NULL THEN CAST(0.35 AS DOUBLE) ELSE 0 END
            + CASE WHEN lin IS NOT NULL THEN CAST(0.10 AS DOUBLE) ELSE 0 END + CASE WHEN lstm IS NOT NULL THEN CAST(0.25 AS DOUBLE) ELSE 0 END) AS tw,
    (CASE WHEN rf IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN xgb IS NOT NULL THEN 1 ELSE 0 END
     + CASE WHEN lin IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN lstm IS NOT NULL THEN 1 ELSE 0 END) AS n
  FROM preds),
val AS (
  SELECT *, least(greatest(CASE WHEN tw > 0 THEN coalesce(rf * CAST(0.30 AS DOUBLE) / tw, 0) + coalesce(xgb * CAST(0.35 AS DOUBLE) / tw, 0)
      + coalesce(lin * CAST(0.10 AS DOUBLE) / tw, 0) + coalesce(lstm * CAST(0.25 AS DOUBLE) / tw, 0) ELSE CAST(0.5 AS DOUBLE) END, 0.0), 3.0) AS v,
    (coalesce(rf, 0) + coalesce(xgb, 0) + coalesce(lin, 0) + coalesce(lstm, 0)) / n AS mu
  FROM blend),
lv AS (
  SELECT *, CAST(round_even(v, 0) AS INT) AS lvl,
    (coalesce((rf - mu) * (rf - mu), 0) + coalesce((xgb - mu) * (xgb - mu), 0)
     + coalesce((lin - mu) * (lin - mu), 0) + coalesce((lstm - mu) * (lstm - mu), 0)) / n AS var
  FROM val)"""


@register("ensemble_confidence", _with_obs(f"""
SELECT event_id, round_even(v, 2) AS congestion_value, lvl AS congestion_level,
  {_label_sql('lvl')} AS congestion_label,
  round_even(least(greatest((
      (CASE WHEN rf IS NOT NULL AND CAST(round_even(rf, 0) AS INT) = lvl THEN 1 ELSE 0 END
     + CASE WHEN xgb IS NOT NULL AND CAST(round_even(xgb, 0) AS INT) = lvl THEN 1 ELSE 0 END
     + CASE WHEN lin IS NOT NULL AND CAST(round_even(lin, 0) AS INT) = lvl THEN 1 ELSE 0 END
     + CASE WHEN lstm IS NOT NULL AND CAST(round_even(lstm, 0) AS INT) = lvl THEN 1 ELSE 0 END) * 1.0 / n)
    * (1 - least(CASE WHEN n > 1 THEN var ELSE 0 END, 1) * 0.5), 0), 1), 2) AS confidence,
  'ensemble' AS model_used
FROM lv""", _PRED_SQL + "," + _ENS_SQL))
def q_ensemble_confidence(spark, sf):
    df = observations(spark, sf)
    p = _pred_cols()
    x = df.select("event_id", *[c.alias(f"pred_{n}") for n, c in p.items()])
    out = M.finish_scores(x, list(p), "ensemble")
    return out.select("event_id", "congestion_value", "congestion_level", "congestion_label",
                      "confidence", "model_used")


# --- requests (P13) and heuristic scoring (M7 without models) ----------------------

def _requests(spark, sf):
    e = F.col("event_id")
    o = observations(spark, sf)
    wx = C.weather_label("weather_condition")
    return o.select(
        "event_id",
        F.when(e % 7 == 0, F.lit(None)).otherwise(F.col("hour").cast("string")).alias("hour"),
        F.col("day_of_week").cast("string").alias("day_of_week"),
        F.col("month").cast("string").alias("month"),
        F.col("is_weekend").cast("string").alias("is_weekend"),
        F.when(e % 3 == 0, F.lit(None)).otherwise(F.col("is_rush_hour").cast("string")).alias("is_rush_hour"),
        F.when(e % 5 == 0, F.lit("n/a")).otherwise(F.col("temperature").cast("string")).alias("temperature"),
        F.col("humidity").cast("string").alias("humidity"),
        F.col("precipitation").cast("string").alias("precipitation"),
        F.col("wind_speed").cast("string").alias("wind_speed"),
        F.when(e % 9 == 0, F.lit(None)).otherwise(F.col("traffic_volume").cast("string")).alias("traffic_volume"),
        F.col("avg_speed").cast("string").alias("avg_speed"),
        F.when(e % 10 == 0, F.lit(None)).when(e % 2 == 0, F.upper(wx))
        .otherwise(F.concat(F.lit(" "), wx, F.lit(" "))).alias("weather_condition"),
        F.when(e % 11 == 0, F.lit(None)).otherwise(F.col("location")).alias("location"))


_REQ_SQL = """req AS (
  SELECT event_id,
    CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(hour AS VARCHAR) END AS hour,
    CAST(day_of_week AS VARCHAR) AS day_of_week, CAST(month AS VARCHAR) AS month,
    CAST(is_weekend AS VARCHAR) AS is_weekend,
    CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(is_rush_hour AS VARCHAR) END AS is_rush_hour,
    CASE WHEN event_id % 5 = 0 THEN 'n/a' ELSE CAST(temperature AS VARCHAR) END AS temperature,
    CAST(humidity AS VARCHAR) AS humidity, CAST(precipitation AS VARCHAR) AS precipitation,
    CAST(wind_speed AS VARCHAR) AS wind_speed,
    CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(traffic_volume AS VARCHAR) END AS traffic_volume,
    CAST(avg_speed AS VARCHAR) AS avg_speed,
    CASE WHEN event_id % 10 = 0 THEN NULL
         WHEN event_id % 2 = 0 THEN upper(CASE weather_condition WHEN 0 THEN 'Clear' WHEN 1 THEN 'Cloudy'
              WHEN 2 THEN 'Rainy' WHEN 3 THEN 'Stormy' WHEN 4 THEN 'Foggy' WHEN 5 THEN 'Snowy' END)
         ELSE ' ' || CASE weather_condition WHEN 0 THEN 'Clear' WHEN 1 THEN 'Cloudy'
              WHEN 2 THEN 'Rainy' WHEN 3 THEN 'Stormy' WHEN 4 THEN 'Foggy' WHEN 5 THEN 'Snowy' END || ' ' END
      AS weather_condition,
    CASE WHEN event_id % 11 = 0 THEN NULL ELSE location END AS location
  FROM obs),
norm AS (
  SELECT event_id,
    coalesce(TRY_CAST(hour AS INT), 12) AS hour, coalesce(TRY_CAST(day_of_week AS INT), 0) AS day_of_week,
    coalesce(TRY_CAST(month AS INT), 1) AS month, coalesce(TRY_CAST(is_weekend AS INT), 0) AS is_weekend,
    TRY_CAST(is_rush_hour AS INT) AS rush_in,
    coalesce(TRY_CAST(temperature AS DOUBLE), 25.0) AS temperature,
    coalesce(TRY_CAST(humidity AS DOUBLE), 60.0) AS humidity,
    coalesce(TRY_CAST(precipitation AS DOUBLE), 0.0) AS precipitation,
    coalesce(TRY_CAST(wind_speed AS DOUBLE), 10.0) AS wind_speed,
    coalesce(TRY_CAST(traffic_volume AS INT), 500) AS traffic_volume,
    coalesce(TRY_CAST(avg_speed AS INT), 50) AS avg_speed,
    CASE lower(trim(coalesce(weather_condition, 'Clear'))) WHEN 'clear' THEN 0 WHEN 'cloudy' THEN 1
      WHEN 'rainy' THEN 2 WHEN 'stormy' THEN 3 WHEN 'foggy' THEN 4 WHEN 'snowy' THEN 5 ELSE 0 END AS weather_condition,
    coalesce(location, 'Downtown') AS location
  FROM req),
normed AS (
  SELECT * EXCLUDE (rush_in), coalesce(rush_in, CASE WHEN (hour BETWEEN 7 AND 9 OR hour BETWEEN 17 AND 19)
      AND coalesce(is_weekend, 0) = 0 THEN 1 ELSE 0 END) AS is_rush_hour FROM norm)"""


@register("normalise_requests", _with_obs("""
SELECT event_id, hour, day_of_week, month, is_weekend, is_rush_hour, round(temperature, 6) AS temperature,
  round(humidity, 6) AS humidity, round(precipitation, 6) AS precipitation, round(wind_speed, 6) AS wind_speed,
  traffic_volume, avg_speed, weather_condition, location FROM normed""", _REQ_SQL))
def q_normalise_requests(spark, sf):
    from .serving import normalise_requests
    out = normalise_requests(_requests(spark, sf))
    return out.select("event_id", "hour", "day_of_week", "month", "is_weekend", "is_rush_hour",
                      _r6("temperature"), _r6("humidity"), _r6("precipitation"), _r6("wind_speed"),
                      "traffic_volume", "avg_speed", "weather_condition", "location")


_H = HEURISTIC_SQL


@register("score_heuristic", _with_obs(f"""
SELECT event_id, round_even({_H}, 2) AS congestion_value, CAST(round_even({_H}, 0) AS INT) AS congestion_level,
  {_label_sql(f'CAST(round_even({_H}, 0) AS INT)')} AS congestion_label, CAST(0.3 AS DOUBLE) AS confidence,
  'ensemble' AS model_used
FROM normed""", _REQ_SQL))
def q_score_heuristic(spark, sf):
    from .serving import predict
    out = predict(_requests(spark, sf), models=None)
    return out.select("event_id", "congestion_value", "congestion_level", "congestion_label",
                      "confidence", "model_used")


# --- model fits (rows-only: no SQL twin for a fitted model) ------------------------

def _train(spark, sf, models, **kw):
    from ..functions.columns import congestion_score_rule, uniform_draw
    from .training import train_all
    # a target that can be learnt: the rule score with noise of deviation 0.15
    noise = (uniform_draw("event_id", 11) - 0.5) * (0.15 * 12 ** 0.5)
    return train_all(observations(spark, sf).withColumn(TARGET, congestion_score_rule(noise)), models=models, **kw)


@register("fit_linear")
def q_fit_linear(spark, sf):
    return _train(spark, sf, ("linear_regression",)).metrics


@register("fit_random_forest")
def q_fit_random_forest(spark, sf):
    return _train(spark, sf, ("random_forest",)).metrics  # the full 200 trees of depth 20


@register("fit_boosted_trees")
def q_fit_boosted_trees(spark, sf):
    return _train(spark, sf, ("xgboost",)).metrics  # the full 200 rounds of depth 8


@lru_cache(maxsize=1)
def _all_models(spark, sf):
    """All models at their full sizes, fitted once a session and table for the queries
    that report or score with them."""
    return _train(spark, sf, ("random_forest", "xgboost", "linear_regression"))


@register("train_all")
def q_train_all(spark, sf):
    return A.metrics_table(_all_models(spark, sf).metrics)


@register("feature_importance")
def q_feature_importance(spark, sf):
    r = _all_models(spark, sf)
    return M.feature_importance(spark, r.models["random_forest"], r.features, 15)


@register("score_models")
def q_score_models(spark, sf):
    from .serving import predict
    r = _all_models(spark, sf)
    enc = r.state.encoder
    out = predict(_requests(spark, sf), r.models, r.scaler, enc, "ensemble", r.features)
    return out.select("event_id", "congestion_value", "congestion_level", "congestion_label",
                      "confidence", "model_used", "model_predictions")


# --- ST1 batch form ---------------------------------------------------------------------

@register("live_location_summary", _with_obs("""
SELECT date_trunc('hour', "timestamp") AS window_start, date_trunc('hour', "timestamp") + INTERVAL 1 HOUR AS window_end,
  location, round(avg(congestion_level), 6) AS avg_congestion, round(avg(traffic_volume), 6) AS avg_traffic_volume,
  round(avg(avg_speed), 6) AS avg_speed, count(*) AS samples
FROM obs GROUP BY 1, 2, location"""))
def q_live_location_summary(spark, sf):
    out = live_location_summary(observations(spark, sf))
    return out.select("window_start", "window_end", "location", _r6("avg_congestion"),
                      _r6("avg_traffic_volume"), _r6("avg_speed"), "samples")


# --- ST1 as a stream, S1 rejects -----------------------------------------------------------

_ARRIVALS = 4


def _arrival(ts_us, low, high):
    """The arrival a row comes with: by time, but one later for every 17th id."""
    return F.least(F.lit(_ARRIVALS - 1), F.floor((ts_us - low) * _ARRIVALS / (high - low + 1)).cast("int")
                   + F.when(F.col("event_id") % 17 == 0, 1).otherwise(0))


@register("live_stream_summary", _with_obs(f"""
SELECT w AS window_start, w + INTERVAL 1 HOUR AS window_end, location, round(avg(congestion_level), 6) AS avg_congestion,
  round(avg(traffic_volume), 6) AS avg_traffic_volume, round(avg(avg_speed), 6) AS avg_speed, count(*) AS samples
FROM a WHERE coalesce(w + INTERVAL 1 HOUR > before - INTERVAL 1 HOUR, true)
  AND w + INTERVAL 1 HOUR <= (SELECT max("timestamp") FROM obs) - INTERVAL 1 HOUR
GROUP BY w, location""", f"""
k AS (SELECT *, date_trunc('hour', "timestamp") AS w, least({_ARRIVALS - 1}, CAST(floor((epoch_us("timestamp") - min(epoch_us("timestamp")) OVER ()) * {_ARRIVALS}
    / (max(epoch_us("timestamp")) OVER () - min(epoch_us("timestamp")) OVER () + 1)) AS INT) + CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END) AS k FROM obs),
m AS (SELECT k, max("timestamp") AS last FROM k GROUP BY k),
a AS (SELECT *, (SELECT max(last) FROM m WHERE m.k < k.k) AS before FROM k)"""))
def q_live_stream_summary(spark, sf):
    """The events arrive in parts, some rows late; after each part the stream goes on from
    its checkpoint. The rows are what it appended."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/live-{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{sf}/events.parquet")
    us = epoch_micros("ts")
    ends = events.agg(F.min(us).alias("low"), F.max(us).alias("high")).first()
    for k in range(_ARRIVALS):
        (events.where(_arrival(us, F.lit(ends.low), F.lit(ends.high)) == k)
         .write.mode("append").parquet(f"{folder}/in"))
        arrived = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
        summarise_arrivals(observations_from_events(arrived), f"{folder}/out", f"{folder}/state")
    out = spark.read.parquet(f"{folder}/out")
    return out.select("window_start", "window_end", "location", _r6("avg_congestion"),
                      _r6("avg_traffic_volume"), _r6("avg_speed"), "samples")


@register("rejected_rows", _with_obs("""
SELECT CASE event_id % 10 WHEN 1 THEN 'value: temperature' WHEN 3 THEN 'fields' WHEN 5 THEN 'value: hour wind_speed'
  ELSE 'accepted' END AS reason, count(*) AS rows, round(sum(traffic_volume), 6) AS traffic_volume
FROM obs GROUP BY 1"""))
def q_rejected_rows(spark, sf):
    """Observations as CSV with lines that cannot be read, and what reading them says."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    kind = F.col("event_id") % 10
    bad = {"temperature": kind == 1, "wind_speed": kind == 5, "hour": kind == 5}
    fields = [F.when(bad[c], F.lit("n/a")).otherwise(F.col(c).cast("string")) if c in bad else F.col(c).cast("string")
              for c in OBSERVATION_COLUMNS]
    line = F.when(kind == 3, F.concat_ws(",", *fields[:-1])).otherwise(F.concat_ws(",", *fields))
    # one column: nothing in a line is a separator or needs quotes
    observations(spark, sf).select(line.alias("header")).write.option("header", True).option("sep", "\x01").csv(path)
    rows, rejects = read_observations_checked(spark, path)
    lost = F.get(F.split("line", ","), F.lit(OBSERVATION_COLUMNS.index("traffic_volume"))).cast("int")
    return (rows.select(F.lit("accepted").alias("reason"), "traffic_volume")
            .unionByName(rejects.select("reason", lost.alias("traffic_volume")))
            .groupBy("reason").agg(F.count(F.lit(1)).alias("rows"), F.sum("traffic_volume").alias("traffic_volume")))


# --- A7, A8, A11, A12 from stored states -----------------------------------------------------

_STATE_COLUMNS = ["congestion_level", "traffic_volume", "avg_speed", "temperature"]


def _stored_states(spark, sf):
    """The observations reduced in three batches, by id, and read back."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/states-{uuid.uuid4().hex}"
    obs = observations(spark, sf)
    for k in range(3):
        batch = S.partial_states(obs.where(F.col("event_id") % 3 == k), _STATE_COLUMNS)
        S.append_states(batch, folder, f"{k:012d}")
    return S.read_states(spark, folder)


def _middle(states, obs):
    """The states of the second and third quarter of the hours, and the bounds."""
    hour = F.date_trunc("hour", "timestamp")
    ends = obs.agg(F.min(hour).alias("low"), F.max(hour).alias("high")).select(
        *[F.timestamp_seconds(F.floor((F.unix_timestamp("low") + (F.unix_timestamp("high") - F.unix_timestamp("low")) * q) / 3600) * 3600)
          .alias(n) for n, q in (("a", 0.25), ("b", 0.75))]).first()
    return states.between(ends.a, ends.b), ends


_MIDDLE_SQL = """
e AS (SELECT epoch(date_trunc('hour', min("timestamp"))) AS low, epoch(date_trunc('hour', max("timestamp"))) AS high FROM obs),
mid AS (SELECT obs.* FROM obs, e WHERE epoch("timestamp") >= floor((low + (high - low) * 0.25) / 3600) * 3600
  AND epoch("timestamp") < floor((low + (high - low) * 0.75) / 3600) * 3600)"""


@register("hourly_band_from_states", _with_obs("""
SELECT hour, round(avg(congestion_level), 6) AS mean, round(stddev_samp(congestion_level), 6) AS std,
  round(avg(congestion_level) + stddev_samp(congestion_level), 6) AS upper,
  round(avg(congestion_level) - stddev_samp(congestion_level), 6) AS lower
FROM mid GROUP BY hour""", _MIDDLE_SQL))
def q_hourly_band_from_states(spark, sf):
    states, _ = _middle(_stored_states(spark, sf), observations(spark, sf))
    return S.band_of_states(states).select("hour", _r6("mean"), _r6("std"), _r6("upper"), _r6("lower"))


@register("summary_from_states", _with_obs("""
SELECT v.*, s.* FROM (
  SELECT congestion_level AS value, count(*) AS count,
    CASE WHEN congestion_level = floor(congestion_level) AND congestion_level BETWEEN 0 AND 3
         THEN """ + _label_sql("CAST(congestion_level AS INT)") + """
         ELSE 'Level ' || CAST(congestion_level AS VARCHAR) END AS label
  FROM mid GROUP BY congestion_level) v
CROSS JOIN (
  SELECT count(*) AS total_records, round(avg(congestion_level), 6) AS avg_congestion,
    round(avg(traffic_volume), 6) AS avg_traffic_volume, round(avg(avg_speed), 6) AS avg_speed,
    count(DISTINCT location) AS locations FROM mid) s""", _MIDDLE_SQL))
def q_summary_from_states(spark, sf):
    # the value distribution beside the one row of statistics
    states, _ = _middle(_stored_states(spark, sf), observations(spark, sf))
    return S.values_of_states(states).crossJoin(F.broadcast(S.summary_of_states(states))).select(
        "value", "count", "label", "total_records", _r6("avg_congestion"), _r6("avg_traffic_volume"), _r6("avg_speed"), "locations")


@register("describe_from_states", _with_obs("\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 6) AS mean, "
    f"round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, "
    f"true AS q25_in_bound, true AS q50_in_bound, true AS q75_in_bound FROM mid" for c in _STATE_COLUMNS), _MIDDLE_SQL))
def q_describe_from_states(spark, sf):
    """The quartiles come from sketches with random choices, so the rows say whether
    their exact ranks among the observations lie within the sketch's bound."""
    obs = observations(spark, sf)
    states, ends = _middle(_stored_states(spark, sf), obs)
    got = S.describe_states(states)
    mid = obs.where((F.col("timestamp") >= F.lit(ends.a)) & (F.col("timestamp") < F.lit(ends.b)))
    long = mid.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v"))
                                          for c in _STATE_COLUMNS])).alias("e")).select("e.*")
    quartiles = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    # a quantile's ranks are those of the rows below it and of the rows up to it
    ranks = long.join(F.broadcast(got.select("column", *quartiles)), "column").groupBy("column").agg(*[
        (F.avg((F.col("v") < F.col(q)).cast("int")).alias(f"{q}_low")) for q in quartiles], *[
        (F.avg((F.col("v") <= F.col(q)).cast("int")).alias(f"{q}_high")) for q in quartiles])
    return got.join(ranks, "column").select("column", "count", _r6("mean"), _r6("std"), "min", "max", *[
        ((F.col(f"{q}_low") <= p + S.RANK_ERROR) & (F.col(f"{q}_high") >= p - S.RANK_ERROR)).alias(f"{q}_in_bound")
        for q, p in quartiles.items()])
