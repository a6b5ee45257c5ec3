"""Feature, window and transform queries (registered on import)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import windows as W
from ..schema import LOCATION_BIAS
from ..sources.tables import observations
from .catalog import _label_sql, _r6, _with_obs, draw_sql, register

_KEY = ["event_id", "location"]


def _lag_sql(cols, lags, part="PARTITION BY location ", order='"timestamp", event_id'):
    sel = ", ".join(f"lag({c}, {k}) OVER (PARTITION BY location ORDER BY {order}) AS {c}_lag_{k}h"
                    for c in cols for k in lags)
    return _with_obs(f"SELECT event_id, location, {sel} FROM obs")


@register("lag_features", _lag_sql(W.DEFAULT_COLUMNS, W.DEFAULT_LAGS))
def q_lag_features(spark, sf):
    df = observations(spark, sf)
    out = W.lag_features(df)
    return out.select(*_KEY, *[c for c in out.columns if "_lag_" in c])


@register("lag_features_chunked", _lag_sql(W.DEFAULT_COLUMNS, W.DEFAULT_LAGS))
def q_lag_features_chunked(spark, sf):
    # Same result through the skew-safe plan (small chunks force many halos).
    df = observations(spark, sf)
    out = W.lag_features(df, strategy="chunked", chunk_rows=500)
    return out.select(*_KEY, *[c for c in out.columns if "_lag_" in c])


def _rolling_sql(cols, wins):
    parts = []
    for c in cols:
        for k in wins:
            fr = f'OVER (PARTITION BY location ORDER BY "timestamp", event_id ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)'
            parts += [f"round(avg({c}) {fr}, 6) AS {c}_rolling_mean_{k}h",
                      f"round(coalesce(stddev_samp({c}) {fr}, 0), 6) AS {c}_rolling_std_{k}h",
                      f"max({c}) {fr} AS {c}_rolling_max_{k}h",
                      f"min({c}) {fr} AS {c}_rolling_min_{k}h"]
    return _with_obs(f"SELECT event_id, location, {', '.join(parts)} FROM obs")


def _rolling_select(out):
    cols = [c for c in out.columns if "_rolling_" in c]
    return out.select(*_KEY, *[_r6(c) if ("_mean_" in c or "_std_" in c) else F.col(c) for c in cols])


@register("rolling_features", _rolling_sql(W.DEFAULT_COLUMNS, W.DEFAULT_WINDOWS))
def q_rolling_features(spark, sf):
    return _rolling_select(W.rolling_features(observations(spark, sf)))


@register("rolling_features_chunked", _rolling_sql(W.DEFAULT_COLUMNS, W.DEFAULT_WINDOWS))
def q_rolling_features_chunked(spark, sf):
    return _rolling_select(W.rolling_features(observations(spark, sf), strategy="chunked", chunk_rows=500))


_ROW_ORDER = 'OVER (ORDER BY "timestamp", event_id'


@register("rolling_features_frame_order", _with_obs(f"""
SELECT event_id, round(avg(traffic_volume) {_ROW_ORDER} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6)
  AS traffic_volume_rolling_mean_3h,
  round(coalesce(stddev_samp(traffic_volume) {_ROW_ORDER} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 0), 6)
  AS traffic_volume_rolling_std_3h,
  lag(traffic_volume, 1) {_ROW_ORDER}) AS traffic_volume_lag_1h FROM obs"""))
def q_rolling_frame_order(spark, sf):
    # The reference's un-partitioned frame order (whole table, by time).
    df = observations(spark, sf)
    r = W.rolling_features(df, columns=["traffic_volume"], windows=[3], partition_by=None)
    r = W.lag_features(r, columns=["traffic_volume"], lags=[1], partition_by=None)
    return r.select("event_id", _r6("traffic_volume_rolling_mean_3h"),
                    _r6("traffic_volume_rolling_std_3h"), "traffic_volume_lag_1h")


def _time_sql():
    parts = []
    for c in W.DEFAULT_COLUMNS:
        for k in (3, 24):
            fr = (f"OVER (PARTITION BY location ORDER BY epoch_us(\"timestamp\") "
                  f"RANGE BETWEEN {k * 3600 * 1000000 - 1} PRECEDING AND CURRENT ROW)")
            parts += [f"round(avg({c}) {fr}, 6) AS {c}_time_mean_{k}h",
                      f"max({c}) {fr} AS {c}_time_max_{k}h",
                      f"min({c}) {fr} AS {c}_time_min_{k}h",
                      f"count({c}) {fr} AS {c}_time_count_{k}h"]
    return _with_obs(f"SELECT event_id, location, {', '.join(parts)} FROM obs")


@register("rolling_time", _time_sql())
def q_rolling_time(spark, sf):
    out = W.rolling_time(observations(spark, sf), hours=[3, 24])
    cols = [c for c in out.columns if "_time_" in c]
    return out.select(*_KEY, *[_r6(c) if "_mean_" in c else F.col(c) for c in cols])


@register("congestion_trend", _with_obs("""
SELECT event_id, location,
  CASE WHEN d > 0.1 THEN 1 WHEN d < -0.1 THEN -1 ELSE 0 END AS congestion_trend,
  round(coalesce(d - lag(d) OVER w, 0), 6) + 0.0 AS congestion_acceleration
FROM (SELECT *, s - lag(s) OVER w AS d FROM (
        SELECT event_id, location, "timestamp",
          avg(congestion_level) OVER (w ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS s
        FROM obs WINDOW w AS (PARTITION BY location ORDER BY "timestamp", event_id))
      WINDOW w AS (PARTITION BY location ORDER BY "timestamp", event_id))
WINDOW w AS (PARTITION BY location ORDER BY "timestamp", event_id)"""))
def q_congestion_trend(spark, sf):
    out = W.congestion_trend(observations(spark, sf))
    return out.select(*_KEY, "congestion_trend", _r6("congestion_acceleration"))


@register("quantile_bins", _with_obs("""
SELECT event_id, congestion_level,
  CAST(greatest((((row_number() OVER (ORDER BY congestion_level, event_id)) - 1) * 10
        + (count(*) OVER () - 2)) // (count(*) OVER () - 1) - 1, 0) AS INT) AS bin
FROM obs"""))
def q_quantile_bins(spark, sf):
    df = observations(spark, sf).select("event_id", "congestion_level")
    return W.quantile_bins(df, "congestion_level", 10)


# ------------------------------------------------------------- P columns ---

@register("time_features", _with_obs("""
SELECT event_id, hour, day_of_week, day_of_month, month, is_weekend, is_holiday, is_rush_hour,
  CAST(hour * 60 AS INT) AS minutes_from_midnight,
  CASE WHEN hour >= 5 AND hour < 12 THEN 0 WHEN hour >= 12 AND hour < 17 THEN 1
       WHEN hour >= 17 AND hour < 21 THEN 2 ELSE 3 END AS part_of_day,
  CASE WHEN hour >= 9 AND hour <= 17 AND is_weekend = 0 THEN 1 ELSE 0 END AS is_business_hours,
  CAST(month * 30 + day_of_month AS INT) AS day_of_year,
  CASE WHEN (hour BETWEEN 7 AND 9 OR hour BETWEEN 17 AND 19) THEN 1 ELSE 0 END AS is_peak_hour,
  printf('%02d:00 - %02d:00', hour, (hour + 1) % 24) AS time_slot
FROM obs"""))
def q_time_features(spark, sf):
    from ..plans.features import with_time_features
    df = observations(spark, sf)
    # P1 recomputed from the timestamp (must equal the adapter's fields).
    recomputed = df.select("event_id", *[v.alias(k) for k, v in C.time_fields("timestamp").items()],
                           "timestamp")
    recomputed = recomputed.withColumn("is_rush_hour", C.rush_hour())
    out = with_time_features(recomputed)
    return out.select("event_id", "hour", "day_of_week", "day_of_month", "month", "is_weekend",
                      "is_holiday", "is_rush_hour", "minutes_from_midnight", "part_of_day",
                      "is_business_hours", "day_of_year",
                      C.rush_hour(weekend_aware=False).alias("is_peak_hour"),
                      C.time_slot("hour").alias("time_slot"))


@register("interaction_features", _with_obs("""
SELECT event_id,
  round(traffic_volume * (weather_condition + 1) / 1000.0, 6) AS volume_weather_interaction,
  round(CASE WHEN traffic_volume > 0 THEN avg_speed / traffic_volume ELSE 0 END, 6) AS speed_volume_ratio,
  is_rush_hour * traffic_volume AS rush_hour_volume, is_weekend * traffic_volume AS weekend_volume,
  round(temperature * 0.5 + humidity * 0.5, 6) AS temp_humidity_index,
  round(precipitation * 0.6 + wind_speed * 0.4, 6) AS storm_severity
FROM obs"""))
def q_interaction_features(spark, sf):
    df = observations(spark, sf).withColumns(C.interaction_columns())
    return df.select("event_id", _r6("volume_weather_interaction"), _r6("speed_volume_ratio"),
                     "rush_hour_volume", "weekend_volume", _r6("temp_humidity_index"),
                     _r6("storm_severity"))


@register("weather_impact_score", _with_obs("""
SELECT event_id, round(0.3 * precipitation / nullif(mp, 0) + 0.2 * wind_speed / nullif(mw, 0)
  + 0.2 * abs(temperature - 25) / 25 + 0.15 * humidity / 100 + 0.15 * weather_condition / 5, 6)
  AS weather_impact_score
FROM obs CROSS JOIN (SELECT max(precipitation) AS mp, max(wind_speed) AS mw FROM obs)"""))
def q_weather_impact_score(spark, sf):
    from ..plans.features import with_weather_impact_score
    out = with_weather_impact_score(observations(spark, sf))
    return out.select("event_id", _r6("weather_impact_score"))


@register("cyclic", _with_obs("""
SELECT event_id, round(sin(2 * pi() * hour / 24.0), 6) + 0.0 AS hour_sin, round(cos(2 * pi() * hour / 24.0), 6) + 0.0 AS hour_cos,
  round(sin(2 * pi() * day_of_week / 7.0), 6) + 0.0 AS day_sin, round(cos(2 * pi() * day_of_week / 7.0), 6) + 0.0 AS day_cos,
  round(sin(2 * pi() * month / 12.0), 6) + 0.0 AS month_sin, round(cos(2 * pi() * month / 12.0), 6) + 0.0 AS month_cos
FROM obs"""))
def q_cyclic(spark, sf):
    from ..plans.features import with_cyclic_features
    out = with_cyclic_features(observations(spark, sf))
    return out.select("event_id", *[_r6(f"{p}_{f}") for p in ("hour", "day", "month") for f in ("sin", "cos")])


@register("hourly_multiplier", _with_obs("""
SELECT event_id, round(CASE WHEN is_weekend <> 0 THEN
    CASE WHEN hour BETWEEN 8 AND 11 THEN 0.7 WHEN hour BETWEEN 12 AND 17 THEN 0.8
         WHEN hour BETWEEN 18 AND 22 THEN 0.6 ELSE 0.2 END
  ELSE CASE WHEN hour BETWEEN 7 AND 9 THEN 1.0 + 0.2 * sin(pi() * (hour - 7) / 2)
            WHEN hour BETWEEN 10 AND 15 THEN 0.6 + 0.1 * sin(pi() * (hour - 10) / 5)
            WHEN hour BETWEEN 16 AND 19 THEN 1.0 + 0.2 * sin(pi() * (hour - 16) / 3)
            WHEN hour BETWEEN 20 AND 23 THEN 0.4 ELSE 0.1 END END, 6) AS hourly_multiplier
FROM obs"""))
def q_hourly_multiplier(spark, sf):
    df = observations(spark, sf)
    return df.select("event_id", F.round(C.hourly_multiplier(), 6).alias("hourly_multiplier"))


_BIAS_SQL = "CASE location " + " ".join(
    f"WHEN '{k}' THEN {v}" for k, v in LOCATION_BIAS.items()) + " ELSE 0 END"


@register("congestion_score_rule", _with_obs(f"""
SELECT event_id, round_even(least(greatest(CAST(0.3 AS DOUBLE)
  + CAST(CASE WHEN is_rush_hour <> 0 THEN 0.8 WHEN hour BETWEEN 10 AND 15 THEN 0.2 WHEN hour >= 20 OR hour <= 5 THEN -0.2 ELSE 0 END AS DOUBLE)
  + CAST(CASE WHEN is_weekend <> 0 THEN -0.15 ELSE 0 END AS DOUBLE)
  + CAST(CASE WHEN traffic_volume > 1000 THEN 0.5 WHEN traffic_volume > 700 THEN 0.25 WHEN traffic_volume < 300 THEN -0.2 ELSE 0 END AS DOUBLE)
  + CAST(CASE WHEN avg_speed < 20 THEN 0.7 WHEN avg_speed < 35 THEN 0.3 WHEN avg_speed > 60 THEN -0.2 ELSE 0 END AS DOUBLE)
  + CAST(CASE WHEN weather_condition >= 3 OR precipitation > 10 THEN 0.5 WHEN weather_condition >= 2 OR precipitation > 3 THEN 0.2 ELSE 0 END AS DOUBLE)
  + CAST(CASE WHEN temperature > 38 OR temperature < 0 THEN 0.2 WHEN temperature > 33 OR temperature < 5 THEN 0.1 ELSE 0 END AS DOUBLE)
  + CAST({_BIAS_SQL} AS DOUBLE), CAST(0.0 AS DOUBLE)), CAST(3.0 AS DOUBLE)), 2) AS rule_score
FROM obs"""))
def q_congestion_score_rule(spark, sf):
    return observations(spark, sf).select("event_id", C.congestion_score_rule().alias("rule_score"))


HEURISTIC_SQL = """least(greatest(CAST(0.5 AS DOUBLE)
  + CAST(CASE WHEN is_rush_hour <> 0 THEN 0.8 WHEN hour BETWEEN 10 AND 15 THEN 0.3 WHEN hour >= 20 OR hour <= 5 THEN -0.3 ELSE 0 END AS DOUBLE)
  + CAST(CASE WHEN is_weekend <> 0 THEN -0.2 ELSE 0 END AS DOUBLE)
  + CAST(CASE WHEN traffic_volume > 1000 THEN 0.5 WHEN traffic_volume > 700 THEN 0.2 WHEN traffic_volume < 300 THEN -0.2 ELSE 0 END AS DOUBLE)
  + CAST(CASE WHEN avg_speed < 20 THEN 0.8 WHEN avg_speed < 35 THEN 0.3 WHEN avg_speed > 60 THEN -0.2 ELSE 0 END AS DOUBLE)
  + CAST(CASE WHEN weather_condition >= 3 OR precipitation > 10 THEN 0.4 WHEN weather_condition >= 1 THEN 0.1 ELSE 0 END AS DOUBLE),
  CAST(0.0 AS DOUBLE)), CAST(3.0 AS DOUBLE))"""


@register("congestion_heuristic", _with_obs(f"""
SELECT event_id, round({HEURISTIC_SQL}, 6) AS heuristic_score,
  CAST(round_even({HEURISTIC_SQL}, 0) AS INT) AS level_half_even,
  CAST(least(floor({HEURISTIC_SQL}), 3) AS INT) AS level_floor,
  CAST(trunc({HEURISTIC_SQL}) AS INT) AS level_trunc,
  {_label_sql(f'CAST(round_even({HEURISTIC_SQL}, 0) AS INT)')} AS label
FROM obs"""))
def q_congestion_heuristic(spark, sf):
    df = observations(spark, sf).withColumn("h", C.congestion_heuristic())
    return df.select("event_id", F.round("h", 6).alias("heuristic_score"),
                     C.level("h", "half_even").alias("level_half_even"),
                     C.level("h", "floor").alias("level_floor"),
                     C.level("h", "trunc").alias("level_trunc"),
                     C.level_label(C.level("h", "half_even")).alias("label"))


@register("weather_codes", _with_obs("""
SELECT event_id, CASE weather_condition WHEN 0 THEN 'Clear' WHEN 1 THEN 'Cloudy' WHEN 2 THEN 'Rainy'
  WHEN 3 THEN 'Stormy' WHEN 4 THEN 'Foggy' WHEN 5 THEN 'Snowy' ELSE 'Unknown' END AS weather_label,
  weather_condition AS roundtrip_code
FROM obs"""))
def q_weather_codes(spark, sf):
    df = observations(spark, sf)
    lab = C.weather_label("weather_condition")
    # Round trip label → code through the request normaliser's encoding,
    # with spacing / case noise as in free-form requests.
    noisy = F.concat(F.lit("  "), F.upper(lab), F.lit(" "))
    return df.select("event_id", lab.alias("weather_label"),
                     C.encode_weather(noisy).alias("roundtrip_code"))


# ------------------------------------------------------------- T transforms ---

from ..operators import transforms as T  # noqa: E402

_NULLED_SQL = """nulled AS (
  SELECT event_id,
    CASE WHEN event_id % 17 = 0 THEN NULL ELSE traffic_volume END AS traffic_volume,
    CASE WHEN event_id % 13 = 0 THEN NULL ELSE temperature END AS temperature,
    CASE WHEN event_id % 11 = 0 THEN NULL ELSE location END AS location
  FROM obs)"""


def _nulled(spark, sf):
    e = F.col("event_id")
    return observations(spark, sf).select(
        "event_id",
        F.when(e % 17 == 0, F.lit(None)).otherwise(F.col("traffic_volume")).alias("traffic_volume"),
        F.when(e % 13 == 0, F.lit(None)).otherwise(F.col("temperature")).alias("temperature"),
        F.when(e % 11 == 0, F.lit(None)).otherwise(F.col("location")).alias("location"))


@register("impute", _with_obs("""
SELECT event_id,
  coalesce(CAST(traffic_volume AS DOUBLE), (SELECT CAST(median(traffic_volume) AS DOUBLE) FROM nulled)) AS traffic_volume,
  round(coalesce(temperature, (SELECT median(temperature) FROM nulled)), 6) AS temperature,
  coalesce(location, (SELECT location FROM nulled WHERE location IS NOT NULL
                      GROUP BY location ORDER BY count(*) DESC, location LIMIT 1)) AS location
FROM nulled""", _NULLED_SQL))
def q_impute(spark, sf):
    out = T.impute(_nulled(spark, sf), numeric=["traffic_volume", "temperature"], categorical=["location"])
    return out.select("event_id", "traffic_volume", _r6("temperature"), "location")


_CAP_COLS = ["hour", "day_of_week", "day_of_month", "month", "weather_condition", "temperature",
             "humidity", "precipitation", "wind_speed", "traffic_volume", "avg_speed"]


def _cap_sql_cols():
    bounds = ", ".join(
        f"quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo_{c}, "
        f"quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi_{c}"
        for c in _CAP_COLS)
    sel = ", ".join(f"round(least(greatest(CAST({c} AS DOUBLE), lo_{c}), hi_{c}), 6) + 0.0 AS {c}"
                    for c in _CAP_COLS)
    return bounds, sel


_B, _S = _cap_sql_cols()


@register("cap_outliers_iqr", _with_obs(f"SELECT event_id, {_S} FROM obs CROSS JOIN (SELECT {_B} FROM obs)"))
def q_cap_outliers_iqr(spark, sf):
    df = observations(spark, sf)
    out = T.cap_outliers_iqr(df)  # default columns: numeric minus the six excluded and the row id
    return out.select("event_id", *[_r6(c) for c in _CAP_COLS])


_Z_COLS = ["temperature", "humidity", "precipitation", "wind_speed", "traffic_volume", "avg_speed"]
_ZB = ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}, median({c}) AS md_{c}" for c in _Z_COLS)
_ZS = ", ".join(f"round(CASE WHEN abs(({c} - m_{c}) / nullif(s_{c}, 0)) > 3 THEN CAST(md_{c} AS DOUBLE) "
                f"ELSE CAST({c} AS DOUBLE) END, 6) AS {c}" for c in _Z_COLS)


@register("replace_outliers_zscore", _with_obs(f"SELECT event_id, {_ZS} FROM obs CROSS JOIN (SELECT {_ZB} FROM obs)"))
def q_replace_outliers_zscore(spark, sf):
    out = T.replace_outliers_zscore(observations(spark, sf), _Z_COLS, 3.0)
    return out.select("event_id", *[_r6(c) for c in _Z_COLS])


@register("label_encode", _with_obs("""
SELECT event_id, location, CAST(dense_rank() OVER (ORDER BY location) - 1 AS INT) AS location_encoded FROM obs"""))
def q_label_encode(spark, sf):
    out, _ = T.label_encode(observations(spark, sf).select("event_id", "location"), ["location"])
    return out.select("event_id", "location", "location_encoded")


_SC_COLS = ["hour", "temperature", "humidity", "precipitation", "wind_speed", "traffic_volume",
            "avg_speed", "is_holiday"]
_SCB = ", ".join(f"avg({c}) AS m_{c}, coalesce(nullif(stddev_pop({c}), 0), 1) AS s_{c}" for c in _SC_COLS)
_SCS = ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) + 0.0 AS {c}_scaled" for c in _SC_COLS)


@register("standard_scale", _with_obs(f"SELECT event_id, {_SCS} FROM obs CROSS JOIN (SELECT {_SCB} FROM obs)"))
def q_standard_scale(spark, sf):
    out = T.standard_scale(observations(spark, sf), _SC_COLS, suffix="_scaled")
    return out.select("event_id", *[_r6(f"{c}_scaled") for c in _SC_COLS])


def _stratum_sql(name: str, source: str, share: float) -> str:
    """CTEs that rank ``source`` into ten strata and mark, per stratum, the rows with
    the smallest draws: ceil(share * n) rows, allocated by largest remainder."""
    return f"""
{name}_r AS (SELECT *, row_number() OVER (ORDER BY congestion_level, event_id) AS r, count(*) OVER () AS n FROM {source}),
{name}_b AS (SELECT event_id, congestion_level, u, n, CAST(greatest(0, ((r - 1) * 10 + n - 2) // (n - 1) - 1) AS INT) AS bin FROM {name}_r),
{name}_q AS (SELECT bin, m, n, ceil({share} * n) AS total, ceil({share} * n) * m / n AS exact
  FROM (SELECT bin, count(*) AS m, any_value(n) AS n FROM {name}_b GROUP BY bin)),
{name}_k AS (SELECT bin, floor(exact) + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, bin)
  <= total - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS quota FROM {name}_q),
{name}_p AS (SELECT b.*, row_number() OVER (PARTITION BY b.bin ORDER BY u, event_id) <= k.quota AS picked
  FROM {name}_b b JOIN {name}_k k USING (bin))"""


@register("stratified_split", _with_obs("""
SELECT event_id, CASE WHEN t.picked THEN 'test' WHEN v.picked THEN 'validation' ELSE 'train' END AS split, t.bin
FROM t_p t LEFT JOIN v_p v USING (event_id)""",
  f"d AS (SELECT event_id, congestion_level, {draw_sql(42)} AS u FROM obs)," + _stratum_sql("t", "d", 0.2)
  + ", rest AS (SELECT event_id, congestion_level, u FROM t_p WHERE NOT picked)," + _stratum_sql("v", "rest", 0.125)))
def q_stratified_split(spark, sf):
    # every row's part, with its stratum of the target
    return T.stratified_split(observations(spark, sf).select("event_id", "congestion_level"), bin_col="bin").select(
        "event_id", "split", "bin")


@register("preprocess", _with_obs(
    f"SELECT event_id, {_S}, CAST(dense_rank() OVER (ORDER BY location) - 1 AS INT) AS location_encoded "
    f"FROM obs CROSS JOIN (SELECT {_B} FROM obs)"))
def q_preprocess(spark, sf):
    from .training import preprocess
    out, _state = preprocess(observations(spark, sf))
    return out.select("event_id", *[_r6(c) for c in _CAP_COLS], "location_encoded")


_ENG_TIME = ["minutes_from_midnight", "part_of_day", "is_business_hours", "day_of_year"]
_ENG_TERMS = ["volume_weather_interaction", "speed_volume_ratio", "rush_hour_volume", "weekend_volume",
              "temp_humidity_index", "storm_severity", "weather_impact_score", "congestion_acceleration"]
_ENG_LAGS = [f"{c}_lag_{k}h" for c in W.DEFAULT_COLUMNS for k in W.DEFAULT_LAGS]
_ENG_ROLL = [f"{c}_rolling_{s}_{k}h" for c in W.DEFAULT_COLUMNS for k in W.DEFAULT_WINDOWS for s in ("mean", "std", "max", "min")]


def _engineered_sql() -> str:
    w = '(PARTITION BY location ORDER BY "timestamp", event_id'
    lags = ", ".join(f"lag({c}, {k}) OVER {w}) AS {c}_lag_{k}h" for c in W.DEFAULT_COLUMNS for k in W.DEFAULT_LAGS)
    roll = []
    for c in W.DEFAULT_COLUMNS:
        for k in W.DEFAULT_WINDOWS:
            frame = f"OVER {w} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
            roll += [f"{f} {frame} AS {c}_rolling_{s}_{k}h" for s, f in (
                ("mean", f"avg({c})"), ("std", f"stddev_samp({c})"), ("max", f"max({c})"), ("min", f"min({c})"))]
    rounded = ", ".join([f"round({c}, 6) AS {c}" if "_mean_" in c else f"round(coalesce({c}, 0), 6) AS {c}" if "_std_" in c else c
                         for c in _ENG_ROLL])
    return _with_obs(f"""
SELECT event_id, location, CAST(hour * 60 AS INT) AS minutes_from_midnight,
  CASE WHEN hour >= 5 AND hour < 12 THEN 0 WHEN hour >= 12 AND hour < 17 THEN 1
       WHEN hour >= 17 AND hour < 21 THEN 2 ELSE 3 END AS part_of_day,
  CASE WHEN hour >= 9 AND hour <= 17 AND is_weekend = 0 THEN 1 ELSE 0 END AS is_business_hours,
  CAST(month * 30 + day_of_month AS INT) AS day_of_year,
  {", ".join(_ENG_LAGS)}, {rounded},
  round(traffic_volume * (weather_condition + 1) / 1000.0, 6) AS volume_weather_interaction,
  round(CASE WHEN traffic_volume > 0 THEN avg_speed / traffic_volume ELSE 0 END, 6) AS speed_volume_ratio,
  is_rush_hour * traffic_volume AS rush_hour_volume, is_weekend * traffic_volume AS weekend_volume,
  round(temperature * 0.5 + humidity * 0.5, 6) AS temp_humidity_index,
  round(precipitation * 0.6 + wind_speed * 0.4, 6) AS storm_severity,
  round(0.3 * precipitation / nullif(mp, 0) + 0.2 * wind_speed / nullif(mw, 0)
    + 0.2 * abs(temperature - 25) / 25 + 0.15 * humidity / 100 + 0.15 * weather_condition / 5, 6) AS weather_impact_score,
  CASE WHEN d > 0.1 THEN 1 WHEN d < -0.1 THEN -1 ELSE 0 END AS congestion_trend,
  round(coalesce(d - last_d, 0), 6) + 0.0 AS congestion_acceleration
FROM (SELECT *, lag(d) OVER {w}) AS last_d FROM (
        SELECT *, s - lag(s) OVER {w}) AS d FROM (
          SELECT *, avg(congestion_level) OVER {w} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS s,
            max(precipitation) OVER () AS mp, max(wind_speed) OVER () AS mw, {lags}, {", ".join(roll)} FROM obs)))
WHERE {" AND ".join(f"{c} IS NOT NULL" for c in _ENG_LAGS)}""")


@register("engineer_features", _engineered_sql())
def q_engineer_features(spark, sf):
    from .features import engineer_features
    out = engineer_features(observations(spark, sf))
    exact = {"rush_hour_volume", "weekend_volume"}
    return out.select(*_KEY, *_ENG_TIME, *_ENG_LAGS,
                      *[_r6(c) if "_mean_" in c or "_std_" in c else F.col(c) for c in _ENG_ROLL],
                      *[F.col(c) if c in exact else _r6(c) for c in _ENG_TERMS], "congestion_trend")
