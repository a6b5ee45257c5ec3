"""Observation schema and the fixed code tables of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Column order of an observation row (canonical order used by ``select_ordered``).
OBSERVATION_COLUMNS = [
    "timestamp", "hour", "day_of_week", "day_of_month", "month",
    "is_weekend", "is_holiday", "is_rush_hour",
    "location", "weather_condition",
    "temperature", "humidity", "precipitation", "wind_speed",
    "traffic_volume", "avg_speed", "congestion_level",
]

OBSERVATION_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("hour", T.IntegerType()),
    T.StructField("day_of_week", T.IntegerType()),
    T.StructField("day_of_month", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("is_weekend", T.IntegerType()),
    T.StructField("is_holiday", T.IntegerType()),
    T.StructField("is_rush_hour", T.IntegerType()),
    T.StructField("location", T.StringType()),
    T.StructField("weather_condition", T.IntegerType()),
    T.StructField("temperature", T.DoubleType()),
    T.StructField("humidity", T.DoubleType()),
    T.StructField("precipitation", T.DoubleType()),
    T.StructField("wind_speed", T.DoubleType()),
    T.StructField("traffic_volume", T.IntegerType()),
    T.StructField("avg_speed", T.IntegerType()),
    T.StructField("congestion_level", T.DoubleType()),
])

# Observation schema plus the row id used for tie-breaks, sampling and splits.
OBSERVATION_WITH_ID_SCHEMA = T.StructType(
    [T.StructField("event_id", T.LongType())] + list(OBSERVATION_SCHEMA.fields))

TARGET = "congestion_level"
ROW_ID = "event_id"

# --- Fixed values (must equal the reference data model) -------------------
# Congestion level labels, level 0..3.
LEVEL_LABELS = {0: "Low", 1: "Moderate", 2: "High", 3: "Severe"}
# Weather codes 0..5.
WEATHER_LABELS = {0: "Clear", 1: "Cloudy", 2: "Rainy", 3: "Stormy", 4: "Foggy", 5: "Snowy"}
# Monitored locations, in configured order.
LOCATIONS = [
    "Downtown", "Highway_A", "Highway_B", "Residential_A",
    "Commercial_A", "Airport_Road", "Ring_Road", "Bridge_1",
    "Bridge_2", "Market_Area", "Industrial_Zone", "University_Area",
]
# Baseline congestion added per location by the generating rule.
LOCATION_BIAS = {
    "Downtown": 0.3, "Highway_A": 0.2, "Highway_B": 0.2, "Commercial_A": 0.2,
    "Airport_Road": 0.15, "Ring_Road": 0.15, "Bridge_1": 0.25, "Bridge_2": 0.25,
    "Market_Area": 0.2, "Industrial_Zone": 0.15, "University_Area": 0.1,
    "Residential_A": -0.1,
}
# The 13 model inputs, in the order the fitted scaler expects.
MODEL_FEATURES = [
    "hour", "day_of_week", "month", "is_weekend", "is_holiday",
    "temperature", "humidity", "precipitation", "wind_speed",
    "traffic_volume", "avg_speed", "location_encoded", "is_rush_hour",
]
# The 25 declared model features (only 13 exist after the reference pipeline).
DECLARED_FEATURES = [
    "hour", "day_of_week", "month", "is_weekend", "is_holiday",
    "temperature", "humidity", "precipitation", "wind_speed",
    "traffic_volume", "avg_speed", "weather_condition_encoded",
    "location_encoded", "is_rush_hour", "day_sin", "day_cos",
    "month_sin", "month_cos", "hour_sin", "hour_cos",
    "traffic_lag_1h", "traffic_lag_2h", "traffic_lag_3h",
    "traffic_rolling_mean_3h", "speed_rolling_mean_3h",
]
# Ensemble weights: training form excludes linear regression, serving adds it.
TRAINING_WEIGHTS = {"random_forest": 0.30, "xgboost": 0.35, "lstm": 0.25, "linear_regression": 0.10}
SERVING_WEIGHTS = {"random_forest": 0.30, "xgboost": 0.35, "lstm": 0.25, "linear_regression": 0.10}
UNKNOWN_SERVING_WEIGHT = 0.25
# Request defaults applied when a field is missing.
REQUEST_DEFAULTS = {
    "hour": 12, "day_of_week": 0, "month": 1, "is_weekend": 0, "is_rush_hour": 0,
    "temperature": 25.0, "humidity": 60.0, "precipitation": 0.0, "wind_speed": 10.0,
    "traffic_volume": 500, "avg_speed": 50, "weather_condition": "Clear",
    "location": "Downtown",
}
# ---------------------------------------------------------------------------
