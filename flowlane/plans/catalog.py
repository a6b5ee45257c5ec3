"""Registered queries: one Spark callable and (where SQL can say it) one
DuckDB-runnable oracle statement per operator.

Every query starts from the driver's ``events`` table through the
observation adapter, so its work grows with the table. Doubles that the
two engines may sum in a different order are rounded to 6 dp on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import LOCATIONS
from ..sources.tables import observations
from ..operators import profiles as A

_LOC_LIST = ", ".join(f"'{n}'" for n in LOCATIONS)

# DuckDB twin of ``sources.tables.observations_from_events``.
OBS_SQL = f"""
obs AS (
  WITH t AS (SELECT event_id, ts, hour(ts) AS h, isodow(ts) - 1 AS d, user_id, value FROM events)
  SELECT event_id, ts AS "timestamp", CAST(h AS INT) AS hour, CAST(d AS INT) AS day_of_week,
    CAST(day(ts) AS INT) AS day_of_month, CAST(month(ts) AS INT) AS month,
    CASE WHEN d >= 5 THEN 1 ELSE 0 END AS is_weekend, 0 AS is_holiday,
    CASE WHEN d < 5 AND (h BETWEEN 7 AND 9 OR h BETWEEN 17 AND 19) THEN 1 ELSE 0 END AS is_rush_hour,
    list_extract([{_LOC_LIST}], CAST(user_id % 12 + 1 AS INT)) AS location,
    CAST(event_id % 6 AS INT) AS weather_condition,
    (event_id * 37 % 560) / CAST(10 AS DOUBLE) - 10 AS temperature,
    10 + (event_id * 53 % 901) / CAST(10 AS DOUBLE) AS humidity,
    CASE WHEN event_id % 6 = 0 THEN CAST(0 AS DOUBLE) ELSE value / 10 END AS precipitation,
    (event_id * 29 % 500) / CAST(10 AS DOUBLE) AS wind_speed,
    CAST(event_id * 131 % 1500 AS INT) AS traffic_volume,
    CAST(5 + event_id * 17 % 86 AS INT) AS avg_speed,
    ((event_id * 97 + h * 13) % 301) / CAST(100 AS DOUBLE) AS congestion_level
  FROM t
)"""


def _with_obs(body: str, extra_ctes: str = "") -> str:
    ctes = OBS_SQL + ("," + extra_ctes if extra_ctes else "")
    return f"WITH {ctes}\n{body}"


def _r6(c: str) -> F.Column:
    return F.round(F.col(c), 6).alias(c)


LEVEL_LABEL_SQL = ("CASE {x} WHEN 0 THEN 'Low' WHEN 1 THEN 'Moderate' WHEN 2 THEN 'High' "
                   "WHEN 3 THEN 'Severe' ELSE 'Unknown' END")


def _label_sql(x: str) -> str:
    return LEVEL_LABEL_SQL.format(x=x)


_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        _Q[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn
    return deco


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(_SQL)


def _load_all() -> None:
    # Query groups register themselves on import.
    from . import catalog_features, catalog_models  # noqa: F401


# ----------------------------------------------------------------- A / L ---

@register("location_ranking", _with_obs(f"""
SELECT CAST(row_number() OVER (ORDER BY m DESC, location) AS INT) AS rank, location,
  round_even(m, 3) AS avg_congestion, CAST(round_even(v, 0) AS BIGINT) AS avg_traffic_volume,
  CAST(round_even(s, 0) AS BIGINT) AS avg_speed, samples,
  CAST(round_even(m, 0) AS INT) AS congestion_level,
  {_label_sql('CAST(round_even(m, 0) AS INT)')} AS congestion_label
FROM (SELECT location, avg(congestion_level) AS m, avg(traffic_volume) AS v, avg(avg_speed) AS s,
        count(congestion_level) AS samples FROM obs GROUP BY location)"""))
def q_location_ranking(spark, sf):
    return A.location_ranking(observations(spark, sf))


@register("location_summary", _with_obs("""
SELECT count(*) AS total_locations, arg_max(location, m) AS most_congested,
  arg_min(location, m) AS least_congested
FROM (SELECT location, avg(congestion_level) AS m FROM obs GROUP BY location)"""))
def q_location_summary(spark, sf):
    return A.location_summary(A.location_ranking(observations(spark, sf)))


@register("time_profile", _with_obs("""
SELECT 'hour' AS dimension, hour AS key, round(avg(congestion_level), 6) AS avg_congestion,
  count(congestion_level) AS samples FROM obs GROUP BY hour
UNION ALL
SELECT 'day_of_week', day_of_week, round(avg(congestion_level), 6), count(congestion_level) FROM obs GROUP BY day_of_week
UNION ALL
SELECT 'month', month, round(avg(congestion_level), 6), count(congestion_level) FROM obs GROUP BY month"""))
def q_time_profile(spark, sf):
    return A.time_profile(observations(spark, sf)).select("dimension", "key", _r6("avg_congestion"), "samples")


@register("rush_split", _with_obs("""
SELECT round(coalesce(avg(CASE WHEN is_rush_hour = 1 THEN congestion_level END), 0), 6) AS rush_hour_avg,
  round(coalesce(avg(CASE WHEN is_rush_hour = 0 THEN congestion_level END), 0), 6) AS non_rush_avg FROM obs"""))
def q_rush_split(spark, sf):
    return A.rush_split(observations(spark, sf)).select(_r6("rush_hour_avg"), _r6("non_rush_avg"))


@register("weather_impact", _with_obs("""
SELECT weather_condition, round(avg(congestion_level), 6) AS avg_congestion,
  count(congestion_level) AS samples FROM obs GROUP BY weather_condition"""))
def q_weather_impact(spark, sf):
    return A.weather_impact(observations(spark, sf)).select("weather_condition", _r6("avg_congestion"), "samples")


@register("optimal_times", _with_obs("""
SELECT location, best_hour, worst_hour,
  printf('%02d:00 - %02d:00', best_hour, (best_hour + 1) % 24) AS best_time,
  printf('%02d:00 - %02d:00', worst_hour, (worst_hour + 1) % 24) AS worst_time,
  round(mn, 6) AS congestion_level, round(mx, 6) AS max_congestion,
  CAST(trunc(bv) AS BIGINT) AS traffic_volume, CAST(trunc(bs) AS BIGINT) AS avg_speed,
  round_even((1 - mn / greatest(mx, 0.01)) * 100, 1) AS improvement_pct
FROM (
  SELECT location,
    min(m) AS mn, max(m) AS mx,
    first(hour ORDER BY m, hour) AS best_hour,
    first(hour ORDER BY m DESC, hour) AS worst_hour,
    first(v ORDER BY m, hour) AS bv, first(s ORDER BY m, hour) AS bs
  FROM (SELECT location, hour, avg(congestion_level) AS m, avg(traffic_volume) AS v,
          avg(avg_speed) AS s FROM obs GROUP BY location, hour)
  GROUP BY location)"""))
def q_optimal_times(spark, sf):
    return A.optimal_times(observations(spark, sf)).select(
        "location", "best_hour", "worst_hour", "best_time", "worst_time",
        _r6("congestion_level"), _r6("max_congestion"), "traffic_volume", "avg_speed", "improvement_pct")


OUTLOOK_HOUR = 22  # explicit "current hour" (wraps past midnight)


@register("hour_outlook", _with_obs(f"""
SELECT f.offset, f.hour, round_even(coalesce(h.m, 0), 3) AS predicted_congestion,
  {_label_sql('CAST(round_even(coalesce(h.m, 0), 0) AS INT)')} AS label,
  CASE WHEN nx > cu THEN 'increasing' WHEN nx < cu THEN 'decreasing' ELSE 'stable' END AS trend_direction
FROM (SELECT CAST(i AS INT) AS offset, CAST((i + {OUTLOOK_HOUR}) % 24 AS INT) AS hour FROM range(6) r(i)) f
LEFT JOIN (SELECT hour, avg(congestion_level) AS m FROM obs GROUP BY hour) h USING (hour)
CROSS JOIN (
  SELECT coalesce(max(CASE WHEN hour = {OUTLOOK_HOUR} THEN m END), 0) AS cu,
         coalesce(max(CASE WHEN hour = {(OUTLOOK_HOUR + 1) % 24} THEN m END), 0) AS nx
  FROM (SELECT hour, avg(congestion_level) AS m FROM obs GROUP BY hour))"""))
def q_hour_outlook(spark, sf):
    return A.hour_outlook(observations(spark, sf), OUTLOOK_HOUR)


@register("summary_stats", _with_obs("""
SELECT count(*) AS total_records, round(avg(congestion_level), 6) AS avg_congestion,
  round(avg(traffic_volume), 6) AS avg_traffic_volume, round(avg(avg_speed), 6) AS avg_speed,
  count(DISTINCT location) AS locations FROM obs"""))
def q_summary_stats(spark, sf):
    return A.summary_stats(observations(spark, sf)).select(
        "total_records", _r6("avg_congestion"), _r6("avg_traffic_volume"), _r6("avg_speed"), "locations")


@register("value_distribution", _with_obs(f"""
SELECT congestion_level AS value, count(*) AS count,
  CASE WHEN congestion_level = floor(congestion_level) AND congestion_level BETWEEN 0 AND 3
       THEN {_label_sql('CAST(congestion_level AS INT)')}
       ELSE 'Level ' || CAST(congestion_level AS VARCHAR) END AS label
FROM obs GROUP BY congestion_level"""))
def q_value_distribution(spark, sf):
    return A.value_distribution(observations(spark, sf))


@register("level_distribution", _with_obs(f"""
SELECT l.level, {_label_sql('l.level')} AS label, coalesce(c.n, 0) AS count,
  round_even(coalesce(c.n, 0) * 100.0 / sum(coalesce(c.n, 0)) OVER (), 2) AS pct
FROM (SELECT CAST(i AS INT) AS level FROM range(4) r(i)) l
LEFT JOIN (SELECT CAST(least(floor(least(greatest(congestion_level, 0), 3)), 3) AS INT) AS level,
             count(*) AS n FROM obs GROUP BY 1) c USING (level)"""))
def q_level_distribution(spark, sf):
    return A.level_distribution(observations(spark, sf), "floor")


_HEAT_COLS = ", ".join(
    f"round(avg(CASE WHEN hour = {h} THEN congestion_level END), 6) AS h{h:02d}" for h in range(24))


@register("heatmap", _with_obs(f"SELECT location, {_HEAT_COLS} FROM obs GROUP BY location"))
def q_heatmap(spark, sf):
    df = A.heatmap(observations(spark, sf))
    return df.select("location", *[_r6(c) for c in df.columns if c != "location"])


@register("hourly_band", _with_obs("""
SELECT hour, round(avg(congestion_level), 6) AS mean, round(stddev_samp(congestion_level), 6) AS std,
  round(avg(congestion_level) + stddev_samp(congestion_level), 6) AS upper,
  round(avg(congestion_level) - stddev_samp(congestion_level), 6) AS lower
FROM obs GROUP BY hour"""))
def q_hourly_band(spark, sf):
    return A.hourly_band(observations(spark, sf)).select(
        "hour", _r6("mean"), _r6("std"), _r6("upper"), _r6("lower"))


@register("time_series", _with_obs("""
SELECT "timestamp", event_id, traffic_volume, avg_speed, congestion_level
FROM obs ORDER BY "timestamp", event_id LIMIT 500"""))
def q_time_series(spark, sf):
    return A.time_series(observations(spark, sf), 500)


def draw_sql(seed: int) -> str:
    """SQL twin of ``uniform_draw("event_id", seed)``."""
    return f"(('0x' || substr(md5(CAST(event_id AS VARCHAR) || ':{seed}'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0)"


_SAMPLE_SQL = f"SELECT * FROM obs ORDER BY {draw_sql(42)}, event_id LIMIT 500"


@register("sample_exact", _with_obs(_SAMPLE_SQL))
def q_sample_exact(spark, sf):
    return A.sample_exact(observations(spark, sf), 500, seed=42)


@register("sample_stats", _with_obs(f"""
SELECT v.*, s.* FROM (
  SELECT congestion_level AS value, count(*) AS count,
    CASE WHEN congestion_level = floor(congestion_level) AND congestion_level BETWEEN 0 AND 3
         THEN {_label_sql('CAST(congestion_level AS INT)')}
         ELSE 'Level ' || CAST(congestion_level AS VARCHAR) END AS label
  FROM ({_SAMPLE_SQL}) GROUP BY congestion_level) v
CROSS JOIN (
  SELECT count(*) AS total_records, round(avg(congestion_level), 6) AS avg_congestion,
    round(avg(traffic_volume), 6) AS avg_traffic_volume, round(avg(avg_speed), 6) AS avg_speed,
    count(DISTINCT location) AS locations FROM ({_SAMPLE_SQL})) s"""))
def q_sample_stats(spark, sf):
    # the sample's value distribution beside its one row of statistics
    _, stats, values = A.sample_with_stats(observations(spark, sf), 500, seed=42)
    return values.crossJoin(F.broadcast(stats)).select(
        *values.columns, "total_records", _r6("avg_congestion"), _r6("avg_traffic_volume"), _r6("avg_speed"), "locations")


@register("congestion_gauge", _with_obs("""
SELECT round(avg(congestion_level), 6) AS avg_congestion,
  least(round(avg(congestion_level) / 3 * 100, 0), 100.0) AS congestion_rate_pct FROM obs"""))
def q_congestion_gauge(spark, sf):
    return A.congestion_gauge(observations(spark, sf)).select(_r6("avg_congestion"), "congestion_rate_pct")


_DESC_COLS = ["congestion_level", "traffic_volume", "temperature", "precipitation"]


@register("describe", _with_obs("\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 6) AS mean, "
    f"round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS min, "
    f"round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, "
    f"round(quantile_cont({c}, 0.75), 6) AS q75, CAST(max({c}) AS DOUBLE) AS max FROM obs"
    for c in _DESC_COLS)))
def q_describe(spark, sf):
    d = A.describe(observations(spark, sf), _DESC_COLS)
    return d.select("column", "count", _r6("mean"), _r6("std"), "min", _r6("q25"), _r6("q50"),
                    _r6("q75"), "max")


@register("missing_count", _with_obs("""
SELECT count(*) FILTER (WHERE event_id IS NULL) AS event_id,
  count(*) FILTER (WHERE traffic_volume IS NULL) AS traffic_volume,
  count(*) FILTER (WHERE temperature IS NULL) AS temperature,
  count(*) FILTER (WHERE location IS NULL) AS location,
  count(*) FILTER (WHERE traffic_volume IS NULL) + count(*) FILTER (WHERE temperature IS NULL)
    + count(*) FILTER (WHERE location IS NULL) + count(*) FILTER (WHERE event_id IS NULL) AS total_missing
FROM (SELECT event_id,
    CASE WHEN event_id % 17 = 0 THEN NULL ELSE traffic_volume END AS traffic_volume,
    CASE WHEN event_id % 13 = 0 THEN NULL ELSE temperature END AS temperature,
    CASE WHEN event_id % 11 = 0 THEN NULL ELSE location END AS location FROM obs)"""))
def q_missing_count(spark, sf):
    from .catalog_features import _nulled
    return A.missing_count(_nulled(spark, sf))
