"""Driver tables and the observation adapter view.

``observations(spark, sf_dir)`` turns the ``events`` table into the
observation data model: a pure projection (no shuffle), so it scales with
the scan and every downstream plan still prunes columns / pushes filters
into the parquet reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import LOCATIONS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _location_of(user_id: Column) -> Column:
    names = F.array(*[F.lit(n) for n in LOCATIONS])
    return F.element_at(names, (F.pmod(user_id, F.lit(len(LOCATIONS))) + 1).cast("int"))


def observations_from_events(events: DataFrame) -> DataFrame:
    """Map ``events`` rows onto the 17 observation columns plus ``event_id``.

    Deterministic functions of ``event_id``, ``ts``, ``user_id`` and
    ``value`` only, so DuckDB computes the same rows (see
    ``plans.catalog.OBS_SQL``).
    """
    ts = F.col("ts")
    h = F.hour(ts)
    d = F.weekday(ts)
    eid = F.col("event_id")
    return events.select(
        eid.alias("event_id"),
        ts.alias("timestamp"),
        h.cast("int").alias("hour"),
        d.cast("int").alias("day_of_week"),
        F.dayofmonth(ts).cast("int").alias("day_of_month"),
        F.month(ts).cast("int").alias("month"),
        F.when(d >= 5, 1).otherwise(0).alias("is_weekend"),
        F.lit(0).alias("is_holiday"),
        F.when((d < 5) & (h.between(7, 9) | h.between(17, 19)), 1).otherwise(0).alias("is_rush_hour"),
        _location_of(F.col("user_id")).alias("location"),
        F.pmod(eid, F.lit(6)).cast("int").alias("weather_condition"),
        (F.pmod(eid * 37, F.lit(560)) / F.lit(10.0) - 10).alias("temperature"),
        (F.lit(10) + F.pmod(eid * 53, F.lit(901)) / F.lit(10.0)).alias("humidity"),
        F.when(F.pmod(eid, F.lit(6)) == 0, F.lit(0.0)).otherwise(F.col("value") / 10).alias("precipitation"),
        (F.pmod(eid * 29, F.lit(500)) / F.lit(10.0)).alias("wind_speed"),
        F.pmod(eid * 131, F.lit(1500)).cast("int").alias("traffic_volume"),
        (F.lit(5) + F.pmod(eid * 17, F.lit(86))).cast("int").alias("avg_speed"),
        (F.pmod(eid * 97 + h * 13, F.lit(301)) / F.lit(100.0)).alias("congestion_level"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations_from_events(table(spark, sf_dir, "events"))
