"""Column expressions (P1-P18, F-predicates).

All are built-in Spark expressions, so they stay inside whole-stage
codegen; none needs a Python UDF. Each takes Columns (or names) and
returns a Column, so the same expression serves batch, streaming and
single-request DataFrames.
"""

from __future__ import annotations

import math
from typing import Union

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import LEVEL_LABELS, LOCATION_BIAS, WEATHER_LABELS

ColumnOrName = Union[Column, str]


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _map(d: dict) -> Column:
    kv = []
    for k, v in d.items():
        kv += [F.lit(k), F.lit(v)]
    return F.create_map(*kv)


# --- P1 / P2: calendar fields -------------------------------------------

def time_fields(ts: ColumnOrName = "timestamp") -> dict[str, Column]:
    """Hour, Monday=0 day_of_week, day_of_month, month, weekend flag
    (day_of_week >= 5) and the holiday flag (always 0)."""
    t = _c(ts)
    dow = F.weekday(t)
    return {
        "hour": F.hour(t).cast("int"),
        "day_of_week": dow.cast("int"),
        "day_of_month": F.dayofmonth(t).cast("int"),
        "month": F.month(t).cast("int"),
        "is_weekend": F.when(dow >= 5, 1).otherwise(0),
        "is_holiday": F.lit(0),
    }


def rush_hour(hour: ColumnOrName = "hour", is_weekend: ColumnOrName = "is_weekend",
              weekend_aware: bool = True) -> Column:
    """1 when hour is in 7-9 or 17-19 (and, if weekend aware, not a
    weekend)."""
    h = _c(hour)
    peak = h.between(7, 9) | h.between(17, 19)
    if weekend_aware:
        peak = peak & (F.coalesce(_c(is_weekend), F.lit(0)) == 0)
    return F.when(peak, 1).otherwise(0)


def hourly_multiplier(hour: ColumnOrName = "hour", is_weekend: ColumnOrName = "is_weekend") -> Column:
    """Traffic multiplier by hour, separate weekend / weekday curves."""
    h = _c(hour)
    weekend = (F.when(h.between(8, 11), 0.7).when(h.between(12, 17), 0.8)
               .when(h.between(18, 22), 0.6).otherwise(0.2))
    weekday = (F.when(h.between(7, 9), 1.0 + 0.2 * F.sin(F.lit(math.pi) * (h - 7) / 2))
               .when(h.between(10, 15), 0.6 + 0.1 * F.sin(F.lit(math.pi) * (h - 10) / 5))
               .when(h.between(16, 19), 1.0 + 0.2 * F.sin(F.lit(math.pi) * (h - 16) / 3))
               .when(h.between(20, 23), F.lit(0.4)).otherwise(F.lit(0.1)))
    return F.when(_c(is_weekend) != 0, weekend).otherwise(weekday).cast("double")


# --- P4: extra time features ---------------------------------------------

def minutes_from_midnight(hour: ColumnOrName = "hour") -> Column:
    return (_c(hour) * 60).cast("int")


def part_of_day(hour: ColumnOrName = "hour") -> Column:
    """[5,12) morning 0, [12,17) afternoon 1, [17,21) evening 2, else 3."""
    h = _c(hour)
    return (F.when((h >= 5) & (h < 12), 0).when((h >= 12) & (h < 17), 1)
            .when((h >= 17) & (h < 21), 2).otherwise(3))


def is_business_hours(hour: ColumnOrName = "hour", is_weekend: ColumnOrName = "is_weekend") -> Column:
    """9 <= hour <= 17 on a weekday (hour 17 included)."""
    h = _c(hour)
    return F.when((h >= 9) & (h <= 17) & (_c(is_weekend) == 0), 1).otherwise(0)


def approx_day_of_year(month: ColumnOrName = "month", day: ColumnOrName = "day_of_month") -> Column:
    """P4d: month*30 + day_of_month (an approximation kept for parity; use
    ``F.dayofyear`` for the true value)."""
    return (_c(month) * 30 + _c(day)).cast("int")


# --- P5: interactions -----------------------------------------------------

def interaction_columns(columns: list[str] | None = None) -> dict[str, Column]:
    """P5a-f; with ``columns`` only the terms whose inputs are among them."""
    vol = F.col("traffic_volume")
    terms = {
        "volume_weather_interaction": (["traffic_volume", "weather_condition"],
                                       vol * (F.col("weather_condition") + 1) / F.lit(1000.0)),
        "speed_volume_ratio": (["traffic_volume", "avg_speed"],
                               F.when(vol > 0, F.col("avg_speed") / vol).otherwise(F.lit(0.0))),
        "rush_hour_volume": (["is_rush_hour", "traffic_volume"], F.col("is_rush_hour") * vol),
        "weekend_volume": (["is_weekend", "traffic_volume"], F.col("is_weekend") * vol),
        "temp_humidity_index": (["temperature", "humidity"],
                                F.col("temperature") * 0.5 + F.col("humidity") * 0.5),
        "storm_severity": (["precipitation", "wind_speed"],
                           F.col("precipitation") * 0.6 + F.col("wind_speed") * 0.4),
    }
    return {name: term for name, (needs, term) in terms.items()
            if columns is None or set(needs) <= set(columns)}


# --- P7: cyclic encoding --------------------------------------------------

def cyclic_encode(col: ColumnOrName, period: float) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * _c(col) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


# --- P8 / P9: rule scores -------------------------------------------------

def _level_clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(3.0))


def congestion_score_rule(noise: Column | None = None) -> Column:
    """The data-generating rule without noise (add ``noise`` e.g.
    ``F.randn(42) * 0.15`` to reproduce the noisy target), clamped to 0-3
    and rounded to 2 decimals."""
    h, vol, spd = F.col("hour"), F.col("traffic_volume"), F.col("avg_speed")
    wx, pr, tp = F.col("weather_condition"), F.col("precipitation"), F.col("temperature")
    s = (F.lit(0.3)
         + F.when(F.col("is_rush_hour") != 0, 0.8).when(h.between(10, 15), 0.2)
         .when((h >= 20) | (h <= 5), -0.2).otherwise(0.0)
         + F.when(F.col("is_weekend") != 0, -0.15).otherwise(0.0)
         + F.when(vol > 1000, 0.5).when(vol > 700, 0.25).when(vol < 300, -0.2).otherwise(0.0)
         + F.when(spd < 20, 0.7).when(spd < 35, 0.3).when(spd > 60, -0.2).otherwise(0.0)
         + F.when((wx >= 3) | (pr > 10), 0.5).when((wx >= 2) | (pr > 3), 0.2).otherwise(0.0)
         + F.when((tp > 38) | (tp < 0), 0.2).when((tp > 33) | (tp < 5), 0.1).otherwise(0.0)
         + F.coalesce(F.try_element_at(_map(LOCATION_BIAS), F.col("location")), F.lit(0.0)))
    if noise is not None:
        s = s + noise
    return round_binary(_level_clamp(s), 2)


def congestion_heuristic() -> Column:
    """Fallback score when no model is available. Missing inputs take
    hour 12, volume 500, speed 50, everything else 0."""
    h = F.coalesce(F.col("hour"), F.lit(12))
    vol = F.coalesce(F.col("traffic_volume"), F.lit(500))
    spd = F.coalesce(F.col("avg_speed"), F.lit(50))
    wx = F.coalesce(F.col("weather_condition"), F.lit(0))
    pr = F.coalesce(F.col("precipitation"), F.lit(0.0))
    s = (F.lit(0.5)
         + F.when(F.coalesce(F.col("is_rush_hour"), F.lit(0)) != 0, 0.8)
         .when(h.between(10, 15), 0.3).when((h >= 20) | (h <= 5), -0.3).otherwise(0.0)
         + F.when(F.coalesce(F.col("is_weekend"), F.lit(0)) != 0, -0.2).otherwise(0.0)
         + F.when(vol > 1000, 0.5).when(vol > 700, 0.2).when(vol < 300, -0.2).otherwise(0.0)
         + F.when(spd < 20, 0.8).when(spd < 35, 0.3).when(spd > 60, -0.2).otherwise(0.0)
         + F.when((wx >= 3) | (pr > 10), 0.4).when(wx >= 1, 0.1).otherwise(0.0))
    return _level_clamp(s)


# --- P10-P12: levels and code tables -------------------------------------

def level(value: ColumnOrName, mode: str = "half_even") -> Column:
    """P10: clamp to 0-3 then round. Modes: ``half_even`` (serving),
    ``floor`` (dashboard), ``trunc`` (training truth), ``half_up``."""
    v = _level_clamp(_c(value).cast("double"))
    if mode == "half_even":
        out = F.bround(v, 0)
    elif mode == "half_up":
        out = F.round(v, 0)
    elif mode == "floor":
        out = F.least(F.floor(v), F.lit(3))
    elif mode == "trunc":
        out = v.cast("int")
    else:
        raise ValueError(f"unknown level mode {mode!r}")
    return out.cast("int")


def level_label(lvl: ColumnOrName) -> Column:
    """0 Low, 1 Moderate, 2 High, 3 Severe, anything else Unknown."""
    return F.coalesce(F.try_element_at(_map(LEVEL_LABELS), _c(lvl).cast("int")), F.lit("Unknown"))


def encode_weather(name: ColumnOrName) -> Column:
    """Weather name → code via ``lower(trim)``; unknown/blank → 0."""
    codes = {v.lower(): k for k, v in WEATHER_LABELS.items()}
    return F.coalesce(F.try_element_at(_map(codes), F.lower(F.trim(_c(name)))), F.lit(0))


def weather_label(code: ColumnOrName) -> Column:
    return F.coalesce(F.try_element_at(_map(WEATHER_LABELS), _c(code).cast("int")), F.lit("Unknown"))


# --- P14 / P15 / P18 -------------------------------------------------------

def time_slot(hour: ColumnOrName) -> Column:
    """``"HH:00 - HH:00"`` with the next hour wrapping at 24."""
    h = _c(hour).cast("int")
    return F.format_string("%02d:00 - %02d:00", h, F.pmod(h + 1, F.lit(24)))


def congestion_rate_pct(avg: ColumnOrName, cap: bool = True) -> Column:
    """Share of the 0-3 scale in percent, 0 dp; capped at 100 for the gauge."""
    pct = F.round(_c(avg) / 3 * 100, 0)
    return F.least(pct, F.lit(100.0)) if cap else pct


def location_code_fallback(location: ColumnOrName) -> Column:
    """Stable replacement for a process-salted string hash."""
    return F.pmod(F.xxhash64(_c(location)), F.lit(100)).cast("int")


# --- F3 ---------------------------------------------------------------------

def within_hours_ahead(hour: ColumnOrName, current_hour: int, horizon: int) -> Column:
    """hour lies in the next ``horizon`` hours from ``current_hour``
    (wrapping at 24)."""
    return F.pmod(_c(hour) - F.lit(int(current_hour)), F.lit(24)) < horizon


def round_binary(x: ColumnOrName, digits: int) -> Column:
    """Half-even rounding of the binary value scaled by 10^digits, exactly
    as numpy / pandas ``round`` do (multiply, round to even, divide).
    ``bround(x, d)`` instead rounds the shortest decimal printout:
    1.015 → 1.02 where numpy gives 1.01. (Python's float ``round`` is
    correctly rounded and differs from numpy only when the scaling itself
    lands on a tie, e.g. 2.675.)"""
    if digits == 0:
        return F.bround(_c(x), 0)
    scale = float(10 ** digits)
    return F.bround(_c(x) * F.lit(scale), 0) / F.lit(scale)


def uniform_draw(id_col: ColumnOrName, seed: int) -> Column:
    """Deterministic uniform draw in [0, 1) per row: the first 52 bits of
    ``md5("id:seed")`` as an exact double (sampling / split order). Any SQL
    engine with md5 can repeat it."""
    digest = F.md5(F.concat_ws(":", _c(id_col).cast("string"), F.lit(str(seed))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") * F.lit(2.0 ** -52)
