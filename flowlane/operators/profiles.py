"""Dashboard aggregations (A1-A15) and ordered outputs.

Every aggregate here is algebraic (count/sum/avg/min/max/var) or a
bounded two-level aggregate, so Spark plans partial + final
HashAggregate: rows are pre-aggregated inside each scan task and only
one small buffer per key and task crosses the shuffle. A location that
holds a third of all rows therefore costs no more than any other key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import (congestion_rate_pct, level, level_label, round_binary,
                                 time_slot, uniform_draw, within_hours_ahead)
from ..schema import LEVEL_LABELS, ROW_ID, TARGET


def time_profile(df: DataFrame, value: str = TARGET) -> DataFrame:
    """A1: mean congestion per hour, per day_of_week and per month in ONE
    scan (grouping sets → Expand + one aggregate). Long format:
    ``dimension, key, avg_congestion, samples``."""
    g = df.groupingSets([["hour"], ["day_of_week"], ["month"]], "hour", "day_of_week", "month")
    out = g.agg(F.avg(value).alias("avg_congestion"), F.count(value).alias("samples"),
                F.grouping_id().alias("_gid"))
    # grouping_id bits: hour=4, day_of_week=2, month=1 (1 = aggregated away)
    return out.select(
        F.when(F.col("_gid") == 3, "hour").when(F.col("_gid") == 5, "day_of_week")
        .otherwise("month").alias("dimension"),
        F.coalesce("hour", "day_of_week", "month").alias("key"),
        "avg_congestion", "samples")


def rush_split(df: DataFrame, value: str = TARGET) -> DataFrame:
    """A2: mean congestion in and outside rush hour; an empty side is 0."""
    r = F.col("is_rush_hour")
    return df.agg(
        F.coalesce(F.avg(F.when(r == 1, F.col(value))), F.lit(0.0)).alias("rush_hour_avg"),
        F.coalesce(F.avg(F.when(r == 0, F.col(value))), F.lit(0.0)).alias("non_rush_avg"))


def weather_impact(df: DataFrame, value: str = TARGET) -> DataFrame:
    """A3: per weather code mean congestion and non-null sample count."""
    return df.groupBy("weather_condition").agg(
        F.avg(value).alias("avg_congestion"), F.count(value).alias("samples"))


def location_ranking(df: DataFrame, value: str = TARGET) -> DataFrame:
    """A4: per location mean congestion (3 dp), mean volume / speed (rounded
    to int), sample count, level + label from the *unrounded* mean, and the
    rank by mean congestion (ties broken by location name)."""
    agg = df.groupBy("location").agg(
        F.avg(value).alias("_m"), F.avg("traffic_volume").alias("_v"),
        F.avg("avg_speed").alias("_s"), F.count(value).alias("samples"))
    # Ranking window runs over one row per location (bounded by the number of
    # locations, not by the data).
    w = Window.orderBy(F.col("_m").desc(), F.col("location"))
    return agg.select(
        F.row_number().over(w).alias("rank"),
        "location",
        round_binary("_m", 3).alias("avg_congestion"),
        F.bround("_v", 0).cast("long").alias("avg_traffic_volume"),
        F.bround("_s", 0).cast("long").alias("avg_speed"),
        "samples",
        F.bround("_m", 0).cast("int").alias("congestion_level"),
        level_label(F.bround("_m", 0)).alias("congestion_label"))


def location_summary(ranking: DataFrame) -> DataFrame:
    """A4 summary over the ranking rows: number of locations, most and least
    congested (rank 1 and last rank)."""
    return ranking.agg(
        F.count("*").alias("total_locations"),
        F.min_by("location", F.col("rank")).alias("most_congested"),
        F.max_by("location", F.col("rank")).alias("least_congested"))


def optimal_times(df: DataFrame, value: str = TARGET) -> DataFrame:
    """A5: per location the best / worst hour (arg-min / arg-max of the hourly
    mean, smallest hour on ties), their slots, the min and max hourly mean,
    the best hour's mean volume and speed truncated to int, and
    ``improvement_pct = round((1 - min / max(max, .01)) * 100, 1)``.

    Two-level aggregate: (location, hour) partials, then per location with
    ``min_by`` / ``max_by`` — no self-join, no re-scan per location. Largest
    improvement first, ties by location.
    """
    hourly = df.groupBy("location", "hour").agg(
        F.avg(value).alias("m"), F.avg("traffic_volume").alias("v"), F.avg("avg_speed").alias("s"))
    per_loc = hourly.groupBy("location").agg(
        # hours without any target value are no candidates
        F.min_by(F.struct("hour", "v", "s"), F.when(F.col("m").isNotNull(), F.struct("m", "hour"))).alias("best"),
        F.max_by(F.col("hour"), F.when(F.col("m").isNotNull(), F.struct(F.col("m"), -F.col("hour")))
                 ).alias("worst_hour"),
        F.min("m").alias("congestion_level"), F.max("m").alias("max_congestion"))
    pct = (1 - F.col("congestion_level") / F.greatest(F.col("max_congestion"), F.lit(0.01))) * 100
    return per_loc.select(
        "location",
        F.col("best.hour").alias("best_hour"), F.col("worst_hour"),
        time_slot("best.hour").alias("best_time"), time_slot("worst_hour").alias("worst_time"),
        "congestion_level", "max_congestion",
        F.col("best.v").cast("long").alias("traffic_volume"),
        F.col("best.s").cast("long").alias("avg_speed"),
        round_binary(pct, 1).alias("improvement_pct")).orderBy(F.desc("improvement_pct"), "location")


def hour_outlook(df: DataFrame, current_hour: int, horizon: int = 6, value: str = TARGET) -> DataFrame:
    """Hourly mean for ``current_hour`` and the following hours
    (0 when an hour has no rows), 3 dp, label, and the direction of the
    next hour against the current one (increasing / decreasing / stable).

    The hour filter (F3) runs before the aggregate, so only the wanted
    hours are aggregated; the frame of ``horizon`` offsets is generated."""
    spark: SparkSession = df.sparkSession
    hourly = (df.filter(within_hours_ahead("hour", current_hour, horizon))
              .groupBy("hour").agg(F.avg(value).alias("m")))
    frame = spark.range(horizon).select(
        F.col("id").cast("int").alias("offset"),
        F.pmod(F.col("id") + F.lit(int(current_hour)), F.lit(24)).cast("int").alias("hour"))
    j = frame.join(F.broadcast(hourly), "hour", "left").withColumn("m", F.coalesce("m", F.lit(0.0)))
    cur = F.max(F.when(F.col("offset") == 0, F.col("m"))).over(Window.partitionBy())
    nxt = F.max(F.when(F.col("offset") == 1, F.col("m"))).over(Window.partitionBy())
    return j.select(
        "offset", "hour",
        round_binary("m", 3).alias("predicted_congestion"),
        level_label(F.bround("m", 0)).alias("label"),
        F.when(nxt > cur, "increasing").when(nxt < cur, "decreasing").otherwise("stable")
        .alias("trend_direction"))


def summary_stats(df: DataFrame, value: str = TARGET, approx_distinct: bool = False) -> DataFrame:
    """Row count, means of congestion / volume / speed, distinct locations."""
    distinct = (F.approx_count_distinct("location") if approx_distinct
                else F.count_distinct("location"))
    return df.agg(
        F.count("*").alias("total_records"),
        F.avg(value).alias("avg_congestion"),
        F.avg("traffic_volume").alias("avg_traffic_volume"),
        F.avg("avg_speed").alias("avg_speed"),
        distinct.alias("locations"))


def value_distribution(df: DataFrame, col: str = TARGET) -> DataFrame:
    """Count per distinct raw value, with the level label when the
    value is a whole level and ``Level x`` otherwise."""
    return (df.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("count"))
            .select("value", "count", value_label(F.col("value")).alias("label")))


def value_label(v: Column) -> Column:
    """The level label of a whole level, ``Level x`` of any other value."""
    whole = (v == F.floor(v)) & v.between(0, 3)
    return F.when(whole, level_label(v.cast("int"))).otherwise(F.concat(F.lit("Level "), v.cast("string")))


def level_distribution(df: DataFrame, mode: str = "floor", value: str = TARGET) -> DataFrame:
    """Counts for levels 0-3 (zero counts included) and percent share."""
    spark = df.sparkSession
    counts = df.groupBy(level(value, mode).alias("level")).agg(F.count("*").alias("n"))
    levels = spark.range(len(LEVEL_LABELS)).select(F.col("id").cast("int").alias("level"))
    j = levels.join(F.broadcast(counts), "level", "left").withColumn("count", F.coalesce("n", F.lit(0)))
    total = F.sum("count").over(Window.partitionBy())  # 4 rows
    return j.select("level", level_label("level").alias("label"), "count",
                    F.coalesce(round_binary(F.try_divide(F.col("count") * 100.0, total), 2),
                               F.lit(0.0)).alias("pct"))


def heatmap(df: DataFrame, value: str = TARGET) -> DataFrame:
    """A10: mean congestion, location × hour; a missing cell is null.
    Pivot values are given, so Spark skips the distinct-values job."""
    p = df.groupBy("location").pivot("hour", list(range(24))).agg(F.avg(value))
    return p.select("location", *[F.col(str(h)).alias(f"h{h:02d}") for h in range(24)])


def hourly_band(df: DataFrame, value: str = TARGET) -> DataFrame:
    """Per hour mean, sample std and the mean ± std band."""
    a = df.groupBy("hour").agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    return a.select("hour", "mean", "std", (F.col("mean") + F.col("std")).alias("upper"),
                    (F.col("mean") - F.col("std")).alias("lower"))


def describe(df: DataFrame, columns: list[str] | None = None,
             accuracy: int | None = None) -> DataFrame:
    """Count, mean, sample std, min, exact interpolated quartiles and
    max per column, long format (one row per column). Moments and the sketches that
    bracket the quartiles come from one aggregate, the quartiles from a second scan."""
    from .quantiles import approx_quantiles, exact_quantiles, sketch_aggs
    cols = columns or [TARGET]
    aggs = [] if accuracy else sketch_aggs(df, cols)
    for c in cols:
        aggs += [F.count(c).alias(f"rows_{c}"), F.avg(c).alias(f"mean_{c}"),
                 F.stddev_samp(c).alias(f"std_{c}"), F.min(F.col(c).cast("double")).alias(f"min_{c}"),
                 F.max(F.col(c).cast("double")).alias(f"max_{c}")]
    m = df.agg(*aggs).first().asDict()
    probs = [0.25, 0.5, 0.75]
    q = approx_quantiles(df, cols, probs, accuracy) if accuracy else exact_quantiles(df, cols, probs, bounds=m)
    rows = [(c, m[f"rows_{c}"], m[f"mean_{c}"], m[f"std_{c}"], m[f"min_{c}"], *q[c], m[f"max_{c}"])
            for c in cols]
    return df.sparkSession.createDataFrame(
        rows, "column string, count long, mean double, std double, min double, q25 double, "
              "q50 double, q75 double, max double")


def missing_count(df: DataFrame) -> DataFrame:
    """Nulls per column and in total, one row, one scan."""
    per = [F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    out = df.agg(*per)
    return out.withColumn("total_missing", sum((F.col(c) for c in df.columns), F.lit(0)))


def metrics_table(metrics: DataFrame) -> DataFrame:
    """MAE / RMSE / R2 / Accuracy side by side, missing → 0."""
    cols = ["MAE", "RMSE", "R2", "Accuracy"]
    present = [c for c in cols if c in metrics.columns]
    return metrics.select("model", *present).na.fill(0.0, subset=present)


def congestion_gauge(df: DataFrame, value: str = TARGET) -> DataFrame:
    """P15 applied to the overall mean (home-page gauge)."""
    return df.agg(F.avg(value).alias("avg_congestion")).select(
        "avg_congestion", congestion_rate_pct("avg_congestion").alias("congestion_rate_pct"))


# --- L1-L6 ------------------------------------------------------------------

def time_series(df: DataFrame, n: int = 500, id_col: str = ROW_ID) -> DataFrame:
    """L1: the first ``n`` rows by time (row id breaks ties) of volume,
    speed and congestion. ``orderBy().limit()`` plans as
    TakeOrderedAndProject: each task keeps its top n, only n·tasks rows move."""
    return (df.select("timestamp", id_col, "traffic_volume", "avg_speed", TARGET)
            .orderBy("timestamp", id_col).limit(n))


def head(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """L2: first n rows of a defined order."""
    return df.orderBy(*order).limit(n)


def sample_exact(df: DataFrame, n: int, seed: int = 42, id_col: str = ROW_ID) -> DataFrame:
    """L3: exactly ``min(n, rows)`` rows without replacement, deterministic
    for a seed: the rows with the n smallest ``(u, id)``, u a uniform draw
    hashed from (id, seed).

    The n-th smallest of uniform draws lies within a few deviations of n / rows: one
    scan counts the draws below that bracket and reads the rank off those inside it,
    and the sample is a plain filter, so no task ever buffers n rows, whatever n is."""
    if n <= 0:
        return df.limit(0)
    x = df.withColumn("_u", uniform_draw(id_col, seed))
    from .quantiles import select_ranks, uniform_bracket
    total = df.count()
    if n >= total:
        return df
    key = ("_u", n - 1)
    t, below, same = select_ranks(x, [key], brackets={key: uniform_bracket(n - 1, total)})[key]
    if same == n - below:
        return x.filter(F.col("_u") <= F.lit(t)).drop("_u")
    # rows sharing the threshold draw (a handful at most) are cut by id
    tie = x.filter(F.col("_u") == F.lit(t)).orderBy(id_col).limit(n - below)
    return x.filter(F.col("_u") < F.lit(t)).unionByName(tie).drop("_u")


def top_k(df: DataFrame, by: str, k: int, ascending: bool = False) -> DataFrame:
    """L4/L5 helper: ranking sort + limit."""
    c = F.col(by).asc() if ascending else F.col(by).desc()
    return df.orderBy(c).limit(k)


def sample_with_stats(df: DataFrame, n: int, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """L3 then A7 and A8 computed on the sample."""
    s = sample_exact(df, n, seed)
    return s, summary_stats(s), value_distribution(s)
