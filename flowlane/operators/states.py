"""Dashboard figures from stored partial states.

A batch of observations is reduced once to mergeable states, one row per hour of time:
counts, sums, squared deviations, extremes, a KLL sketch of each column and an HLL
sketch of the locations, and beside them the count of each value of the target. A
figure over any range of hours merges the states of that range, so a refresh reads a
few hundred rows a month instead of the observations.

Counts, means, deviations, extremes and value counts are exact (up to the rounding of
sums in double precision); the number of locations and the quartiles lie within their
sketches' bounds. Batches are appended: the states of an hour that several batches
touch are merged when read, and a batch counts once, whenever its writer stopped or
was repeated.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import level, level_label
from ..schema import TARGET
from ..sources import published
from .profiles import value_label

SKETCH_K = 1024
#: Twice the sketch's single-sided rank error at 99 %, as a share of the rows.
RANK_ERROR = 2 * 2.296 / SKETCH_K ** 0.9021
LG_K = 12  # of the sketch of locations


@dataclass
class States:
    """``moments``: a row per (bucket, column) and batch; ``rows``: a row per bucket and
    batch; ``values``: a row per (bucket, value of the target) and batch."""
    rows: DataFrame
    moments: DataFrame
    values: DataFrame

    def between(self, start, end) -> "States":
        """The states of the hours from ``start`` to before ``end`` (timestamps or
        columns; None: open). Both are taken as bounds of whole hours."""
        def cut(df: DataFrame) -> DataFrame:
            for bound, keep in ((start, lambda b: F.col("bucket") >= b), (end, lambda b: F.col("bucket") < b)):
                if bound is not None:
                    df = df.where(keep(bound if isinstance(bound, Column) else F.lit(bound)))
            return df
        return States(cut(self.rows), cut(self.moments), cut(self.values))


def _number(c: str) -> Column:
    """A column as a double; NaN counts as null."""
    v = F.col(f"`{c}`").cast("double")
    return F.when(~F.isnan(v), v)


def partial_states(df: DataFrame, columns: list[str], time: str = "timestamp", place: str = "location",
                   value: str = TARGET) -> States:
    """The states of observations. A row without a time has the bucket null, which no
    range holds but the open one. Each scan task reduces its rows first, so an hour or a
    value that holds a third of the rows moves as one row per task."""
    bucket = F.date_trunc("hour", F.col(time)).alias("bucket")
    rows = df.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(F.col(place), F.lit(LG_K)).alias("places"))
    each = []
    for c in columns:
        v = _number(c)
        each += [F.struct(
            F.count(v).alias("n"), F.sum(v).alias("total"), (F.var_pop(v) * F.count(v)).alias("squares"),
            F.min(v).alias("low"), F.max(v).alias("high"), F.kll_sketch_agg_double(v, F.lit(SKETCH_K)).alias("sketch"),
        ).alias(c)]
    # one scan for all columns; the few state rows are turned to one per column
    wide = df.groupBy(bucket).agg(*each)
    moments = wide.select("bucket", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("s")) for c in columns])).alias("e")
    ).select("bucket", "e.column", "e.s.*")
    values = df.groupBy(bucket, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return States(rows, moments, values)


def append_states(states: States, folder: str, batch: str) -> bool:
    """Store the states of a batch under its name; False, and nothing changed, if a batch
    of that name is there. Readers see the whole batch or nothing of it."""
    spark = states.rows.sparkSession
    if batch in published.names(spark, f"{folder}/batches"):
        return False
    home = f"{folder}/data/{batch}-{uuid.uuid4().hex}"
    for kind in ("rows", "moments", "values"):
        getattr(states, kind).write.parquet(f"{home}/{kind}")
    return published.publish(spark, f"{folder}/batches", batch, {"folder": home})


def read_states(spark: SparkSession, folder: str) -> States:
    """The states of all stored batches."""
    have = published.names(spark, f"{folder}/batches")
    if not have:
        raise FileNotFoundError(f"no stored batch below {folder}")
    entries = spark.read.schema("folder string").json([f"{folder}/batches/{n}" for n in have]).collect()
    return States(*[spark.read.parquet(*[f"{r['folder']}/{kind}" for r in entries]) for kind in ("rows", "moments", "values")])


def _merged(moments: DataFrame, *by: str) -> DataFrame:
    """(by, n, mean, std, low, high) of merged states. The squared deviations are moved to
    the common mean, which a first pass over the states finds, so nothing cancels."""
    some = moments.where("n > 0")
    means = some.groupBy(*by).agg((F.sum("total") / F.sum("n")).alias("mean"))
    apart = F.col("total") / F.col("n") - F.col("mean")
    return some.join(means, list(by)).groupBy(*by).agg(
        F.sum("n").alias("n"), F.first("mean").alias("mean"),
        F.sum(F.col("squares") + F.col("n") * apart * apart).alias("squares"),
        F.min("low").alias("low"), F.max("high").alias("high"),
    ).withColumn("std", F.when(F.col("n") > 1, F.sqrt(F.col("squares") / (F.col("n") - 1)))).drop("squares")


def summary_of_states(states: States, value: str = TARGET) -> DataFrame:
    """A7 from states: one row, ``locations`` by sketch."""
    held = states.rows.agg(F.sum("n").alias("total_records"), F.hll_union_agg("places").alias("places"))

    def mean(c: str, name: str) -> Column:
        here = F.col("column") == c
        return F.try_divide(F.sum(F.when(here, F.col("total"))), F.sum(F.when(here, F.col("n")))).alias(name)

    means = states.moments.agg(mean(value, "avg_congestion"), mean("traffic_volume", "avg_traffic_volume"),
                               mean("avg_speed", "avg_speed"))
    return held.select(F.coalesce("total_records", F.lit(0)).alias("total_records"),
                       F.coalesce(F.hll_sketch_estimate("places"), F.lit(0)).alias("locations")).join(
        F.broadcast(means)).select("total_records", *means.columns, "locations")


def values_of_states(states: States) -> DataFrame:
    """A8 / A14 from states: count and label of each value of the target."""
    return (states.values.groupBy("value").agg(F.sum("n").alias("count"))
            .select("value", "count", value_label(F.col("value")).alias("label")))


def levels_of_states(states: States, mode: str = "floor") -> DataFrame:
    """A9 without the empty levels, from states: count of each level."""
    return (states.values.groupBy(level("value", mode).alias("level")).agg(F.sum("n").alias("count"))
            .select("level", level_label("level").alias("label"), "count"))


def band_of_states(states: States, value: str = TARGET) -> DataFrame:
    """A11 from states: per hour of the day mean, sample deviation and their band."""
    own = states.moments.where(F.col("column") == value).withColumn("hour", F.hour("bucket"))
    return _merged(own, "hour").select(
        "hour", "mean", "std", (F.col("mean") + F.col("std")).alias("upper"), (F.col("mean") - F.col("std")).alias("lower"))


def describe_states(states: States) -> DataFrame:
    """A12 from states: a row per column that has values; quartiles by sketch, whose ranks
    are right within ``RANK_ERROR`` of the rows."""
    sketches = states.moments.where("n > 0").groupBy("column").agg(F.kll_merge_agg_double("sketch", F.lit(SKETCH_K)).alias("sketch"))
    quartile = [F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(name)
                for name, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))]
    return _merged(states.moments, "column").join(sketches, "column").select(
        "column", F.col("n").alias("count"), "mean", "std", F.col("low").alias("min"), *quartile, F.col("high").alias("max"))
