"""Readers and writers (S1-S7): explicit schemas, no inference."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import OBSERVATION_SCHEMA, OBSERVATION_WITH_ID_SCHEMA, REQUEST_DEFAULTS


def read_observations(spark: SparkSession, path: str, fmt: str = "csv",
                      with_id: bool = False) -> DataFrame:
    """Read observation rows with the fixed schema.

    CSV needs a header. A missing path raises (``AnalysisException``), it is
    never replaced with invented rows. NaN read from CSV becomes null so Spark
    aggregates skip it like pandas does.
    """
    schema = OBSERVATION_WITH_ID_SCHEMA if with_id else OBSERVATION_SCHEMA
    if fmt == "csv":
        df = (spark.read.schema(schema).option("header", True)
              .option("mode", "PERMISSIVE").option("nanValue", "NaN")
              .csv(path))  # default NTZ parsing accepts "2024-01-01 08:00:00[.ffffff]" and ISO "T"
    elif fmt == "parquet":
        df = spark.read.schema(schema).parquet(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}")
    doubles = [f.name for f in schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in doubles})


def read_observations_checked(spark: SparkSession, path: str, with_id: bool = False) -> tuple[DataFrame, DataFrame]:
    """S1 from CSV with its rejects: (rows as ``read_observations`` has them, rejects
    (file, reason, line)), both from one description of the read. A line is rejected
    for another number of fields than the header's or for values that are not of their
    column's type; the reason names those columns. Lines are split at commas: the
    fixed columns need no quotes."""
    schema = OBSERVATION_WITH_ID_SCHEMA if with_id else OBSERVATION_SCHEMA
    line = "_line"
    raw = (spark.read.schema(T.StructType([*schema.fields, T.StructField(line, T.StringType())])).option("header", True)
           .option("mode", "PERMISSIVE").option("nanValue", "NaN").option("columnNameOfCorruptRecord", line)
           .csv(path).withColumn("_file", F.input_file_name()))
    parts = F.split(line, ",", -1)
    wrong = F.array_join(F.array_compact(F.array(*[
        F.when(F.col(f.name).isNull() & (F.trim(F.get(parts, F.lit(i))) != ""), F.lit(f.name))
        for i, f in enumerate(schema.fields)])), " ")
    reason = (F.when(F.size(parts) != len(schema.fields), F.lit("fields"))
              .otherwise(F.concat(F.lit("value: "), wrong)))
    # the reader judges a line by the columns it is asked for: this condition, which always
    # holds, asks for all of them
    whole = F.pmod(F.hash(*schema.names), F.lit(1)) == 0
    rejects = raw.where(F.col(line).isNotNull() & whole).select(F.col("_file").alias("file"), reason.alias("reason"), F.col(line).alias("line"))
    doubles = [f.name for f in schema.fields if isinstance(f.dataType, T.DoubleType)]
    rows = raw.where(F.col(line).isNull() & whole).drop(line, "_file").withColumns(
        {c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in doubles})
    return rows, rejects


def write_observations(df: DataFrame, path: str, fmt: str = "parquet", partition_by: str | None = "location",
                       max_records: int = 10_000_000) -> None:
    """Overwrite-write observation rows; ``partitionBy(location)`` lets
    later location filters prune directories. Rows are rebalanced on that column
    before, so a small location is one file and a large one is split by size among
    tasks (AQE); no file has more than ``max_records`` rows."""
    if partition_by:
        df = df.hint("rebalance", partition_by)
    w = df.write.mode("overwrite").option("maxRecordsPerFile", max_records)
    if partition_by:
        w = w.partitionBy(partition_by)
    if fmt == "csv":
        w.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path)
    else:
        w.format(fmt).save(path)


REQUEST_FIELDS = T.StructType([
    T.StructField("hour", T.StringType()),
    T.StructField("day_of_week", T.StringType()),
    T.StructField("month", T.StringType()),
    T.StructField("is_weekend", T.StringType()),
    T.StructField("is_rush_hour", T.StringType()),
    T.StructField("temperature", T.StringType()),
    T.StructField("humidity", T.StringType()),
    T.StructField("precipitation", T.StringType()),
    T.StructField("wind_speed", T.StringType()),
    T.StructField("traffic_volume", T.StringType()),
    T.StructField("avg_speed", T.StringType()),
    T.StructField("weather_condition", T.StringType()),
    T.StructField("location", T.StringType()),
])
BATCH_REQUEST_SCHEMA = T.StructType([
    T.StructField("inputs", T.ArrayType(REQUEST_FIELDS)),
    T.StructField("model", T.StringType()),
])


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """S3: batch request files ``{"inputs": [...], "model": ...}`` → one row
    per input with its ``model`` (default ``ensemble``). A file without
    ``inputs`` is an error. Fields are read as strings and cast later with
    ``try_cast`` (P13), so a bad value becomes null instead of failing."""
    raw = (spark.read.schema(BATCH_REQUEST_SCHEMA).option("multiLine", True)
           .option("primitivesAsString", True).json(path))
    missing = raw.filter(F.col("inputs").isNull()).limit(1).count()
    if missing:
        raise ValueError("request without 'inputs'")
    return raw.select(F.coalesce("model", F.lit("ensemble")).alias("model"),
                      F.posexplode("inputs").alias("input_pos", "r")).select(
        "model", "input_pos", "r.*")


def write_metrics(metrics: DataFrame, path: str, report_path: str | None = None) -> None:
    """Metrics as JSON lines (one object per model) plus an optional
    plain-text report built with ``format_string``."""
    metrics.coalesce(1).write.mode("overwrite").json(path)
    if report_path:
        cols = [c for c in ("MAE", "MSE", "RMSE", "R2", "Accuracy") if c in metrics.columns]
        fmt = "%-18s " + " ".join(f"{c}=%.4f" for c in cols)
        (metrics.select(F.format_string(fmt, F.upper("model"), *[F.col(c) for c in cols]).alias("value"))
         .coalesce(1).write.mode("overwrite").text(report_path))


METRICS_SCHEMA = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("MAE", T.DoubleType()), T.StructField("MSE", T.DoubleType()),
    T.StructField("RMSE", T.DoubleType()), T.StructField("R2", T.DoubleType()),
    T.StructField("Accuracy", T.DoubleType()),
    T.StructField("weights", T.MapType(T.StringType(), T.DoubleType())),
])


def read_metrics(spark: SparkSession, path: str, models: list[str] | None = None) -> DataFrame:
    """Stored metrics, optionally only for models that are available."""
    df = spark.read.schema(METRICS_SCHEMA).json(path)
    if models is not None:
        df = df.filter(F.col("model").isin(list(models)))
    return df


def request_defaults_json() -> str:
    return json.dumps(REQUEST_DEFAULTS, sort_keys=True)
