"""Streaming operators (ST1, ST2).

Both are plain DataFrame transformations, so they run unchanged on a
batch DataFrame (used to check that stream and batch agree) and on a
``readStream`` source.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import TARGET
from ..sources import published


def live_location_summary(obs: DataFrame, window: str = "1 hour", watermark: str = "1 hour",
                          ts: str = "timestamp") -> DataFrame:
    """ST1: per location × tumbling window mean congestion / volume / speed
    and row count. On a stream the watermark bounds the state: rows older
    than the watermark are dropped, finished windows are emitted in
    append mode."""
    t = F.col(ts).cast("timestamp") if obs.isStreaming else F.col(ts)
    x = obs.withColumn("_t", t)
    if obs.isStreaming:
        x = x.withWatermark("_t", watermark)
    g = x.groupBy(F.window("_t", window).alias("w"), "location").agg(
        F.avg(TARGET).alias("avg_congestion"), F.avg("traffic_volume").alias("avg_traffic_volume"),
        F.avg("avg_speed").alias("avg_speed"), F.count(F.lit(1)).alias("samples"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("window_end"),
                    "location", "avg_congestion", "avg_traffic_volume", "avg_speed", "samples")


def read_observation_stream(spark, source_dir: str, name_glob: str = "events*.parquet",
                            max_files_per_trigger: int = 1) -> DataFrame:
    """Observation stream over the ``events`` parquet files arriving in
    ``source_dir`` (file sources watch a folder; ``name_glob`` selects the
    files of the events table)."""
    from ..sources.tables import observations_from_events
    schema = spark.read.option("pathGlobFilter", name_glob).parquet(source_dir).schema
    ev = (spark.readStream.schema(schema).option("pathGlobFilter", name_glob)
          .option("maxFilesPerTrigger", max_files_per_trigger).parquet(source_dir))
    return observations_from_events(ev)


def summarise_arrivals(obs_stream: DataFrame, sink: str, checkpoint: str, window: str = "1 hour",
                       watermark: str = "1 hour") -> None:
    """ST1 as a job: take what has arrived since the last call into the summary and stop.

    State, watermark and the input read so far live in ``checkpoint``, so a call goes on
    where the last one ended, also after a crash. A window is appended to ``sink`` once,
    when the watermark passes its end; a row that comes later than that is dropped."""
    q = (live_location_summary(obs_stream, window, watermark).writeStream.outputMode("append").format("parquet")
         .option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def score_stream(obs_stream: DataFrame, sink_path: str, checkpoint: str, models: dict | None = None,
                 scaler=None, encoder=None, trigger_once: bool = True, bundle: str | None = None):
    """ST2: score a stream of requests (M7 without row-window features) through
    ``foreachBatch``. A micro-batch goes to a folder of its own attempt and counts once
    a commit file names it; a batch that is replayed after that changes nothing. Read
    the result with ``read_scored``.

    ``bundle``: a folder of published versions (``TrainingResult.save``); the newest one is
    looked up for every batch, instead of fixed ``models``."""
    from ..plans.serving import predict
    from ..plans.training import TrainingResult
    held: dict = {}

    def current(spark):
        have = published.names(spark, f"{bundle}/published")
        if have and held.get("version") != have[-1]:
            held["result"] = TrainingResult.load(spark, bundle)
            held["version"] = held["result"].version
        return held.get("result")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        commits, name = f"{sink_path}/commits", f"{batch_id:012d}"
        if name in published.names(spark, commits):
            return
        r = current(spark) if bundle else None
        scored = (predict(batch, r.models, r.scaler, r.state.encoder, features=r.features) if r
                  else predict(batch, models, scaler, encoder))
        folder = f"{sink_path}/data/{name}-{uuid.uuid4().hex}"
        scored.withColumn("batch_id", F.lit(batch_id)).write.parquet(folder)
        published.publish(spark, commits, name, {"folder": folder, "version": r.version if r else None})
    w = obs_stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_once else w.trigger(processingTime="10 seconds")
    return w.start()


def read_scored(spark, sink_path: str) -> DataFrame | None:
    """The rows of all committed batches; None before the first one."""
    commits = f"{sink_path}/commits"
    have = published.names(spark, commits)
    if not have:
        return None
    entries = spark.read.schema("folder string, version string").json([f"{commits}/{n}" for n in have])
    return spark.read.parquet(*[r["folder"] for r in entries.collect()])
