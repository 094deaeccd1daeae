"""Views of the driver's tables as recordings: frames of pixels and sampled signals.

A recording is the unit of order and of partitioning: windows are always within one, so many recordings run in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

SIDE = 8
RATE = 20.0
RECORDINGS = 16


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recording_id, frame_idx, time, pixels) of 8x8 frames at 20 Hz, a recording for each label."""
    source = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    idx = F.row_number().over(W.partitionBy("label").orderBy("vec_id")).cast("long") - 1
    pixels = F.col("embedding").cast("array<double>")
    return source.select(F.col("label").cast("long").alias("recording_id"), idx.alias("frame_idx"), pixels.alias("pixels")).withColumn("time", F.col("frame_idx") / RATE)


def pixels(frames: DataFrame, side: int = SIDE) -> DataFrame:
    """The frames in long form: (recording_id, frame_idx, time, row, col, z)."""
    long = frames.select("recording_id", "frame_idx", "time", F.posexplode("pixels").alias("k", "z"))
    return long.select("recording_id", "frame_idx", "time", F.expr(f"CAST(k div {side} AS INT)").alias("row"), (F.col("k") % side).alias("col"), "z")


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recording_id, idx, time, value): events in order of time, users dealt into recordings."""
    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    time = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") / 1e6
    recording = (F.col("user_id") % RECORDINGS).cast("long")
    order = W.partitionBy("recording_id").orderBy("time", "event_id")
    rows = source.select(recording.alias("recording_id"), "event_id", time.alias("time"), "value", "event_type")
    return rows.withColumn("idx", F.row_number().over(order).cast("long") - 1).select("recording_id", "idx", "time", "value", "event_type")


SQL = f"""frames AS (SELECT CAST(label AS BIGINT) AS recording_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_idx, embedding AS px FROM embeddings),
pix AS (SELECT recording_id, frame_idx, CAST((k - 1) // {SIDE} AS INTEGER) AS row, CAST((k - 1) % {SIDE} AS INTEGER) AS col, CAST(px[k] AS DOUBLE) AS z
    FROM (SELECT *, unnest(range(1, len(px) + 1)) AS k FROM frames)),
sig AS (SELECT user_id % {RECORDINGS} AS recording_id, row_number() OVER (PARTITION BY user_id % {RECORDINGS} ORDER BY ts, event_id) - 1 AS idx,
    epoch_us(ts) / 1e6 AS time, value, event_type FROM events)"""
