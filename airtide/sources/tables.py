"""Recordings as stored tables, laid out by recording so that a selection reads only the folders it needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Samples of a recording that one task writes, so that a long recording is spread over tasks.
SPAN = 1_000_000


def write(table: DataFrame, path: str, *, idx: str = "idx", mode: str = "errorifexists") -> None:
    """Store a table of recordings, one folder for each, in files of consecutive samples."""
    spread = table.repartition("recording_id", F.floor(F.col(idx) / SPAN))
    spread.sortWithinPartitions("recording_id", idx).write.partitionBy("recording_id").mode(mode).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
