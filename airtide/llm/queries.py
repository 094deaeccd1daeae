"""The queries of this subpackage, for ``__spark_entry__.py``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fingerprints, langid, mixing, neardup, packing, quality, secrets, substrings, toxicity, warc
from .common import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_table(table(spark, sf_dir, "pages"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_dup_table(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_table(table(spark, sf_dir, "documents"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_table(table(spark, sf_dir, "documents"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_table(table(spark, sf_dir, "documents"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_table(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc, op2_near_dedup, op3_packing, op4_mixing, op5_secrets, op6_toxicity, op7_quality, op8_substrings, op9_fingerprints, op10_langid)}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express whole."""
    return {"op1_warc": warc.archive_sql(), "op2_near_dedup": neardup.near_dup_sql(), "op4_mixing": mixing.mixture_sql(), "op7_quality": quality.quality_sql(), "op8_substrings": substrings.substring_sql()}
