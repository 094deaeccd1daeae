"""Corpus pipeline: from raw documents to packed training sequences, with operators of ``airtide.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read as the next one's
documents. All but the last keep the columns of documents.

Defined results: null and empty texts are not toxic, link with nothing, hold no secrets, are left out of the mix and so
of the sequences. Null ids go on like others; repeated rows are one group of near-duplicates, of which one stays. Without
labels, or where no word marks toxic documents, none is rejected. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airtide.llm import mixing, neardup, packing, secrets, toxicity
from airtide.llm.common import fold_of, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity field, trained on four fifths of the labels, does not reject."""
    labels = table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(fold_of(F.col("doc_id"), 5) != 0))
    return toxicity.without_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles with a likeness of 0.8 or more."""
    return neardup.without_near_duplicates(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in plain or decoded layers masked."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Showings of the documents, sources at their target weights."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids."""
    return packing.pack(docs, ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Models, tokenizers and decoding are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each stored in the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{name}")
    return docs
