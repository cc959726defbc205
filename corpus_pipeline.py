"""A training corpus from raw documents: language, exact copies, near copies, personal data, packing.

Each stage is written as Parquet and read again, so a lost executor costs at most one stage. Nulls,
empty tables, ties, repeated rows and extra columns are handled as the operators' modules say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import exact_dedup, langid, near_dedup, packing, pii
from barloom.llm.common import documents, landed

BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = "2m"


def small_arrow(spark: SparkSession) -> None:
    """Python workers live through all stages and keep what their largest batch took; so batches are
    small, unless the session says otherwise."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised: with a letter, and no two languages equally likely."""
    small_arrow(spark)
    return langid.with_language(docs, langid.trained(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    small_arrow(spark)
    return exact_dedup.without_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    small_arrow(spark)
    return near_dedup.without_near_copies(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with pseudonyms for personal data."""
    return pii.without_pii(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their token ids."""
    small_arrow(spark)
    return packing.packed(docs, tokens=True)


STAGES = [
    ("language", language),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("pii", private),
    ("packing", pack),
]

# Prediction by partial matching, a MinHash forest and tokenisation cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = landed(stage(spark, docs, sf_dir))
    return docs
