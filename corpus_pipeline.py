"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

Quality classifier, language identification, near-duplicate removal, sanitising of personal data, packing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import hilbert, langid, minhash, pii, quality
from brindle.llm.base import ship, table
from brindle.session import shared_dir


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling draws."""
    return quality.keep_selected(docs, table(spark, sf_dir, "labels"), quality.TARGET)


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text holds a share of the language they are labelled with."""
    ship(spark)
    return langid.keep_identified(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    ship(spark)
    return minhash.keep_one(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their protected entities and disclosing terms replaced."""
    ship(spark)
    return pii.clean_columns(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in packs along the Hilbert curve."""
    ship(spark)
    return hilbert.pack(docs)


STAGES = [("quality", by_quality), ("language", by_language), ("near_duplicates", without_copies), ("personal_data", without_personal_data), ("packing", packed)]

#: no stage can be put in SQL: hashed n-gram models, minima of permuted hashes, check digits, Hilbert keys
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
