"""A training-data pipeline: quality, near-duplicates, benchmark text, secrets, packing.

Every stage takes (spark, docs, sf_dir), with docs the kept documents of the stage
before, and works on all of them. Stages keep the columns of ``documents``; the last
one returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparkwarden.llm.decontamination import decontaminated
from sparkwarden.llm.packing import packed_documents
from sparkwarden.llm.quality_lm import accepted
from sparkwarden.llm.secrets import redacted
from sparkwarden.llm.simhash import deduplicated
from sparkwarden.session import configure
from sparkwarden.shared import kept


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model of their language accepts."""
    return accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of five-word similarity of 0.8 or more, confirmed exactly."""
    return deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with all benchmark passages cut out."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret masked."""
    return redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place there."""
    return packed_documents(docs, public_tokenizers.path("word_bpe_49k.json")).drop("row", "fill")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]

# Minimum hashes, Kneser-Ney scores and best-fit packing are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
