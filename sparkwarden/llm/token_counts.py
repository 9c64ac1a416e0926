"""Token counts of whole texts with a stored count per content digest.

A text is known by the digest of its normalised content, the tokenizer by the digest
of its model file. Texts whose digest has a stored count for this tokenizer are never
encoded; each distinct other text is encoded once and its count appended.

The content is normalised only where that cannot change a count: null becomes the
empty text. Texts travel to the encoder once per digest, combined before the shuffle;
everything else moves digests and numbers.

Given results: null or empty text has 0 bytes and the count of the empty text. Every
row gives one row, repeated rows too; an empty table gives none. Extra columns are
ignored. The store assumes one writer at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import sentencepiece
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.llm.batches import bounded
from sparkwarden.llm.tokens import encoder
from sparkwarden.shared import kept

STORED = "digest binary, n_tokens long, tokenizer string"


def tokenizer_version(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


@lru_cache(maxsize=4)
def _counter(path: str):
    if path.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    encode = encoder(path).encode
    return lambda texts: [len(raw) // 4 for raw in encode(texts)]


def stored_counts(spark: SparkSession, store: str, version: str) -> DataFrame:
    try:
        found = spark.read.schema(STORED).parquet(store)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], STORED)
    return found.where(F.col("tokenizer") == version).select("digest", "n_tokens")


def count_tokens(docs: DataFrame, tokenizer: str, store: str, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``; new counts are
    appended to the Parquet table ``store``."""
    spark, version = docs.sparkSession, tokenizer_version(tokenizer)
    texts = docs.select(
        F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).withColumn("digest", F.unhex(F.sha2("text", 256)))
    distinct = texts.groupBy("digest").agg(F.first("text").alias("text"))
    misses = distinct.join(stored_counts(spark, store, version), "digest", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(tokenizer)
        for batch in bounded(batches):
            counts = pa.array(count(batch.column("text").to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("digest"), counts], ["digest", "n_tokens"])

    new = misses.select("digest", "text").mapInArrow(encode, "digest binary, n_tokens long")
    new.withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(store)
    # An interrupted earlier append may have stored a digest twice, with the same count.
    # Stored as a table, the other side of the join can be split where a digest is hot.
    known = stored_counts(spark, store, version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    known = kept(known, "known-counts")
    sizes = texts.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    return sizes.join(known, "digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
