"""One query per operator, with production parameters, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparkwarden.llm import conversations
from sparkwarden.llm.decontamination import contamination
from sparkwarden.llm.exact_topk import top_k
from sparkwarden.llm.licenses import licenses, licenses_sql
from sparkwarden.llm.packing import packed_documents
from sparkwarden.llm.quality_lm import judged
from sparkwarden.llm.secrets import secret_spans
from sparkwarden.llm.simhash import near_duplicates
from sparkwarden.llm.spelling import variants
from sparkwarden.llm.token_counts import count_tokens
from sparkwarden.llm.token_files import written_and_read
from sparkwarden.llm.toxicity import toxicity
from sparkwarden.llm.warc import archived
from sparkwarden.session import configure
from sparkwarden.shared import new_folder

QUERIES = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(function):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(configure(spark), sf_dir)

    QUERIES[function.__name__] = run
    return function


@query
def op7_plane_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return written_and_read(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packed_documents(docs, public_tokenizers.path("word_bpe_49k.json")).drop("row", "fill")


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, store = table(spark, sf_dir, "documents"), new_folder(spark, "token-counts")
    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), store, limit=4096)


@query
def op10_fm_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op9_bit_sliced_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4)


@query
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages"))


@query
def op6_ball_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where("vec_id % 50 = 0"), k=5)


@query
def op2_secret_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))


@query
def op8_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("digest")


@query
def op4_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents"))


ORACLES["op4_license_rules"] = licenses_sql()


@query
def op11_permuterm_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


@query
def op13_coalescing_viterbi_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repairs(conversations.damaged(table(spark, sf_dir, "conversations")))


@query
def op12_scaled_ngram_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
