"""The registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conjunct.llm import exact_dedup, fingerprints, language, lm_scoring, near_dups, sharding, toxicity
from conjunct.llm.packing import pack
from conjunct.llm.pieces import encode_digests
from conjunct.llm.shared import table
from conjunct.llm.token_counts import token_counts


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.jaccard_classes(table(spark, sf_dir, "documents"), k=4, percent=85).select("doc_id", "n_shingles", "component_id", "n_links")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document (doc_id) and every page (page_id)."""
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs)
    new = ["lang_id", "lang_confidence", "lang_words", "lang_text", "lang_rejected"]
    null = F.lit(None).cast("long")
    of_docs = language.identify_documents(docs, model, carry=["doc_id"]).select("doc_id", null.alias("page_id"), *new)
    pages = language.identify_pages(table(spark, sf_dir, "pages"), model, carry=["page_id"]).select(null.alias("doc_id"), "page_id", *new)
    return of_docs.unionByName(pages)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, "text", public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text", "lang"), model)
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "threshold", "rejected")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.stupid_backoff(table(spark, sf_dir, "documents"), order=lm_scoring.ORDER)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_digests(docs, "text", public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spanned_bytes", "spans_crc32")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard, op2_packing, op3_language_id, op4_exact_dedup, op5_token_counts, op6_toxicity, op7_sharding, op8_lm_scoring, op9_sentencepiece, op10_fingerprints)}

#: SQL for the operators that SQL can express.
ORACLES: dict[str, str] = {"op4_exact_dedup": exact_dedup.SQL}
