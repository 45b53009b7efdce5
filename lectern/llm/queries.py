"""Registered queries: each operator over its whole table, with the
parameters meant for production, digested to the columns of its contract."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import (alignment, bpe, decontaminate, language, line_rules, quality, sharding, simhash, token_store, topk, toxicity,
                         url_reputation, whitening)
from lectern.llm.common import is_held_out, ship, table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
END_ID = 2
SHARDS = 16
TOXIC_FROM, GOOD_FROM = 0.3, 0.7
QUERY_EVERY, TOP_K = 100, 10


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return simhash.simhash_components(docs)


def op2_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a test item, whole or edited: one row per document
    and item with the alignment's score and place."""
    return decontaminate.leaks(table(spark, sf_dir, "documents", "doc_id", "text"),
                               table(spark, sf_dir, "benchmark", "item_id", "text"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from the labelled rows outside the held-out fold."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = language.identify(docs, language.train(docs), spans=False)
    return found.select("doc_id", is_held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op4_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document; every shard has each source in proportion."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    placed = sharding.shard_assignment(docs, SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op5_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the line-first quality rules for every document."""
    return line_rules.clean(table(spark, sf_dir, "documents", "doc_id", "text")).drop("clean_text")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability that a document is toxic, by compression distance."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.score_texts(docs, model).select(
        "doc_id", is_held_out("doc_id").alias("held_out"), "score",
        (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op7_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every document's ids into wavelet-matrix files and read them back."""
    folder = token_store.token_folder(spark)
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    token_store.write_tokens(docs, folder, VOCABULARY, END_ID)
    return token_store.read_documents(spark, folder)


def op8_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the text decoded from them, as digests."""
    return bpe.roundtrip_digests(table(spark, sf_dir, "documents", "doc_id", "text"), VOCABULARY)


def op9_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability that a document is of good quality, by quadratic discriminant."""
    documents = quality.document_statistics(table(spark, sf_dir, "documents", "doc_id", "text"))
    model = quality.train(documents, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality.score(documents, model).select(
        "doc_id", is_held_out("doc_id").alias("held_out"), "score", (F.col("score") >= GOOD_FROM).cast("int").alias("predicted"))


def op10_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's URL."""
    return url_reputation.judge(table(spark, sf_dir, "pages", "page_id", "url")).drop("good_upper")


def op11_spectral_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the leading whitened components of all of them."""
    return whitening.whiten(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best scores of every hundredth embedding against all others."""
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return topk.exact_top_k(vectors, vectors.filter(F.col("vec_id") % QUERY_EVERY == 0), TOP_K)


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizations of every document, with the links' corpus counts."""
    return alignment.cross_tokenizer_alignment(table(spark, sf_dir, "documents", "doc_id", "text"), VOCABULARY, PIECES)


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_simhash_dedup, op2_benchmark_leaks, op3_language_id, op4_stratified_shards, op5_line_rules,
             op6_toxicity, op7_wavelet_tokens, op8_bpe_roundtrip, op9_quality_qda, op10_url_reputation, op11_spectral_whitening, op12_exact_top_k,
             op13_tokenizer_alignment)
    return {f.__name__: _shipped(f) for f in found}
