"""Corpus pipeline over ``documents``: language identification, toxicity,
SimHash near-duplicates, benchmark decontamination, BPE encoding.

``STAGES`` lists the stages in order; each takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import bpe, decontaminate, language, simhash, toxicity
from lectern.llm.common import ship, table
from lectern.llm.queries import TOXIC_FROM, VOCABULARY
from lectern.session import ensure_checkpoint_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language go on, ``lang`` set to the one found; NULL
    texts and texts without a letter are rejected."""
    ship(spark)
    return language.keep_identified(docs, language.train(docs))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being toxic is below TOXIC_FROM go on."""
    ship(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.drop_toxic(docs, model, TOXIC_FROM)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate component the document with the smallest id goes on."""
    ship(spark)
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item go on."""
    ship(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every remaining document, as digests with the decoded text's."""
    ship(spark)
    return bpe.roundtrip_digests(docs, VOCABULARY)


STAGES = [
    ("language ID", language_id),
    ("toxicity", drop_toxic),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminated),
    ("BPE encoding", encoded),
]

# Models, XXH64 and token ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to
    the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/llm-pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            out.write.parquet(f"{folder}/{number}")
            docs = spark.read.parquet(f"{folder}/{number}")
    return out
