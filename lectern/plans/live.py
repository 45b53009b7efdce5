"""Registered queries of kept answers, the live stage table and the completion
stream, and their DuckDB twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import answers as AN
from lectern.operators import summaries as M
from lectern.operators import vocabulary as V
from lectern.session import ensure_checkpoint_dir
from lectern.sources import adapters as A
from lectern.streaming import stages as SG
from lectern.streaming import uploads as ST


def _submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.paragraph_lists(A.documents(spark, sf_dir))


def _store(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/answer-store-{uuid.uuid4().hex}"


def stored_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer store after one run over all documents, a row for each distinct prompt."""
    store = _store(spark)
    AN.answer(_submissions(spark, sf_dir), store)
    return AN.read_store(spark, store).drop("response")


def repeated_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary rows of a second run, all of whose answers come from the store."""
    store, submissions = _store(spark), _submissions(spark, sf_dir)
    AN.answer(submissions, store)
    return M.summary_rows(AN.answer(submissions, store))


def live_stage_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X3 + X4: the stage table kept by the stateful stream; equals the batch ``stage_state``."""
    return SG.run_live_state(spark, sf_dir)


def completion_guide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X2 + D1: guides written as both stages of a submission have reported; equals the batch ``study_guide``."""
    docs = A.documents(spark, sf_dir)
    lemma_map = V.prepare_lemma_map(V.corpus_statistics(docs, A.quality_ids(spark, sf_dir)))
    base = ST.run_document_stages(spark, sf_dir, lemma_map)
    return SG.run_completed_guides(spark, base).withColumn("vocabulary", F.array_join("vocabulary", " "))


QUERIES = {"stored_answers": stored_answers, "repeated_summaries": repeated_summaries,
           "streamed_live_state": live_stage_state, "streamed_completion_guide": completion_guide}


def oracle_sql(others: dict[str, str], summary_ctes: str) -> dict[str, str]:
    """Twins; three of the queries give what a batch query gives."""
    return {
        "stored_answers": f"""WITH {summary_ctes}
SELECT DISTINCT sha256(system_prompt || chr(31) || user_prompt || chr(31) || response_format) AS prompt_key, n_items FROM prompts""",
        "repeated_summaries": others["paragraph_summaries"],
        "streamed_live_state": others["stage_state"],
        "streamed_completion_guide": others["study_guide"]}
