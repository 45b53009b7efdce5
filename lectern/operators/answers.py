"""Content-addressed model answers (M10 across runs).

Answers are stored by the SHA-256 of what the model is asked.  A run computes
the keys of its prompts, sends only one prompt of each key the store lacks to
the model, adds the valid answers to the store and joins all answers back.
Re-uploaded texts, texts of other users and repeated runs cost no call.

A run stores its prompts first, so that their texts are made once.  What moves
by key are digests; of the prompts' texts only those not answered yet do.  The store is a folder of Parquet files, one sub-folder a run; if two
runs answer the same prompt at the same time, every later run reads the same
one of the two.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import summaries as M
from lectern.operators.joins import materialise

_KEY = ["user_id", "submission_id"]
STORE_SCHEMA = "prompt_key string, n_items int, response string"
FIELD_END = "\x1f"


def prompt_key(prompt: Column) -> Column:
    """SHA-256 of all that the model sees."""
    seen = [prompt["system_prompt"], prompt["user_prompt"], prompt["response_format"]]
    return F.sha2(F.concat_ws(FIELD_END, *seen), 256)


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """(prompt_key, n_items, response), one row a key; an absent folder is empty."""
    try:
        rows = spark.read.parquet(store).select("prompt_key", "n_items", "response")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], STORE_SCHEMA)
    return rows.groupBy("prompt_key").agg(F.min("n_items").alias("n_items"), F.min("response").alias("response"))


def unanswered(prompts: DataFrame, stored: DataFrame) -> DataFrame:
    """One prompt of each key that ``stored`` lacks, (prompt_key, prompt)."""
    return prompts.join(stored.select("prompt_key"), "prompt_key", "left_anti").dropDuplicates(["prompt_key"])


def answer(submissions: DataFrame, store: str, model=None, subject: str = "",
           batch_size: int = M.BATCH_SIZE) -> DataFrame:
    """``summaries.answer`` with a store: same columns, same rows.

    ``submissions`` has one row a submission.  An answer that fails M5 counts
    in this run only, so the next run asks again.  A NULL ``paragraphs`` array
    asks nothing.
    """
    spark = submissions.sparkSession
    # Read three times below: the texts are split and asked about once.
    prompted = materialise(M._prompted(submissions, subject, batch_size).select(
        *_KEY, "prompts", M.kept_paragraphs().alias("kept")), "prompts")
    each = prompted.select(*_KEY, F.posexplode("prompts").alias("batch_no", "prompt")).withColumn(
        "prompt_key", prompt_key(F.col("prompt")))
    asked = materialise(each.select(
        *_KEY, "batch_no", "prompt_key", F.col("prompt.n_items").alias("n_items"),
        F.col("prompt.paragraph_numbers").alias("paragraph_numbers")), "asked")

    todo = unanswered(each.select("prompt_key", "prompt"), read_store(spark, store))
    called = M.call_model(todo.select("prompt_key", F.array("prompt").alias("prompts")), model)
    new = materialise(M.validate_responses(called.select(
        "prompt_key", F.col("prompts")[0]["n_items"].alias("n_items"), F.col("responses")[0].alias("response"))), "new-answers")
    columns = ["prompt_key", "n_items", "response"]
    new.filter("status = 'ok'").select(*columns).write.parquet(f"{store.rstrip('/')}/run={uuid.uuid4().hex}")

    failed = new.filter("status <> 'ok'").select("prompt_key", "response")
    answers = read_store(spark, store).select("prompt_key", "response").unionByName(failed)
    met = asked.join(answers, "prompt_key", "left").groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct(
        "batch_no", "n_items", "paragraph_numbers", "response"))).alias("met"))
    kept = prompted.select(*_KEY, "kept")
    same = F.col("user_id").eqNullSafe(F.col("_user")) & F.col("submission_id").eqNullSafe(F.col("_submission"))
    met = met.withColumnsRenamed({"user_id": "_user", "submission_id": "_submission"})
    none = F.filter(F.array(F.struct(F.lit(0).alias("n_items"), F.array().cast("array<int>").alias("paragraph_numbers"))), lambda x: F.lit(False))
    return materialise(kept.join(met, same, "left").select(
        *_KEY, F.coalesce(F.transform("met", lambda m: F.struct(
            m["n_items"].alias("n_items"), m["paragraph_numbers"].alias("paragraph_numbers"))), none).alias("asked"),
        F.coalesce(F.transform("met", lambda m: m["response"]), F.array().cast("array<string>")).alias("responses"),
        "kept"), "answers")
