"""Summarisation dataflow (M1-M10); the model call is a plug-in.

A submission is one row with its paragraphs as an array, so batching (M2),
prompts with their response format (M3, M4), validation (M5), the scatter
back onto paragraphs (M6) and the intro words (M7) are array functions on
that row: no window, no shuffle, no key that gathers rows.  Only the answers
and what the result needs besides (intro words, short texts) are stored
between the model call and its readers.

The default model answers each marked paragraph with its first sentence, in
Spark SQL; any other model is a pandas function run through ``mapInPandas``,
the only place rows cross into Python.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from lectern.functions import text as T
from lectern.operators.joins import materialise

# Fixed values.
MIN_SUMMARY_CHARS = 300      # shorter paragraphs are their own summary
BATCH_SIZE = 20              # paragraphs per model call
SUMMARY_CAP = 100            # M8, where asked for: numbers up to the cap are kept, so cap + 1 rows
INTRO_WORDS = 10             # words of a paragraph kept as its start
ITEM_MARKER = "\n\n---PARAGRAPH {n}---\n{text}"   # structure of one prompt item
ANSWER_FIELDS = {"paragraph_number": "integer", "summary": "string"}
ANSWER_LIST = "summaries"
RESPONSE_DDL = "summaries ARRAY<STRUCT<paragraph_number: INT, summary: STRING>>"

SYSTEM_PROMPT = (
    "You help {subject} students who are learning English read assigned texts. "
    "Paragraphs are delimited by markers of the form ---PARAGRAPH n---. "
    "For each paragraph write exactly one plain sentence that keeps its key facts and claims "
    "and that an English learner can follow.")

_KEY = ["user_id", "submission_id"]


def gather(paragraphs: DataFrame) -> DataFrame:
    """Long-form paragraphs as one row per submission with ``paragraphs``
    ARRAY<STRUCT<paragraph_number, text>> in order."""
    return paragraphs.groupBy(*_KEY).agg(
        F.array_sort(F.collect_list(F.struct("paragraph_number", "text"))).alias("paragraphs"))


def needs_summary(text: Column | str = "text") -> Column:
    """M1: a paragraph goes to the model when its stripped length is >= 300."""
    return F.length(T.strip_ws(text)) >= MIN_SUMMARY_CHARS


def _batched(submissions: DataFrame, batch_size: int) -> DataFrame:
    """Adds ``batches``: the qualifying paragraphs in order, cut in groups."""
    with_long = submissions.withColumn("_long", F.filter("paragraphs", lambda p: needs_summary(p["text"])))
    n = F.ceil(F.size("_long") / batch_size).cast("int")
    cut = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                      lambda b: F.slice("_long", (b - 1) * batch_size + 1, batch_size))
    return with_long.withColumn("batches", F.filter(cut, lambda b: F.size(b) > 0)).drop("_long")


def batch_paragraphs(submissions: DataFrame, batch_size: int = BATCH_SIZE) -> DataFrame:
    """M2: qualifying paragraphs in order, groups of ``batch_size``;
    ``batch_no`` from 0, ``item_no`` from 1 inside the batch."""
    batches = _batched(submissions, batch_size).select(*_KEY, F.posexplode("batches").alias("batch_no", "b"))
    return batches.select(*_KEY, "batch_no", F.posexplode("b").alias("_i", "p")).select(
        *_KEY, F.col("p.paragraph_number").alias("paragraph_number"), F.col("p.text").alias("text"),
        "batch_no", (F.col("_i") + 1).alias("item_no"))


def response_format(n: Column) -> Column:
    """M4: strict JSON schema asking for ``n`` numbered one-sentence summaries."""
    def strict(properties: dict) -> dict:
        return {"type": "object", "properties": properties, "required": list(properties), "additionalProperties": False}

    item = strict({name: {"type": kind} for name, kind in ANSWER_FIELDS.items()})
    answers = {"type": "array", "description": "\x00 one-sentence answers", "items": item}
    envelope = {"type": "json_schema", "json_schema": {
        "name": "paragraph_summaries", "strict": True, "schema": strict({ANSWER_LIST: answers})}}
    head, tail = json.dumps(envelope, separators=(",", ":")).split("\\u0000")
    return F.concat(F.lit(head), n.cast("string"), F.lit(tail))


def _prompt(batch: Column, subject: str) -> Column:
    """M3 + M4: the prompt of one batch."""
    head, tail = ITEM_MARKER.split("{n}")
    mid, _ = tail.split("{text}")
    n = F.size(batch)
    items = F.array_join(F.transform(batch, lambda p, i: F.concat(
        F.lit(head), (i + 1).cast("string"), F.lit(mid), p["text"])), "\n\n")
    user = T.strip_ws(F.concat(
        F.lit("Summarise each of the "), n.cast("string"), F.lit(" paragraphs below in one sentence.\n---\n\n"), items,
        F.lit("\n\n---\n\nReturn exactly "), n.cast("string"), F.lit(" summaries, one per paragraph, numbered as marked.")))
    return F.struct(
        n.alias("n_items"), user.alias("user_prompt"),
        F.lit(SYSTEM_PROMPT.format(subject=subject).replace("  ", " ")).alias("system_prompt"),
        response_format(n).alias("response_format"),
        F.transform(batch, lambda p: p["paragraph_number"]).alias("paragraph_numbers"))


def _prompted(submissions: DataFrame, subject: str, batch_size: int) -> DataFrame:
    return _batched(submissions, batch_size).withColumn(
        "prompts", F.transform("batches", lambda b: _prompt(b, subject))).drop("batches")


def build_prompts(submissions: DataFrame, subject: str = "", batch_size: int = BATCH_SIZE) -> DataFrame:
    """M3: one row per (submission, batch) with its prompt and M4's format."""
    rows = _prompted(submissions, subject, batch_size).select(*_KEY, F.posexplode("prompts").alias("batch_no", "p"))
    return rows.select(*_KEY, "batch_no", "p.*")


# --------------------------------------------------------------------------
# Model plug-in
# --------------------------------------------------------------------------

ITEM_PATTERN = r"(?s)---PARAGRAPH (\d+)---\n(.*?)(?=\n\n)"


def first_sentences(prompt: Column) -> Column:
    """The default model: every marked paragraph answered with its first sentence."""
    numbers = F.regexp_extract_all(prompt, F.lit(ITEM_PATTERN), 1)
    texts = F.regexp_extract_all(prompt, F.lit(ITEM_PATTERN), 2)
    items = F.zip_with(numbers, texts, lambda n, t: F.struct(
        n.try_cast("int").alias("paragraph_number"), T.sentences(t)[0].alias("summary")))
    return F.to_json(F.struct(items.alias(ANSWER_LIST)))


def call_model(prompted: DataFrame, model: Callable[[pd.DataFrame], pd.Series] | None = None) -> DataFrame:
    """Adds ``responses``, the JSON answer to each of the row's ``prompts``.

    ``model`` takes a pandas frame of prompts (``system_prompt``,
    ``user_prompt``, ``response_format``, ``n_items``) and returns the
    responses; it runs on Arrow batches inside the executors.
    """
    if model is None:
        return prompted.withColumn("responses", F.transform("prompts", lambda p: first_sentences(p["user_prompt"])))
    schema = StructType([*prompted.schema.fields, StructField("responses", ArrayType(StringType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sizes = frame["prompts"].map(len)
            flat = pd.DataFrame([dict(p) for row in frame["prompts"] for p in row],
                                columns=["n_items", "user_prompt", "system_prompt", "response_format", "paragraph_numbers"])
            answers = iter(model(flat).tolist()) if len(flat) else iter(())
            yield frame.assign(responses=[[next(answers) for _ in range(n)] for n in sizes])

    return prompted.mapInPandas(run, schema)


# --------------------------------------------------------------------------
# M5, M6
# --------------------------------------------------------------------------

def _items(response: Column) -> Column:
    return F.coalesce(F.from_json(response, RESPONSE_DDL)[ANSWER_LIST],
                      F.array().cast("array<struct<paragraph_number:int,summary:string>>"))


def verdict(response: Column, n: Column) -> Column:
    """M5: ``ok`` or the first failed check: empty response, invalid json,
    wrong count (not exactly ``n`` summaries), missing numbers (numbers in
    1..n not all present once), missing summary (an answer without text)."""
    items = _items(response)
    numbers = F.array_distinct(F.filter(F.transform(items, lambda x: x["paragraph_number"]), lambda p: p.between(1, n)))
    return (F.when(response.isNull() | (T.strip_ws(response) == ""), "empty response")
            .when(F.try_parse_json(response).isNull(), "invalid json")
            .when(F.size(items) != n, "wrong count")
            .when(F.size(numbers) != n, "missing numbers")
            .when(F.exists(items, lambda x: x["summary"].isNull()), "missing summary")
            .otherwise("ok"))


def validate_responses(responses: DataFrame) -> DataFrame:
    """M5 over rows (keys, batch_no, n_items, response): one verdict each."""
    return responses.withColumn("status", verdict(F.col("response"), F.col("n_items")))


def verdicts(answered: DataFrame) -> DataFrame:
    """One verdict row per batch of :func:`answer`'s rows."""
    each = F.posexplode(F.arrays_zip("asked", "responses")).alias("batch_no", "a")
    return validate_responses(answered.select(*_KEY, each).select(
        *_KEY, "batch_no", F.col("a.asked.n_items").alias("n_items"), F.col("a.responses").alias("response")))


def failed_submissions(verdict_rows: DataFrame) -> DataFrame:
    """A failing batch fails the whole submission."""
    return verdict_rows.filter(F.col("status") != "ok").select(*_KEY).distinct()


def kept_paragraphs() -> Column:
    """Each paragraph's number and start (M7), and its text if that is its own summary."""
    return F.transform("paragraphs", lambda p: F.struct(
        p["paragraph_number"].alias("paragraph_number"), T.intro_words(p["text"], INTRO_WORDS).alias("paragraph_start"),
        F.when(~needs_summary(p["text"]), p["text"]).alias("own")))


def answer(submissions: DataFrame, model=None, subject: str = "", batch_size: int = BATCH_SIZE) -> DataFrame:
    """M1-M4 and M10, stored: per submission ``asked`` (size and paragraph
    numbers of each batch), ``responses``, and the paragraphs' starts (M7),
    with the text of those that are their own summary."""
    prompted = _prompted(submissions, subject, batch_size).withColumn("kept", kept_paragraphs())
    called = call_model(prompted.select(*_KEY, "prompts", "kept"), model)
    asked = F.transform("prompts", lambda p: F.struct(p["n_items"].alias("n_items"), p["paragraph_numbers"].alias("paragraph_numbers")))
    # A model's answers are expensive and may differ when asked again.
    return materialise(called.select(*_KEY, asked.alias("asked"), "responses", "kept"), "answers")


def summary_rows(answered: DataFrame, cap: int | None = None) -> DataFrame:
    """M6-M8: per paragraph its start and its summary, the text itself where
    short; a submission with a failed batch has no rows.  With ``cap`` only
    paragraph numbers up to it are kept."""
    each = F.zip_with("asked", "responses", lambda a, r: F.struct(a["n_items"].alias("n"), r.alias("r")))
    ok = answered.filter(F.forall(each, lambda x: verdict(x["r"], x["n"]) == "ok"))
    # Sorted by number, a batch's summaries stand in the order of its paragraphs.
    told = F.flatten(F.transform("responses", lambda r: F.transform(F.array_sort(_items(r)), lambda x: x["summary"])))
    long = F.filter("kept", lambda p: p["own"].isNull())
    rows = F.concat(
        F.transform(F.filter("kept", lambda p: p["own"].isNotNull()), lambda p: F.struct(
            p["paragraph_number"].alias("paragraph_number"), p["paragraph_start"].alias("paragraph_start"), p["own"].alias("summary"))),
        F.zip_with(long, told, lambda p, s: F.struct(
            p["paragraph_number"].alias("paragraph_number"), p["paragraph_start"].alias("paragraph_start"), s.alias("summary"))))
    out = ok.select(*_KEY, F.explode(rows).alias("row")).select(*_KEY, "row.*")
    return out if cap is None else out.filter(F.col("paragraph_number") <= cap)


def summarise(submissions: DataFrame, model=None, subject: str = "", batch_size: int = BATCH_SIZE,
              cap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """M1-M10 end to end over rows (keys, ``paragraphs`` array): returns
    (summary rows, batch verdicts)."""
    answered = answer(submissions, model, subject, batch_size)
    return summary_rows(answered, cap), verdicts(answered)
