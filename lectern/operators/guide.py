"""Read side (D1-D9): study guides, text, listings, definitions.

``study_guide`` is the per-paragraph join of vocabulary and summaries for
every completed submission at once, keyed by (submission, paragraph); the
dense paragraph index is generated with ``sequence`` + ``explode``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import labels as LB
from lectern.functions import text as T
from lectern.operators.keyed import STATE_COMPLETE

_KEY = ["user_id", "submission_id"]

DEFINITIONS_DDL = ("ARRAY<STRUCT<meanings: ARRAY<STRUCT<partOfSpeech: STRING, "
                   "definitions: ARRAY<STRUCT<definition: STRING>>>>>>")


def completed(submissions: DataFrame, state_col: str = "state") -> DataFrame:
    """Submissions whose state is exactly complete."""
    return submissions.filter(F.col(state_col) == STATE_COMPLETE).select(*_KEY)


def words_by_paragraph(vocabulary: DataFrame, order: str = "word") -> DataFrame:
    """Per (submission, paragraph) the words in scan order.

    ``order='word'`` reproduces the stored layout (byte order of the sort
    key, i.e. alphabetical within a paragraph); ``order='rank'`` keeps the
    rarity order when a ``rank`` column is present.
    """
    # Within a paragraph the stored keys differ in the word only, which ends them.
    sort = F.col("word") if order == "word" else F.col("rank")
    pairs = F.sort_array(F.collect_list(F.struct(sort.alias("k"), F.col("word").alias("w"))))
    return (vocabulary.groupBy(*_KEY, "paragraph_number")
            .agg(pairs["w"].alias("vocabulary")))


def summaries_by_paragraph(summaries: DataFrame) -> DataFrame:
    """D3: one summary row per (submission, paragraph); the last write wins, a
    write without a time counts as the earliest."""
    if "created_at" not in summaries.columns:
        return summaries
    written = F.coalesce(F.col("created_at").cast("bigint"), F.lit(0))
    latest = F.max_by(F.struct("paragraph_start", "summary"), F.struct(written, "summary"))
    return (summaries.groupBy(*_KEY, "paragraph_number").agg(latest.alias("s"))
            .select(*_KEY, "paragraph_number", "s.paragraph_start", "s.summary"))


def study_guide(vocabulary: DataFrame, summaries: DataFrame, submissions: DataFrame,
                order: str = "word", dense: str = "max_index") -> DataFrame:
    """``(user_id, submission_id, paragraph_index, vocabulary,
    summary, paragraph_start)`` for completed submissions.

    The index runs densely from 0 to the largest paragraph number seen;
    ``dense='count'`` sizes it by max(#paragraphs with words, #paragraphs with
    a summary) instead, as the original does, which cuts off what lies
    beyond.  Missing sides default to ``[]`` and ``""``.

    Rows meet on (submission, paragraph): a submission's paragraphs need
    not sit in one task, and an index row without any is made by ``sequence``.
    """
    by_paragraph = [*_KEY, "paragraph_number"]
    words = words_by_paragraph(vocabulary, order)
    told = summaries_by_paragraph(summaries).select(*by_paragraph, "paragraph_start", "summary")
    both = words.join(told, by_paragraph, "full_outer").join(completed(submissions), _KEY, "left_semi")
    sizes = both.groupBy(*_KEY).agg(
        F.max("paragraph_number").alias("top"), F.count("vocabulary").alias("nw"), F.count("summary").alias("ns"))
    n = F.col("top") + 1 if dense == "max_index" else F.greatest("nw", "ns").cast("int")
    index = sizes.filter(n > 0).select(*_KEY, F.explode(F.sequence(F.lit(0), n - 1)).alias("paragraph_number"))
    return index.join(both, by_paragraph, "left").select(
        *_KEY, F.col("paragraph_number").alias("paragraph_index"),
        F.coalesce("vocabulary", F.array().cast("array<string>")).alias("vocabulary"),
        F.coalesce("summary", F.lit("")).alias("summary"),
        F.coalesce("paragraph_start", F.lit("")).alias("paragraph_start"))


def submission_text(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs joined by a blank line, in order."""
    return paragraphs.groupBy(*_KEY).agg(T.ordered_join("text", "\n\n", "paragraph_number").alias("text"))


def listing(submissions: DataFrame) -> DataFrame:
    """D6 + D7 + D10: every user's list, newest first (a missing date sorts
    as 0).  A global sort: range partitioning splits a user with many
    submissions across partitions instead of gathering them in one task."""
    return (submissions.select(
        "user_id", F.col("submission_id").alias("id"),
        F.coalesce("filename", F.lit(LB.DEFAULT_NAME)).alias("filename"),
        "created_at", LB.status_label(F.col("state")).alias("status"),
        LB.created_date(F.col("created_at")).alias("created_date"))
        .withColumn("details_link", F.col("status") == "complete")
        .orderBy("user_id", F.coalesce("created_at", F.lit(0)).desc(), "id"))


def definitions(entries: DataFrame, json_col: str = "entry_json") -> DataFrame:
    """Dictionary JSON -> (definition, partOfSpeech); non-list -> nothing."""
    parsed = F.from_json(F.col(json_col), DEFINITIONS_DDL)
    is_list = F.regexp_like(F.col(json_col), F.lit(r"^\s*\["))
    keep = [c for c in entries.columns if c != json_col]
    meanings = entries.select(*keep, F.explode(F.when(is_list, parsed)).alias("e")) \
        .select(*keep, F.explode("e.meanings").alias("m"))
    defs = meanings.select(*keep, F.col("m.partOfSpeech").alias("partOfSpeech"),
                           F.posexplode("m.definitions").alias("def_no", "d"))
    return (defs.filter(F.col("d.definition").isNotNull() & (F.col("d.definition") != ""))
            .select(*keep, F.col("d.definition").alias("definition"), "partOfSpeech"))


def paragraph_display(summaries: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Collapsed heading (start + ``...``) and the expanded full text."""
    return (summaries.join(paragraphs.select(*_KEY, "paragraph_number", "text"),
                           [*_KEY, "paragraph_number"], "left")
            .select(*_KEY, "paragraph_number",
                    F.concat("paragraph_start", F.lit("...")).alias("collapsed"),
                    F.coalesce("text", F.concat("paragraph_start", F.lit("..."))).alias("expanded")))


def markdown_export(guide: DataFrame) -> DataFrame:
    """One Markdown document per submission from its study-guide rows."""
    section = F.concat(
        F.lit("## "), F.col("paragraph_start"), F.lit("...\n\n"), F.col("summary"),
        F.when(F.size("vocabulary") > 0,
               F.concat(F.lit("\n\n**Vocabulary:** "), F.array_join("vocabulary", ", "))).otherwise(F.lit("")))
    return (guide.select(*_KEY, "paragraph_index", section.alias("section"))
            .groupBy(*_KEY).agg(T.ordered_join("section", "\n\n", "paragraph_index").alias("markdown")))

