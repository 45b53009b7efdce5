"""Composed plans: the corpus-wide study guide.

One plan from documents to per-paragraph study-guide rows:

    documents -> paragraphs (P3) ----> vocabulary (V1-V14) ---\\
                        \\-----------> summaries (M1-M10) -----+--> D1-D4
    stage ledger (K10) from what each stage produced ----------/

The paragraph DataFrame feeds both branches; stage completion is derived
from the stage outputs themselves (every submission passes the
paragraph and vocabulary stages; the summary stage completes only when
no batch failed), so the completion gate reflects real failures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import guide as G
from lectern.operators import keyed as K
from lectern.operators import summaries as M
from lectern.operators import vocabulary as V
from lectern.operators.joins import materialise, split_repeated
from lectern.sources import adapters as A

_KEY = ["user_id", "submission_id"]


def stage_ledger(*reports: tuple[DataFrame, list[int]]) -> DataFrame:
    """K10 over stage reports: each ``(submissions, bits)`` says those
    submissions reported those stage bits; one row per (submission, bit)."""
    out = None
    for df, bits in reports:
        rows = df.select(*_KEY, F.explode(F.array(*[F.lit(b) for b in bits])).alias("bit"))
        out = rows if out is None else out.unionByName(rows)
    return K.accumulate_state(out, _KEY)


def study_guide_parts(spark: SparkSession, sf_dir: str, threshold: float = V.DEFAULT_THRESHOLD):
    docs = A.documents(spark, sf_dir)
    lists = materialise(A.paragraph_lists(docs), "paragraphs")       # read by both branches
    stats = V.corpus_statistics(docs, A.quality_ids(spark, sf_dir))
    once, again = map(A.long_form, split_repeated(lists, _KEY))
    words = V.ranked_words(once, stats, None, threshold, repeated=again, sentences=False)
    summary_rows, verdicts = M.summarise(lists)
    subs = lists.select(*_KEY)
    summarized = subs.join(M.failed_submissions(verdicts), _KEY, "left_anti")
    every = [K.STAGE_RECEIVED, K.STAGE_PARAGRAPHS, K.STAGE_VOCABULARY]
    # The gate reads the idempotent mask: a redelivered stage report would
    # push the arithmetic sum past "complete" (the original's quirk).
    state = stage_ledger((subs, every), (summarized, [K.STAGE_SUMMARIES])) \
        .select(*_KEY, F.col("state_mask").alias("state"))
    return V.vocabulary_rows(words), summary_rows, state


def study_guide(spark: SparkSession, sf_dir: str, threshold: float = V.DEFAULT_THRESHOLD) -> DataFrame:
    vocab, summaries, state = study_guide_parts(spark, sf_dir, threshold)
    return G.study_guide(vocab, summaries, state)
