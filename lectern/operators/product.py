"""Features from the product specification.

All are keyed by user or submission.  Hot keys (one user with a third of
all submissions, one text uploaded many times) are handled by partial
aggregation and, for top-k, by Spark's partial ``WindowGroupLimit``,
which keeps at most k rows per user in every map task before the
shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.joins import broadcast_if_small, materialise
from lectern.operators.keyed import STAGE_PARAGRAPHS, STAGE_SUMMARIES, STAGE_VOCABULARY

# Fixed values.
RATE_LIMIT_PER_MINUTE = 10
REQUIRED_STAGES = (STAGE_PARAGRAPHS, STAGE_VOCABULARY, STAGE_SUMMARIES)
WORD_MARKS = ("known", "learned", "not interested")


def duplicate_submissions(subs: DataFrame, key: list[str], hash_col: str, order: list[str]) -> DataFrame:
    """Flag every submission whose exact text the same user sent before.

    First copy per (user, hash) by aggregation (partial per map task, so a
    group of a million copies is not gathered as rows), joined back on the
    group key; AQE splits a skewed join partition.
    """
    group = [*key, hash_col]
    first = subs.groupBy(*group).agg(F.min(F.struct(*order)).alias("_first"),
                                     F.count(F.lit(1)).alias("copies"))
    return (subs.join(first, group)
            .withColumn("is_duplicate", F.struct(*order) > F.col("_first")).drop("_first"))


def rate_per_minute(events: DataFrame, user_col: str, ts_col: str,
                    limit: int = RATE_LIMIT_PER_MINUTE, window: str = "1 minute") -> DataFrame:
    """Z3: submissions per user per tumbling ``window``, flagged above ``limit``."""
    return (events.groupBy(user_col, F.window(ts_col, window).alias("w"))
            .agg(F.count(F.lit(1)).alias("uploads"))
            .select(user_col, F.col("w.start").alias("window_start"), "uploads",
                    (F.col("uploads") > limit).alias("over_limit")))


def sliding_rate(events: DataFrame, user_col: str, ts_col: str, limit: int = RATE_LIMIT_PER_MINUTE,
                 seconds: int = 60, slice_windows: int = 60) -> DataFrame:
    """Z3 with a sliding window: each event with the user's ``uploads`` in the
    ``seconds`` up to and including it, flagged above ``limit``; a burst across
    a minute's border counts whole.

    A user's time is cut into slices of ``slice_windows`` windows, so a busy
    user is spread over tasks; events of a slice's last window go along into
    the next slice as context.  Events without a time have no rate: NULL."""
    width = seconds * 1_000_000
    length = width * slice_windows
    at = F.unix_micros(F.col(ts_col).cast("timestamp"))
    rows = events.withColumn("_at", at).withColumn("_slice", F.floor(F.col("_at") / F.lit(length)))
    # The next slice needs what lies less than one window before its start.
    late = F.pmod(F.col("_at"), F.lit(length)) > length - width
    own, both = F.array(F.struct(F.col("_slice").alias("s"), F.lit(False).alias("c"))), F.array(
        F.struct(F.col("_slice").alias("s"), F.lit(False).alias("c")), F.struct((F.col("_slice") + 1).alias("s"), F.lit(True).alias("c")))
    placed = rows.withColumn("_p", F.explode(F.when(late, both).otherwise(own)))
    window = Window.partitionBy(user_col, "_p.s").orderBy("_at").rangeBetween(-(width - 1), 0)
    counted = placed.withColumn("uploads", F.when(F.col("_at").isNotNull(), F.count(F.lit(1)).over(window))).filter(~F.col("_p.c"))
    return counted.withColumn("over_limit", F.col("uploads") > limit).drop("_at", "_slice", "_p")


def threshold_profile(words: DataFrame, thresholds: list[float]) -> DataFrame:
    """Per submission, how many uncommon words each threshold keeps.

    ``words`` must come from the vocabulary run at the largest threshold;
    smaller thresholds keep subsets, so one conditional aggregate answers
    every slider position (no cross join with the threshold list).
    A row stands for as many words as its column ``words`` says, if there is one.
    """
    n = F.col("words") if "words" in words.columns else F.lit(1).cast("bigint")
    aggs = [F.coalesce(F.sum(F.when(F.col("language_frequency") < F.lit(float(t)), n)), F.lit(0).cast("bigint")).alias(threshold_column(t))
            for t in sorted(thresholds)]
    return words.groupBy("user_id", "submission_id").agg(*aggs)


def threshold_index(words: DataFrame) -> DataFrame:
    """Per submission the sorted frequencies of its words, from which
    ``words_below`` answers any slider position without another run.

    A submission has one entry for each of its distinct uncommon words, so an
    array is never longer than the lexicon."""
    return words.groupBy("user_id", "submission_id").agg(F.array_sort(F.collect_list("language_frequency")).alias("frequencies"))


def words_below(frequencies: Column, threshold: Column | float) -> Column:
    """How many of the sorted frequencies lie strictly below the threshold, by
    binary search.  ``threshold`` may be a column: another position each row."""
    t = F.lit(float(threshold)) if isinstance(threshold, (int, float)) else threshold
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(frequencies) + F.lit(1))).cast("int"))

    def halve(state: Column, _: Column) -> Column:
        middle = F.floor((state["low"] + state["high"]) / 2).cast("int")
        below = F.get(frequencies, middle) < t
        open_ = state["low"] < state["high"]
        return F.struct(F.when(open_ & below, middle + 1).otherwise(state["low"]).alias("low"),
                        F.when(open_ & ~below, middle).otherwise(state["high"]).alias("high"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(frequencies).alias("high")), halve, lambda s: s["low"])


def threshold_column(t: float) -> str:
    return "words_below_" + f"{t:.0e}".replace("-", "_").replace("+", "")


def top_k_recent(subs: DataFrame, k: int, group: str = "user_id") -> DataFrame:
    """The ``k`` newest submissions of every user (missing date = 0)."""
    w = Window.partitionBy(group).orderBy(F.coalesce("created_at", F.lit(0)).desc(), F.col("submission_id"))
    return subs.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k)


def missing_stages(done: DataFrame, key: list[str], bit_col: str = "bit") -> DataFrame:
    """Stages still to run per key = required stage bits minus those seen.

    Every key is paired with the fixed list of required stages by
    ``explode`` (a projection, not a cross join), then completed stages
    are removed with an anti join.
    """
    keys = done.select(*key).distinct()
    wanted = keys.select(*key, F.explode(F.array(*[F.lit(b) for b in REQUIRED_STAGES])).alias("stage"))
    seen = done.select(*key, F.col(bit_col).alias("stage")).distinct()
    return wanted.join(seen, [*key, "stage"], "left_anti")


def word_marks(vocabulary: DataFrame, marks: DataFrame) -> DataFrame:
    """Each word's latest mark for its user (default ``unmarked``)."""
    latest = marks.groupBy("user_id", "word").agg(F.max_by("mark", F.struct("ts", "mark")).alias("mark"))
    # Stored, so that Spark knows its size before it would shuffle the vocabulary.
    latest = broadcast_if_small(materialise(latest, "marks"))
    return (vocabulary.join(latest, ["user_id", "word"], "left")
            .withColumn("mark", F.coalesce("mark", F.lit("unmarked"))))


def hide_known(vocabulary: DataFrame, marks: DataFrame) -> DataFrame:
    """Drop words the user marked as known."""
    return word_marks(vocabulary, marks).filter(F.col("mark") != "known")


def rename(subs: DataFrame, renames: DataFrame) -> DataFrame:
    """Latest rename per submission wins."""
    latest = renames.groupBy("user_id", "submission_id").agg(F.max_by("filename", F.struct("ts", "filename")).alias("_new"))
    return (subs.join(latest, ["user_id", "submission_id"], "left")
            .withColumn("filename", F.coalesce("_new", "filename")).drop("_new"))
