"""OCR layout blocks -> paragraphs.

Blocks arrive flat: ``(doc_id, path ARRAY<INT>, type, text, page_start,
page_end)``; ``path`` is the position in the layout tree, and arrays
compare lexicographically with a prefix first, so ordering by ``path``
is a pre-order walk (P6).

Stitching (P8) looks sequential but each decision depends only on the
previous qualifying block's own text and page, never on the text built
so far, so it is a ``lag`` plus a running sum that numbers the output
paragraphs, then an ordered string aggregate per paragraph.  The window
is partitioned by document; a document is bounded by the upload size
limit, so no window partition grows with the corpus, and the rows in
the window are the blocks themselves (short texts).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators.joins import materialise

# Fixed values of the body-block filter and the stitching rules.
MIN_BODY_CHARS = 40          # blocks of at most this many characters are dropped
MAX_CAPS_HEADING_CHARS = 80  # all-caps blocks up to this length are headings
ENDS_MID_WORD = r"[\p{L}\p{N}_][—-]$"
ENDS_MID_SENTENCE = r"[a-z]$"
STARTS_MID_SENTENCE = r"^[a-z]"


NOT_TEXT = ("table", "list")     # node types that are never descended into


def flatten_layout(blocks: DataFrame, key: str | list[str] = "doc_id") -> DataFrame:
    """Paragraph-typed nodes of the tree (pre-order via ``path``), at any
    depth below text nodes; nothing below a node of another kind is reached."""
    key = [key] if isinstance(key, str) else list(key)
    paragraphs = blocks.filter(F.col("type") == "paragraph")
    shut = blocks.filter(F.col("type").isin(*NOT_TEXT)).select(*key, F.col("path").alias("_above"))
    above = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda k: F.slice("path", F.lit(1), k))
    below = (paragraphs.filter(F.size("path") > 1).select(*key, "path", F.explode(above).alias("_above"))
             .join(shut, [*key, "_above"], "left_semi").select(*key, "path").distinct())
    return paragraphs.join(below, [*key, "path"], "left_anti")


def paths_from_parents(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """P6 input with parent pointers: (key, node_id, parent_id, position, ...)
    to the same rows with ``path``, a level of the tree at a time; nodes that
    hang on no root have no path and are left out."""
    level = nodes.filter(F.col("parent_id").isNull()).withColumn("path", F.array("position"))
    out = level
    while not level.isEmpty():
        parents = level.select(key, F.col("node_id").alias("parent_id"), F.col("path").alias("_path"))
        level = materialise(nodes.join(parents, [key, "parent_id"]).withColumn(
            "path", F.concat("_path", F.array("position"))).drop("_path"), "layout-level")
        out = out.unionByName(level)
    return out


def is_all_caps(text) -> F.Column:
    """Python ``str.isupper()``: an upper-case letter, and no letter that is
    lower or title case."""
    return text.rlike(r"\p{IsUppercase}") & ~text.rlike(r"\p{IsLowercase}|\p{Lt}")


def body_blocks(blocks: DataFrame) -> DataFrame:
    """Stripped text; drop empty, short, and short all-caps blocks."""
    stripped = blocks.withColumn("text", T.strip_ws("text"))
    n = F.length("text")
    heading = (n <= MAX_CAPS_HEADING_CHARS) & is_all_caps(F.col("text"))
    return stripped.filter((n > MIN_BODY_CHARS) & ~heading)


def stitch_pages(blocks: DataFrame, key: str | list[str] = "doc_id", drop_hyphen: bool = False) -> DataFrame:
    """Join a block to the previous paragraph when it opens a new page
    with a lower-case letter and the previous block ended mid-word
    (joined without a space, hyphen kept) or mid-sentence (one space).
    ``drop_hyphen`` removes the hyphen of a word broken across the pages.

    Input: qualifying blocks (after P6+P7).  Output:
    ``(*key, paragraph_number, text)``.
    """
    key = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*key).orderBy("path")
    # How a block ends is found first, so the window looks back at flags, not at text.
    ends = blocks.select(*key, "path", "text", "page_start", "page_end", F.col("text").rlike(ENDS_MID_WORD).alias("_word"),
                         F.col("text").rlike(ENDS_MID_SENTENCE).alias("_sentence"))
    prev_word = F.lag("_word").over(w)
    flagged = ends.select(
        *key, "path", "text", prev_word.isNotNull().alias("has_prev"),
        (~F.col("page_start").eqNullSafe(F.lag("page_end").over(w))).alias("top_of_page"),
        prev_word.alias("prev_mid_word"), F.lag("_sentence").over(w).alias("prev_mid_sentence"))
    joins = (F.col("has_prev") & F.col("top_of_page") & F.col("text").rlike(STARTS_MID_SENTENCE)
             & (F.col("prev_mid_word") | F.col("prev_mid_sentence")))
    sep = F.when(~joins, "").when(F.col("prev_mid_word"), "").otherwise(" ")
    text = F.col("text")
    if drop_hyphen:
        # This block's hyphen goes when the next block continues the word.
        flagged = flagged.withColumn("_joins", joins).withColumn("_mid", F.col("prev_mid_word"))
        next_glues = F.coalesce(F.lead(F.col("_joins") & F.col("_mid")).over(w), F.lit(False))
        text = F.when(next_glues, F.expr("substring(text, 1, length(text) - 1)")).otherwise(F.col("text"))
    numbered = flagged.select(
        *key, "path", F.concat(sep, text).alias("piece"),
        (F.sum(F.when(joins, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
        .cast("int").alias("paragraph_number"))
    return (numbered.groupBy(*key, "paragraph_number")
            .agg(T.ordered_join("piece", "", "path").alias("text")))
