"""Paragraph segmentation and cleaning (P1-P3, P9 text route).

A submission's paragraph list is an ``ARRAY<STRING>`` on one row (the
same shape the paragraph sink writes), so splitting, cleaning and the
min-length filter are higher-order array functions and positions come
from ``posexplode``: renumbering after the filter needs no window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T

MIN_LENGTH = 100


def blank_line_split(text: Column | str) -> Column:
    """Split on a literal blank line, strip, drop empty pieces."""
    col = F.col(text) if isinstance(text, str) else text
    pieces = F.transform(F.split(col, "\n\n", -1), lambda x: T.strip_ws(x))
    return F.filter(pieces, lambda x: x != "")


def one_line(paragraphs: Column) -> Column:
    """P2 over a paragraph list: CR/LF runs become a space."""
    return F.transform(paragraphs, lambda x: T.collapse_newlines(x))


def clean_min_length(paragraphs: Column, min_length: int = MIN_LENGTH) -> Column:
    """P3 over a paragraph list: normalise whitespace, keep ``len >= min_length``."""
    cleaned = F.transform(paragraphs, lambda x: T.clean_paragraph(x))
    return F.filter(cleaned, lambda x: F.length(x) >= min_length)


def explode_paragraphs(df: DataFrame, paragraphs: Column, keep: list[str]) -> DataFrame:
    """Long form: one row per paragraph with its 0-based ``paragraph_number``."""
    return df.select(*keep, F.posexplode(paragraphs).alias("paragraph_number", "text"))


def text_paragraph_list(text: Column | str, min_length: int = MIN_LENGTH) -> Column:
    """P9 for text files: P1 -> P2 -> P3."""
    return clean_min_length(one_line(blank_line_split(text)), min_length)


def number_pieces(pieces: DataFrame, paragraphs: Column, key: str = "submission_id", order: str = "turn") -> DataFrame:
    """Long form of texts that arrive as ordered pieces joined by blank lines:
    a blank-line split never crosses a piece, so each piece is split on its
    own and numbered from how many paragraphs stand before it.  Only counts
    go through the window, never a text; pieces of one ``order`` follow by
    their text."""
    rows = pieces.select(key, order, F.xxhash64("text").alias("_tie"), paragraphs.alias("_ps"))
    sizes = rows.select(key, order, "_tie", F.size("_ps").alias("_n")).filter("_n > 0").groupBy(key, order, "_tie").agg(
        F.sum("_n").alias("_n"), F.min("_n").alias("_each"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy(order, "_tie")) - F.col("_n")
    offsets = sizes.select(key, order, "_tie", before.alias("_before"), "_n", "_each")
    first = rows.dropDuplicates([key, order, "_tie"]).select(key, order, "_tie", F.posexplode("_ps").alias("_i", "text"))
    placed = first.join(offsets, [key, order, "_tie"])
    # A piece given more than once counts as often.
    again = F.explode(F.sequence(F.lit(0), (F.col("_n") / F.col("_each")).cast("int") - 1)).alias("_copy")
    return placed.select(key, "text", "_before", "_each", "_i", again).select(
        key, (F.col("_before") + F.col("_copy") * F.col("_each") + F.col("_i")).cast("int").alias("paragraph_number"), "text")
