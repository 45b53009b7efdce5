"""Line-first quality rules, in DataFrame expressions only.

Every line with a word is tested for punctuation (too dense, or without any
sentence end), navigation (separators, or a lone menu word) and boilerplate
(a stock phrase in a short line).  Failing lines are removed; a document that
loses more than half of its characters is rejected.  Two rules on the whole
text come first: too few words, or too many of them inside repeated 8-word
windows.

Repeated windows are found within the row: words, then windows of word hashes,
are hashed to 64 bits; windows are sorted with their places, and equal
neighbours give the covered words.  Two different words or windows of one text
would have to share a hash to be mistaken (for a text of a million words a
chance of 1 in 18 million).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import WORD

# Fixed by the contract.
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
MAX_PUNCTUATION_PERCENT = 20  # of a line's characters
FEW_MARKS = 4                 # fewer are never too dense
SENTENCE_END = r"[.!?…][)\]\"'”»]*([\x20\x09-\x0D]|\z)|[。！？]"
SEPARATORS = (" | ", " > ", " » ", " › ", " · ", " • ")
SEPARATOR_EVERY = 60          # characters; two separators are needed in any case
MENU_WORDS = ("home", "menu", "next", "previous", "login", "log in", "sign in", "sign up", "search", "back to top", "read more")
BOILERPLATE = (r"all rights reserved|privacy policy|cookie policy|uses cookies|terms of (use|service)|"
               r"(licensed|released) under|enable javascript|subscribe to our|powered by|copyright (©|\(c\))")
BOILERPLATE_CHARS = 200       # only lines up to this length
MAX_LOSS_PERCENT = 50
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def n_characters(text: Column) -> Column:
    """Code points that are not white space."""
    return F.length(without(text, SPACES))


def fails_punctuation(line: Column, solid: Column, marks: Column) -> Column:
    """``solid``: characters that are not white space; ``marks``: punctuation."""
    dense = (marks >= FEW_MARKS) & (100 * marks.cast("long") > MAX_PUNCTUATION_PERCENT * solid.cast("long"))
    return dense | ~line.rlike(SENTENCE_END)


def fails_navigation(line: Column) -> Column:
    shorter = [(F.length(line) - F.length(F.replace(line, F.lit(s), F.lit("")))) for s in SEPARATORS]
    total = sum(shorter[1:], shorter[0]) / len(SEPARATORS[0])
    bare = F.trim(line)
    short = F.length(bare) <= max(map(len, MENU_WORDS))
    menu = short & F.translate(bare, _UPPER, _LOWER).isin(*MENU_WORDS)
    return ((total >= 2) & (total * SEPARATOR_EVERY >= F.length(line))) | menu


def fails_boilerplate(line: Column) -> Column:
    return (F.length(line) <= BOILERPLATE_CHARS) & F.translate(line, _UPPER, _LOWER).rlike(BOILERPLATE)


def fails(line: Column, solid: Column, marks: Column) -> Column:
    return fails_navigation(line) | fails_boilerplate(line) | fails_punctuation(line, solid, marks)


def measured_lines(text: Column) -> Column:
    """Lines with a word, as (line, solid, marks).  The characters are taken out
    of the whole text and what is left is cut into the same lines: that stays in
    generated code, where a translation per line would not."""
    blanks = SPACES.replace("\n", "")
    solid = F.split(without(text, blanks), "\n")
    bare = F.split(without(text, blanks + PUNCTUATION), "\n")
    counts = F.zip_with(solid, bare, lambda s, b: F.struct(F.length(s).alias("solid"), (F.length(s) - F.length(b)).alias("marks")))
    lines = F.zip_with(F.split(text, "\n"), counts, lambda x, c: F.struct(
        x.alias("line"), c["solid"].alias("solid"), c["marks"].alias("marks")))
    return F.filter(lines, lambda x: x["solid"] > 0)


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, clean_text (the lines that pass, joined
    by newlines), the counts, base_failed and kept.

    NULL counts as the empty text: all counts 0, base_failed.  Lines without a
    word are neither tested nor kept nor counted.  Texts of any length are
    judged whole; repeated rows and ids keep a row each.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Each select builds on columns of the one before, so that no array is
    # computed twice, and carries on no more than the next ones need.
    counts = ["id", "n_symbols"]
    step = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    step = step.select(
        "id", (F.length("text") - F.length(without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        F.transform(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)), lambda w: F.xxhash64(w)).alias("words"),
        measured_lines(F.col("text")).alias("lines"))
    windows = F.when(F.size("words") >= WINDOW, F.transform(
        F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW))))
    step = step.select(
        *counts, F.size("words").cast("long").alias("n_words"), windows.alias("windows"),
        F.aggregate("lines", F.lit(0), lambda n, x: n + x["solid"]).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct(F.transform("lines", lambda x: x["line"])))).cast("long").alias("n_dup_lines"),
        F.transform("lines", lambda x: F.struct(
            x["line"].alias("line"), x["solid"].alias("solid"), fails(x["line"], x["solid"], x["marks"]).alias("fails"))).alias("tested"))
    # Most lines pass, so the loss is counted on those that do not.
    counts += ["n_words", "word_chars", "n_dup_lines"]
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    step = step.select(
        *counts, F.array_join(F.transform(F.filter("tested", lambda x: ~x["fails"]), lambda x: x["line"]), "\n").alias("clean_text"),
        F.aggregate(F.filter("tested", lambda x: x["fails"]), F.lit(0), lambda n, x: n + x["solid"]).cast("long").alias("lost_chars"),
        F.when(repeats, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))).alias("placed"))
    counts += ["clean_text", "lost_chars"]

    def equal(x: Column, at: Column) -> Column:
        return F.coalesce(F.get("placed", at)["h"] == x["h"], F.lit(False))

    same = F.filter("placed", lambda x, k: equal(x, k - 1) | equal(x, k + 1))
    covered = F.aggregate(
        F.array_sort(F.transform(same, lambda x: x["p"])), F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    step = step.select(*counts, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    loses = 100 * F.col("lost_chars") > MAX_LOSS_PERCENT * F.col("word_chars")
    return step.select(F.col("id").alias(id_col), "clean_text", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                       "n_repeat_words", base_failed.alias("base_failed"), (~base_failed & ~loses).alias("kept"))
