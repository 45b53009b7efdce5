"""Column expressions for text cleaning and tokenising.

All helpers return ``Column`` objects built from Spark built-ins, so they
stay inside whole-stage codegen.  Java regexes need ``(?U)`` to give
``\\s`` and ``\\w`` the Unicode meaning Python's ``re`` uses by default.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values the results depend on.
# Letters kept by the tokeniser: ASCII letters plus the Latin-1 range
# U+00C0..U+00FF (which also contains the two symbols U+00D7 and U+00F7).
LETTER_RUN = "[a-zA-ZÀ-ÿ]+"
# The two non-word characters inside that range, removed on normalising.
NON_WORD_IN_LETTERS = "×÷"
# Upper-case letters inside the range, as (first, first after) code points.
UPPER_INITIAL = [("A", "["), ("À", "×"), ("Ø", "ß")]
# Sentence end: terminal punctuation followed by whitespace.
SENTENCE_END = "(?U)(?<=[.!?])\\s+"
SENTENCE_MARK = "\u0001"
# The characters with Unicode's White_Space property, which ``(?U)\\s`` matches.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_ws(col: Column | str) -> Column:
    """Python ``str.strip()``: drop leading/trailing Unicode whitespace.  Looks at
    the ends only, where a pattern would try every space inside."""
    return F.btrim(_c(col), F.lit(WHITE_SPACE))


def collapse_ws(col: Column | str) -> Column:
    """Every whitespace run becomes one space (a single space, the usual run, is
    no match: most texts stay as they are)."""
    return F.regexp_replace(_c(col), r"(?U) \s+|[^\S ]\s*", " ")


def collapse_newlines(col: Column | str) -> Column:
    """Runs of CR/LF become one space."""
    return F.regexp_replace(_c(col), r"[\n\r]+", " ")


def clean_paragraph(col: Column | str) -> Column:
    """P3 cleaning: whitespace runs to one space, then strip."""
    return F.trim(collapse_ws(col))


def intro_words(col: Column | str, n: int = 10) -> Column:
    """M7: the first ``n`` whitespace-separated words joined by one space."""
    words = F.split(strip_ws(col), r"(?U)\s+", -1)
    return F.array_join(F.slice(words, 1, n), " ")


ABBREVIATION_GUARD = "\u0003"


def sentences(col: Column | str, abbreviations: list[str] | None = None) -> Column:
    """V1: rule-based sentence split (``.``, ``!``, ``?`` followed by whitespace).

    ``abbreviations`` (e.g. ``["Mr", "Dr", "e.g"]``, matched case-insensitively
    as whole words) do not end a sentence: the whitespace after such a dot
    is guarded before splitting and restored afterwards.
    """
    text = _c(col)
    if abbreviations:
        alternatives = "|".join(re.escape(a.rstrip(".")) for a in abbreviations)
        text = F.regexp_replace(text, rf"(?iU)\b({alternatives})\.(\s+)", "$1." + ABBREVIATION_GUARD + "$2")
    marked = F.regexp_replace(text, SENTENCE_END, SENTENCE_MARK)
    parts = F.split(marked, SENTENCE_MARK, -1)
    if abbreviations:
        parts = F.transform(parts, lambda x: F.replace(x, F.lit(ABBREVIATION_GUARD), F.lit("")))
    return parts


# The Penn Treebank contraction splits that change letter
# runs (apostrophes already separate tokens here), as (pattern, replacement).
TREEBANK_CONTRACTIONS = [
    (r"(?i)\b(can)(not)\b", "$1 $2"),
    (r"(?i)\b(d)('ye)\b", "$1 $2"),
    (r"(?i)\b(gim)(me)\b", "$1 $2"),
    (r"(?i)\b(gon)(na)\b", "$1 $2"),
    (r"(?i)\b(got)(ta)\b", "$1 $2"),
    (r"(?i)\b(lem)(me)\b", "$1 $2"),
    (r"(?i)\b(more)('n)\b", "$1 $2"),
    (r"(?i)\b(wan)(na)(\s)", "$1 $2$3"),
    (r"(?i)([^'\s])(n't)\b", "$1 $2"),
]


def split_contractions(col: Column | str) -> Column:
    """Treebank-style contraction splitting (``can't`` -> ``ca n't``)."""
    out = _c(col)
    for pattern, replacement in TREEBANK_CONTRACTIONS:
        out = F.regexp_replace(out, pattern, replacement)
    return out


def letter_tokens(col: Column | str, contractions: bool = False) -> Column:
    """V2+V3: maximal runs of letters; every other character separates tokens.
    With ``contractions`` the Treebank splits are applied first."""
    text = split_contractions(col) if contractions else _c(col)
    return F.regexp_extract_all(text, F.lit(LETTER_RUN), 0)


# Characters outside the letters whose lower case has a letter in it.
BECOME_LETTERS = "\u0130\u0178\u1e9e\u212a\u212b"


def normalised_tokens(col: Column | str) -> Column:
    """V2, V3 and V5 on a whole text, the words that are left empty dropped: the
    text is made lower case once, not each of its tokens.  Signs that V5 removes
    are removed before; what would become a letter separates tokens."""
    text = _c(col)
    for sign in BECOME_LETTERS:
        text = F.replace(text, F.lit(sign), F.lit(" "))
    for sign in NON_WORD_IN_LETTERS:
        text = F.replace(text, F.lit(sign), F.lit(""))
    return F.regexp_extract_all(F.lower(text), F.lit(LETTER_RUN), 0)


# The first token of a sentence with the mark before it; or any other token that is capitalised.
_UPPER = "A-ZÀ-ÖØ-Þ"
FIRST_OR_PROPER = (f"({SENTENCE_MARK}[^a-zA-ZÀ-ÿ{SENTENCE_MARK}]*+{LETTER_RUN})"
                   f"|[{_UPPER}](?<![a-zA-ZÀ-ÿ][{_UPPER}])[a-zA-ZÀ-ÿ]*+")


def without_proper(col: Column | str) -> Column:
    """V4 on a text: proper nouns (capitalised and not the first token of a sentence)
    are cut out, and nothing has to be asked of each token.  ``SENTENCE_MARK``
    between texts that are joined keeps their sentences apart."""
    marked = F.concat(F.lit(SENTENCE_MARK), F.regexp_replace(_c(col), SENTENCE_END, SENTENCE_MARK))
    return F.regexp_replace(marked, FIRST_OR_PROPER, "$1")


def normalise_token(col: Column | str) -> Column:
    """V5: remove non-word characters and lower-case.  Runs once or more for every
    token of a corpus: byte searches, where ``translate`` looks up each letter."""
    word = _c(col)
    for sign in NON_WORD_IN_LETTERS:
        word = F.replace(word, F.lit(sign), F.lit(""))
    return F.lower(word)


def is_capitalised(col: Column | str) -> Column:
    """Whether the first character is an upper-case letter: strings compare by
    code points, so ranges of them tell it without a pattern."""
    token, expr = _c(col), F.lit(False)
    for first, after in UPPER_INITIAL:
        expr = expr | (token >= first) & (token < after)
    return expr


def ordered_join(col: str, sep: str, *order: str) -> Column:
    """``listagg(col, sep) WITHIN GROUP (ORDER BY order...)`` (NULLs skipped)."""
    keys = ", ".join(f"`{o}`" for o in order)
    escaped = sep.replace("\\", "\\\\").replace("'", "\\'")
    return F.expr(f"listagg(`{col}`, '{escaped}') WITHIN GROUP (ORDER BY {keys})")
