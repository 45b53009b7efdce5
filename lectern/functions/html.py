"""Column expressions for HTML paragraph extraction (P4, P5; S10 is in
``pagetree``).

Regex-based, no DOM: markup that never holds paragraph text (scripts,
styles, comments) is removed first, then ``<p>`` openings and block
boundaries are marked with control characters and the text between an
opening and the next boundary is one paragraph.  This is the HTML
reading of an unclosed ``<p>``: it ends at the next ``<p>``, at ``</p>``,
or at the start/end of a block-level element.

A tag starts with a letter, ``/`` and a letter, ``!`` or ``?`` right after
``<``, and ends at the first ``>`` outside a quoted attribute value; any
other ``<`` is text.
"""

from __future__ import annotations

import html.entities
import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

P_OPEN_MARK = "\u0001"
BOUNDARY_MARK = "\u0002"

# What may stand between a tag's name and its end; possessive, so that a tag
# that never ends costs one pass.
_REST = r"""(?:=\s*+(?:"[^"]*+"|'[^']*+')|[^>])*+"""
# Markup removed before extraction.
INVISIBLE = (rf"(?is)<script(?:[\s/]{_REST})?>.*?</script\s*>|<style(?:[\s/]{_REST})?>.*?</style\s*>|<!--.*?-->")
# Tags that end an open paragraph.
BLOCK_TAGS = ("address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl",
              "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header",
              "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "pre", "search", "section", "summary", "table",
              "td", "th", "tr", "ul")
P_OPEN = rf"(?i)<p(?:[\s/]{_REST})?>"
BOUNDARY = rf"(?i)</p\s*>|</?(?:{'|'.join(BLOCK_TAGS)})(?:[\s/]{_REST})?>"
TAG = rf"<(?:/?[a-zA-Z]|[!?]){_REST}>"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def visible(html: Column | str) -> Column:
    return F.regexp_replace(_c(html), INVISIBLE, "")


# Character references: decimal, hexadecimal or named.  The names are those of
# the HTML standard, taken from Python's library; the few that may stand
# without a semicolon are also found before other letters.
_BARE = sorted((n for n in html.entities.html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
REFERENCE = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]*;|" + "|".join(map(re.escape, _BARE)) + ")"
REPLACEMENT_CHAR = "\ufffd"
# References to U+0080..U+009F name windows-1252 characters (HTML rule);
# bytes that code page leaves undefined stand for themselves.
C1_AS_CP1252 = [bytes([b]).decode("cp1252", errors="ignore") or chr(b) for b in range(0x80, 0xA0)]


def _char_of(cp: Column) -> Column:
    utf32 = F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32")
    c1 = F.element_at(F.array(*[F.lit(c) for c in C1_AS_CP1252]), (cp - 0x7F).cast("int"))
    invalid = cp.isNull() | (cp == 0) | cp.between(0xD800, 0xDFFF) | (cp > 0x10FFFF)
    return F.when(invalid, F.lit(REPLACEMENT_CHAR)).when(cp.between(0x80, 0x9F), c1).otherwise(utf32)


def _named(name: Column) -> Column:
    """Text of a named reference, itself (with ``&``) if there is none."""
    table = F.from_json(F.lit(json.dumps(html.entities.html5)), "map<string,string>")
    return F.coalesce(F.try_element_at(table, name), F.concat(F.lit("&"), name))


def _reference(ref: Column) -> Column:
    body = F.rtrim(ref, F.lit(";"))
    hexadecimal = F.lower(F.substring(body, 2, 1)) == "x"
    digits = F.when(hexadecimal, F.substring(body, 3, 12)).otherwise(F.substring(body, 2, 12))
    cp = F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(digits).try_cast("long")
    return F.when(ref.startswith("#"), _char_of(cp)).otherwise(_named(ref))


def decode_entities(col: Column) -> Column:
    """Every character reference replaced once, in one pass, so that
    ``&amp;lt;`` and ``&#38;lt;`` both give ``&lt;``.  The text is split at the
    references and joined again; texts without ``&`` are left alone."""
    pieces = F.split(col, REFERENCE, -1)
    refs = F.regexp_extract_all(col, F.lit(REFERENCE), 1)
    chars = F.concat(F.transform(refs, _reference), F.array(F.lit("")))
    joined = F.array_join(F.zip_with(pieces, chars, lambda p, c: F.concat(p, c)), "")
    return F.when(col.contains("&"), joined).otherwise(col)


def paragraph_fragments(html: Column) -> Column:
    """Inner HTML of every ``<p>`` in document order (markup kept)."""
    marked = F.regexp_replace(F.regexp_replace(html, BOUNDARY, BOUNDARY_MARK), P_OPEN, P_OPEN_MARK)
    pieces = F.split(marked, P_OPEN_MARK, -1)
    after_first = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
    return F.transform(after_first, lambda x: F.substring_index(x, BOUNDARY_MARK, 1))


def plain_text(inner_html: Column) -> Column:
    """Tags removed, references decoded, unstripped."""
    return decode_entities(F.regexp_replace(inner_html, TAG, ""))


def paragraph_texts(html: Column | str) -> Column:
    """Full text of every ``<p>`` (tags removed, references decoded, unstripped)."""
    return F.transform(paragraph_fragments(visible(html)), plain_text)


def stripped_paragraph_texts(inner_html: Column) -> Column:
    """P5: each text node stripped, nodes concatenated without separator,
    empty paragraphs dropped."""
    from lectern.functions.text import strip_ws
    frags = paragraph_fragments(inner_html)
    texts = F.transform(frags, lambda x: F.array_join(
        F.transform(F.split(x, TAG, -1), lambda n: strip_ws(decode_entities(n))), ""))
    return F.filter(texts, lambda x: x != "")
