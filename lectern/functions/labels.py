"""Scalar display rules (D7, D10-D13) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.operators.keyed import STATE_COMPLETE

# Fixed values.
SIZE_UNITS = ["Bytes", "KB", "MB", "GB"]
SIZE_BASE = 1024
UI_ACCEPTED_EXTENSIONS = [".txt", ".pdf", ".jpg", ".jpeg", ".png", ".docx", ".doc", ".rtf",
                          ".html", ".htm", ".md"]
# MIME substring rules, tried in order.
MIME_RULES = [("pdf", ["pdf"]), ("image", ["image"]), ("text", ["text", "html", "md"]),
              ("document", ["word", "document"])]
DEFAULT_NAME = "Unnamed Document"


def status_label(state: Column) -> Column:
    """0 received, below complete processing, complete, above: the digits;
    missing: ``Invalid state``."""
    return (F.when(state.isNull(), "Invalid state")
            .when(state == 0, "received")
            .when(state < STATE_COMPLETE, "processing")
            .when(state == STATE_COMPLETE, "complete")
            .otherwise(state.cast("string")))


def created_date(created_at: Column) -> Column:
    """Epoch seconds rendered as a calendar date (UTC)."""
    return F.to_date(F.timestamp_seconds(created_at))


def file_size(nbytes: Column) -> Column:
    """Base-1024 size, two decimals, trailing zeros dropped (``1.5 KB``)."""
    i = F.floor(F.log(nbytes.cast("double")) / F.log(F.lit(float(SIZE_BASE)))).cast("int")
    i = F.least(i, F.lit(len(SIZE_UNITS) - 1))
    value = F.round(nbytes / F.pow(F.lit(float(SIZE_BASE)), i), 2)
    number = F.regexp_replace(value.cast("string"), r"\.0$", "")
    unit = F.element_at(F.array(*[F.lit(u) for u in SIZE_UNITS]), i + 1)
    return F.when(nbytes == 0, "0 Bytes").otherwise(F.concat(number, F.lit(" "), unit))


def mime_class(mime: Column) -> Column:
    """First matching substring rule, else ``other``."""
    expr = None
    for label, needles in MIME_RULES:
        cond = None
        for n in needles:
            c = mime.contains(n)
            cond = c if cond is None else (cond | c)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise("other")


def ui_extension(file_name: Column) -> Column:
    """The upload form's extension: text after the last dot (the whole name
    when there is none), lower-cased, with a leading dot."""
    return F.concat(F.lit("."), F.lower(F.element_at(F.split(file_name, r"\.", -1), -1)))


def ui_accepts(file_name: Column) -> Column:
    """The upload form's accepted-type check."""
    return F.array_contains(F.array(*[F.lit(e) for e in UI_ACCEPTED_EXTENSIONS]), ui_extension(file_name))
