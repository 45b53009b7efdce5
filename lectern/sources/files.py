"""Whole-file scan (S1) and format routing (S2, P9 dispatch)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import html as H
from lectern.functions import text as T
from lectern.operators import layout as L
from lectern.operators import segment as S

# Lower-cased file suffix -> extractor route.
ROUTES = {
    ".pdf": "pdf",
    ".docx": "docx", ".doc": "docx",
    ".html": "html", ".htm": "html",
    ".txt": "text", ".md": "text", ".csv": "text", ".json": "text", ".xml": "text",
    ".xlsx": "not implemented", ".xls": "not implemented",
    ".pptx": "not implemented", ".ppt": "not implemented",
    ".rtf": "rtf",
}
# Routes with an extractor in this package; the others go to quarantine.
BUILT_ROUTES = ("text", "html", "pdf")


def read_text_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """One row per file, content decoded as UTF-8 with invalid bytes
    replaced by U+FFFD.  Columns: ``path``, ``length``, ``text``."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)
    return files.select("path", "length", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def suffix(name: Column) -> Column:
    """Lower-cased suffix of the last path component (``''`` when none;
    a leading dot alone is not a suffix)."""
    base = F.element_at(F.split(name, "/", -1), -1)
    return F.lower(F.regexp_extract(base, r"^.+(\.[^./]+)$", 1))


def route(name: Column) -> Column:
    """Extractor route for a file name, or ``unsupported``."""
    ext = suffix(name)
    expr = None
    for e, r in ROUTES.items():
        expr = F.when(ext == e, r) if expr is None else expr.when(ext == e, r)
    return expr.otherwise("unsupported")


def split_routes(uploads: DataFrame, name_col: str = "file_name") -> tuple[DataFrame, DataFrame]:
    """(routable rows with ``route``, quarantine rows with ``reason``)."""
    routed = uploads.withColumn("route", route(F.col(name_col)))
    ok = routed.filter(F.col("route").isin(*BUILT_ROUTES))
    bad = routed.filter(~F.col("route").isin(*BUILT_ROUTES)).withColumn(
        "reason", F.when(F.col("route") == "unsupported", F.concat(F.lit("unsupported file type: "),
                                                                   F.col(name_col)))
        .otherwise(F.concat(F.lit("no extractor for route "), F.col("route"))))
    return ok, bad


def extract_paragraphs(uploads: DataFrame, ocr: Callable[[DataFrame], DataFrame] | None = None, min_length: int = 100,
                       key: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """P9 over a mixed upload set: route, extract, one-line (P2), clean.

    ``uploads``: key columns, ``file_name``, ``content`` (text or HTML).
    ``ocr`` gives the layout blocks, keyed by the same columns, of the PDF
    uploads it is handed.  Returns (paragraphs in long form, rejected uploads
    with a reason).
    """
    key = key or ["user_id", "submission_id"]
    ok, bad = split_routes(uploads)
    # Text and HTML in one pass over the uploads: the route picks the list.
    lists = F.when(F.col("route") == "text", S.text_paragraph_list("content", min_length)).when(
        F.col("route") == "html", S.clean_min_length(S.one_line(H.paragraph_texts("content")), min_length))
    out = ok.filter(F.col("route") != "pdf").select(*key, F.posexplode(lists).alias("paragraph_number", "text"))
    pdf = ok.filter(F.col("route") == "pdf")
    if ocr is None:
        bad = bad.unionByName(pdf.withColumn("reason", F.lit("no layout blocks for pdf")))
    else:
        stitched = L.stitch_pages(L.body_blocks(L.flatten_layout(ocr(pdf), key)), key)
        cleaned = stitched.withColumn("text", T.clean_paragraph(T.collapse_newlines("text"))).filter(F.length("text") >= min_length)
        number = F.row_number().over(Window.partitionBy(*key).orderBy("paragraph_number")) - 1
        out = out.unionByName(cleaned.select(*key, number.alias("paragraph_number"), "text"))
    return out, bad.drop("content")
