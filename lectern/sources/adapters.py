"""Adapters: shape the driver tables into the inputs the operators take.

Each adapter only reshapes rows (it does none of an operator's work) and
has a SQL twin in ``lectern.plans.oracle`` with the same definition.

* ``documents``           the documents table (optionally one language)
* ``paragraph_lists``     one row per document (user_id=source, submission_id=doc_id) with
                          its lines through P3 (clean, min length), numbered from 0
* ``doc_paragraphs``      the same, a row per paragraph
* ``conv_turns``          conversation turns in order: a text per conversation is its
                          turns joined by blank lines, so each turn can be split on its own
* ``quality_ids``         documents labelled ``quality = 1`` (lexicon source)
* ``layout_blocks``       OCR layout tree: words in blocks of 12, three blocks a page
* ``pages``               web pages (page_id, url, html)
* ``uploads`` / ``upload_blocks``  documents and pages as files with names and content
* ``upload_requests``     registration requests (user, file name, content hash, time)
* ``stage_rows``          events as stage reports (bit, failed)
* ``notification_messages``  events as queue messages (topic envelopes, puts, others)
* ``dictionary_entries``  parts as dictionary responses (list or error object)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.sources.tables import read_table


def documents(spark: SparkSession, sf_dir: str, lang: str | None = None) -> DataFrame:
    df = read_table(spark, sf_dir, "documents", "doc_id", "source", "lang", "text")
    return df.filter(F.col("lang") == lang) if lang else df


def _clean_lines(min_length: int):
    """Lines of ``text`` through P3 (clean, min length); NULL texts have none."""
    cleaned = F.transform(F.split("text", "\n", -1), lambda x: T.clean_paragraph(x))
    return F.coalesce(F.filter(cleaned, lambda x: F.length(x) >= min_length), F.array().cast("array<string>"))


def paragraph_lists(docs: DataFrame, min_length: int = 100) -> DataFrame:
    """Lines cleaned by P3 and renumbered within the document, as
    ``paragraphs`` ARRAY<STRUCT<paragraph_number, text>> on the document's row."""
    numbered = F.transform(_clean_lines(min_length), lambda x, i: F.struct(i.alias("paragraph_number"), x.alias("text")))
    return docs.select(F.col("source").alias("user_id"), F.col("doc_id").alias("submission_id"), "lang", numbered.alias("paragraphs"))


def long_form(lists: DataFrame) -> DataFrame:
    """Stored ``paragraph_lists`` as one row per paragraph."""
    return lists.select("user_id", "submission_id", "lang", F.explode("paragraphs").alias("p")).select(
        "user_id", "submission_id", "lang", "p.paragraph_number", "p.text")


def doc_paragraphs(docs: DataFrame, min_length: int = 100) -> DataFrame:
    """``paragraph_lists`` as one row per paragraph.  The lines are cleaned inside
    the generator: of a column that it explodes, Spark would also filter the
    size, below the projection, and so clean every text twice."""
    return docs.select(F.col("source").alias("user_id"), F.col("doc_id").alias("submission_id"), "lang",
                       F.posexplode(_clean_lines(min_length)).alias("paragraph_number", "text"))


def joined_paragraphs(docs: DataFrame, min_length: int = 100) -> DataFrame:
    """The ``doc_paragraphs`` of a document as one ``text``, a sentence mark between two."""
    return docs.select(F.col("source").alias("user_id"), F.col("doc_id").alias("submission_id"), "lang",
                       F.array_join(_clean_lines(min_length), T.SENTENCE_MARK).alias("text"))


def quality_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of documents labelled ``quality = 1`` (the lexicon's sources)."""
    return read_table(spark, sf_dir, "labels", "doc_id", "quality").filter(F.col("quality") == 1).select("doc_id")


MAX_UPLOAD_BYTES = 100 * 1024 * 1024


def conv_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(submission_id, turn, text): the pieces of one text per conversation."""
    conv = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    return conv.select(F.col("conv_id").alias("submission_id"), "turn", "text")


WORDS_PER_BLOCK = 12
BLOCKS_PER_PAGE = 3


def layout_blocks(docs: DataFrame, *keys) -> DataFrame:
    """Flat OCR layout tree built from the ``text`` of ``docs``, keyed by ``keys``
    (``doc_id`` by default).

    The words of each document are laid out in blocks of 12, three blocks
    to a page.  Each page is a container node ``path=[page]`` of type
    ``page`` whose children ``path=[page, block]`` are ``paragraph`` nodes
    with ``page_start = page_end = page``.
    """
    # The word array is a column of its own: a lambda that referenced the
    # split expression would re-split the text for every block.
    keys = list(keys) or ["doc_id"]
    docs = docs.select(*keys, F.split(T.strip_ws("text"), r"(?U)\s+", -1).alias("words"))
    words = F.col("words")
    n_blocks = F.ceil(F.size(words) / WORDS_PER_BLOCK).cast("int")
    texts = F.transform(F.sequence(F.lit(0), F.greatest(n_blocks - 1, F.lit(0))),
                        lambda i: F.array_join(F.slice(words, i * WORDS_PER_BLOCK + 1, WORDS_PER_BLOCK), " "))
    page = lambda block: (block / BLOCKS_PER_PAGE).cast("int")
    paragraphs = F.transform(texts, lambda t, i: F.struct(
        F.array(page(i), i).alias("path"), F.lit("paragraph").alias("type"), t.alias("text"), page(i).alias("page")))
    n_pages = F.ceil(n_blocks / BLOCKS_PER_PAGE).cast("int")
    containers = F.transform(F.sequence(F.lit(0), F.greatest(n_pages - 1, F.lit(0))), lambda i: F.struct(
        F.array(i).alias("path"), F.lit("page").alias("type"), F.lit("").alias("text"), i.alias("page")))
    nodes = docs.select(*keys, F.explode(F.concat(paragraphs, containers)).alias("n"))
    return nodes.select(*keys, "n.path", "n.type", "n.text", F.col("n.page").alias("page_start"), F.col("n.page").alias("page_end"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages", "page_id", "url", "html")


def blog_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages with their article as a ``div`` of several classes, behind an
    attribute without quotes, as publishing systems write it."""
    div = F.replace(F.col("html"), F.lit("<article>"), F.lit('<div data-kind=post class="post entry-content wide">'))
    return pages(spark, sf_dir).withColumn("html", F.replace(div, F.lit("</article>"), F.lit("</div>")))


# --------------------------------------------------------------------------
# Upload-side stand-ins built from documents / pages / events / part
# --------------------------------------------------------------------------

# Fixed values of the stand-in upload names: documents are given these
# extensions in turn (by doc_id), pages are HTML files.  Where content is
# extracted, only extensions with an extractor are handed out.
READABLE_EXTENSIONS = [".txt", ".md", ".pdf", ".csv"]
DOC_EXTENSIONS = [".txt", ".md", ".pdf", ".docx", ".rtf", ".csv", ".png", ".xlsx"]
EXTENSION_MIME = {
    ".txt": "text/plain", ".md": "text/markdown", ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".rtf": "application/rtf", ".csv": "text/csv", ".png": "image/png",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".html": "text/html",
}
EPOCH_BASE = 1_700_000_000   # created_at of doc 0; one minute per doc_id
MISSING_NAME_EVERY = 50      # every 50th document is registered without a file name


def _doc_ext(doc_id, extensions: list[str] = DOC_EXTENSIONS) -> F.Column:
    exts = F.array(*[F.lit(e) for e in extensions])
    return F.element_at(exts, (F.pmod(doc_id, F.lit(len(extensions))) + 1).cast("int"))


def uploads(spark: SparkSession, sf_dir: str, extensions: list[str] = DOC_EXTENSIONS) -> DataFrame:
    """Mixed upload set: documents as files with assorted extensions
    (content = text), pages as ``.html`` files (content = html)."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "source", "text")
    pg = read_table(spark, sf_dir, "pages", "page_id", "html")
    d = docs.select(F.col("source").alias("user_id"), F.col("doc_id").cast("string").alias("submission_id"),
                    F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), _doc_ext(F.col("doc_id"), extensions))
                    .alias("file_name"), F.col("text").alias("content"))
    p = pg.select(F.lit("web").alias("user_id"), F.concat(F.lit("p"), F.col("page_id").cast("string"))
                  .alias("submission_id"),
                  F.concat(F.lit("page_"), F.col("page_id").cast("string"), F.lit(".html")).alias("file_name"),
                  F.col("html").alias("content"))
    return d.unionByName(p)


def ocr(uploads: DataFrame) -> DataFrame:
    """The layout blocks of uploads whose content is text, keyed like them."""
    return layout_blocks(uploads.select("user_id", "submission_id", F.col("content").alias("text")), "user_id", "submission_id")


def mime_type(ext) -> F.Column:
    expr = None
    for e, m in EXTENSION_MIME.items():
        expr = F.when(ext == e, m) if expr is None else expr.when(ext == e, m)
    return expr.otherwise("application/octet-stream")


def upload_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registration requests: one per document (user=source, hash of the text)."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "source", "text")
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), _doc_ext(F.col("doc_id")))
    return docs.select(
        "doc_id", F.col("source").alias("user_id"),
        F.when(F.col("doc_id") % MISSING_NAME_EVERY != MISSING_NAME_EVERY - 1, name).alias("file_name"),
        F.sha2("text", 256).alias("file_hash"),
        (F.lit(EPOCH_BASE) + F.col("doc_id") * 60).cast("bigint").alias("requested_at"),
        F.col("doc_id").alias("seq"))


# Fixed values of the stage stand-in: event types mapped to stage bits.
EVENT_STAGE_BITS = {"signup": 0, "view": 1, "click": 2, "purchase": 4}


def stage_rows(ev: DataFrame) -> DataFrame:
    """Stage completions from events: (user_id, event_id, ts, bit, failed).
    Works on batch and streaming DataFrames alike."""
    bit = None
    for t, b in EVENT_STAGE_BITS.items():
        bit = F.when(F.col("event_type") == t, b) if bit is None else bit.when(F.col("event_type") == t, b)
    return ev.select("user_id", "event_id", "ts", bit.alias("bit"),
                     (F.col("event_type") == "error").alias("failed"))


def day_stage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage reports of one submission per (user, day): a user's events of a
    day are the reports on what was submitted that day, each stage reported
    at most once (``submission_id`` is the day)."""
    rows = stage_events(spark, sf_dir).withColumn("submission_id", F.to_date("ts").cast("string"))
    return rows.dropDuplicates(["user_id", "submission_id", "bit", "failed"])


def word_mark_events(spark: SparkSession, sf_dir: str, vocabulary: DataFrame) -> DataFrame:
    """Marks that readers set, from ``events``: an event marks one word of the
    document that has its user's number; the event's number picks the word (by
    rank) and the mark."""
    from lectern.operators.product import WORD_MARKS
    marks = F.element_at(F.array(*[F.lit(m) for m in WORD_MARKS]), (F.col("event_id") % len(WORD_MARKS) + 1).cast("int"))
    ev = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id").select(
        F.col("user_id").alias("submission_id"), (F.col("event_id") % 5 + 1).cast("int").alias("rank"), marks.alias("mark"), "ts")
    # No event names a later rank, so the rest of the vocabulary need not meet the events.
    first = vocabulary.filter(F.col("rank") <= 5)
    return first.join(ev, ["submission_id", "rank"]).select("user_id", "word", "mark", "ts")


def rename_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rename requests from ``events``: a ``view`` renames the document that has
    its number."""
    ev = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type").filter("event_type = 'view'")
    docs = read_table(spark, sf_dir, "documents", "doc_id", "source", "text")
    named = ev.select(F.col("user_id").alias("doc_id"), "ts", F.concat(F.lit("renamed_"), F.col("event_id").cast("string"), F.lit(".txt")).alias("filename"))
    return named.join(docs, "doc_id").select(
        F.col("source").alias("user_id"), F.sha2("text", 256).alias("submission_id"), "filename", "ts")


def stage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage_rows(read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type"))


def notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notification_messages(read_table(spark, sf_dir, "events", "event_id", "user_id", "event_type"))


def notification_messages(ev: DataFrame) -> DataFrame:
    """Queue messages from ``events`` (batch or stream): clicks and errors are object puts,
    everything else another event; messages of even ``event_id`` come wrapped in a
    topic envelope, and a wrapped ``signup`` carries an unparsable message;
    ``error`` events point at a key outside the upload layout."""
    key = F.when(F.col("event_type") == "error", F.concat(F.lit("incoming/"), F.col("event_id").cast("string"))) \
        .otherwise(F.concat(F.lit("uploads/u"), F.col("user_id").cast("string"), F.lit("/"),
                            F.sha2(F.col("event_id").cast("string"), 256), F.lit(".txt")))
    put = F.col("event_type").isin("click", "error")
    name = F.when(put, F.lit("ObjectCreated:Put")).otherwise(F.lit("ObjectRemoved:Delete"))
    record = F.struct(name.alias("eventName"), F.struct(
        F.struct(F.lit("uploads-bucket").alias("name")).alias("bucket"),
        F.struct(key.alias("key")).alias("object")).alias("s3"))
    inner = F.to_json(F.struct(F.array(record).alias("Records")))
    wrapped_msg = F.when(F.col("event_type") == "signup", F.lit("not json")).otherwise(inner)
    envelope = F.to_json(F.struct(F.lit("Notification").alias("Type"),
                                  F.lit("arn:topic:paragraphs").alias("TopicArn"), wrapped_msg.alias("Message")))
    body = F.when(F.col("event_id") % 2 == 0, envelope).otherwise(inner)
    return ev.select("event_id", body.alias("body"))


def dictionary_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary responses built from ``part``: the part name is the
    headword, its type the part of speech; parts of size above 45 answer
    with a non-list error object."""
    part = read_table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type", "p_size")
    entry = F.array(F.struct(F.array(F.struct(
        F.lower("p_type").alias("partOfSpeech"),
        F.array(F.struct(F.concat(F.lit("A "), F.col("p_name"), F.lit(".")).alias("definition")),
                F.struct(F.lit("").alias("definition")),
                F.struct(F.concat(F.lit("Kind of "), F.get(F.split("p_name", " "), 1), F.lit(".")).alias("definition")))
        .alias("definitions"))).alias("meanings")))
    body = F.when(F.col("p_size") > 45, F.to_json(F.struct(F.lit("No Definitions Found").alias("title")))) \
        .otherwise(F.to_json(entry))
    return part.select(F.col("p_partkey").alias("word_id"), F.col("p_name").alias("word"), body.alias("entry_json"))
