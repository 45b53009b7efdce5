"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Every query reads the driver tables (or data Spark derives from them)
in full.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import html as H
from lectern.functions import labels as LB
from lectern.functions import pagetree as PT
from lectern.functions import text as T
from lectern.operators import guide as G
from lectern.operators import keyed as K
from lectern.operators import layout as L
from lectern.operators import product as Z
from lectern.operators import segment as S
from lectern.operators import summaries as M
from lectern.operators import vocabulary as V
from lectern.operators.joins import materialise, split_repeated
from lectern.plans import guide as PG
from lectern.plans import learned as PL
from lectern.plans import live as PV
from lectern.session import ensure_checkpoint_dir
from lectern.sources import adapters as A
from lectern.sources import files as FS
from lectern.sources import notifications as N
from lectern.sources import uploads as U
from lectern.sources.tables import read_table
from lectern.streaming import uploads as ST

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary_report(spark: SparkSession, sf_dir: str, lang: str | None = None,
                      threshold: float = V.DEFAULT_THRESHOLD) -> DataFrame:
    """Flagship: per document, its uncommon words with count, first sentence,
    first paragraph, frequency and rarity rank (V1-V13), each in its own
    language's tables; ``lang`` reports on one language only."""
    docs = A.documents(spark, sf_dir, lang)
    stats = V.corpus_statistics(docs, A.quality_ids(spark, sf_dir))
    once, again = map(A.doc_paragraphs, split_repeated(docs, ["source", "doc_id"]))
    return V.uncommon_words(once, stats, None, threshold, repeated=again)


def _ranked(spark: SparkSession, sf_dir: str, threshold: float = V.DEFAULT_THRESHOLD, sentences: bool = True) -> DataFrame:
    """The flagship's words without their sentences, for queries that do not return these;
    without ``sentences`` not even their places."""
    docs = A.documents(spark, sf_dir)
    stats = V.corpus_statistics(docs, A.quality_ids(spark, sf_dir))
    once, again = map(A.doc_paragraphs, split_repeated(docs, ["source", "doc_id"]))
    return V.ranked_words(once, stats, None, threshold, repeated=again, sentences=sentences)


_QUERIES: dict[str, Query] = {"vocabulary_report": vocabulary_report}


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


# --------------------------------------------------------------------------
# Paragraph segmentation (P1-P3, P9 text route) over conversations
# --------------------------------------------------------------------------

def blank_line_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank-line paragraphs of each conversation text (stripped, non-empty)."""
    return S.number_pieces(A.conv_turns(spark, sf_dir), S.blank_line_split("text"))


def text_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P9 text route: P1 -> P2 newline collapse -> P3 clean, length >= 100."""
    return S.number_pieces(A.conv_turns(spark, sf_dir), S.text_paragraph_list("text"))


# --------------------------------------------------------------------------
# HTML (P4, P5, S10)
# --------------------------------------------------------------------------

def html_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full text of every <p> of each page, in order, unstripped."""
    pages = A.pages(spark, sf_dir)
    return S.explode_paragraphs(pages, H.paragraph_texts("html"), ["page_id"])


def html_clean_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P9 html route: P4 -> P2 -> P3 (length >= 100)."""
    pages = A.pages(spark, sf_dir)
    paras = S.clean_min_length(S.one_line(H.paragraph_texts("html")))
    return S.explode_paragraphs(pages, paras, ["page_id"])


def page_article_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S10 + P5: stripped paragraph texts inside <article> (else <body>)."""
    pages = A.pages(spark, sf_dir)
    return S.explode_paragraphs(pages, H.stripped_paragraph_texts(PT.first_inner_html("html", "article")),
                                ["page_id", "url"])


def page_content_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S10 + P5 by a class: stripped paragraph texts inside ``div.entry-content``,
    on pages whose article is such a ``div``."""
    pages = A.blog_pages(spark, sf_dir)
    inner = PT.first_inner_html("html", "main > div.entry-content[data-kind=post], body > div.entry-content")
    return S.explode_paragraphs(pages, H.stripped_paragraph_texts(inner), ["page_id", "url"])


def page_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S10, every match: target and text of each link in a page's navigation list."""
    links = PT.selected("html", "nav > ul li > a[href]", lambda tree, element: F.struct(
        PT.attribute(PT.start_tag(tree, element), "href").alias("href"), H.plain_text(PT.inner_html(tree, element)).alias("text"),
        element["depth"].alias("depth")))
    found = A.pages(spark, sf_dir).select("page_id", F.posexplode(links).alias("link_number", "link"))
    return found.select("page_id", "link_number", "link.href", "link.text", "link.depth")


# --------------------------------------------------------------------------
# Layout blocks
# --------------------------------------------------------------------------

def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents", "doc_id", "text")


def layout_body_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6 + P7: paragraph nodes in pre-order that pass the body-block filter."""
    blocks = L.body_blocks(L.flatten_layout(A.layout_blocks(_texts(spark, sf_dir))))
    return blocks.select("doc_id", F.array_join(F.transform("path", lambda x: x.cast("string")), ".").alias("path_key"), "text",
                         "page_start", "page_end")


def cross_page_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6 -> P7 -> P8: paragraphs stitched across page breaks."""
    blocks = L.body_blocks(L.flatten_layout(A.layout_blocks(_texts(spark, sf_dir))))
    return L.stitch_pages(blocks)


_QUERIES.update({
    "blank_line_split": blank_line_split,
    "text_paragraphs": text_paragraphs,
    "html_paragraphs": html_paragraphs,
    "html_clean_paragraphs": html_clean_paragraphs,
    "page_article_paragraphs": page_article_paragraphs,
    "page_content_paragraphs": page_content_paragraphs,
    "page_navigation": page_navigation,
    "layout_body_blocks": layout_body_blocks,
    "cross_page_paragraphs": cross_page_paragraphs,
})


# --------------------------------------------------------------------------
# Summarisation (M1-M10) over document paragraphs
# --------------------------------------------------------------------------

def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.doc_paragraphs(A.documents(spark, sf_dir))


def _submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.paragraph_lists(A.documents(spark, sf_dir))


def summary_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 + M2: qualifying paragraphs (>= 300 chars) in batches of 20."""
    return M.batch_paragraphs(_submissions(spark, sf_dir)).drop("text")


def summary_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3 + M4: one prompt (with its response schema) per batch."""
    prompts = M.build_prompts(_submissions(spark, sf_dir))
    members = F.array_join(F.transform("paragraph_numbers", lambda x: x.cast("string")), ",")
    return prompts.withColumn("paragraph_numbers", members)


def summary_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M10 default model + M5 verdict per batch."""
    return M.verdicts(M.answer(_submissions(spark, sf_dir))).drop("response")


def paragraph_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1-M7: a summary row for every paragraph."""
    rows, _ = M.summarise(_submissions(spark, sf_dir))
    return rows


CAP = 20      # of the query below; M.SUMMARY_CAP is the original's


def capped_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: the same rows under a cap on paragraph numbers (21 rows a submission)."""
    rows, _ = M.summarise(_submissions(spark, sf_dir), cap=CAP)
    return rows


def single_paragraph_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9: every paragraph summarised on its own (a one-paragraph submission)."""
    single = _paragraphs(spark, sf_dir).select(
        F.concat_ws("/", "user_id", F.col("submission_id").cast("string")).alias("user_id"),
        F.col("paragraph_number").alias("submission_id"),
        F.array(F.struct(F.lit(0).alias("paragraph_number"), "text")).alias("paragraphs"))
    rows, _ = M.summarise(single)
    return rows.select(F.split("user_id", "/")[0].alias("user_id"),
                       F.split("user_id", "/")[1].cast("bigint").alias("submission_id"),
                       F.col("submission_id").alias("paragraph_number"), "summary")


_QUERIES.update({
    "summary_batches": summary_batches,
    "summary_prompts": summary_prompts,
    "summary_validation": summary_validation,
    "paragraph_summaries": paragraph_summaries,
    "capped_summaries": capped_summaries,
    "single_paragraph_summaries": single_paragraph_summaries,
})


# --------------------------------------------------------------------------
# Sources (S2-S9)
# --------------------------------------------------------------------------

def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 submission id of every document's bytes."""
    docs = A.documents(spark, sf_dir)
    return docs.select(F.col("source").alias("user_id"), "doc_id", U.content_hash(F.col("text")).alias("submission_id"))


def format_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route of every upload; unsupported or unbuilt routes carry a reason."""
    ok, bad = FS.split_routes(A.uploads(spark, sf_dir))
    cols = ["user_id", "submission_id", "file_name", "route"]
    return ok.select(*cols, F.lit(None).cast("string").alias("reason")).unionByName(bad.select(*cols, "reason"))


def extract_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route -> extract (text, html, pdf layout blocks) -> P2 -> P3, of
    every document and page."""
    paras, _ = FS.extract_paragraphs(A.uploads(spark, sf_dir, A.READABLE_EXTENSIONS), A.ocr)
    return paras


def rejected_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P9 quarantine: uploads that no extractor reads, with the reason."""
    _, bad = FS.extract_paragraphs(A.uploads(spark, sf_dir), A.ocr)
    return bad


def undecodable_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4 quarantine: queue messages without JSON, with the reason."""
    return N.undecodable(A.notifications(spark, sf_dir)).drop("body")


def object_key_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4 + S3: decode queue messages (topic envelopes too), keep puts,
    parse object keys into (user, submission) or a quarantine reason."""
    recs = N.decode_notifications(A.notifications(spark, sf_dir))
    return N.parse_object_keys(recs).drop("event_name")


def paragraph_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraph sink format, one JSON array per submission."""
    return U.paragraphs_to_json(_paragraphs(spark, sf_dir))


def paragraph_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5 -> S6: write the JSON arrays, read them back as numbered rows."""
    good, _ = U.paragraphs_from_json(U.paragraphs_to_json(_paragraphs(spark, sf_dir)))
    return good


def _registration(spark: SparkSession, sf_dir: str):
    return U.register_uploads(A.upload_requests(spark, sf_dir).drop("doc_id"))


def upload_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7 + K3: the submissions table after every registration request
    (re-registering a hash resets its row)."""
    table, _ = _registration(spark, sf_dir)
    return table


def rejected_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests missing a required field."""
    _, rejected = _registration(spark, sf_dir)
    return rejected.select("user_id", "file_hash", "requested_at", "reason")


def input_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8 + Z1: file > url > text precedence, size and length gates
    (byte limit lowered to 16 KiB so it bites at test scale)."""
    docs = A.documents(spark, sf_dir)
    req = docs.select("doc_id", F.lit(None).cast("binary").alias("file_bytes"),
                      F.lit(None).cast("binary").alias("url_bytes"), "text")
    gated = U.gate_inputs(req, max_bytes=16 * 1024, max_chars=U.MAX_TEXT_CHARS)
    return gated.select("doc_id", F.octet_length("content").cast("bigint").alias("n_bytes"), "status", "reason")


# --------------------------------------------------------------------------
# Keyed tables
# --------------------------------------------------------------------------

def summary_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: composite sort keys of every paragraph row."""
    p = _paragraphs(spark, sf_dir)
    return p.select("user_id", "submission_id", "paragraph_number",
                    K.summary_key(F.col("submission_id"), F.col("paragraph_number")).alias("sort_key"))


def vocabulary_key_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: decode vocabulary sort keys built from web-page paragraphs
    (their first word may hold ``#``); bad keys get a reason."""
    pages = A.pages(spark, sf_dir)
    paras = S.explode_paragraphs(pages, H.paragraph_texts("html"), ["page_id"])
    first = F.get(F.split(T.strip_ws("text"), r"(?U)\s+", -1), 0)
    page = F.concat(F.lit("p"), F.col("page_id").cast("string"))
    keys = paras.select(K.vocab_key(page, F.col("paragraph_number"), first).alias("sort_key"))
    return K.decode_keys(keys, "sort_key", 4)


def submission_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5 bulk form: look up each conversation turn and each document as a
    (user, content hash) request; absent ones come back with found=false."""
    table = upload_registration(spark, sf_dir).select("user_id", "submission_id", "state", "filename")
    docs = A.documents(spark, sf_dir).select(F.col("source").alias("user_id"),
                                             F.sha2("text", 256).alias("submission_id"))
    conv = read_table(spark, sf_dir, "conversations", "role", "text").select(
        F.col("role").alias("user_id"), F.sha2("text", 256).alias("submission_id"))
    return K.lookup(table, docs.unionByName(conv).distinct(), ["user_id", "submission_id"])


def user_submissions(spark: SparkSession, sf_dir: str, user_id: str = "src3") -> DataFrame:
    """K6: all submissions of one user."""
    return K.scan_user(upload_registration(spark, sf_dir), user_id)


def summary_key_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: paragraph rows of each submission in byte order of their sort key."""
    return K.scan_prefix(summary_keys(spark, sf_dir), "sort_key", ["user_id", "submission_id"])


def submissions_by_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8: a user's submissions with a given file name."""
    return K.filter_filename(upload_registration(spark, sf_dir), "src7", "doc_7.xlsx")


def delete_toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K9: submissions left after deleting those of documents labelled toxic."""
    req = A.upload_requests(spark, sf_dir)
    toxic = read_table(spark, sf_dir, "labels", "doc_id", "toxic").filter(F.col("toxic") == 1)
    tomb = req.join(toxic, "doc_id", "left_semi").select("user_id", F.col("file_hash").alias("submission_id"))
    return K.delete(upload_registration(spark, sf_dir), tomb, ["user_id", "submission_id"])


def stage_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State per key as arithmetic sum (faithful) and bit mask."""
    ev = A.stage_events(spark, sf_dir).filter(~F.col("failed"))
    return K.accumulate_state(ev, ["user_id"])


def paragraph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document submission gets paragraph_count set by the
    paragraph stage (0 when no paragraph survives)."""
    docs = A.documents(spark, sf_dir)
    table = docs.select(F.col("source").alias("user_id"), F.col("doc_id").alias("submission_id"),
                        F.lit(0).alias("state"))
    kept = F.filter(F.transform(F.split("text", "\n", -1), lambda x: T.clean_paragraph(x)),
                    lambda x: F.length(x) >= S.MIN_LENGTH)
    updates = docs.select(F.col("source").alias("user_id"), F.col("doc_id").alias("submission_id"),
                          F.size(kept).alias("paragraph_count"), F.lit(1).alias("ts"))
    return K.set_attribute(table, updates, ["user_id", "submission_id"], "paragraph_count")


# --------------------------------------------------------------------------
# Read side
# --------------------------------------------------------------------------

def submission_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status label of each (user, day) submission's accumulated state."""
    reports = A.day_stage_events(spark, sf_dir).filter(~F.col("failed"))
    st = K.accumulate_state(reports, ["user_id", "submission_id"])
    return st.select("user_id", "submission_id", "state_sum", LB.status_label(F.col("state_sum")).alias("status"))


def redelivered_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D7 on the arithmetic sum per user, which redelivered stages overshoot
    (the label is then the digits)."""
    st = stage_state(spark, sf_dir)
    return st.select("user_id", "state_sum", LB.status_label(F.col("state_sum")).alias("status"))


def submission_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D6 + D10: listing rows (default name, status, date, link flag), newest
    first, of the (user, day) submissions; a day's name is what its first
    ``view`` names, others have none."""
    reports = A.day_stage_events(spark, sf_dir).filter(~F.col("failed"))
    state = K.accumulate_state(reports, ["user_id", "submission_id"])
    seen = A.stage_events(spark, sf_dir).groupBy("user_id", F.to_date("ts").cast("string").alias("submission_id")).agg(
        F.min(F.when(F.col("bit") == K.STAGE_PARAGRAPHS, F.col("event_id"))).alias("view"), F.min(F.unix_timestamp("ts")).alias("created_at"))
    table = state.join(seen, ["user_id", "submission_id"]).select(
        "user_id", "submission_id", F.col("state_sum").alias("state"), "created_at",
        F.when(F.col("view").isNotNull(), F.concat(F.lit("upload_"), F.col("view").cast("string"), F.lit(".txt"))).alias("filename"))
    return G.listing(table)


def document_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Human-readable size of every document."""
    docs = A.documents(spark, sf_dir)
    n = F.octet_length("text").cast("bigint")
    return docs.select("doc_id", n.alias("n_bytes"), LB.file_size(n).alias("size_label"))


def upload_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D12 + D13: MIME class, upload-form acceptance and service route per upload."""
    up = A.uploads(spark, sf_dir)
    mime = A.mime_type(FS.suffix(F.col("file_name")))
    return up.select("user_id", "submission_id", "file_name", mime.alias("mime"),
                     LB.mime_class(mime).alias("icon"), LB.ui_accepts(F.col("file_name")).alias("ui_accepts"),
                     FS.route(F.col("file_name")).alias("route"))


def type_acceptance_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extensions one side accepts and the other rejects."""
    accepts = F.col("route").isin(*FS.BUILT_ROUTES, "docx", "rtf")
    t = upload_types(spark, sf_dir).select(FS.suffix(F.col("file_name")).alias("ext"), "ui_accepts", accepts.alias("service"))
    by_ext = t.groupBy("ext").agg(F.bool_or("ui_accepts").alias("ui"), F.bool_or("service").alias("service"))
    gap = F.when(F.col("ui") & ~F.col("service"), "form only").when(F.col("service") & ~F.col("ui"), "service only")
    return by_ext.select("ext", gap.alias("gap")).filter("gap IS NOT NULL")


def word_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flatten dictionary responses to (definition, partOfSpeech)."""
    return G.definitions(A.dictionary_entries(spark, sf_dir))


def submission_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each submission's paragraphs joined by blank lines."""
    return G.submission_text(_paragraphs(spark, sf_dir))


def paragraph_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collapsed and expanded display text of every summarised paragraph."""
    return G.paragraph_display(paragraph_summaries(spark, sf_dir), _paragraphs(spark, sf_dir))


_QUERIES.update({
    "content_hash": content_hash,
    "format_routing": format_routing,
    "extract_paragraphs": extract_paragraphs,
    "rejected_formats": rejected_formats,
    "undecodable_messages": undecodable_messages,
    "object_key_parse": object_key_parse,
    "paragraph_json": paragraph_json,
    "paragraph_json_roundtrip": paragraph_json_roundtrip,
    "upload_registration": upload_registration,
    "rejected_uploads": rejected_uploads,
    "input_gate": input_gate,
    "summary_keys": summary_keys,
    "vocabulary_key_decode": vocabulary_key_decode,
    "submission_lookup": submission_lookup,
    "user_submissions": user_submissions,
    "summary_key_scan": summary_key_scan,
    "submissions_by_filename": submissions_by_filename,
    "delete_toxic": delete_toxic,
    "stage_state": stage_state,
    "paragraph_counts": paragraph_counts,
    "submission_status": submission_status,
    "redelivered_status": redelivered_status,
    "submission_listing": submission_listing,
    "document_sizes": document_sizes,
    "upload_types": upload_types,
    "type_acceptance_gaps": type_acceptance_gaps,
    "word_definitions": word_definitions,
    "submission_text": submission_text,
    "paragraph_display": paragraph_display,
})


# --------------------------------------------------------------------------
# Vocabulary stages on their own, all languages
# --------------------------------------------------------------------------

def word_frequency_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative frequency of every word per language over all documents."""
    return V.word_frequencies(A.documents(spark, sf_dir))


def lemma_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6 + V7 + V10: lemma of every corpus word that has one in the lexicon."""
    docs = A.documents(spark, sf_dir)
    stats = materialise(V.corpus_statistics(docs, A.quality_ids(spark, sf_dir)))   # read twice below
    return V.lemmatise(stats.select("lang", "word"), stats.filter("in_lexicon").select("lang", "word"))


def vocabulary_all_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V13 with each document's own language tables (threshold 2e-4)."""
    return vocabulary_report(spark, sf_dir, lang=None, threshold=2e-4)


def vocabulary_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The persisted projection of the vocabulary report."""
    return V.vocabulary_rows(_ranked(spark, sf_dir, sentences=False))


# --------------------------------------------------------------------------
# Study guide (D1-D4) and product features
# --------------------------------------------------------------------------

def study_guide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per completed submission, dense paragraph rows with vocabulary
    (words of that paragraph), summary and paragraph start."""
    guide = PG.study_guide(spark, sf_dir)
    return guide.withColumn("vocabulary", F.array_join("vocabulary", " "))


def guide_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The study guide of each submission exported as Markdown."""
    return G.markdown_export(PG.study_guide(spark, sf_dir))


def duplicate_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose exact text the same user already submitted."""
    docs = A.documents(spark, sf_dir)
    subs = docs.select(F.col("source").alias("user_id"), "doc_id", F.sha2("text", 256).alias("submission_id"),
                       (F.lit(A.EPOCH_BASE) + F.col("doc_id") * 60).cast("bigint").alias("created_at"))
    return Z.duplicate_submissions(subs, ["user_id"], "submission_id", ["created_at", "doc_id"])


def upload_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z3: uploads (object puts) per user per minute against the limit of 10."""
    ev = read_table(spark, sf_dir, "events", "user_id", "ts", "event_type").filter(F.col("event_type") == "click")
    return Z.rate_per_minute(ev, "user_id", "ts")


def busy_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z3 with a limit and a window that the events reach: two a day."""
    ev = read_table(spark, sf_dir, "events", "user_id", "ts", "event_type").filter(F.col("event_type") == "click")
    return Z.rate_per_minute(ev, "user_id", "ts", limit=2, window="1 day")


def sliding_upload_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z3, sliding: each upload with its user's uploads in the hour before it, against a limit of one."""
    ev = read_table(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type").filter(F.col("event_type") == "click")
    return Z.sliding_rate(ev.drop("event_type"), "user_id", "ts", limit=1, seconds=3600, slice_windows=24)


def word_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vocabulary word with its owner's latest mark."""
    words = materialise(V.vocabulary_rows(_ranked(spark, sf_dir, sentences=False)), "vocabulary")
    return Z.word_marks(words, A.word_mark_events(spark, sf_dir, words))


def unknown_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary without the words their owner marked as known."""
    words = materialise(V.vocabulary_rows(_ranked(spark, sf_dir, sentences=False)), "vocabulary")
    return Z.hide_known(words, A.word_mark_events(spark, sf_dir, words))


def renamed_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The submissions table after all rename requests."""
    return Z.rename(upload_registration(spark, sf_dir), A.rename_events(spark, sf_dir))


THRESHOLDS = [1e-5, 2e-5, 5e-5, 1e-4]


def threshold_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uncommon-word counts per submission at several thresholds, from
    one vocabulary run at the largest threshold."""
    docs = A.documents(spark, sf_dir)
    stats = V.corpus_statistics(docs, A.quality_ids(spark, sf_dir))
    once, again = map(A.joined_paragraphs, split_repeated(docs, ["source", "doc_id"]))
    return Z.threshold_profile(V.frequency_profile(once, stats, max(THRESHOLDS), again), THRESHOLDS)


SLIDER = [1.3e-5, 2.7e-5, 8.1e-5]


def threshold_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slider positions looked up in a stored index of word frequencies."""
    index = materialise(Z.threshold_index(_ranked(spark, sf_dir, max(THRESHOLDS), sentences=False)), "threshold-index")
    rows = index.select("user_id", "submission_id", "frequencies", F.explode(F.array(*map(F.lit, SLIDER))).alias("threshold"))
    return rows.select("user_id", "submission_id", "threshold", Z.words_below(F.col("frequencies"), F.col("threshold")).alias("words"))


def recent_submissions(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """Each user's five newest submissions."""
    return Z.top_k_recent(upload_registration(spark, sf_dir), k)


def resume_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages each (user, day) submission still has to run."""
    ev = A.day_stage_events(spark, sf_dir).filter(~F.col("failed"))
    return Z.missing_stages(ev, ["user_id", "submission_id"])


_QUERIES.update({
    "word_frequency_table": word_frequency_table,
    "lemma_table": lemma_table,
    "vocabulary_all_languages": vocabulary_all_languages,
    "vocabulary_table": vocabulary_table,
    "study_guide": study_guide,
    "guide_markdown": guide_markdown,
    "duplicate_submissions": duplicate_submissions,
    "upload_rate": upload_rate,
    "busy_days": busy_days,
    "word_marks": word_marks,
    "unknown_words": unknown_words,
    "renamed_submissions": renamed_submissions,
    "threshold_profile": threshold_profile,
    "recent_submissions": recent_submissions,
    "resume_stages": resume_stages,
})


# --------------------------------------------------------------------------
# Streaming (X1-X4): run to completion with availableNow, return the sink
# --------------------------------------------------------------------------

def streamed_stage_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1 + X3 + X4: stage state accumulated by a deduplicating stream;
    equals the batch ``stage_state``."""
    return ST.run_stage_state(spark, sf_dir)[0]


def streamed_stage_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's quarantine, failed stage reports with the reason."""
    return ST.run_stage_state(spark, sf_dir)[1]


def streamed_upload_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1 + X2: upload keys parsed by the stream, fanned out to a key table
    and a quarantine table; equals the batch ``object_key_parse``."""
    keys, quarantine = ST.run_upload_keys(spark, sf_dir)
    return keys.unionByName(quarantine)


_QUERIES.update({
    "streamed_stage_state": streamed_stage_state,
    "streamed_stage_failures": streamed_stage_failures,
    "streamed_upload_keys": streamed_upload_keys,
})


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: sentences of every document paragraph."""
    return V.split_sentences(_paragraphs(spark, sf_dir))


def paragraph_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2-V5: tokens per paragraph, kept after the proper-noun filter, and distinct words."""
    once, again = split_repeated(A.documents(spark, sf_dir), ["source", "doc_id"])
    return V.token_counts(A.doc_paragraphs(once)).unionByName(V.token_counts_by_key(A.doc_paragraphs(again)))


def streamed_upload_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z3 as a stream: per-user tumbling-minute upload counts."""
    return ST.run_upload_rate(spark, sf_dir)


_QUERIES.update({
    "sentence_split": sentence_split,
    "paragraph_token_counts": paragraph_token_counts,
    "streamed_upload_rate": streamed_upload_rate,
})


def streamed_study_guide(spark: SparkSession, sf_dir: str,
                         files_per_trigger: int = ST.FILES_PER_TRIGGER) -> DataFrame:
    """X1 + X2 end to end: documents arrive as a stream, each micro-batch
    fans out to the vocabulary and summary stages; the study guide joins
    what the stages wrote.  Equals the batch ``study_guide``."""
    docs = A.documents(spark, sf_dir)
    lemma_map = V.prepare_lemma_map(V.corpus_statistics(docs, A.quality_ids(spark, sf_dir)))
    base = ST.run_document_stages(spark, sf_dir, lemma_map, files_per_trigger=files_per_trigger)
    vocab = ST.read_sink(spark, f"{base}/vocabulary", ST.VOCABULARY_SCHEMA).drop("epoch")
    sums = ST.read_sink(spark, f"{base}/summaries", ST.SUMMARIES_SCHEMA).drop("epoch")
    stages = ST.read_sink(spark, f"{base}/stages", ST.STAGES_SCHEMA)
    state = (K.accumulate_state(stages, ["user_id", "submission_id"])
             .select("user_id", "submission_id", F.col("state_mask").alias("state")))
    return G.study_guide(vocab, sums, state).withColumn("vocabulary", F.array_join("vocabulary", " "))


_QUERIES["streamed_study_guide"] = streamed_study_guide


def uploaded_text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 + S2 + P9: the documents written as text files (a folder per owner
    under the shared checkpoint folder, a hundred documents a file at most,
    each after a mark), read back with the whole-file scan (UTF-8, bad bytes
    replaced), routed, split into paragraphs.  Owner comes from the path."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/uploads-{uuid.uuid4().hex}"
    docs = A.documents(spark, sf_dir).filter("text IS NOT NULL").select("source", "doc_id", "text")
    docs.repartitionByRange("source", "doc_id").select(
        "source", F.concat(F.lit(DOCUMENT_MARK), F.col("doc_id").cast("string"), F.lit("\n"), F.col("text")).alias("value")
    ).write.option("maxRecordsPerFile", 100).partitionBy("source").text(base)
    files = FS.read_text_files(spark, base, glob="*.txt")
    parts = files.select(
        F.regexp_extract("path", r"/source=([^/]+)/", 1).alias("user_id"), F.element_at(F.split("path", "/"), -1).alias("file_name"),
        F.explode(F.slice(F.split("text", DOCUMENT_MARK, -1), 2, 1 << 30)).alias("part"))
    uploads = parts.select(
        "user_id", F.substring_index("part", "\n", 1).cast("bigint").alias("submission_id"), "file_name",
        F.regexp_replace("part", r"(?s)\A[^\n]*\n", "").alias("content"))
    paras, _ = FS.extract_paragraphs(uploads)
    return paras


DOCUMENT_MARK = "\u001e"      # stands before each document of a file
_QUERIES["uploaded_text_files"] = uploaded_text_files


RUN_TS = 1_700_000_000   # the explicit write time of one bulk insert (no wall clock)


def vocabulary_bulk_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4 (+ V14): the vocabulary rows appended with one run time to a table
    clustered by user in the shared folder, then read back."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/vocabulary-{uuid.uuid4().hex}"
    K.append(K.with_write_time(V.vocabulary_rows(_ranked(spark, sf_dir, sentences=False)), RUN_TS), path)
    schema = "user_id STRING, submission_id BIGINT, paragraph_number INT, word STRING, rank INT, created_at BIGINT"
    return spark.read.schema(schema).parquet(path)


_QUERIES["vocabulary_bulk_insert"] = vocabulary_bulk_insert

_QUERIES.update(PL.QUERIES)
_QUERIES.update(PV.QUERIES)
_QUERIES["sliding_upload_rate"] = sliding_upload_rate
_QUERIES["threshold_lookup"] = threshold_lookup
