"""Invariants from the test strategy, checked on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import vocabulary as V
from lectern.plans import guide as PG
from lectern.sources import adapters as A

from .conftest import SF_SMALL


def test_word_counts_sum_to_the_kept_tokens(spark):
    """Per submission, the counts of its uncommon words add up to the
    number of its tokens that survive the filters and map to such a word."""
    docs = A.documents(spark, SF_SMALL, "en")
    stats = V.corpus_statistics(docs, A.quality_ids(spark, SF_SMALL))
    lemma_map = V.prepare_lemma_map(stats)
    paras = A.doc_paragraphs(docs)
    words = V.uncommon_words(paras, lemma_map=lemma_map)
    toks = V.tokenize(V.split_sentences(paras.select("user_id", "submission_id", "lang", "paragraph_number", "text")))
    hits = (toks.filter(~F.col("is_proper") & (F.col("word") != ""))
            .join(lemma_map.select("lang", "word"), ["lang", "word"]))
    per_sub_words = {r.submission_id: r.n for r in words.groupBy("submission_id").agg(F.sum("count").alias("n")).collect()}
    per_sub_hits = {r.submission_id: r.n for r in hits.groupBy("submission_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert per_sub_words == per_sub_hits and sum(per_sub_words.values()) > 0


def test_study_guide_covers_every_paragraph(spark):
    """Every submission with a paragraph has its guide, indexed densely
    from 0 to its last paragraph."""
    from lectern.operators import guide as G
    guide = G.study_guide(*PG.study_guide_parts(spark, SF_SMALL))
    got = guide.groupBy("submission_id").agg(F.count(F.lit(1)).alias("n"), F.min("paragraph_index").alias("lo"), F.max("paragraph_index").alias("hi"))
    rows = {r.submission_id: (r.n, r.lo, r.hi) for r in got.collect()}
    want = {r.submission_id: r.n for r in A.doc_paragraphs(A.documents(spark, SF_SMALL)).groupBy("submission_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert rows == {k: (n, 0, n - 1) for k, n in want.items()} and want


def test_threshold_profile_is_monotone(spark):
    """A higher threshold never keeps fewer uncommon words."""
    import __spark_entry__ as E
    from lectern.operators.product import threshold_column
    from lectern.plans.catalog import THRESHOLDS
    cols = [threshold_column(t) for t in sorted(THRESHOLDS)]
    rows = E.queries()["threshold_profile"](spark, SF_SMALL).collect()
    assert rows and all([r[c] for c in cols] == sorted(r[c] for c in cols) for r in rows)
    assert any(r[cols[-1]] > r[cols[0]] for r in rows)


def test_ranks_are_dense_per_submission(spark):
    """Every submission's words are ranked 1..n without gaps or ties."""
    import __spark_entry__ as E
    words = E.queries()["vocabulary_report"](spark, SF_SMALL)
    per = words.groupBy("submission_id").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("lo"),
                                             F.max("rank").alias("hi"), F.count_distinct("rank").alias("d"))
    rows = per.collect()
    assert rows and all(r.lo == 1 and r.hi == r.n == r.d for r in rows)


def test_every_paragraph_has_its_summary(spark):
    import __spark_entry__ as E
    rows = E.queries()["paragraph_summaries"](spark, SF_SMALL)
    assert rows.count() == A.doc_paragraphs(A.documents(spark, SF_SMALL)).count() > 0
    capped = E.queries()["capped_summaries"](spark, SF_SMALL)
    assert 0 < capped.count() < rows.count() and capped.agg(F.max("paragraph_number")).first()[0] == 20


def test_every_readable_document_is_extracted(spark):
    import __spark_entry__ as E
    got = {r.submission_id for r in E.queries()["extract_paragraphs"](spark, SF_SMALL).filter("user_id <> 'web'").select("submission_id").distinct().collect()}
    long = {str(r.doc_id) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").filter("length(text) > 2000").collect()}
    assert long <= got


def test_labels_have_every_branch(spark):
    import __spark_entry__ as E
    status = {r.status for r in E.queries()["submission_status"](spark, SF_SMALL).collect()}
    assert {"received", "processing", "complete"} <= status
    assert all(r.status.isdigit() or r.status in ("received", "processing", "complete") for r in E.queries()["redelivered_status"](spark, SF_SMALL).collect())
    listing = E.queries()["submission_listing"](spark, SF_SMALL).collect()
    assert {r.details_link for r in listing} == {True, False} and any(r.filename == "Unnamed Document" for r in listing)
    assert {r.over_limit for r in E.queries()["busy_days"](spark, SF_SMALL).collect()} == {True, False}
    assert {r.stage for r in E.queries()["resume_stages"](spark, SF_SMALL).collect()} == {1, 2, 4}


def test_stitching_keeps_every_character(spark):
    """P8 on the layout blocks of real documents: per document, the stitched
    paragraphs hold exactly the body blocks' characters in order (joins add
    only single spaces)."""
    from lectern.functions.text import ordered_join
    from lectern.operators import layout as L
    blocks = L.body_blocks(L.flatten_layout(A.layout_blocks(A.documents(spark, SF_SMALL))))
    stitched = L.stitch_pages(blocks)
    squash = lambda c: F.regexp_replace(c, " ", "")
    before = blocks.groupBy("doc_id").agg(ordered_join("text", "", "path").alias("t")).select("doc_id", squash("t").alias("t"))
    after = stitched.groupBy("doc_id").agg(ordered_join("text", "", "paragraph_number").alias("t")) \
        .select("doc_id", squash("t").alias("t"))
    diff = before.join(after, "doc_id", "full_outer").filter(~before.t.eqNullSafe(after.t))
    assert blocks.count() > stitched.count() > 0 and diff.count() == 0
