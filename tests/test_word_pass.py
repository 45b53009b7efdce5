"""Words are found in whole texts, marks move no vocabulary, and profiles move few words."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import guide as G
from lectern.operators import product as Z
from lectern.operators import vocabulary as V
from lectern.plans import catalog
from lectern.sources import adapters as A
from lectern.streaming import uploads as ST

TEXTS = ("Foo bar Baz qux. Then New York ended! 12 Ab cd", "× Foo bar", "×Foo Bar× a×b ÷÷ c", "İstanbul K Åb ẞa aẞb aŸb Ÿ", "a.\u0001 B c\u0001D",
         "?! X y Z", "One. 123. Two Three", "ÀB éÀ Öx ß Øy", "", " . ", "end. ", "A", "x-Foo 3Bar4 O'Neil o'Neil", "a.  B\t C.　D e", "ÿÞ Þÿ. Þ")


def _plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_words_of_a_text_are_the_kept_tokens_of_its_sentences(spark):
    rows = spark.createDataFrame([("u", i, "en", 3, t) for i, t in enumerate([*TEXTS, None])],
                                 "user_id string, submission_id long, lang string, paragraph_number int, text string")

    def in_order(df):
        return [(r.submission_id, r.token_at >> 32, r.word) for r in df.orderBy("submission_id", "token_at").collect()]

    plain = V.paragraph_tokens(rows).filter(~F.col("is_proper") & (F.col("word") != ""))
    assert in_order(V.placed_words(rows)) == in_order(plain) and len(in_order(plain)) > 30
    words = rows.select("submission_id", F.explode(T.normalised_tokens("text")).alias("w"))
    tokens = rows.select("submission_id", F.explode(T.letter_tokens("text")).alias("t")).select("submission_id", T.normalise_token("t").alias("w"))
    assert sorted(words.collect()) == sorted(tokens.filter("w != ''").collect())


def test_no_other_character_becomes_a_letter(spark):
    points = spark.range(1, 0x110000).filter("id < 55296 OR id > 57343")
    char = points.select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    found = char.filter(~F.col("c").rlike(T.LETTER_RUN) & F.lower("c").rlike(T.LETTER_RUN))
    assert {r.c for r in found.collect()} == set(T.BECOME_LETTERS)


def _odd(spark, sf_small, folder) -> str:
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    odd = docs.filter("doc_id < 60").unionByName(docs.filter("doc_id < 5").withColumn("lang", F.lit(None).cast("string"))).withColumn(
        "doc_id", F.when(F.col("doc_id").between(30, 33), None).otherwise(F.col("doc_id")))
    odd.write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{sf_small}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_profile_of_shared_lemmas_and_repeated_ids_is_that_of_ranked_words(spark, sf_small, tmp_path):
    sf = _odd(spark, sf_small, tmp_path)
    docs = A.documents(spark, sf)
    stats, limits = V.corpus_statistics(docs, A.quality_ids(spark, sf)), [1e-3, 3e-3, 1e-2]
    ranked = V.ranked_words(A.doc_paragraphs(docs), stats, None, max(limits))
    once, again = map(A.joined_paragraphs, catalog.split_repeated(docs, ["source", "doc_id"]))
    profile = V.frequency_profile(once, stats, max(limits), again)
    found = Z.threshold_profile(profile, limits)
    assert sorted(map(str, found.collect())) == sorted(map(str, Z.threshold_profile(ranked, limits).collect())) and found.count() > 30
    assert profile.count() < ranked.count()


def test_ranked_words_without_sentences_are_the_same_words(spark, sf_small, tmp_path):
    sf = _odd(spark, sf_small, tmp_path)
    plain = catalog._ranked(spark, sf, 0.01).drop("sentence_at", "rank")
    assert sorted(map(str, catalog._ranked(spark, sf, 0.01, sentences=False).drop("rank").collect())) == sorted(map(str, plain.collect()))


def test_few_marks_move_no_vocabulary_and_meet_the_first_ranks_only(spark):
    words = spark.createDataFrame([("u", i, 0, f"w{i}", i) for i in range(9)],
                                  "user_id string, submission_id long, paragraph_number int, word string, rank int")
    marks = spark.createDataFrame([("u", "w1", "known", 1)], "user_id string, word string, mark string, ts long")
    assert "Exchange hashpartitioning" not in _plan(Z.word_marks(words, marks))
    assert "rank#" in _plan(words) and "<= 5" in _plan(A.word_mark_events(spark, "/root/testdata/sf0.001", words))


def test_words_of_a_paragraph_are_sorted_without_their_keys(spark):
    rows = spark.createDataFrame([("u", 1, 0, w) for w in ("b", "a", "é", "a#", "B", "b")], "user_id string, submission_id long, paragraph_number int, word string")
    found = G.words_by_paragraph(rows)
    assert found.first().vocabulary == ["B", "a", "a#", "b", "b", "é"] and "concat_ws" not in _plan(found)


def test_stream_ranks_single_submissions_where_they_meet(spark, sf_small, monkeypatch):
    seen, ranked = [], V.ranked_words
    monkeypatch.setattr(V, "ranked_words", lambda *a, **k: seen.append(k) or ranked(*a, **k))
    docs = A.documents(spark, sf_small)
    ST.run_document_stages(spark, sf_small, V.prepare_lemma_map(V.corpus_statistics(docs, A.quality_ids(spark, sf_small))))
    assert seen and all(k["repeated"] is not None and not k["sentences"] for k in seen)


def test_strings_are_those_of_the_array():
    from lectern.llm.bpe import _strings
    for values in ([], [" a", "", "é\U0001f600", "x\0y"]):
        assert _strings(pa.array(values, pa.string())) == values
