"""The words of a text are found once and counted where they stand."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import answers as AN
from lectern.operators import joins as J
from lectern.operators import keyed as K
from lectern.operators import learned as LL
from lectern.operators import vocabulary as V
from lectern.plans import catalog
from lectern.sources import adapters as A

SPACES = "a  b", " a\t b ", "a b", "a  \u0085 b　", "\n", "", " ", "é  è", "a b c", "\x1c a\x1c"
WORDS = "Ab", "éÀ", "×", "÷a", "A×B", "×A", "ÞÐ", "ßa", "Øx", "zZ", "[A", "", "Àb", "ÿ", "Ö"
TEXTS = "One. Two!  Three", "a.\u0001 b", "a. \u0001b", "?! x", ". . y", "e.g. Mr. X", "no end", "", "end. "


def _column(spark, values, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate([*values, None])], "i int, x string")
    return [r.y for r in rows.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def test_text_functions_give_what_their_patterns_gave(spark):
    assert _column(spark, SPACES, T.clean_paragraph) == _column(
        spark, SPACES, lambda c: F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), "^ | $", ""))
    assert _column(spark, SPACES, T.strip_ws) == _column(spark, SPACES, lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    assert _column(spark, WORDS, T.normalise_token) == _column(spark, WORDS, lambda c: F.lower(F.translate(c, "×÷", "")))
    assert _column(spark, WORDS, T.is_capitalised) == _column(spark, WORDS, lambda c: c.rlike("^[A-ZÀ-ÖØ-Þ]"))
    assert _column(spark, TEXTS, T.sentences) == _column(
        spark, TEXTS, lambda c: F.split(F.regexp_replace(c, r"(?U)([.!?])\s+", "$1\u0001"), "\u0001", -1))


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_text_is_cleaned_once(spark, sf_small):
    words = V.paragraph_tokens(A.doc_paragraphs(A.documents(spark, sf_small)))
    assert _plan(words).count(r"(?U) \s+") == 1


def test_token_functions_search_no_dictionary_and_no_pattern(spark):
    rows = spark.createDataFrame([("a",)], "t string")
    plan = _plan(rows.select(T.normalise_token("t"), T.is_capitalised("t")))
    assert "translate" not in plan and "RLIKE" not in plan.upper()


def test_common_counts_move_one_row_a_key(spark, tmp_path, monkeypatch):
    tokens = spark.createDataFrame(
        [("en", 1, "a"), ("en", 1, "a"), ("en", 1, "b"), ("de", 1, "a"), (None, 2, "a"), (None, 2, "c")], "lang string, k int, word string")
    names = spark.createDataFrame([("en", "a"), (None, "c")], "lang string, word string")
    names.write.parquet(str(tmp_path / "names"))
    names = spark.read.parquet(str(tmp_path / "names"))
    direct = LL.common_counts(tokens, names, ["k"])
    assert "BroadcastHashJoin" in _plan(direct) and _plan(direct).count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, direct.collect())) == [(1, 4, 2), (2, 2, 1)]
    monkeypatch.setattr(LL, "is_small", lambda table: False)
    shuffled = LL.common_counts(tokens, names, ["k"])
    assert shuffled.dtypes == direct.dtypes and sorted(map(tuple, shuffled.collect())) == [(1, 4, 2), (2, 2, 1)]


def test_token_counts_move_no_words(spark, sf_small):
    paragraphs = A.doc_paragraphs(A.documents(spark, sf_small))
    counts = V.token_counts(paragraphs)
    assert "Exchange" not in _plan(counts)
    by_key = V.token_counts_by_key(paragraphs)
    assert counts.dtypes == by_key.dtypes and sorted(counts.collect()) == sorted(by_key.collect())


def test_token_counts_of_repeated_and_missing_ids(spark, tmp_path):
    text = "Some words of Anna and words of × Bert stand here. Words again, and so on until the line is long enough to be kept."
    rows = [("s", 1, text), ("s", 2, text), ("s", 2, text + " Other end."), (None, None, text), (None, None, text), ("s", 3, None), ("s", 4, "9" * 120)]
    spark.createDataFrame([(i, t, "en", s) for s, i, t in rows], "doc_id long, text string, lang string, source string").write.parquet(
        str(tmp_path / "documents.parquet"))
    found = catalog.paragraph_token_counts(spark, str(tmp_path))
    by_key = V.token_counts_by_key(A.doc_paragraphs(A.documents(spark, str(tmp_path))))
    assert sorted(map(str, found.collect())) == sorted(map(str, by_key.collect())) and found.count() == 3


def test_white_space_is_what_the_pattern_matches(spark):
    points = spark.range(1, 0x3100).select("id", F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("c")).filter(r"c rlike '(?U)\\s'")
    assert {r.id for r in points.collect()} == set(map(ord, T.WHITE_SPACE))


def test_prompts_are_made_once_a_run(spark, sf_small, tmp_path, monkeypatch):
    made = []
    monkeypatch.setattr(AN, "materialise", lambda df, name: made.append((name, _plan(df))) or J.materialise(df, name))
    AN.answer(A.paragraph_lists(A.documents(spark, sf_small)), str(tmp_path / "store"))
    assert [name for name, plan in made if "You help" in plan] == ["prompts"]


def test_append_makes_its_rows_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(rows):
        for row in rows:
            seen.add(1)
            yield row

    made = spark.createDataFrame(spark.sparkContext.parallelize([("a", 1), ("b", 2), ("c", 3)], 2).mapPartitions(count), "user_id string, n int")
    K.append(made, str(tmp_path / "table"))
    assert seen.value == 3 and sorted(map(tuple, spark.read.parquet(str(tmp_path / "table")).collect())) == [("a", 1), ("b", 2), ("c", 3)]


def test_gathered_words_are_those_of_any_paragraphs_and_meet_once(spark, sf_small):
    docs = A.documents(spark, sf_small)
    lemma_map = V.prepare_lemma_map(V.corpus_statistics(docs, A.quality_ids(spark, sf_small)))
    paragraphs = A.doc_paragraphs(docs)
    any_rows = V.ranked_words(paragraphs, lemma_map=lemma_map)
    gathered = V.ranked_words(paragraphs, lemma_map=lemma_map, repeated=paragraphs.limit(0))
    assert sorted(gathered.collect()) == sorted(any_rows.collect()) and any_rows.count() > 0
    hits = spark.read.parquet(_stored(any_rows)).withColumnsRenamed({"word": "lemma", "language_frequency": "freq"}).withColumn("token_at", F.col("sentence_at"))
    assert _plan(V.rank_words(V.aggregate_gathered(hits))).count("Exchange hashpartitioning") == 1


def _stored(df) -> str:
    return J.materialise(df).inputFiles()[0].rsplit("/", 1)[0]


def test_report_of_repeated_ids_is_that_of_any_paragraphs(spark, sf_small, tmp_path):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    odd = docs.filter("doc_id < 40").unionByName(docs.filter("doc_id < 5")).withColumn(
        "doc_id", F.when(F.col("doc_id").between(30, 33), None).otherwise(F.col("doc_id")))
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf_small}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    found = catalog._ranked(spark, str(tmp_path), 0.01).drop("rank")
    docs = A.documents(spark, str(tmp_path))
    stats = V.corpus_statistics(docs, A.quality_ids(spark, str(tmp_path)))
    plain = V.ranked_words(A.doc_paragraphs(docs), stats, None, 0.01).drop("rank")      # ties of one place may rank either way
    assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect())) and found.filter("submission_id IS NULL").count() > 0
