"""Golden rows (hand-written inputs with known answers) per operator."""

from __future__ import annotations

import json
import string

from pyspark.sql import functions as F

from lectern.functions import labels as LB
from lectern.functions import text as T
from lectern.operators import guide as G
from lectern.operators import keyed as K
from lectern.operators import layout as L
from lectern.operators import segment as S
from lectern.operators import summaries as M
from lectern.operators import vocabulary as V
from lectern.sources import notifications as N
from lectern.sources import uploads as U

LONG = "x" * 50


def _blocks(spark, rows):
    return spark.createDataFrame(
        [(1, [i], "paragraph", text, p0, p1) for i, (text, p0, p1) in enumerate(rows)],
        "doc_id long, path array<int>, type string, text string, page_start int, page_end int")


def _stitched(spark, rows):
    out = L.stitch_pages(L.body_blocks(L.flatten_layout(_blocks(spark, rows))))
    return [r.text for r in out.orderBy("paragraph_number").collect()]


# P8 --------------------------------------------------------------------------

def test_stitch_mid_word_keeps_hyphen(spark):
    a = LONG + " the experi-"
    b = "mental results " + LONG
    assert _stitched(spark, [(a, 1, 1), (b, 2, 2)]) == [a + b]


def test_stitch_mid_sentence_adds_space(spark):
    a = LONG + " of the"
    b = "house " + LONG
    assert _stitched(spark, [(a, 1, 1), (b, 2, 2)]) == [a + " " + b]


def test_stitch_same_page_stays_apart(spark):
    a = LONG + " of the"
    b = "house " + LONG
    assert _stitched(spark, [(a, 1, 1), (b, 1, 1)]) == [a, b]


def test_stitch_capital_start_stays_apart(spark):
    a = LONG + " of the"
    b = "House " + LONG
    assert _stitched(spark, [(a, 1, 1), (b, 2, 2)]) == [a, b]


def test_stitch_skipped_footer_does_not_count(spark):
    a = LONG + " of the"
    footer = "Page 1 of 12, printed copy only"   # 31 chars: dropped by P7
    b = "house " + LONG
    assert _stitched(spark, [(a, 1, 1), (footer, 1, 1), (b, 2, 2)]) == [a + " " + b]


def test_stitch_never_loses_characters(spark):
    rows = [(LONG + " and the", 1, 1), ("next part " + LONG, 2, 2), ("Another " + LONG, 2, 2),
            (LONG + " ends-", 2, 2), ("here " + LONG, 3, 3)]
    out = _stitched(spark, rows)
    assert sum(len(x) for x in out) >= sum(len(t) for t, _, _ in rows)
    assert "".join(out).replace(" ", "") == "".join(t for t, _, _ in rows).replace(" ", "")


# P7 --------------------------------------------------------------------------

def test_body_block_filter(spark):
    rows = [("a" * 40, 1, 1), ("a" * 41, 1, 1), ("A" * 80, 1, 1), ("A" * 81, 1, 1)]
    kept = L.body_blocks(_blocks(spark, rows)).orderBy("path").collect()
    assert [len(r.text) for r in kept] == [41, 81]


# P1, P3 ----------------------------------------------------------------------

def test_blank_line_split(spark):
    df = spark.createDataFrame([("a\n\n\n\nb\n\n",)], "text string")
    assert df.select(S.blank_line_split("text").alias("p")).first().p == ["a", "b"]


def test_min_length_boundary(spark):
    df = spark.createDataFrame([(["x" * 99, " " + "y" * 100 + "  "],)], "ps array<string>")
    assert df.select(S.clean_min_length(F.col("ps")).alias("p")).first().p == ["y" * 100]


# V3, V5, V6, V7, V9, V10 -----------------------------------------------------

def test_letter_tokens(spark):
    df = spark.createDataFrame([("far-off islands, north/south winds; ice_age 3rd",)], "s string")
    toks = df.select(T.letter_tokens("s").alias("t")).first().t
    assert toks == ["far", "off", "islands", "north", "south", "winds", "ice", "age", "rd"]


def test_tag_class_depends_on_the_first_letter_only(spark):
    tags = [first + rest for first in string.ascii_uppercase for rest in ("", "X", "ZZ")] + ["", "$", "``", "nn", "v"]
    df = spark.createDataFrame([(t,) for t in tags], "tag string")
    for tag, cls in df.select("tag", V.lemma_class(F.col("tag"))).collect():
        assert cls == dict(J="adj", V="verb", R="adv").get(tag[:1], "noun")


def test_lemmatise_against_lexicon(spark):
    words = spark.createDataFrame([("en", w) for w in ["torches", "berries", "calves", "zorble", "lamp"]],
                                  "lang string, word string")
    lex = spark.createDataFrame([("en", w) for w in ["torch", "berry", "calf", "lamp"]], "lang string, word string")
    got = {r.word: r.lemma for r in V.lemmatise(words, lex).collect()}
    assert got == {"torches": "torch", "berries": "berry", "calves": "calf", "lamp": "lamp"}


def test_first_places_pack_paragraph_sentence_and_token(spark):
    from lectern.operators import vocabulary as V
    rows = [("u", 1, "en", 0, "one two. three"), ("u", 1, "en", 70000, "x " * 70000 + "end. last one"), (None, None, None, 2, "lone word")]
    paras = spark.createDataFrame(rows, "user_id string, submission_id bigint, lang string, paragraph_number int, text string")
    at = {(r.submission_id, r.word): r for r in V.paragraph_tokens(paras).filter("word <> 'x'").collect()
          if (r.submission_id, r.word) != (1, "one") or r.token_at >> 32 == 70000}
    last = at[1, "last"]
    assert (last.sentence_at >> 32, last.sentence_at & 0xFFFFFFFF) == (70000, 1)
    assert last.token_at & 0xFFFFFFFF == 70001 and at[1, "end"].sentence_at & 0xFFFFFFFF == 0
    freq = spark.createDataFrame([("en", w, 1, 0.0, True) for w in ("one", "three", "last")] + [(None, "lone", 1, 0.0, True)],
                                 "lang string, word string, n bigint, freq double, in_lexicon boolean")
    words = {(r.submission_id, r.word): r for r in V.uncommon_words(paras, freq, threshold=1.0).collect()}
    assert set(words) == {(1, "one"), (1, "three"), (1, "last"), (None, "lone")}
    one, final = words[1, "one"], words[1, "last"]
    assert (one["count"], one.first_sentence, one.first_paragraph, one["rank"]) == (2, "one two.", 0, 1)
    assert (final.first_sentence, final.first_paragraph, final["rank"]) == ("last one", 70000, 3)
    assert words[None, "lone"].first_sentence == "lone word"


def test_uncommon_words_of_a_small_text(spark):
    paras = spark.createDataFrame(
        [("u", 1, "en", 0, "The harbour lamp burned low."),
         ("u", 1, "en", 1, "A second lamp stood there! Nobody had seen zorble before."),
         ("u", 1, "en", 2, "Low tide came.")],
        "user_id string, submission_id long, lang string, paragraph_number int, text string")
    freq = spark.createDataFrame([("en", w, 1, 1e-5, True) for w in ["lamp", "harbour", "low"]],
                                 "lang string, word string, n long, freq double, in_lexicon boolean")
    rows = {r.word: r for r in V.uncommon_words(paras, freq, None, 2e-5).collect()}
    assert set(rows) == {"lamp", "harbour", "low"}
    assert rows["lamp"]["count"] == 2 and rows["lamp"].first_paragraph == 0
    assert rows["low"]["count"] == 2
    assert rows["harbour"].first_sentence == "The harbour lamp burned low."
    assert sorted(r.rank for r in rows.values()) == [1, 2, 3]


def test_word_first_seen_in_second_paragraph_keeps_index(spark):
    paras = spark.createDataFrame(
        [("u", 1, "en", 0, "Nothing here."), ("u", 1, "en", 1, "An obscure word appears.")],
        "user_id string, submission_id long, lang string, paragraph_number int, text string")
    freq = spark.createDataFrame([("en", "obscure", 1, 1e-6, True)],
                                 "lang string, word string, n long, freq double, in_lexicon boolean")
    (row,) = V.uncommon_words(paras, freq, None).collect()
    assert (row.word, row.first_paragraph) == ("obscure", 1)


# M1, M2, M5, M8 --------------------------------------------------------------

def _paras(spark, texts):
    return M.gather(spark.createDataFrame([("u", 1, i, t) for i, t in enumerate(texts)],
                                          "user_id string, submission_id long, paragraph_number int, text string"))


def test_batches_of_twenty(spark):
    df = _paras(spark, ["p " * 200] * 41 + ["short"])
    sizes = [r["count"] for r in M.batch_paragraphs(df).groupBy("batch_no").count().orderBy("batch_no").collect()]
    assert sizes == [20, 20, 1]


def test_batches_and_prompts_need_no_shuffle(spark, sf_small):
    from lectern.plans import catalog
    for name in ("summary_batches", "summary_prompts"):
        plan = catalog.queries()[name](spark, sf_small)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan


def test_paragraphs_from_300_characters_on_are_summarised(spark):
    body = "The ferry left at dawn. " + "It met no other ship on its way. " * 20
    lengths = [1, 299, 300, 301]
    rows, verdicts = M.summarise(_paras(spark, [body[:n - 1] + "." for n in lengths]))
    got = {r.paragraph_number: r.summary for r in rows.collect()}
    assert [got[i] for i in (0, 1)] == [".", body[:298] + "."]
    assert got[2] == got[3] == "The ferry left at dawn."
    assert [v.status for v in verdicts.collect()] == ["ok"]


def test_cap_is_asked_for_and_writes_one_more_than_its_number(spark):
    df = _paras(spark, [f"paragraph {i}" for i in range(150)])
    assert M.summarise(df)[0].count() == 150
    nums = sorted(r.paragraph_number for r in M.summarise(df, cap=M.SUMMARY_CAP)[0].collect())
    assert nums == list(range(101))


def test_a_whole_paragraph_of_the_prompt_is_read(spark):
    text = "First line of it\nsecond line with the end. " + "More words follow. " * 30
    assert M.summarise(_paras(spark, [text]))[0].first().summary == "First line of it\nsecond line with the end."


def test_pluggable_model_runs_in_pandas(spark):
    def model(pdf):
        return pdf["n_items"].map(lambda n: json.dumps(
            {"summaries": [{"paragraph_number": i, "summary": f"S{i}."} for i in range(n, 0, -1)]}))
    rows, verdicts = M.summarise(_paras(spark, ["long text " * 40] * 3 + ["short"]), model=model)
    assert {r.paragraph_number: r.summary for r in rows.collect()} == {0: "S1.", 1: "S2.", 2: "S3.", 3: "short"}


def test_a_broken_answer_fails_its_submission_only(spark):
    def model(pdf):
        return pdf["user_prompt"].map(lambda p: "{" if "broken" in p else json.dumps({"summaries": [{"paragraph_number": 1, "summary": "S."}]}))
    df = spark.createDataFrame([("u", 1, 0, "broken text " * 40), ("u", 1, 1, "short"), ("u", 2, 0, "sound text " * 40)],
                               "user_id string, submission_id long, paragraph_number int, text string")
    rows, verdicts = M.summarise(M.gather(df), model=model)
    assert [(r.submission_id, r.summary) for r in rows.collect()] == [(2, "S.")]
    assert {r.submission_id: r.status for r in verdicts.collect()} == {1: "invalid json", 2: "ok"}
    assert [r.submission_id for r in M.failed_submissions(verdicts).collect()] == [1]


# K2, K7 ----------------------------------------------------------------------

def test_key_decode_quarantine(spark):
    df = spark.createDataFrame([("VOCAB#s#1#a#b",), ("VOCAB#s#x#a",), ("VOCAB#s#3#word",)], "k string")
    rows = {r.k: r for r in K.decode_keys(df, "k", 4).collect()}
    assert rows["VOCAB#s#1#a#b"].reason == "expected 4 parts"
    assert rows["VOCAB#s#x#a"].reason == "paragraph number is not an integer"
    good = rows["VOCAB#s#3#word"]
    assert (good.reason, good.submission_id, good.paragraph_number, good.word) == (None, "s", 3, "word")


def test_prefix_scan_is_byte_ordered(spark):
    df = spark.createDataFrame([("u", "s", 2), ("u", "s", 10)], "user_id string, submission_id string, p int")
    keyed = df.withColumn("k", K.summary_key(F.col("submission_id"), F.col("p")))
    got = [r.p for r in K.scan_prefix(keyed, "k", ["user_id", "submission_id"]).orderBy("scan_position").collect()]
    assert got == [10, 2]


def test_upsert_last_write_wins(spark):
    cur = spark.createDataFrame([("u", "h", 7, "old.txt", 1)], "user_id string, submission_id string, state int, "
                                                               "filename string, created_at long")
    new = spark.createDataFrame([("u", "h", 0, "new.txt", 5)], cur.schema)
    (row,) = K.upsert(cur, new, ["user_id", "submission_id"], ["created_at"]).collect()
    assert (row.state, row.filename) == (0, "new.txt")


# D4, D7, D11 -----------------------------------------------------------------

def test_study_guide_dense_index_uses_counts(spark):
    vocab = spark.createDataFrame([("u", 1, 0, "alpha"), ("u", 1, 5, "beta")],
                                  "user_id string, submission_id long, paragraph_number int, word string")
    sums = spark.createDataFrame([("u", 1, 0, "Start of it", "Sum.")],
                                 "user_id string, submission_id long, paragraph_number int, "
                                 "paragraph_start string, summary string")
    state = spark.createDataFrame([("u", 1, 7)], "user_id string, submission_id long, state int")
    rows = G.study_guide(vocab, sums, state, dense="count").orderBy("paragraph_index").collect()
    assert [r.paragraph_index for r in rows] == [0, 1]
    assert rows[0].vocabulary == ["alpha"] and rows[0].summary == "Sum."
    assert rows[1].vocabulary == [] and rows[1].summary == ""


def test_incomplete_submission_has_no_guide(spark):
    vocab = spark.createDataFrame([("u", 1, 0, "alpha")],
                                  "user_id string, submission_id long, paragraph_number int, word string")
    sums = spark.createDataFrame([], "user_id string, submission_id long, paragraph_number int, "
                                     "paragraph_start string, summary string")
    state = spark.createDataFrame([("u", 1, 3)], "user_id string, submission_id long, state int")
    assert G.study_guide(vocab, sums, state).count() == 0


def test_status_labels(spark):
    df = spark.createDataFrame([(0,), (3,), (7,), (9,), (None,)], "s int")
    got = [r.l for r in df.select(LB.status_label(F.col("s")).alias("l")).collect()]
    assert got == ["received", "processing", "complete", "9", "Invalid state"]


def test_file_size_format(spark):
    df = spark.createDataFrame([(0,), (1024,), (1536,), (1048576,), (500,)], "n long")
    got = [r.l for r in df.select(LB.file_size(F.col("n")).alias("l")).collect()]
    assert got == ["0 Bytes", "1 KB", "1.5 KB", "1 MB", "500 Bytes"]


# S1, S3, S6, S8 --------------------------------------------------------------

def test_object_key_parse(spark):
    df = spark.createDataFrame([("uploads/u/h.tar.txt",), ("x/u/h",), ("uploads/u/.bashrc",)], "key string")
    rows = {r.key: r for r in N.parse_object_keys(df).collect()}
    assert (rows["uploads/u/h.tar.txt"].user_id, rows["uploads/u/h.tar.txt"].submission_id) == ("u", "h.tar")
    assert rows["x/u/h"].reason is not None and rows["x/u/h"].user_id is None
    assert rows["uploads/u/.bashrc"].submission_id == ".bashrc"


def test_notification_envelope(spark):
    rec = {"Records": [{"eventName": "ObjectCreated:Put",
                        "s3": {"bucket": {"name": "b"}, "object": {"key": "uploads/u/h.txt"}}},
                       {"eventName": "ObjectRemoved:Delete",
                        "s3": {"bucket": {"name": "b"}, "object": {"key": "uploads/u/g.txt"}}}]}
    wrapped = {"TopicArn": "arn", "Type": "Notification", "Message": json.dumps(rec)}
    broken = {"TopicArn": "arn", "Type": "Notification", "Message": "nope"}
    df = spark.createDataFrame([(1, json.dumps(rec)), (2, json.dumps(wrapped)), (3, json.dumps(broken))],
                               "id long, body string")
    got = sorted((r.id, r.key) for r in N.decode_notifications(df).collect())
    assert got == [(1, "uploads/u/h.txt"), (2, "uploads/u/h.txt")]


def test_whole_file_scan_replaces_bad_bytes(spark, tmp_path):
    from lectern.sources.files import read_text_files
    (tmp_path / "a.txt").write_bytes(b"a\xffb")
    (row,) = read_text_files(spark, str(tmp_path)).collect()
    assert row.text == "a�b"


def test_paragraph_json_roundtrip_and_quarantine(spark):
    df = spark.createDataFrame([("u", 1, '["a", "b"]'), ("u", 2, '{"a": 1}')],
                               "user_id string, submission_id long, paragraphs_json string")
    good, bad = U.paragraphs_from_json(df)
    assert sorted((r.paragraph_number, r.text) for r in good.collect()) == [(0, "a"), (1, "b")]
    assert [r.submission_id for r in bad.collect()] == [2]


def test_input_gate_precedence(spark):
    df = spark.createDataFrame([(b"file", b"url", "text"), (None, b"url", "text"), (None, None, "text"),
                                (None, None, ""), (None, None, "x" * 20)],
                               "file_bytes binary, url_bytes binary, text string")
    rows = U.gate_inputs(df, max_bytes=10).collect()
    assert [bytes(r.content) if r.content else None for r in rows][:3] == [b"file", b"url", b"text"]
    assert [r.status for r in rows] == [200, 200, 200, 400, 413]


# K4, Z4, Z6, Z2, Z9 ----------------------------------------------------------

def test_bulk_insert_appends_with_run_time(spark, tmp_path):
    rows = spark.createDataFrame([("u", "s", 0, "w")], "user_id string, submission_id string, "
                                                       "paragraph_number int, word string")
    K.append(K.with_write_time(rows, 1234567890), str(tmp_path / "vocab"))
    K.append(K.with_write_time(rows, 1234567891), str(tmp_path / "vocab"))
    back = spark.read.parquet(str(tmp_path / "vocab")).filter("user_id = 'u'")
    assert sorted(r.created_at for r in back.collect()) == [1234567890, 1234567891]


def test_word_marks_latest_wins_and_hide_known(spark):
    from lectern.operators import product as Z
    vocab = spark.createDataFrame([("u", "alpha"), ("u", "beta"), ("u", "gamma")], "user_id string, word string")
    marks = spark.createDataFrame([("u", "alpha", "learned", 1), ("u", "alpha", "known", 2),
                                   ("u", "beta", "not interested", 1)],
                                  "user_id string, word string, mark string, ts long")
    got = {r.word: r.mark for r in Z.word_marks(vocab, marks).collect()}
    assert got == {"alpha": "known", "beta": "not interested", "gamma": "unmarked"}
    assert sorted(r.word for r in Z.hide_known(vocab, marks).collect()) == ["beta", "gamma"]


def test_rename_latest_wins(spark):
    from lectern.operators import product as Z
    subs = spark.createDataFrame([("u", "s", "a.txt"), ("u", "t", "b.txt")],
                                 "user_id string, submission_id string, filename string")
    ren = spark.createDataFrame([("u", "s", "x.txt", 1), ("u", "s", "y.txt", 2)],
                                "user_id string, submission_id string, filename string, ts long")
    assert {r.submission_id: r.filename for r in Z.rename(subs, ren).collect()} == {"s": "y.txt", "t": "b.txt"}


def test_duplicates_flag_later_copies(spark):
    from lectern.operators import product as Z
    subs = spark.createDataFrame([("u", 1, "h", 10), ("u", 2, "h", 20), ("u", 3, "g", 30), ("v", 4, "h", 40)],
                                 "user_id string, doc_id long, submission_id string, created_at long")
    got = {r.doc_id: (r.copies, r.is_duplicate) for r in
           Z.duplicate_submissions(subs, ["user_id"], "submission_id", ["created_at", "doc_id"]).collect()}
    assert got == {1: (2, False), 2: (2, True), 3: (1, False), 4: (1, False)}


def test_missing_stages(spark):
    from lectern.operators import product as Z
    done = spark.createDataFrame([("u", 1), ("u", 2), ("v", 1), ("v", 2), ("v", 4)], "user_id string, bit int")
    assert [(r.user_id, r.stage) for r in Z.missing_stages(done, ["user_id"]).collect()] == [("u", 4)]


def test_user_scan_prunes_partitions(spark, tmp_path):
    import contextlib
    import io
    paras = spark.createDataFrame([("u1", 1, 0, "a"), ("u1", 1, 1, "b"), ("u2", 2, 0, "c")],
                                  "user_id string, submission_id long, paragraph_number int, text string")
    U.write_paragraphs(paras, str(tmp_path / "paragraphs"))
    table = spark.read.parquet(str(tmp_path / "paragraphs"))
    one = K.scan_user(table, "u1")
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        one.explain()
    assert "PartitionFilters: [isnotnull(user_id" in buf.getvalue()
    good, _ = U.paragraphs_from_json(one)
    assert sorted(r.text for r in good.collect()) == ["a", "b"]


def test_stage_stream_quarantines_failures(spark):
    from lectern.streaming import uploads as ST
    _, failed = ST.run_stage_state(spark, "/root/testdata/sf0.001")
    expected = spark.read.parquet("/root/testdata/sf0.001/events.parquet").filter("event_type = 'error'").count()
    assert failed.count() == expected > 0


def test_pos_tag_table_marks_proper_nouns(spark):
    paras = spark.createDataFrame([("u", 1, "en", 0, "Rare words about Obscure things. Obscure people.")],
                                  "user_id string, submission_id long, lang string, paragraph_number int, text string")
    freq = spark.createDataFrame([("en", w, 1, 1e-6, True) for w in ["obscure", "rare"]],
                                 "lang string, word string, n long, freq double, in_lexicon boolean")
    tags = spark.createDataFrame([("obscure", "NNP")], "word string, tag string")
    # heuristic: the mid-sentence "Obscure" is a proper noun, the sentence-initial one is not
    assert {r.word for r in V.uncommon_words(paras, freq).collect()} == {"rare", "obscure"}
    assert {r.word for r in V.uncommon_words(paras, freq, pos_tags=tags).collect()} == {"rare"}
    tags2 = spark.createDataFrame([("rare", "NNP")], "word string, tag string")
    assert {r.word for r in V.uncommon_words(paras, freq, pos_tags=tags2).collect()} == {"obscure"}


def test_treebank_contractions(spark):
    df = spark.createDataFrame([("I can't go, we cannot stay; don't wanna see it.",)], "s string")
    plain = df.select(T.letter_tokens("s").alias("t")).first().t
    split = df.select(T.letter_tokens("s", contractions=True).alias("t")).first().t
    assert plain == ["I", "can", "t", "go", "we", "cannot", "stay", "don", "t", "wanna", "see", "it"]
    assert split == ["I", "ca", "n", "t", "go", "we", "can", "not", "stay", "do", "n", "t", "wan", "na", "see", "it"]


def test_exception_table_overrides_rules(spark):
    words = spark.createDataFrame([("en", w) for w in ["geese", "boxes", "mice"]], "lang string, word string")
    lex = spark.createDataFrame([("en", w) for w in ["goose", "box", "mouse", "mice"]], "lang string, word string")
    exc = spark.createDataFrame([("geese", "noun", "goose"), ("mice", "noun", "mouse")],
                                "word string, cls string, lemma string")
    got = {r.word: r.lemma for r in V.lemmatise(words, lex, exceptions=exc).collect()}
    # "mice" is itself in the lexicon and shorter than "mouse": the shortest wins.
    assert got == {"geese": "goose", "boxes": "box", "mice": "mice"}
    assert {r.word: r.lemma for r in V.lemmatise(words, lex).collect()} == {"boxes": "box", "mice": "mice"}


def test_sentence_split_with_abbreviations(spark):
    df = spark.createDataFrame([("Mr. Smith met Dr. Jones. They talked, e.g. about rain! Done?  Yes.",)], "s string")
    plain = df.select(T.sentences("s").alias("x")).first().x
    guarded = df.select(T.sentences("s", ["Mr", "Dr", "e.g"]).alias("x")).first().x
    assert plain == ["Mr.", "Smith met Dr.", "Jones.", "They talked, e.g.", "about rain!", "Done?", "Yes."]
    assert guarded == ["Mr. Smith met Dr. Jones.", "They talked, e.g. about rain!", "Done?", "Yes."]


def test_format_router(spark):
    from lectern.sources import files as FS
    names = ["a.PDF", "b.docx", "c.doc", "d.Html", "e.htm", "f.txt", "g.md", "h.csv", "i.json", "j.xml",
             "k.xlsx", "l.pptx", "m.rtf", "n.png", "noext", ".hidden", "dir.x/file", "a.b.TXT"]
    df = spark.createDataFrame([(n,) for n in names], "file_name string")
    got = {r.file_name: r.route for r in df.select("file_name", FS.route(F.col("file_name")).alias("route")).collect()}
    assert got == {"a.PDF": "pdf", "b.docx": "docx", "c.doc": "docx", "d.Html": "html", "e.htm": "html",
                   "f.txt": "text", "g.md": "text", "h.csv": "text", "i.json": "text", "j.xml": "text",
                   "k.xlsx": "not implemented", "l.pptx": "not implemented", "m.rtf": "rtf",
                   "n.png": "unsupported", "noext": "unsupported", ".hidden": "unsupported",
                   "dir.x/file": "unsupported", "a.b.TXT": "text"}
    ok, bad = FS.split_routes(df)
    assert sorted(r.file_name for r in ok.collect()) == sorted(
        ["a.PDF", "d.Html", "e.htm", "f.txt", "g.md", "h.csv", "i.json", "j.xml", "a.b.TXT"])
    reasons = {r.file_name: r.reason for r in bad.collect()}
    assert reasons["m.rtf"] == "no extractor for route rtf" and reasons["n.png"].startswith("unsupported file type")


def test_extract_paragraphs_routes_text_html_and_pdf(spark):
    from lectern.sources import files as FS
    long = "word " * 30
    uploads = spark.createDataFrame(
        [("u", "t", "a.txt", f"{long}\n\n\n{long}end"), ("u", "h", "b.html", f"<p>{long}</p><p>short</p>"),
         ("u", "p", "c.pdf", None), ("u", "x", "d.png", "binary")],
        "user_id string, submission_id string, file_name string, content string")
    blocks = spark.createDataFrame(
        [("u", "p", [0], "paragraph", long + "of the", 0, 0), ("u", "p", [1], "paragraph", "house " + long, 1, 1)],
        "user_id string, submission_id string, path array<int>, type string, text string, page_start int, page_end int")
    paras, bad = FS.extract_paragraphs(uploads, lambda pdf: blocks.join(pdf.select("user_id", "submission_id"), ["user_id", "submission_id"], "left_semi"))
    got = sorted((r.submission_id, r.paragraph_number) for r in paras.collect())
    assert got == [("h", 0), ("p", 0), ("t", 0), ("t", 1)]
    assert [r.submission_id for r in bad.collect()] == ["x"]


def test_study_guide_word_order_by_key_or_rank(spark):
    vocab = spark.createDataFrame([("u", 1, 0, "zeta", 1), ("u", 1, 0, "alpha", 2)],
                                  "user_id string, submission_id long, paragraph_number int, word string, rank int")
    sums = spark.createDataFrame([], "user_id string, submission_id long, paragraph_number int, "
                                     "paragraph_start string, summary string")
    state = spark.createDataFrame([("u", 1, 7)], "user_id string, submission_id long, state int")
    assert G.study_guide(vocab, sums, state).first().vocabulary == ["alpha", "zeta"]
    assert G.study_guide(vocab, sums, state, order="rank").first().vocabulary == ["zeta", "alpha"]


def test_stitch_can_drop_the_broken_hyphen(spark):
    a = LONG + " the experi-"
    b = "mental results " + LONG
    out = L.stitch_pages(L.body_blocks(_blocks(spark, [(a, 1, 1), (b, 2, 2)])), drop_hyphen=True)
    assert [r.text for r in out.collect()] == [a[:-1] + b]


def test_study_guide_dense_by_max_index(spark):
    vocab = spark.createDataFrame([("u", 1, 0, "alpha", 1), ("u", 1, 5, "beta", 2)],
                                  "user_id string, submission_id long, paragraph_number int, word string, rank int")
    sums = spark.createDataFrame([("u", 1, 0, "Start", "Sum.")], "user_id string, submission_id long, "
                                 "paragraph_number int, paragraph_start string, summary string")
    state = spark.createDataFrame([("u", 1, 7)], "user_id string, submission_id long, state int")
    rows = G.study_guide(vocab, sums, state).orderBy("paragraph_index").collect()
    assert [r.paragraph_index for r in rows] == [0, 1, 2, 3, 4, 5]
    assert rows[5].vocabulary == ["beta"] and rows[3].vocabulary == []


def test_command_line_runs_a_query(spark, tmp_path, sf_small):
    from lectern.__main__ import main
    out = str(tmp_path / "status")
    assert main(["submission_status", sf_small, out, "--format", "json"]) == 0
    back = spark.read.json(out)
    assert set(back.columns) == {"user_id", "submission_id", "state_sum", "status"} and back.count() > 0


def test_prefix_scan_point_form_is_pushed_down_and_ordered(spark, tmp_path):
    import contextlib
    import io
    rows = [("u", f"SUMMARY#s#{p}") for p in (2, 10, 1)] + [("u", "SUMMARY#t#1"), ("v", "SUMMARY#s#3")]
    spark.createDataFrame(rows, "user_id string, sort_key string").write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    scan = K.prefix_scan(table, "u", "sort_key", "SUMMARY#s#")
    assert [r.sort_key for r in scan.collect()] == ["SUMMARY#s#1", "SUMMARY#s#10", "SUMMARY#s#2"]
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        scan.explain()
    assert "StringStartsWith(sort_key,SUMMARY#s#)" in buf.getvalue()


def test_character_gate_survives_malformed_bytes(spark):
    df = spark.createDataFrame([(b"ab\xff\xfecd", None, None), (b"x" * 30, None, None)],
                               "file_bytes binary, url_bytes binary, text string")
    rows = U.gate_inputs(df, max_bytes=1000, max_chars=10).collect()
    assert [r.status for r in rows] == [200, 413]


def test_listing_is_newest_first_with_defaults(spark):
    subs = spark.createDataFrame(
        [("u", "a", 7, "a.txt", 100), ("u", "b", 0, None, 300), ("u", "c", 3, "c.md", None), ("u", "d", 9, "d.txt", 300)],
        "user_id string, submission_id string, state int, filename string, created_at long")
    rows = G.listing(subs).collect()
    assert [r.id for r in rows] == ["b", "d", "a", "c"]          # 300, 300 (by id), 100, missing as 0
    assert [r.filename for r in rows] == ["Unnamed Document", "d.txt", "a.txt", "c.md"]
    assert [r.status for r in rows] == ["received", "9", "complete", "processing"]
    assert [r.details_link for r in rows] == [False, False, True, False]


def test_documents_without_a_language_keep_their_words(spark):
    """NULL is a language of its own: same words, same counts as under a name."""
    rows = [(1, None, "Cats chase mice. Dogs chased cats."), (2, None, "Mice fear cats."), (3, "en", "Cats like fish.")]
    named = [(i, lang or "xx", text) for i, lang, text in rows]
    ids = spark.createDataFrame([(1,), (2,)], "doc_id long")

    def report(rows):
        docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
        paragraphs = docs.selectExpr("'u' AS user_id", "doc_id AS submission_id", "lang", "1 AS paragraph_number", "text")
        found = V.uncommon_words(paragraphs, V.corpus_statistics(docs, ids), threshold=2.0)
        listed = V.word_frequencies(docs).selectExpr("coalesce(lang, 'xx')", "word", "n", "freq")
        return sorted(map(tuple, found.collect())), sorted(map(tuple, listed.collect()))

    assert report(rows) == report(named)
    assert {r[1] for r in report(rows)[0]} == {1, 2}
