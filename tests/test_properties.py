"""Properties and case tables: nothing is lost, order is kept, counts add up,
and Python's own library agrees where it has the same function."""

from __future__ import annotations

import html
import json
import os
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import html as H
from lectern.functions import labels as LB
from lectern.functions import text as T
from lectern.operators import keyed as K
from lectern.operators import layout as L
from lectern.operators import segment as S
from lectern.operators import summaries as M
from lectern.sources import notifications as N
from lectern.sources import uploads as U

QUICK = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
WORDS = st.text(alphabet="abcXYZé  \t\n.,-", max_size=40)


def column(spark, values, expr, kind="string"):
    """``expr`` of column ``x`` for each value, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


@QUICK
@given(st.lists(WORDS, min_size=1, max_size=8))
def test_cleaning_is_idempotent_and_keeps_the_words(spark, texts):
    once = column(spark, texts, T.clean_paragraph)
    assert once == [" ".join(t.split()) for t in texts]
    assert column(spark, once, T.clean_paragraph) == once


@QUICK
@given(st.lists(st.text(alphabet="abÀÿ×÷1_ -'", max_size=30), min_size=1, max_size=8))
def test_tokens_are_all_the_letters_in_order(spark, texts):
    tokens = column(spark, texts, T.letter_tokens)
    for text, found in zip(texts, tokens):
        assert "".join(found) == "".join(c for c in text if c in "abÀÿ×÷")
        assert all(found)


@QUICK
@given(st.lists(st.text(alphabet="a.b-/", min_size=1, max_size=12), min_size=1, max_size=8))
def test_file_names_split_as_the_library_splits(spark, names):
    bases = [os.path.basename(n) for n in names]
    assert column(spark, bases, N.strip_extension) == [os.path.splitext(b)[0] for b in bases]
    assert column(spark, bases, U.file_extension) == [os.path.splitext(b)[1] for b in bases]


@QUICK
@given(st.lists(WORDS, min_size=1, max_size=6))
def test_blank_line_pieces_lose_nothing_but_space(spark, texts):
    for text, pieces in zip(texts, column(spark, texts, S.blank_line_split)):
        assert "".join("".join(p.split()) for p in pieces) == "".join(text.split())
        assert all(p and p == p.strip() and "\n\n" not in p for p in pieces)


@QUICK
@given(st.lists(st.lists(st.sampled_from(["one\n\ntwo", "three", "", "\n\n", "four\n", None, "five\n\n\nsix"]), min_size=1, max_size=5), min_size=1, max_size=4))
def test_pieces_number_as_the_joined_text_does(spark, conversations):
    rows = [(c, i, t) for c, turns in enumerate(conversations) for i, t in enumerate(turns)]
    got = S.number_pieces(spark.createDataFrame(rows, "submission_id int, turn int, text string"), S.blank_line_split("text")).collect()
    joined = ["\n\n".join(t for t in turns if t is not None) for turns in conversations]
    want = {(c, i): p for c, pieces in enumerate(column(spark, joined, S.blank_line_split)) for i, p in enumerate(pieces)}
    assert {(r.submission_id, r.paragraph_number): r.text for r in got} == want and len(got) == len(want)


def test_a_repeated_piece_counts_as_often(spark):
    rows = spark.createDataFrame([(1, 0, "a\n\nb"), (1, 0, "a\n\nb"), (1, 1, "c")], "submission_id int, turn int, text string")
    got = sorted((r.paragraph_number, r.text) for r in S.number_pieces(rows, S.blank_line_split("text")).collect())
    assert got == [(0, "a"), (1, "b"), (2, "a"), (3, "b"), (4, "c")]


BLOCK_TEXTS = st.sampled_from(["the long block that breaks off in mid-", "another block that simply runs on", "A full sentence that ends properly here.",
                               "continues with lower case letters right away", "Begins with an upper case letter and goes on"])


@QUICK
@given(st.lists(st.tuples(BLOCK_TEXTS, st.integers(0, 2)), min_size=1, max_size=10), st.booleans())
def test_stitching_keeps_every_character_in_order(spark, raw, drop):
    page, rows = 1, []
    for i, (text, step) in enumerate(raw):
        page += step
        rows.append((1, [i], "paragraph", text, page, page))
    blocks = spark.createDataFrame(rows, "doc_id int, path array<int>, type string, text string, page_start int, page_end int")
    out = [r.text for r in L.stitch_pages(blocks, drop_hyphen=drop).orderBy("paragraph_number").collect()]
    squeezed = re.sub(r"\s", "", "".join(out))
    whole = re.sub(r"\s", "", "".join(t for t, _ in raw))
    assert squeezed.replace("-", "") == whole.replace("-", "")
    assert drop or squeezed == whole
    # A paragraph is only ever continued across a page, by a lower-case start.
    assert len(out) >= 1 + sum(step > 0 and text[0].isupper() for text, step in raw[1:])


@QUICK
@given(st.lists(st.integers(0, 700), max_size=60), st.integers(1, 25))
def test_batches_are_contiguous_and_bounded(spark, lengths, size):
    rows = [("u", 1, [{"paragraph_number": i, "text": "x" * n} for i, n in enumerate(lengths)])]
    df = spark.createDataFrame(rows, "user_id string, submission_id int, paragraphs array<struct<paragraph_number:int,text:string>>")
    got = sorted((r.batch_no, r.item_no, r.paragraph_number) for r in M.batch_paragraphs(df, size).collect())
    long = [i for i, n in enumerate(lengths) if n >= M.MIN_SUMMARY_CHARS]
    assert [p for _, _, p in got] == long
    assert [(b, i) for b, i, _ in got] == [(k // size, k % size + 1) for k in range(len(long))]


REFERENCES = st.lists(st.sampled_from(["&amp;", "&lt;", "&#38;", "lt;", "&#x41;", "&eacute;", "&mdash;", "&nosuch;", "&copy", "&", "a", ";", "&#150;", "&#0;",
                                       "&euro;", " ", "&AMP;", "&frac12;", "&#xD800;", "&notin;"]), max_size=8).map("".join)


@QUICK
@given(st.lists(REFERENCES, min_size=1, max_size=10))
def test_references_decode_as_the_library_decodes(spark, texts):
    assert column(spark, texts, H.decode_entities) == [html.unescape(t) for t in texts]


CAPS = ["ABC", "ABC DEF 12", "AbC", "abc", "123", "", "ABCª", "ABCǅ", "ÀÉÎ", "ß", "ŒUVRE", "ⅷ", "Ⅷ", "日本", "ABC日", "ª"]


@pytest.mark.parametrize("text", CAPS)
def test_all_caps_as_the_library_tells(spark, text):
    assert column(spark, [text], L.is_all_caps) == [text.isupper()]


@pytest.mark.parametrize("text,kept", [
    ("x" * 40, False), ("x" * 41, True), ("  " + "x" * 40 + "  ", False), ("X" * 41, False), ("X" * 80, False), ("X" * 81, True), ("X" * 50 + "y", True),
    ("1" * 41, True), ("", False), (" " * 50, False)])
def test_body_blocks(spark, text, kept):
    blocks = spark.createDataFrame([(text,)], "text string")
    assert (L.body_blocks(blocks).count() == 1) == kept


@pytest.mark.parametrize("size,label", [(0, "0 Bytes"), (1, "1 Bytes"), (1023, "1023 Bytes"), (1024, "1 KB"), (1536, "1.5 KB"), (1234567, "1.18 MB"),
                                        (5 << 30, "5 GB"), (3 << 40, "3072 GB")])
def test_file_sizes(spark, size, label):
    assert column(spark, [size], LB.file_size, "long") == [label]


@pytest.mark.parametrize("mime,icon", [
    ("application/pdf", "pdf"), ("image/png", "image"), ("text/plain", "text"), ("application/xhtml+html", "text"), ("text/markdown", "text"),
    ("application/msword", "document"), ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", "document"), ("application/zip", "other"), ("", "other")])
def test_mime_classes(spark, mime, icon):
    assert column(spark, [mime], LB.mime_class) == [icon]


@pytest.mark.parametrize("name,accepted", [("a.txt", True), ("a.TXT", True), ("a.tar.md", True), ("a.csv", False), ("md", True), ("", False), ("a.", False), ("x.jpeg", True)])
def test_upload_form_accepts(spark, name, accepted):
    assert column(spark, [name], LB.ui_accepts) == [accepted]


@pytest.mark.parametrize("state,label", [(0, "received"), (1, "processing"), (6, "processing"), (7, "complete"), (8, "8"), (14, "14"), (None, "Invalid state")])
def test_status_of_a_state(spark, state, label):
    assert column(spark, [state], LB.status_label, "int") == [label]


KEYS = [
    ("uploads/ann/abc.txt", "ann", "abc", None), ("uploads/ann/abc", "ann", "abc", None), ("uploads/ann/abc.tar.gz", "ann", "abc.tar", None),
    ("uploads/ann/x/y.txt", "ann", "x", None), ("uploads/ann", None, None, "invalid object key: uploads/ann"), ("other/ann/abc.txt", None, None, "invalid object key: other/ann/abc.txt"),
    ("", None, None, "invalid object key: "), (None, None, None, "no object key")]


@pytest.mark.parametrize("key,user,submission,reason", KEYS)
def test_object_keys(spark, key, user, submission, reason):
    row = N.parse_object_keys(spark.createDataFrame([(key,)], "key string")).first()
    assert (row.user_id, row.submission_id, row.reason) == (user, submission, reason)


@pytest.mark.parametrize("key,number,word,reason", [
    ("VOCAB#s#3#word", 3, "word", None), ("any#s#-1#", -1, "", None), ("VOCAB#s#3", None, None, "expected 4 parts"), ("VOCAB#s#3#a#b", None, None, "expected 4 parts"),
    ("VOCAB#s#three#w", None, None, "paragraph number is not an integer"), ("VOCAB#s##w", None, None, "paragraph number is not an integer")])
def test_sort_keys(spark, key, number, word, reason):
    row = K.decode_keys(spark.createDataFrame([(key,)], "k string"), "k", 4).first()
    assert (row.paragraph_number, row.word, row.reason) == (number, word, reason)


@QUICK
@given(st.lists(st.tuples(st.integers(0, 10**6), st.integers(0, 10**6), st.text(alphabet="abc-é", max_size=8)), min_size=1, max_size=8))
def test_encoded_sort_keys_decode_to_themselves(spark, parts):
    rows = spark.createDataFrame(parts, "s long, n long, w string")
    keys = rows.select("*", K.vocab_key(F.col("s"), F.col("n"), F.col("w")).alias("k"))
    for r in K.decode_keys(keys, "k", 4).collect():
        assert (r.submission_id, r.paragraph_number, r.word, r.reason) == (str(r.s), r.n, r.w, None)


def put(key: str | None, name: str = "ObjectCreated:Put") -> dict:
    return {"eventName": name, "s3": {"bucket": {"name": "b"}, "object": {"key": key}}}


def envelope(message: str, kind: str = "Notification") -> str:
    return json.dumps({"TopicArn": "t", "Type": kind, "Message": message})


MESSAGES = [
    (json.dumps({"Records": [put("a"), put("b")]}), ["a", "b"], None), (json.dumps({"Records": [put("a", "ObjectRemoved:Delete")]}), [], None),
    (envelope(json.dumps({"Records": [put("a")]})), ["a"], None), (envelope("not json"), [], "enveloped message is not JSON"),
    (envelope(json.dumps({"Records": [put("a")]}), "Other"), [], None), ("not json", [], "body is not JSON"), (None, [], "body is not JSON"), ("{}", [], None),
    (json.dumps({"Records": []}), [], None)]


@pytest.mark.parametrize("body,keys,reason", MESSAGES)
def test_messages(spark, body, keys, reason):
    rows = spark.createDataFrame([(1, body)], "event_id int, body string")
    assert [r.key for r in N.decode_notifications(rows).collect()] == keys
    assert [r.reason for r in N.undecodable(rows).collect()] == ([reason] if reason else [])


def answers(*numbers, summary="s") -> str:
    return json.dumps({"summaries": [{"paragraph_number": n, "summary": summary} for n in numbers]})


@pytest.mark.parametrize("n,response,status", [
    (2, answers(1, 2), "ok"), (2, answers(2, 1), "ok"), (2, answers(1), "wrong count"), (2, answers(1, 2, 3), "wrong count"), (2, answers(1, 1), "missing numbers"),
    (2, answers(0, 1), "missing numbers"), (2, answers(1, 2, summary=None), "missing summary"), (2, "", "empty response"), (2, "  ", "empty response"), (2, None, "empty response"),
    (2, '{"summaries": [', "invalid json"), (2, "[]", "wrong count"), (1, '{"other": 1}', "wrong count")])
def test_verdicts(spark, n, response, status):
    row = spark.createDataFrame([("u", 1, 0, n, response)], "user_id string, submission_id int, batch_no int, n_items int, response string")
    assert M.validate_responses(row).first().status == status


HTML_CASES = [
    ("<p>if x < 5 and y > 3 holds</p>", ["if x < 5 and y > 3 holds"], ["if x < 5 and y > 3 holds"]),
    ('<p>a <a title="x > y" href=z>link</a> b</p>', ["a link b"], ["alinkb"]),
    ("<p-card>no</p-card><p>yes</p>", ["yes"], ["yes"]), ("<p class=a>one<p>two<div>three</div>", ["one", "two"], ["one", "two"]),
    ("<p>caf&eacute; &mdash; 5&euro; &#38;lt; &amp;lt;</p>", ["café — 5€ &lt; &lt;"], ["café — 5€ &lt; &lt;"]),
    ("<script>var t='<p>no</p>'</script><p>a<!-- <p>no</p> -->b</p>", ["ab"], ["ab"]), ("<p>one<figcaption>x</figcaption>", ["one"], ["one"]),
    ("<p> <b> a </b> c </p><p> </p>", ["  a  c ", " "], ["ac"]), ("<P\n ID='x'>Up</P >", ["Up"], ["Up"]), ("no paragraph", [], []), ("", [], []),
]


@pytest.mark.parametrize("page,full,stripped", HTML_CASES)
def test_html_paragraphs(spark, page, full, stripped):
    assert column(spark, [page], H.paragraph_texts) == [full]
    assert column(spark, [page], lambda x: H.stripped_paragraph_texts(H.visible(x))) == [stripped]


def test_layout_below_other_nodes(spark):
    rows = [([0], "page"), ([0, 0], "paragraph"), ([0, 0, 0], "paragraph"), ([0, 1], "table"), ([0, 1, 0], "paragraph"), ([0, 1, 0, 0], "paragraph"),
            ([1], "heading"), ([1, 0], "subtitle"), ([1, 0, 5], "paragraph"), ([2], "list"), ([2, 0], "page"), ([2, 0, 1], "paragraph"), ([3], "paragraph")]
    blocks = spark.createDataFrame([(1, p, t) for p, t in rows], "doc_id int, path array<int>, type string")
    got = sorted(r.path for r in L.flatten_layout(blocks).collect())
    assert got == [[0, 0], [0, 0, 0], [1, 0, 5], [3]]


def test_paths_from_parent_pointers(spark):
    rows = [(1, "r", None, 0), (1, "a", "r", 0), (1, "b", "r", 1), (1, "c", "b", 0), (1, "lost", "nobody", 0), (2, "r", None, 3)]
    nodes = spark.createDataFrame(rows, "doc_id int, node_id string, parent_id string, position int")
    got = {(r.doc_id, r.node_id): r.path for r in L.paths_from_parents(nodes).collect()}
    assert got == {(1, "r"): [0], (1, "a"): [0, 0], (1, "b"): [0, 1], (1, "c"): [0, 1, 0], (2, "r"): [3]}
