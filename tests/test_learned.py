"""Learned language tables: golden corpora with known answers."""

from __future__ import annotations

import duckdb
import pytest

from lectern.operators import learned as LL
from lectern.plans import learned, oracle
from lectern.plans.compare import differences

TEXTS = "lang string, text string"


def test_abbreviations_keep_their_dot(spark):
    rows = [("en", "Mr. Hale met Dr. Stone at the pier. The late boat was late. They spoke of the boat and the pier again and again.")] * 40
    rows += [("de", "Das Boot kam z.B. spät an. Es war ein Boot. Das Boot lag am Pier, z.B. heute.")] * 40
    rows += [(None, "no. 4 of no. 9 is here. here it is.")] * 20
    table = LL.abbreviations(spark.createDataFrame(rows, TEXTS))
    found = {(r.lang, r.type) for r in table.collect()}
    assert {("en", "mr"), ("en", "dr"), ("de", "z.b"), (None, "no")} <= found
    assert not {("en", "pier"), ("en", "boat"), ("en", "late"), ("de", "boot"), ("en", "z.b")} & found
    paragraphs = spark.createDataFrame([
        (1, "en", "Mr.  Hale left. Dr. Stone stayed! He said z.B. nothing. Mr."), (2, "de", "So z.B. dort.\nMr. Hale kam."), (3, None, "See no. 4. Yes."),
        (4, "xx", "Mr. Hale."), (5, "en", ""), (6, "en", None), (7, "en", "Dr. Mr. Dr. x. y")], "id int, lang string, text string")
    got = {}
    for r in LL.split_sentences_learned(paragraphs, table).orderBy("id", "sentence_number").collect():
        got.setdefault(r.id, []).append(r.sentence)
    assert got == {1: ["Mr.  Hale left.", "Dr. Stone stayed!", "He said z.B.", "nothing.", "Mr."], 2: ["So z.B. dort.", "Mr.", "Hale kam."],
                   3: ["See no. 4.", "Yes."], 4: ["Mr.", "Hale."], 5: [""], 7: ["Dr. Mr. Dr. x.", "y"]}


def test_names_go_and_german_nouns_stay(spark):
    rows = [("en", "The clerk met Keller in the house by the river. Then the clerk saw Keller again in the garden near the old mill house.")] * 30
    rows += [("de", "Der Mann sah Keller im Haus am Fluss. Die Frau kam mit dem Hund zum Haus und der Garten war im Regen nass.")] * 30
    rows += [("fr", "Le client parle avec Paris dans la maison. Une fois la maison est vide on voit le jardin et le moulin de la ville.")] * 30
    found = {(r.lang, r.word) for r in LL.proper_nouns(spark.createDataFrame(rows, TEXTS)).collect()}
    assert {("en", "keller"), ("de", "keller"), ("fr", "paris")} <= found
    assert not {("de", w) for w in ("haus", "mann", "hund", "garten", "frau")} & found
    assert not {("en", w) for w in ("the", "then", "house")} & found


def test_rules_are_the_languages_own(spark):
    stems = [f"{a}{b}l" for a in "bdfgklm" for b in "aeiou"]
    words = [("aa", w + s) for w in stems for s in ("", "en")] + [("bb", w + s) for w in stems for s in ("o", "os")] + [(None, w + s) for w in stems for s in ("", "ak")]
    frame = spark.createDataFrame(words + [("aa", "x"), ("bb", "ende")], "lang string, word string")
    rules = LL.suffix_rules(frame)
    best = {(r.lang, r.suffix): r.ending for r in rules.collect()}
    assert best["aa", "en"] == "" and best["bb", "os"] == "o" and best[None, "ak"] == "" and ("aa", "os") not in best
    lemmas = {(r.lang, r.word): r.lemma for r in LL.lemmatise_learned(frame, frame, rules).collect()}
    assert lemmas["aa", "balen"] == "bal" and lemmas["bb", "bilos"] == "bilo" and lemmas[None, "mulak"] == "mul" and lemmas["bb", "ende"] == "ende"


def test_jargon_of_one_source_is_not_common(spark):
    rows = [("en", f"s{i}", "plain words of the day " * 20 + ("jargon " * 900 if i == 3 else "")) for i in range(8)] + [("en", None, "plain words"), (None, "s1", "alone")]
    found = {(r.lang, r.word): r for r in LL.source_frequencies(spark.createDataFrame(rows, "lang string, source string, text string")).collect()}
    assert found["en", "jargon"].freq == 0 and found["en", "jargon"].n == 900 and found["en", "jargon"].n_sources == 1
    assert found["en", "plain"].freq == pytest.approx(0.2) and found["en", "plain"].n_sources == 9
    assert found[None, "alone"].freq == 1


def test_twins_keep_rows_without_a_language(spark, tmp_path, sf_small):
    """The twins and the queries agree where ``lang`` and ``source`` have NULLs."""
    from lectern.plans import catalog
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    nulled = docs.selectExpr("doc_id", "text", "IF(doc_id % 3 = 0, NULL, lang) AS lang", "IF(doc_id % 5 = 0, NULL, source) AS source", "n_chars")
    nulled.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_small}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    for name, query in {**learned.QUERIES, "vocabulary_all_languages": catalog.vocabulary_all_languages,
                        "word_frequency_table": catalog.word_frequency_table}.items():
        df = query(spark, str(tmp_path))
        rows = [tuple(r) for r in df.collect()]
        res = con.execute(oracle.oracle_sql()[name])
        assert rows and differences(df.columns, rows, [c[0] for c in res.description], res.fetchall()) == [], name
