"""Sharding, line rules and URL reputation."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from lectern.llm import line_rules, sharding, url_reputation
from lectern.llm.common import save
from tests.llm.conftest import ODD


def brute_shards(rows, shards):
    """(id, size, crc) in order of fractional rank, cut into equal counts."""
    by_source = {}
    for doc_id, text, source in rows:
        raw = (text or "").encode()
        digest = hashlib.md5(f"{sharding.SEED}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        by_source.setdefault(source, []).append(
            (int(digest[:8], 16) % sharding.BUCKETS, digest, (doc_id is not None, doc_id or 0), len(raw) + 1, zlib.crc32(raw), doc_id))
    placed = []
    for source, items in by_source.items():
        for rank, item in enumerate(sorted(items), 1):
            placed.append((Fraction(2 * rank - 1, 2 * len(items)), (source is not None, source or ""), item[1:]))
    placed.sort()
    small, larger = divmod(len(placed), shards)
    out, at = [], 0
    for shard in range(shards):
        for slot in range(small + (shard < larger)):
            _, _, (_, _, size, crc, doc_id) = placed[at]
            out.append((doc_id, size, crc, shard, slot))
            at += 1
    return out


@pytest.mark.parametrize("shards", [1, 4, 16, 700])
def test_shards_equal_the_plain_order(documents, shards):
    rows = [(i, "t" * (i % 50), "en", ["big", "big", "big", "mid", None][i % 5] if i % 37 else f"rare{i}") for i in range(500)]
    rows += [(i, t, "en", "odd") for i, t in ODD]
    docs = documents(*rows).withColumnRenamed("lang", "bucket")
    got = sharding.shard_assignment(docs, shards).collect()
    assert Counter(map(tuple, got)) == Counter(brute_shards([(r[0], r[1], r[3]) for r in rows], shards))
    assert sharding.shard_assignment(docs.filter("false"), shards).count() == 0


def test_hot_keys_are_cut(documents):
    """One-row sources, rows without an id and equal rows spread over the partitions."""
    rows = [(None, "t", "en", "none")] * 3000 + [(7, "u", "en", "same")] * 1500 + [(i, "x", "en", f"s{i}") for i in range(1500)]
    docs = documents(*rows).repartition(8).withColumn("shard", F.lit(1))
    placed = sharding.shard_assignment(docs, 7)
    assert Counter(r["shard"] for r in placed.collect()) == Counter({k: 858 if k < 1 else 857 for k in range(7)})
    for order in (("source", "id"), ("source",)):
        sizes = sorted(sharding._numbered(docs.selectExpr("doc_id AS id", "source", "monotonically_increasing_id() AS row"), *order, "row")
                       .groupBy("part").count().toPandas()["count"])
        assert len(sizes) == 1 or sizes[-1] <= 3 * sizes[len(sizes) // 2]


def test_columns_named_like_the_place(documents, spark, tmp_path):
    docs = documents(*[(i, "x", "en") for i in range(30)]).withColumnsRenamed({"lang": "shard", "n_chars": "slot"})
    sharding.write_shards(docs, f"{tmp_path}/out", 4)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 30 and {r["own_shard"] for r in back.collect()} == {"en"} and {r["own_slot"] for r in back.collect()} == {1}


def test_line_rules_of_a_very_long_text(documents):
    (row,) = line_rules.clean(documents((1, "word " * 6_000_000 + "\n" + "-" * 31_000_000))).collect()
    assert row["n_words"] == 6_000_001 and not row["kept"] and row["word_chars"] == 55_000_000


def test_every_shard_matches_the_mixture(documents):
    docs = documents(*[(i, "x", "en", "abc"[min(i % 6, 2)]) for i in range(1200)])
    placed = sharding.shard_assignment(docs, 16).join(docs.select("doc_id", "source"), "doc_id")
    share = {"a": 200, "b": 200, "c": 800}
    for r in placed.groupBy("shard", "source").count().collect():
        assert abs(r["count"] - share[r["source"]] / 16) <= 2


def test_written_shards_hold_their_slots(documents, spark):
    docs = documents(*[(i, f"text {i}", "en", str(i % 3)) for i in range(90)])
    folder = save(docs, "for-shards").inputFiles()[0].rpartition("/")[0] + "-written"
    sharding.write_shards(docs, folder, 4)
    back = spark.read.parquet(folder)
    assert Counter((r["doc_id"], r["shard"], r["slot"]) for r in back.collect()) == Counter(
        (r["doc_id"], r["shard"], r["slot"]) for r in sharding.shard_assignment(docs, 4).collect())


def test_repeated_rows_and_rows_without_an_id_are_written_once(documents, spark):
    rows = [(7, "again", "en", "a")] * 40 + [(None, f"no id {i % 9}", "en", "b") for i in range(30)] + [(i, None, "de", None) for i in range(20)]
    docs = documents(*rows, (7, "other text", "fr", "b"))
    folder = save(docs, "for-shards").inputFiles()[0].rpartition("/")[0] + "-repeated"
    sharding.write_shards(docs, folder, 4)
    back = spark.read.parquet(folder)
    assert set(back.columns) == {*docs.columns, "shard", "slot"}
    assert Counter(map(tuple, back.select(docs.columns).collect())) == Counter(map(tuple, docs.collect()))
    placed = [(r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode()), r["shard"], r["slot"]) for r in back.collect()]
    assert Counter(placed) == Counter(map(tuple, sharding.shard_assignment(docs, 4).collect()))


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    times = Counter(runs)
    covered = {k for i, r in enumerate(runs) if times[r] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_counts_of_line_rules(documents):
    cycle = " ".join("abcdefghijk"[i % 11] for i in range(200))
    extra = [(40, "a b c d e f g h i j a b c d e f g h"), (41, "x " * 8 + "y " + "x " * 9), (42, "l1.\nl1.\n\nl2.\nl1. "), (43, cycle)]
    rows = [*ODD, *extra]
    got = line_rules.clean(documents(*rows).withColumnRenamed("source", "words")).collect()
    assert Counter((r["doc_id"], *map(int, (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]))) for r in got) == \
        Counter((i, *brute_counts(t)) for i, t in rows)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    assert line_rules.clean(documents((1, "x")).filter("false")).count() == 0


GOOD = "This line of plain prose tells a short story and then it ends."
CASES = [
    (GOOD, True), ("He said \"stop.\"", True), ("這是一句話。", True), ("no end mark at all", False),
    ("Home | News | Sports | Weather | About.", False), ("Shop > Tools > Hammers.", False), ("A rule x > y > z in a longer line of prose that goes on and on for more than two separators should need, and then it ends with the words it began with.", True),
    ("Menu", False), (" read more ", False), ("All rights reserved.", False), ("We uses cookies here.", False),
    (GOOD + " " + "Then a much longer account follows of how a library was released under another licence. " * 3, True),
    ("wow!!! ### $$$ %%% so.", False), ("ends with a mark?", True), ("Version 3.5 has no end", False),
]


@pytest.mark.parametrize("line,passes", CASES)
def test_single_lines(documents, line, passes):
    text = f"{GOOD} {GOOD}\n{line}\n{GOOD}"
    row = line_rules.clean(documents((1, text))).first()
    assert (line in row["clean_text"].split("\n")) == passes


def test_documents_that_lose_too_much_go(documents):
    prose = " ".join([f"Sentence {i} is here." for i in range(10)])
    bad = " ".join(f"word{i}" for i in range(200))
    rows = {r["doc_id"]: r for r in line_rules.clean(documents((1, prose), (2, prose + "\n" + bad), (3, bad + "\n" + "\n".join([prose.replace("is", f"was{k}") for k in range(9)])))).collect()}
    assert rows[1]["kept"] and not rows[2]["kept"] and not rows[2]["base_failed"] and rows[3]["kept"]


def test_rules_and_parts_of_urls(spark):
    cases = [
        ("https://a.Example.ORG/en/2", "a.example.org", "/en/2", "org/", "allow"),
        ("https://example.org/en/17?x=1#y", "example.org", "/en/17", "example.org/en/1", "block"),
        ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        ("http://m.example.org/es/9", "m.example.org", "/es/9", "example.org/es/", "block"),
        ("http://shop.com/de/1", "shop.com", "/de/1", "com/de/", "block"), ("http://shop.com/fr/1", "shop.com", "/fr/1", "com/fr/", "allow"),
        ("http://x.org?q=/es/", "x.org", "", None, None), ("http://x.org#a", "x.org", "", None, None),
        ("http://É.ORG/", "É.org", "/", "org/", "allow"), ("a://b://c/d", "b:", "//c/d", None, None),
        (None, "", "", None, None), ("no scheme/org/", "", "", None, None), ("://", "", "", None, None),
    ]
    pages = spark.createDataFrame([(i, c[0], "extra") for i, c in enumerate(cases)], "page_id long, url string, host string")
    for r in url_reputation.judge(pages).collect():
        _, host, path, rule, verdict = cases[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] in ("allow", "block") and (verdict is None or r["verdict"] == verdict)
    assert url_reputation.judge(pages.filter("false")).count() == 0


def test_a_host_of_blocked_pages_is_blocked(spark):
    rows = [f"http://bad{k}.spam.com/de/{i}" for k in range(4) for i in range(60)] + [f"http://good{k}.fine.com/fr/{i}" for k in range(4) for i in range(60)]
    rows += ["http://bad1.spam.com/x", "http://new.spam.com/x", "http://good2.fine.com/x", "http://new.fine.com/x", "http://unknown.net/x"]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    found = {rows[r["page_id"]]: r for r in url_reputation.judge(pages).collect()}
    assert found["http://bad1.spam.com/x"]["verdict"] == "block"
    assert found["http://new.spam.com/x"]["good_upper"] < found["http://unknown.net/x"]["good_upper"] < found["http://new.fine.com/x"]["good_upper"]
    for url in ("http://good2.fine.com/x", "http://new.fine.com/x", "http://unknown.net/x"):
        assert found[url]["verdict"] == "allow"


def test_longest_rule_wins(spark):
    rules = (url_reputation.Rule("a.com", "/", True), url_reputation.Rule("a.com", "/x/", False), url_reputation.Rule("a.com", "/x/y", True))
    row = spark.createDataFrame([("a.com", "/x/yz")], "host string, path string").select(
        *[c.alias(n) for c, n in zip(url_reputation.labelled(F.col("host"), F.col("path"), rules), ("rule", "allow"))]).first()
    assert (row["rule"], row["allow"]) == ("a.com/x/y", True)
