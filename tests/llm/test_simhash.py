from __future__ import annotations

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from lectern.llm import simhash
from tests.llm.conftest import ODD


def brute_fingerprint(text: str | None) -> int:
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    grams = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(points: list[int], bits: int) -> dict[int, int]:
    parent = {p: p for p in points}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    distinct = sorted(set(points))
    for i, a in enumerate(distinct):
        for b in distinct[i + 1:]:
            if (a ^ b).bit_count() <= bits:
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {p: find(p) for p in distinct}


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints_of_odd_texts():
    for _, text in [*ODD, (0, "A b C d"), (0, "a b c d e f g " * 50)]:
        assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_a_block_boundary_changes_nothing(monkeypatch):
    text = " ".join(str(i % 97) for i in range(1000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "BLOCK", 10)
    assert simhash.fingerprint(text) == whole == brute_fingerprint(text)


def test_manhattan_distance_never_exceeds_the_bit_distance(spark):
    rng = random.Random(1)
    pairs = [(signed(a), signed(a ^ (rng.getrandbits(64) & rng.getrandbits(64) & rng.getrandbits(64)))) for a in (rng.getrandbits(64) for _ in range(300))]
    rows = spark.createDataFrame(pairs, "a long, b long").select(
        simhash.distance(simhash.popcounts(F.col("a")), simhash.popcounts(F.col("b"))).alias("low"),
        simhash.distance(F.col("a"), F.col("b")).alias("bits"), "a", "b").collect()
    for r in rows:
        exact = sum(abs((r["a"] >> i & 3).bit_count() - (r["b"] >> i & 3).bit_count()) for i in range(0, 64, 2))
        assert r["low"] == exact <= r["bits"]


@pytest.mark.parametrize("dense,run", [(64, 2048), (2, 8)])
def test_links_keep_every_component(spark, dense, run):
    """Chains of four-bit steps, a crowd of near copies, and loners; with small
    limits nearly every cell is dense and cut into several runs."""
    rng = random.Random(3)
    points = [rng.getrandbits(64) for _ in range(150)]
    for start in points[:20]:
        for _ in range(5):
            start ^= sum(1 << k for k in rng.sample(range(64), 4))
            points.append(start)
    crowd = rng.getrandbits(64)
    points += [crowd ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 3))) for _ in range(150)]
    rows = spark.createDataFrame([(signed(p),) for p in sorted(set(points))], "bits long")
    root = {r["node"]: r["root"] for r in simhash.components(simhash.links(rows, 4, dense, run)).collect()}
    want = brute_components([signed(p) & (1 << 64) - 1 for p in points], 4)
    groups, expected = {}, {}
    for p in set(points):
        groups.setdefault(root.get(signed(p), signed(p)), set()).add(p)
        expected.setdefault(want[p], set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i * 5 % 301, (i + 1) * 5 % 301) for i in range(300)], "a long, b long")
    found = simhash.components(edges).collect()
    assert {r["node"] for r in found} == set(range(301)) and {r["root"] for r in found} == {0}
    assert simhash.components(edges.filter("false")).count() == 0


def test_odd_rows_and_keepers(documents):
    copies = [(20 + i, "the quick brown fox jumps over the lazy dog again and again") for i in range(5)]
    rows = [*ODD, *copies, (19, None), (18, copies[0][1].upper())]
    docs = documents(*rows).withColumnRenamed("source", "bits")
    found = simhash.simhash_components(docs).collect()
    assert len(found) == len(rows)
    expected = {}
    prints = {(i, t): brute_fingerprint(t) for i, t in rows}
    root = brute_components(list(prints.values()), 4)
    for (i, _), p in prints.items():
        if i is not None:
            expected[root[p]] = min(i, expected.get(root[p], i))
    by_print = {f"{p:016x}": expected.get(root[p]) for p in prints.values()}
    assert all(r["component_id"] == by_print[r["fingerprint"]] for r in found)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    assert ids == sorted(set(expected.values()))
    twice = documents((50, "one text of this id, long enough for shingles"), (50, "another text that shares nothing with it at all"), (51, None), (50, None))
    assert sorted((r["doc_id"], r["text"] or "") for r in simhash.keep_one(twice).collect()) == [
        (50, ""), (50, "another text that shares nothing with it at all"), (50, "one text of this id, long enough for shingles")]
    assert simhash.simhash_components(docs.filter("false")).count() == 0 == simhash.keep_one(docs.filter("false")).count()
