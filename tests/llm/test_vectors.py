"""Whitening and exact top-k search against plain numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from lectern.llm import topk, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")


# ---- spectrum slicing --------------------------------------------------------

@pytest.mark.parametrize("seed", range(12))
def test_inertia_equals_the_signs_of_the_spectrum(seed):
    random = np.random.default_rng(seed)
    n = int(random.integers(1, 40))
    a = random.standard_normal((n, n))
    a = a + a.T
    signs = np.linalg.eigvalsh(a)
    assert whitening.inertia(a) == ((signs < 0).sum(), 0, (signs > 0).sum())
    for shift in random.uniform(-5, 5, 5):
        assert whitening.count_above(a, shift) == (signs > shift).sum()


def test_inertia_of_zero_rows_and_hollow_blocks():
    assert whitening.inertia(np.zeros((3, 3))) == (0, 3, 0)
    assert whitening.inertia(np.array([[0.0, 1.0], [1.0, 0.0]])) == (1, 0, 1)
    assert whitening.inertia(np.empty((0, 0))) == (0, 0, 0)


@pytest.mark.parametrize("spectrum", [
    [9, 7, 5, 3, 2, 1], [5, 5, 5, 1, 1, 0], [4, 4 + 1e-9, 2, 1e-3, 1e-6, 1e-9], [3], [2, 0, 0, 0], [1e12, 1, 1e-2], [1] * 12,
    list(np.linspace(1, 1.0001, 20)), [0, 0]])
def test_leading_pairs_of_given_spectra(spectrum):
    random = np.random.default_rng(1)
    basis = np.linalg.qr(random.standard_normal((len(spectrum),) * 2))[0]
    matrix = basis @ np.diag(np.array(spectrum, float)) @ basis.T
    matrix = (matrix + matrix.T) / 2
    values, vectors = whitening.leading_eigenpairs(matrix, 8)
    expected = np.sort(spectrum)[::-1][:8]
    expected = expected[expected > 1e-11 * max(1e-300, max(spectrum))]
    top = max([*spectrum, 1e-300])
    # Values lost in rounding may or may not be told from zero; none above is missed.
    assert abs(len(values) - len(expected)) <= (np.array(spectrum) <= 1e-11 * top).sum()
    k = min(len(values), len(expected))
    assert np.allclose(values[:k], expected[:k], rtol=0, atol=1e-13 * len(spectrum) * top)
    assert np.allclose(vectors @ vectors.T, np.eye(len(values)), atol=1e-12)
    assert np.allclose(matrix @ vectors.T, vectors.T * values, atol=1e-11 * top)


# ---- whitening ---------------------------------------------------------------

def _brute(rows, components=8):
    x = np.array([[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v] for v in rows], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    exact = n * x - sums
    c = (exact / n).astype(float)
    values, vectors = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-values)[:components]
    order = order[values[order] > 1e-9 * max(values)]
    return n, (exact ** 2).sum(axis=1), c @ vectors[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def _check_whitened(df, kept, components=8):
    n, deviation, white, share = _brute([v for _, v in kept], components)
    got = whitening.whiten(df, components).collect()
    assert len(got) == len(kept) * white.shape[1]
    assert all(r["n"] == n and 0 <= r["identity_error"] < 1e-9 for r in got)
    by_component = {}
    for r in got:
        by_component.setdefault(r["component"], []).append((r["vec_id"] is not None, r["vec_id"] or 0, r["deviation"], r["whitened"], r["explained"]))
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is not None, kept[i][0] or 0, deviation[i]))
    for k in range(white.shape[1]):
        rows = sorted(by_component[k + 1])
        assert [r[2] for r in rows] == [deviation[i] for i in order]
        mine, expected = np.array([r[3] for r in rows]), white[order, k]
        mine = mine * np.sign(mine @ expected)
        assert np.allclose(np.sort(mine), np.sort(expected), atol=1e-8)
        assert np.allclose([r[4] for r in rows], share[k], rtol=1e-9)


def test_whitening_equals_numpy_and_drops_unusable_rows(spark):
    random = np.random.default_rng(3)
    kept = [(int(i), [float(v) for v in random.standard_normal(12) * np.arange(1, 13) + 50]) for i in range(300)]
    kept += [(7, kept[0][1]), (7, kept[0][1]), (None, kept[5][1])]
    odd = [(900, None), (901, []), (902, [None] * 12), (903, [1.0] * 11 + [NAN]), (904, [INF] + [0.0] * 11), (905, [1.0, 2.0]),
           (906, [3e38] * 12)]
    df = spark.createDataFrame([(i, v, 1) for i, v in kept + odd], SCHEMA)
    _check_whitened(df.withColumnsRenamed({"label": "component"}), kept)
    _check_whitened(df.repartition(7), kept, components=3)


def test_whitening_of_few_rows(spark):
    def make(*vectors):
        return spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], SCHEMA)
    assert whitening.whiten(make()).count() == 0
    assert whitening.whiten(make([1.0, 2.0])).count() == 0                       # no spread
    assert whitening.whiten(make([1.0, 2.0], [1.0, 2.0], [1.0, 2.0])).count() == 0
    two = whitening.whiten(make([0.0, 1.0], [1.0, 0.0])).collect()
    assert {(r["vec_id"], r["component"], round(abs(r["whitened"]), 9), round(r["explained"], 9)) for r in two} == {(0, 1, 1.0, 1.0), (1, 1, 1.0, 1.0)}
    assert make(None, [NAN]).transform(whitening.whiten).columns == [
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviation_beyond_a_long_is_null(spark):
    df = spark.createDataFrame([(0, [1e9, 0.0]), (1, [-1e9, 1.0]), (2, [0.0, 0.0])], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(df).filter("component = 1").collect()}
    assert got[0] is None and got[1] is None and got[2] is not None


# ---- exact top k ---------------------------------------------------------------

def _held(v):
    return max(-(1 << 63) + 1, min((1 << 63) - 1, v))


def _brute_top(rows, queries, k):
    """Rows and queries as (id, list of integers)."""
    out = []
    for q, vector in {(q, tuple(v)) for q, v in queries}:
        scores = sorted((-_held(sum(a * b for a, b in zip(vector, v))), i) for i, v in rows if i != q and len(v) == len(vector))
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def _integers(v):
    return [int(np.floor(1024 * float(x))) if abs(x) < 2 ** 53 else int(x) * 1024 for x in v]


def _got(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("k", [1, 10, 1000])
def test_top_k_equals_all_scores(spark, k):
    random = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in random.standard_normal(6) / 3]) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(300)]            # one vector very often: ties across tasks
    rows += [(2000, [0.0] * 6), (2000, [0.0] * 6), (2100, rows[3][1]), (2100, [1.0] * 6), (2200, [1.0, 2.0]), (2201, [3.0, 4.0]), (2300, [])]
    odd = [(3000, None), (3100, [None] * 6), (3200, [NAN] * 6), (3300, [1.0] * 5 + [INF]), (None, [1.0] * 6)]
    df = spark.createDataFrame([(i, v, 5) for i, v in rows + odd], SCHEMA).withColumnRenamed("label", "score").repartition(9)
    plain = [(i, _integers(v)) for i, v in rows]
    expected = _brute_top(plain, [(i, v) for i, v in plain if i % 100 == 0], k)
    assert _got(topk.exact_top_k(df, df.filter("vec_id % 100 = 0"), k)) == expected


def test_top_k_in_many_blocks_and_histograms(spark, monkeypatch):
    random = np.random.default_rng(6)
    rows = [(i, [float(x) for x in np.round(random.standard_normal(4) * 10.0 ** random.integers(-3, 4), 3)]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    plain = [(i, _integers(v)) for i, v in rows]
    expected = _brute_top(plain, [(i, v) for i, v in plain if i % 5 == 0], 7)
    monkeypatch.setattr(topk, "BLOCK_BYTES", 400)
    assert _got(topk.exact_top_k(df, df.filter("vec_id % 5 = 0"), 7)) == expected


def test_top_k_of_huge_entries_is_exact(spark):
    big = [(0, [9e15, 1.0]), (1, [9e15, 3.0]), (2, [9e15, 2.0]), (3, [1e300, 0.0]), (4, [-1e300, 1.0]), (5, [1e-3, 7.0]), (6, [0.0, 0.0])]
    df = spark.createDataFrame(big, "vec_id long, embedding array<double>")
    plain = [(i, [max(-(1 << 63), min((1 << 63) - 1, x)) for x in _integers(v)]) for i, v in big]
    assert _got(topk.exact_top_k(df, df, 3)) == _brute_top(plain, plain, 3)


def test_top_k_of_empty_tables(spark):
    df = spark.createDataFrame([(0, [1.0], 0)], SCHEMA)
    assert topk.exact_top_k(df, df).count() == 0                    # no other row
    assert topk.exact_top_k(df.filter("false"), df).count() == 0
    assert topk.exact_top_k(df, df.filter("false")).columns == ["query_id", "rank", "vec_id", "score"]
    assert df.filter(topk.usable(F.array(F.lit(None).cast("float")))).count() == 0


def test_queries_over_the_tables(spark, sf_small):
    import duckdb
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf_small}/embeddings.parquet')")
    got = E.queries()["op12_exact_top_k"](spark, sf_small)
    assert _got(got) == sorted(duck.sql(E.oracle_sql()["op12_exact_top_k"]).fetchall())
    rows = E.queries()["op11_spectral_whitening"](spark, sf_small)
    kept = [tuple(r) for r in spark.read.parquet(f"{sf_small}/embeddings.parquet").select("vec_id", "embedding").collect()]
    n, deviation, white, share = _brute([v for _, v in kept])
    found = {(r["vec_id"], r["component"]): r for r in rows.collect()}
    assert len(found) == 8 * len(kept)
    for k in range(8):
        mine = np.array([found[i, k + 1]["whitened"] for i, _ in kept])
        assert np.allclose(mine * np.sign(mine @ white[:, k]), white[:, k], atol=1e-9)
        assert all(found[i, k + 1]["deviation"] == d for (i, _), d in zip(kept, deviation))
