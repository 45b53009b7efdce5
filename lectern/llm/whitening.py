"""Whitening of embeddings by spectrum slicing.

Spark adds up exact sums of the vectors, then the covariance of the centred
vectors, task by task; a matrix of dimension x dimension is all that the
driver sees.  There the leading eigenvalues are found one by one: the inertia
of an LDL' factorisation of the covariance minus a shift counts the
eigenvalues above that shift, bisection on those counts isolates each of
them, Rayleigh quotient iteration converges to it cubically, and two more
counts, just below and just above the value found, certify its number.

Defined results: rows whose vector is NULL, empty, or holds a NULL or
non-finite entry are dropped, and so are vectors of another length than the
commonest one (ties: the longer) and entries whose scaled value exceeds a
long.  Repeated rows and NULL ids stay.  Eigenvalues that are zero to
rounding have no whitened value, so tables of low rank (a single row, equal
rows) give fewer components or none; empty tables give no rows.  Eigenvalues
equal to rounding share an arbitrary orthonormal basis.  A deviation beyond
a long is NULL.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.topk import SCALE, scaled, usable, vectors_of

OFFSET = 100_000              # added to every scaled entry
COMPONENTS = 8
_LARGEST = float(1 << 61)     # scaled entries beyond do not count
_EPS = float(np.finfo(float).eps)
_LONG = (1 << 63) - 1


# --------------------------------------------------------------------------
# Spectrum slicing of one symmetric matrix
# --------------------------------------------------------------------------

def inertia(matrix: np.ndarray) -> tuple[int, int, int]:
    """(negative, zero, positive) eigenvalues, from the pivots of an LDL'
    factorisation with 1x1 and 2x2 blocks (Bunch and Kaufman's choice)."""
    a, n, i = np.array(matrix, float), len(matrix), 0
    negative = zero = positive = 0
    alpha = (1 + np.sqrt(17)) / 8

    def swap(p: int, q: int) -> None:
        if p != q:
            a[[p, q]] = a[[q, p]]
            a[:, [p, q]] = a[:, [q, p]]

    while i < n:
        size, column = 1, np.abs(a[i + 1:, i])
        largest = column.max(initial=0)
        if abs(a[i, i]) < alpha * largest:
            r = i + 1 + int(column.argmax())
            other = max(np.abs(a[r, i:r]).max(), np.abs(a[r, r + 1:]).max(initial=0))
            if abs(a[i, i]) * other < alpha * largest ** 2:
                if abs(a[r, r]) >= alpha * other:
                    swap(i, r)
                else:
                    swap(i + 1, r)
                    size = 2
        if size == 1:
            d, c = a[i, i], a[i + 1:, i].copy()
            if d:
                a[i + 1:, i + 1:] -= np.outer(c, c / d)
            negative, zero, positive = negative + (d < 0), zero + (d == 0), positive + (d > 0)
        else:                                   # such a block always has one eigenvalue of each sign
            block, c = a[i:i + 2, i:i + 2].copy(), a[i + 2:, i:i + 2].copy()
            a[i + 2:, i + 2:] -= c @ np.linalg.solve(block, c.T)
            negative, positive = negative + 1, positive + 1
        i += size
    return int(negative), int(zero), int(positive)


def count_above(matrix: np.ndarray, shift: float) -> int:
    return inertia(matrix - shift * np.eye(len(matrix)))[2]


def _solve(matrix: np.ndarray, shift: float, x: np.ndarray, least: float) -> np.ndarray:
    try:
        return np.linalg.solve(matrix - shift * np.eye(len(matrix)), x)
    except np.linalg.LinAlgError:
        return np.linalg.solve(matrix - (shift + least) * np.eye(len(matrix)), x)


def leading_eigenpairs(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues that are above zero to rounding, in
    falling order, with unit eigenvectors as rows."""
    n = len(matrix)
    top = float(np.abs(matrix).sum(axis=1).max(initial=0))           # Gershgorin
    least = 4 * n * _EPS * top                                       # what rounding can move an eigenvalue by
    values: list[float] = []
    vectors: list[np.ndarray] = []
    if top == 0:
        return np.empty(0), np.empty((0, n))
    counts = {top * (1 + 1e-6): 0, least: count_above(matrix, least)}
    wanted = min(wanted, counts[least])
    random = np.random.default_rng(0)

    def bounds(number: int) -> tuple[float, float]:
        """The closest shifts known to have at least, and less than, ``number`` values above."""
        return max(s for s, c in counts.items() if c >= number), min(s for s, c in counts.items() if c < number)

    def orthonormal(x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            for v in vectors:
                x = x - v * (v @ x)
        return x / np.linalg.norm(x)

    while len(values) < wanted:
        number = len(values) + 1
        low, high = bounds(number)
        while (counts[low] != number or counts[high] != number - 1) and high - low > 4 * least:
            middle = (low + high) / 2
            counts[middle] = count_above(matrix, middle)
            low, high = bounds(number)
        if high - low <= 4 * least:              # several values, equal to rounding: any basis of their space
            for _ in range(min(counts[low], wanted) - len(values)):
                x = orthonormal(random.standard_normal(n))
                for _ in range(4):
                    x = orthonormal(_solve(matrix, low - least, x, least))
                values.append(float(x @ matrix @ x))
                vectors.append(x)
            continue
        while True:
            low, high = bounds(number)
            middle = (low + high) / 2
            x = random.standard_normal(n)
            for _ in range(3):                   # towards the value nearest to the middle
                x = _solve(matrix, middle, x, least)
                x /= np.linalg.norm(x)
            value = x @ matrix @ x
            for _ in range(12):                  # Rayleigh quotient iteration
                if np.linalg.norm(matrix @ x - value * x) <= least / 4:
                    break
                x = _solve(matrix, value, x, least)
                x /= np.linalg.norm(x)
                value = x @ matrix @ x
            inside = low < value < high and np.linalg.norm(matrix @ x - value * x) <= least
            if inside and count_above(matrix, value - least) >= number and count_above(matrix, value + least) < number:
                break
            counts[middle] = count_above(matrix, middle)
            if high - low <= 4 * least:
                raise ArithmeticError(f"eigenvalue {number} cannot be told from its neighbours")
        x = orthonormal(x)
        values.append(float(x @ matrix @ x))
        vectors.append(x)
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], np.array(vectors).reshape(-1, n)[order]


# --------------------------------------------------------------------------
# Spark: sums, covariance, whitened rows
# --------------------------------------------------------------------------

@dataclass(frozen=True)
class Whitening:
    """Fitted on ``n`` vectors: exact ``sums``, leading ``values`` and unit
    ``vectors`` (rows) of their covariance, whose trace is ``trace``."""
    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def dimension(self) -> int:
        return len(self.sums)


def _scaled_rows(batch: pa.RecordBatch, dimension: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, integers) of the vectors of one length that fit."""
    for rows, matrix in vectors_of(batch.column("vector")):
        if matrix.shape[1] == dimension:
            x = scaled(matrix, SCALE)
            fits = (np.abs(x) < _LARGEST).all(axis=1)
            yield rows[fits], x[fits].astype(np.int64) + OFFSET


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact: as long where that is safe, else Python's integers."""
    largest = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, sums), default=0))
    if largest < 1 << 61:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    return rows.filter(usable(F.col("vector")) & (F.size("vector") > 0))


def fit(df: DataFrame, components: int = COMPONENTS, vector_col: str = "embedding") -> Whitening | None:
    """Whitening of all usable vectors of ``df``; None if there is none."""
    rows = _vectors(df.select(vector_col), vector_col, vector_col).select("vector")
    common = rows.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    if common is None:
        return None
    dimension = common["length"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dimension
        for batch in batches:
            for _, x in _scaled_rows(batch, dimension):
                if int(np.abs(x).max(initial=0)) * max(1, len(x)) >= 1 << 62:
                    x = x.astype(object)
                n, total = n + len(x), [a + int(b) for a, b in zip(total, x.sum(axis=0))]
        yield pa.RecordBatch.from_arrays([
            pa.array([n] * dimension, pa.int64()), pa.array(range(dimension), pa.int32()), pa.array(map(str, total), pa.string())],
            ["n", "i", "total"])

    parts = rows.mapInArrow(add, "n long, i int, total string").groupBy("i")
    found = sorted(parts.agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).cast("string").alias("total")).collect())
    n, sums = found[0]["n"], [int(r["total"]) for r in found]
    if not n:
        return None

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper, matrix = np.triu_indices(dimension), np.zeros((dimension, dimension))
        for batch in batches:
            for _, x in _scaled_rows(batch, dimension):
                c = (_centred(x, n, sums) / n).astype(float)
                matrix += c.T @ c
        yield pa.RecordBatch.from_arrays([pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), pa.array(matrix[upper])],
                                         ["i", "j", "v"])

    covariance = np.zeros((dimension, dimension))
    for i, j, v in rows.mapInArrow(multiply, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v")).collect():
        covariance[i, j] = covariance[j, i] = v / n
    values, vectors = leading_eigenpairs(covariance, components)
    return Whitening(n, tuple(sums), values, vectors, float(np.trace(covariance)))


def project(df: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, deviation, whitened array<double>) of every usable row."""
    n, sums, dimension = model.n, list(model.sums), model.dimension
    axes = model.vectors / np.sqrt(model.values)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _scaled_rows(batch, dimension):
                d = _centred(x, n, sums)
                rough = (d.astype(float) ** 2).sum(axis=1)
                safe = (rough < 9e18) & (d.dtype != object)
                exact = (d[safe].astype(np.int64) ** 2).sum(axis=1)
                deviation = np.full(len(d), None, object)
                deviation[safe] = exact
                for i in np.flatnonzero(~safe).tolist():
                    value = sum(int(v) ** 2 for v in d[i])
                    deviation[i] = value if value <= _LONG else None
                white = (d / n).astype(float) @ axes.T
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1) * len(axes), pa.int32()), pa.array(white.ravel(), pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows)), pa.array(deviation, pa.int64()), lists],
                                                 ["id", "deviation", "whitened"])

    source = _vectors(df, id_col, vector_col)
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, deviation long, whitened array<double>").withColumnRenamed("id", id_col)


def identity_error(projected: DataFrame, components: int) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    if not pairs:
        return 0.0
    split = projected.select(*[F.col("whitened")[i].alias(f"w{i}") for i in range(components)])
    row = split.agg(*[F.covar_pop(f"w{i}", f"w{j}") for i, j in pairs]).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(row, pairs))


def whiten(df: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per usable row and component: id, component (from 1), n,
    deviation, whitened, explained, identity_error.  See the module's notes."""
    schema = f"{id_col} {dict(df.dtypes)[id_col]}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(df, components, vector_col)
    if model is None or not len(model.values):
        return df.sparkSession.createDataFrame([], schema)
    rows = project(df, model, id_col, vector_col)
    error = identity_error(rows, len(model.values))
    share = F.array(*[F.lit(float(v / model.trace)) for v in model.values])
    long = rows.select(id_col, "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return long.select(id_col, (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                       F.get(share, F.col("place")).alias("explained"), F.lit(float(error)).alias("identity_error"))
