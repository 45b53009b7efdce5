"""Exact top-k search by distributed histogram selection.

Every query is scored against every vector.  Nothing but counts leaves the
tasks at first: a histogram of the scores of each query, added up by Spark,
tells the bin that holds its k-th best score; that bin is cut into bins
again until it is one score wide (or ends exactly at the k-th row).  The k-th
value of every query is then known, a last pass keeps the rows that reach it
and breaks ties by id.

Bins are powers of two wide, so a score's bin is exact in floating point.
A task only reports bins from the top down to its own k-th row: the k-th row
of all rows cannot lie lower.

Queries go out in blocks of at most about ``BLOCK_BYTES``; more queries mean
more passes over the vectors, not larger blocks.

Defined results: vectors that are NULL or hold a NULL or non-finite entry,
and rows without an id, take no part.  Vectors of different lengths have no
score together.  Every row with the query's id is the query's own and no
candidate; repeated rows of another id are candidates each.  An id with
several different vectors asks once for each of them.  Scores and entries
beyond a long are held at its ends.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import save
from lectern.session import ensure_checkpoint_dir

BLOCK_BYTES = 16 << 20        # query vectors sent to the executors at once
BINS_LOG2 = 12                # 4,096 bins in a histogram
SCORES_AT_ONCE = 1 << 21      # scores a task holds at once
SCALE = 1024
_EXACT = float(1 << 53)       # integers below are exact as doubles
_LONG = (1 << 63) - 1


def usable(vector: Column) -> Column:
    """True where a vector is there and all its entries are finite numbers."""
    odd = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(False))


def vectors_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, their vectors as one matrix of doubles) for each length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.asarray(column.offsets).astype(np.int64)
    lengths, flat = np.diff(offsets), np.asarray(column.values, np.float64)
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        yield rows, flat[offsets[rows][:, None] + np.arange(length)]


def scaled(matrix: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x), as doubles; an infinite product is left infinite."""
    with np.errstate(over="ignore"):
        return np.floor(matrix * float(scale))


def _exact_row(row: np.ndarray) -> list[int]:
    held = []
    for v in row.tolist():
        value = int(v) * SCALE if abs(v) >= _EXACT else int(np.floor(v * SCALE))
        held.append(max(-_LONG - 1, min(_LONG, value)))
    return held


def _exact_scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products in Python's integers, held at a long's ends."""
    left, right = [_exact_row(q) for q in queries], [_exact_row(r) for r in rows]
    scores = [[max(-_LONG, min(_LONG, sum(a * b for a, b in zip(q, r)))) for r in right] for q in left]
    return np.array(scores, np.int64).reshape(len(left), len(right))


class _Block:
    """The queries of one block, and how far the search for each has come."""

    def __init__(self, ids: np.ndarray, numbers: np.ndarray, matrix: np.ndarray):
        self.ids, self.numbers, self.matrix = ids, numbers, matrix      # one length of vector
        self.scaled = scaled(matrix)
        self.largest = float(np.abs(self.scaled).max(initial=0))

    def scores(self, ids: np.ndarray, raw: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """(queries, row numbers, scores) in pieces; own rows hold no score."""
        x = scaled(raw)
        bound = np.abs(x).max(axis=1, initial=0) * self.largest * max(1, x.shape[1])
        for rows, exact in ((np.flatnonzero(bound < _EXACT), False), (np.flatnonzero(~(bound < _EXACT)), True)):
            if not len(rows):
                continue
            step = max(1, (SCORES_AT_ONCE >> 10 if exact else SCORES_AT_ONCE) // len(rows))
            own, right = ids[rows], x[rows].T
            order = np.argsort(own, kind="stable")
            for at in range(0, len(self.ids), step):
                part = slice(at, min(at + step, len(self.ids)))
                s = _exact_scores(self.matrix[part], raw[rows]) if exact else self.scaled[part] @ right
                first = np.searchsorted(own[order], self.ids[part], "left")
                last = np.searchsorted(own[order], self.ids[part], "right")
                keep = np.ones(s.shape, bool)
                for q in np.flatnonzero(first < last).tolist():
                    keep[q, order[first[q]:last[q]]] = False
                yield part, rows, s if keep.all() else np.where(keep, s, np.iinfo(np.int64).min if exact else -np.inf)


def _histogram(block, low, shift, spans, need, ids, raw) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query numbers, bins, counts) of one batch of rows for one block."""
    bins = 1 << BINS_LOG2
    for part, _, s in block.scores(ids, raw):
        numbers = block.numbers[part]
        open_ = np.flatnonzero(need[numbers] > 0)
        for at in range(0, len(open_), 64):
            rows = open_[at:at + 64]
            mine = numbers[rows]
            if s.dtype == np.int64:
                from_low = s[rows].astype(object) - low[mine][:, None].astype(object)
                place = np.array([[min(max(v >> int(b), -1), bins) for v in line] for line, b in zip(from_low, shift[mine])])
                place = place.reshape(len(rows), -1)
            else:
                place = np.floor((s[rows] - low[mine][:, None]) * np.exp2(-shift[mine].astype(float))[:, None])
            inside = (place >= 0) & (place < spans[mine][:, None])
            q, c = np.nonzero(inside)
            counts = np.bincount(q * bins + place[q, c].astype(np.int64), minlength=len(rows) * bins).reshape(len(rows), bins)
            above = counts[:, ::-1].cumsum(axis=1)[:, ::-1] - counts
            q, b = np.nonzero((counts > 0) & (above < need[mine][:, None]))
            yield mine[q], b, counts[q, b]


def _winners(block, least, ties, ids, raw) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query numbers, row ids, scores) of rows that reach their query's least
    score; of those equal to it the ``ties`` smallest ids (-1: all)."""
    for part, rows, s in block.scores(ids, raw):
        numbers = block.numbers[part]
        q, c = np.nonzero(s > least[numbers][:, None])
        yield numbers[q], ids[rows[c]], s[q, c].astype(np.int64)
        for k in np.flatnonzero((s == least[numbers][:, None]).any(axis=1)).tolist():
            same = np.sort(ids[rows[np.flatnonzero(s[k] == least[numbers[k]])]])
            same = same if ties[numbers[k]] < 0 else same[:ties[numbers[k]]]
            yield np.repeat(numbers[k], len(same)), same, np.repeat(np.int64(least[numbers[k]]), len(same))


def _pass(rows: DataFrame, blocks, work, state: tuple, names: list[str]) -> DataFrame:
    """``work`` over every batch of rows and every block of one length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column("id"))
            for at, matrix in vectors_of(batch.column("vector")):
                block = blocks.value.get(matrix.shape[1])
                found = list(work(block, *state, ids[at], matrix)) if block else []
                if found:
                    columns = [np.concatenate(c).astype(np.int64) for c in zip(*found)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _search(rows: DataFrame, queries: list, k: int, longest: float) -> DataFrame:
    """Top k of one block of queries [(id, vector)]: (number, id, score)."""
    spark, n = rows.sparkSession, len(queries)
    by_length: dict[int, list[int]] = {}
    for number, (_, vector) in enumerate(queries):
        by_length.setdefault(len(vector), []).append(number)
    made, bound = {}, np.ones(n)
    for length, numbers in by_length.items():
        matrix = np.array([queries[i][1] for i in numbers], np.float64).reshape(len(numbers), length)
        made[length] = _Block(np.array([queries[i][0] for i in numbers], np.int64), np.array(numbers), matrix)
        # Cauchy-Schwarz with room for the rounding of both factors.
        bound[numbers] = np.sqrt((made[length].scaled ** 2).sum(axis=1)) * longest * 1.0001 + 1
    bound = np.minimum(np.nan_to_num(bound, nan=2.0 ** 62, posinf=2.0 ** 62), 2.0 ** 62)
    shift = np.maximum(0, np.ceil(np.log2(2 * bound + 2)).astype(np.int64) - BINS_LOG2)
    low = -(1 << np.minimum(62, shift + BINS_LOG2 - 1)).astype(np.int64)
    low = np.where(bound >= 2.0 ** 62, -_LONG, low)
    shift = np.where(bound >= 2.0 ** 62, 64 - BINS_LOG2, shift)
    blocks = spark.sparkContext.broadcast(made)
    need, least, ties, spans = np.full(n, k), low.copy(), np.full(n, -1), np.full(n, 1 << BINS_LOG2)
    while (need > 0).any():
        counts = _pass(rows, blocks, _histogram, (low, shift, spans, need), ["number", "bin", "n"])
        counts = counts.groupBy("number", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("number").orderBy(F.col("bin").desc())
        located = (counts.withColumn("upto", F.sum("n").over(down))
                   .join(F.broadcast(spark.createDataFrame([(int(i), int(need[i])) for i in np.flatnonzero(need > 0)],
                                                           "number long, need long")), "number")
                   .filter((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
                   .select("number", "bin", "n", "upto").toPandas())
        at = located["number"].to_numpy(np.int64)
        edge = (low[at].astype(object) + (located["bin"].to_numpy(np.int64).astype(object) << shift[at].astype(object))).astype(np.int64)
        left = need[at] - (located["upto"] - located["n"]).to_numpy(np.int64)       # rows wanted of this bin
        low[at], least[at] = edge, edge
        single, whole = shift[at] == 0, (located["upto"].to_numpy(np.int64) == need[at])
        ties[at[single & ~whole]] = left[single & ~whole]
        open_ = ~single & ~whole
        need[:] = 0                          # a query that found no such bin has fewer than k rows: all of them are kept
        need[at[open_]] = left[open_]
        finer = np.maximum(0, shift[at] - BINS_LOG2)
        spans[at], shift[at] = 1 << (shift[at] - finer), finer
    return _pass(rows, blocks, _winners, (least, ties), ["number", "id", "score"])


def exact_top_k(candidates: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id",
                vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank from 1, id, score) of each query's ``k`` highest inner
    products of floor(1024 * entry), ties to the smaller id.

    Both tables need only the two named columns; others cannot clash.  See the
    module's notes for NULLs, repeated ids and mixed lengths; a query without
    candidates and an empty table give no rows."""
    spark = candidates.sparkSession
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    asked = save(asked.filter(F.col("id").isNotNull() & usable(F.col("vector"))).distinct(), "topk-queries")
    rows = candidates.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("vector")))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, c: a + F.pow(F.floor(c.cast("double") * SCALE).cast("double"), 2)))
    size = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("vector") * 8 + 16), F.lit(0))).first()
    longest = rows.agg(F.max(norm)).first()[0] if size[0] else None
    folder = f"{ensure_checkpoint_dir(spark)}/llm-topk-{uuid.uuid4().hex}"
    schema = "query_id long, rank int, id long, score long"
    spark.createDataFrame([], schema).write.parquet(folder)
    number = max(1, ceil(size[1] / BLOCK_BYTES)) if longest is not None else 0
    block_of = F.pmod(F.xxhash64("id", "vector"), F.lit(number))
    best = Window.partitionBy("number").orderBy(F.col("score").desc(), "id")
    for b in range(number):
        block = [(r["id"], r["vector"]) for r in asked.filter(block_of == b).sort("id", F.xxhash64("vector")).toLocalIterator()]
        if not block:
            continue
        ids = spark.createDataFrame([(i, q[0]) for i, q in enumerate(block)], "number long, query_id long")
        found = _search(rows, block, k, longest).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        found.join(F.broadcast(ids), "number").select("query_id", "rank", "id", "score").write.mode("append").parquet(folder)
    return spark.read.schema(schema).parquet(folder).withColumnRenamed("id", id_col)
