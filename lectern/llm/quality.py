"""Quality classifier: regularised quadratic discriminant.

A document becomes a vector of transformed statistics (logarithms of counts,
square roots of shares).  Each class gets a mean and a covariance over all
its training rows, summed in Spark; the covariance is shrunk towards the
pooled one and towards its diagonal, and its Cholesky factor is kept.  The
score is the logistic of the difference of the classes' log densities
(half squared Mahalanobis distance and log determinant) and log priors.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import is_training, save, slices, texts_of

POOLED, DIAGONAL = 0.2, 0.1     # shrinkage towards pooled covariance and towards the diagonal
FLOOR = 1e-3                     # least variance of a statistic
SYMBOLS = b"#*$%&|<>@^~=_{}[]\\/+"
MARKS = b".,;:!?"
UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
NAMES = ("words", "distinct words", "word length", "words a line", "distinct lines",
         "repeated words", "symbols", "marks", "exclamations", "upper case", "digits")


def statistics(text: str) -> list[float]:
    """The transformed statistics NAMES of a text; finite for any text."""
    words, lines = text.split(), text.split("\n")
    data = text.encode("utf-8", "surrogatepass")
    solid = max(1, sum(map(len, words)))

    def share(characters: bytes) -> float:
        return math.sqrt(min(1.0, (len(data) - len(data.translate(None, characters))) / solid))

    return [
        math.log1p(len(words)), math.log1p(len(set(words))), math.log1p(solid / max(1, len(words))),
        math.log1p(len(words) / len(lines)), math.sqrt(len(set(lines)) / len(lines)),
        math.sqrt(sum(map(operator.eq, words, words[1:])) / max(1, len(words))),
        share(SYMBOLS), share(MARKS), share(b"!"), share(UPPER), share(DIGITS),
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x) of every row, stored: the texts are read once, for training and
    scoring.  NULL counts as the empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 16 << 20):
                x = pa.array([statistics(t) for t in texts_of(part, "text")], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column("id"), x], ["id", "x"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return save(source.mapInArrow(run, f"id {kind}, x array<double>"), "statistics").withColumnRenamed("id", id_col)


@dataclass
class Model:
    """Per class: mean, lower Cholesky factor of the covariance, log of prior
    over root determinant.  ``constant`` replaces them without both classes."""
    means: list[np.ndarray]
    factors: list[np.ndarray]
    offsets: list[float]
    constant: float | None = None

    def log_density(self, k: int, x: np.ndarray) -> np.ndarray:
        z = np.linalg.solve(self.factors[k], (x - self.means[k]).T)
        return self.offsets[k] - 0.5 * (z * z).sum(axis=0)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        difference = self.log_density(1, x) - self.log_density(0, x)
        return 1 / (1 + np.exp(-np.clip(difference, -30, 30)))


def fit(n: dict[int, float], sums: dict[int, np.ndarray], products: dict[int, np.ndarray]) -> Model:
    """From per-class counts, sums and sums of outer products."""
    total = sum(n.values())
    if min(n.get(0, 0), n.get(1, 0)) < 2:
        return Model([], [], [], (n.get(1, 0) + 0.5) / (total + 1) if total else 0.5)
    means = {k: sums[k] / n[k] for k in (0, 1)}
    scatter = {k: products[k] - n[k] * np.outer(means[k], means[k]) for k in (0, 1)}
    pooled = (scatter[0] + scatter[1]) / total
    factors, offsets = [], []
    for k in (0, 1):
        own = (1 - POOLED) * scatter[k] / n[k] + POOLED * pooled
        own = (1 - DIAGONAL) * own + DIAGONAL * np.diag(np.diag(own)) + FLOOR * np.eye(len(own))
        factor = np.linalg.cholesky(own)
        factors.append(factor)
        offsets.append(float(np.log(n[k] / total) - np.log(np.diag(factor)).sum()))
    return Model([means[0], means[1]], factors, offsets)


def train(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """Moments over every labelled document outside the held-out fold, from
    the rows of :func:`document_statistics`.  Labels other than 0 and 1, and
    NULL ids, are left out; of an id labelled twice the larger label counts."""
    marked = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("label")).filter(
        F.col("label").isin(0, 1) & is_training(id_col)).groupBy(id_col).agg(F.max("label").alias("label"))
    known = documents.join(marked, id_col).select("label", "x")

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for label, x in batch.groupby("label")["x"]:
                x = np.stack(x.to_numpy())
                yield pd.DataFrame({"label": [label], "n": [float(len(x))], "s": [x.sum(axis=0)], "p": [(x.T @ x).ravel()]})

    d = len(NAMES)
    parts = known.mapInPandas(moments, "label int, n double, s array<double>, p array<double>")
    summed = parts.groupBy("label").agg(F.sum("n").alias("n"), *_sums("s", d), *_sums("p", d * d))
    n, sums, products = {}, {}, {}
    for r in summed.collect():                 # a row for each class
        n[r["label"]] = r["n"]
        sums[r["label"]] = np.array([r[f"s{i}"] for i in range(d)])
        products[r["label"]] = np.array([r[f"p{i}"] for i in range(d * d)]).reshape(d, d)
    return fit(n, sums, products)


def _sums(name: str, size: int) -> list[Column]:
    return [F.sum(F.col(name)[i]).alias(f"{name}{i}") for i in range(size)]


def score(documents: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """(id, score) of every row of :func:`document_statistics`."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"id": batch["id"], "score": model.score(np.stack(batch["x"].to_numpy()))})

    found = documents.select(F.col(id_col).alias("id"), "x")
    kind = found.schema["id"].dataType.simpleString()
    return found.mapInPandas(run, f"id {kind}, score double").withColumnRenamed("id", id_col)
