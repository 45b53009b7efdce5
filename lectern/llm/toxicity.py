"""Toxicity by compression distance.

Words are the unit: a text is normalised to words and each word stands as a
code of CODE bytes of its hash, so a match of the compressor is a whole word
and never a piece that other words share.

Two zstandard dictionaries are trained on bounded samples of labelled text,
one on the toxic and one on the ordinary documents, each on the words that a
common dictionary, trained on ordinary text, lacks and that are not far more
frequent in the other class; both then stand before that common one, position
for position.  A text is cut into overlapping
windows of words, each is compressed with either dictionary, and the bytes
that the toxic dictionary saves over the ordinary one are the window's distance.

A second pair stands on words typical of one class only, those found in far
more of its documents than of the other class's: a trained dictionary
holds the commonest words, these may be rare.  A logistic calibration,
fitted on documents that gave nothing to the dictionaries, turns a text's
distances by both pairs into a probability.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import fold, is_training, save, slices, texts_of

SAMPLE = {1: 6_000, 0: 12_000}   # labelled documents of each class at most, by order of hash
CALIBRATION_FOLD = 3              # of the training folds 0, 1 and 3
CODE = 12                         # bytes that stand for a word
MATCH = 7                         # shortest match: more than half a code
WINDOW, STEP = 10 * CODE, 8 * CODE     # bytes of a window and between two starts
DICTIONARY_BYTES = 16384          # of a class's trained dictionary
BASE_BYTES = 16384                # of the dictionary that all share
TRAINED_ON = 30 * CODE            # bytes of a window that a dictionary is trained on
TRAINER_WINDOWS = 60_000          # such windows at most
KNOWN_WORDS = 300_000             # codes a worker remembers
TYPICAL_Z, TYPICAL_RATIO, TYPICAL_DOCS, TYPICAL_SHARE = 5.0, 20.0, 3, 0.01
FREQUENT_Z, FREQUENT_RATIO = 8.0, 3.0    # of a class's words that stay out of the other's trained dictionary
MAX_TYPICAL = 20_000              # typical words of a class at most, the commonest first
RIDGE = 1e-2
SLICE_BYTES = 4 << 20
FEATURES = list("abcdefg")        # columns of document_features
Pair = tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]
_BLANK = bytes(32 if b < 128 and not chr(b).isalpha() else b for b in range(256))


class _Codes(dict):
    """Word -> code, made on first use."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = code = hashlib.blake2b(word, digest_size=CODE).digest()
        return code


_CODES = _Codes()


def normalised(text: str) -> bytes:
    """Codes of the text's lower-case words, one after another; a text without
    words has the code of the empty word."""
    return b"".join(map(_CODES.__getitem__, text.lower().encode("utf-8", "surrogatepass").translate(_BLANK).split())) or _CODES[b""]


def words(data: bytes) -> set[bytes]:
    """The distinct codes of a normalised text."""
    return {data[i:i + CODE] for i in range(0, len(data), CODE)}


@dataclass
class Model:
    base: bytes = b""
    typical: dict[int, bytes] = field(default_factory=lambda: {0: b"", 1: b""})
    trained: dict[int, bytes] = field(default_factory=lambda: {0: b"", 1: b""})
    mean: np.ndarray = field(default_factory=lambda: np.zeros(len(FEATURES)))
    scale: np.ndarray = field(default_factory=lambda: np.ones(len(FEATURES)))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(FEATURES) + 1))

    def compressors(self) -> Pair:
        """(ordinary, toxic) by typical words before the shared dictionary."""
        return self._pair(self.typical)

    def _pair(self, own: dict[int, bytes]) -> Pair:
        longest = max(map(len, own.values()))
        return tuple(_compressor(b"\0" * (longest - len(own[k])) + own[k] + self.base) for k in (0, 1))

    def pairs(self) -> tuple[Pair, Pair]:
        """The trained dictionaries, and those of typical words."""
        return self._pair(self.trained), self.compressors()


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    content = bytes(8) + content              # nothing matches at a dictionary's very start
    parameters = zstandard.ZstdCompressionParameters.from_level(
        3, min_match=MATCH, strategy=zstandard.STRATEGY_DFAST, window_log=max(17, len(content).bit_length()), hash_log=16,
        chain_log=16, search_log=4, target_length=16, write_content_size=0, write_checksum=0, write_dict_id=0,
        format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    content_only = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(dict_data=content_only, compression_params=parameters)


def distances(texts: list[str], *pairs: Pair) -> tuple[np.ndarray, ...]:
    """(bytes that each pair's toxic dictionary saves on each window ..., first
    window of each text).  Windows cover the whole text; a text has one at
    least."""
    data = [normalised(t) for t in texts]
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    counts = np.maximum(1, -(-(sizes - (WINDOW - STEP)) // STEP))
    first = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(data)), counts)
    inside = (np.arange(len(owner)) - first[owner]) * STEP
    begin = (np.cumsum(sizes) - sizes)[owner] + inside
    length = np.minimum(WINDOW, sizes[owner] - inside)
    segments = np.stack([begin, length], axis=1).astype(np.uint64)
    buffer = zstandard.BufferWithSegments(b"".join(data), segments.tobytes())
    sizes = ([np.fromiter(map(len, c.multi_compress_to_buffer(buffer)), np.int64, len(owner)) for c in pair] for pair in pairs)
    return *(ordinary - toxic for ordinary, toxic in sizes), first


def document_features(texts: list[str], pairs: tuple[Pair, Pair]) -> np.ndarray:
    """By the trained dictionaries: the largest and the mean distance and the
    share of windows that the toxic one saves on.  By the typical words: the
    largest distance, and how many windows, how many bytes and what share of
    the windows the toxic dictionary saves."""
    if not texts:
        return np.empty((0, len(FEATURES)))
    trained, saved, first = distances(texts, *pairs)
    hits = np.add.reduceat((saved > 0).astype(np.int64), first)
    counts = np.diff(np.append(first, len(saved)))
    return np.stack([np.maximum.reduceat(trained, first), np.add.reduceat(trained, first) / counts,
                     np.add.reduceat((trained > 0).astype(np.int64), first) / counts,
                     np.maximum.reduceat(saved, first), np.log1p(hits),
                     np.log1p(np.add.reduceat(np.maximum(saved, 0), first)), hits / counts], axis=1).astype(float)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit dictionaries and calibration on at most SAMPLE labelled documents of
    each class outside the held-out fold, chosen by the hash of their id.
    Labels other than 0 and 1, NULL ids and NULL texts are left out.  Without
    a document of either class every text scores the share of label 1, and
    0 without labels."""
    spark = docs.sparkSession
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter(
        F.col("label").isin(0, 1) & is_training("id")).groupBy("id").agg(F.max("label").alias("label"))
    totals = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    # The bound on the sample is also the bound on what is broadcast.
    chosen = [marked.filter(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(n) for k, n in SAMPLE.items()]
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text IS NOT NULL").join(
        F.broadcast(chosen[0].union(chosen[1])), "id")
    sample = save(sample.select("id", "label", "text", (fold("id") == CALIBRATION_FOLD).alias("calibrates")), "toxicity-sample")

    def sizes() -> dict[tuple[int, bool], int]:
        return {(r["label"], r["calibrates"]): r["n"] for r in sample.groupBy("label", "calibrates").agg(F.count(F.lit(1)).alias("n")).collect()}

    n = sizes()
    if any(n.get((k, True), 0) + n.get((k, False), 0) > bound for k, bound in SAMPLE.items()):
        # An id stands on many rows: rows are bounded, too.
        rows = [sample.filter(F.col("label") == k).orderBy(F.xxhash64("id"), "id", F.xxhash64("text")).limit(bound) for k, bound in SAMPLE.items()]
        sample = save(rows[0].union(rows[1]), "toxicity-sample")
        n = sizes()
    prior = (totals.get(1, 0) + 0.5) / (sum(totals.values()) + 1) if totals else 1e-6
    constant = Model(weights=np.r_[math.log(prior / (1 - prior)), np.zeros(len(FEATURES))])
    fitting = sample.filter("NOT calibrates")
    if not n.get((0, False)) or not n.get((1, False)):
        return constant
    frequent = _typical_words(fitting, n[0, False], n[1, False], FREQUENT_Z, FREQUENT_RATIO)
    base = _trained(fitting.filter("label = 0"), BASE_BYTES, words(frequent[0]) | words(frequent[1]))
    common = {base[i:i + CODE] for i in range(len(base) - CODE + 1)}
    model = Model(base, _typical_words(fitting, n[0, False], n[1, False]),
                  {k: _trained(fitting.filter(F.col("label") == k), DICTIONARY_BYTES, common | words(frequent[1 - k])) for k in (0, 1)})
    if not n.get((0, True)) or not n.get((1, True)):
        return constant
    shared = spark.sparkContext.broadcast(model)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = shared.value.pairs()
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at:at + 500]
                found = document_features(part["text"].tolist(), pairs)
                yield pd.DataFrame(found, columns=FEATURES).assign(label=part["label"].to_numpy())

    found = sample.filter("calibrates").mapInPandas(measure, ", ".join(f"{c} double" for c in FEATURES) + ", label int").toPandas()
    found = found.sort_values(FEATURES + ["label"])
    x, y = found[FEATURES].to_numpy(), found["label"].to_numpy()
    # Rows count as often as their class has documents, so that scores are probabilities over all of them.
    times = np.where(y == 1, totals[1] / (y == 1).sum(), totals[0] / (y == 0).sum())
    model.mean, model.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    model.weights = logistic((x - model.mean) / model.scale, y, times / times.mean())
    # The calibration stands; typical words are then taken from the whole sample, calibration fold included.
    model.typical = _typical_words(sample, n[0, False] + n[0, True], n[1, False] + n[1, True])
    return model


def _typical_words(rows: DataFrame, ordinary: int, toxic: int, z: float = TYPICAL_Z, ratio: float = TYPICAL_RATIO) -> dict[int, bytes]:
    """Each class's typical words, the commonest last; so many of the rows are of either class."""
    found = {0: _typical(rows, 0, ordinary, toxic, z, ratio), 1: _typical(rows, 1, toxic, ordinary, z, ratio)}
    return {k: b"".join(sorted(v, key=lambda w: (v[w], w))) for k, v in found.items()}


def logistic(x: np.ndarray, y: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the intercept first."""
    x, weights = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    penalty = RIDGE * len(x) * np.r_[1e-6, np.ones(x.shape[1] - 1)]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (times * (y - p)) - penalty * weights
        hessian = (x * (times * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        weights = weights + step
        if np.abs(step).max() < 1e-9:
            break
    return weights


def _typical(fitting: DataFrame, label: int, own: int, other: int, least_z: float, ratio: float) -> dict[bytes, int]:
    """Words typical of a class, by how many documents have them."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, texts in batch.groupby("label")["text"]:
                for at in range(0, len(texts), 200):
                    found = [w for t in texts.iloc[at:at + 200] for w in words(normalised(t))]
                    times = pd.Series(found, dtype=object).value_counts()
                    yield pd.DataFrame({"word": times.index, "label": k, "n": times.to_numpy()})

    counts = fitting.mapInPandas(count, "word binary, label int, n long").groupBy("word").agg(
        F.sum(F.when(F.col("label") == label, F.col("n")).otherwise(0)).cast("double").alias("a"),
        F.sum(F.when(F.col("label") == label, 0).otherwise(F.col("n"))).cast("double").alias("b"))
    share = (F.col("a") + F.col("b")) / (own + other)
    z = (F.col("a") / own - F.col("b") / other) / F.sqrt(share * (1 - share) * (1 / own + 1 / other) + 1e-12)
    found = counts.filter((F.col("a") >= max(TYPICAL_DOCS, TYPICAL_SHARE * own)) & (z >= least_z)
                          & (F.col("a") / own >= ratio * (F.col("b") + 0.5) / other))
    rows = found.orderBy(F.desc("a"), "word").limit(MAX_TYPICAL).collect()
    return {bytes(r["word"]): int(r["a"]) for r in rows}


def _trained(fitting: DataFrame, size: int, held: set[bytes]) -> bytes:
    """A dictionary of ``size`` bytes trained on the sampled texts without the
    words of ``held``."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                out = []
                for data in map(normalised, batch["text"].iloc[at:at + 200]):
                    new = b"".join(w for i in range(0, len(data), CODE) if (w := data[i:i + CODE]) not in held)
                    out += [new[i:i + TRAINED_ON] for i in range(0, len(new), TRAINED_ON)]
                yield pd.DataFrame({"window": out})

    # The sample is bounded by its rows; a dictionary sees as much text of it as
    # its trainer takes in, whole windows by order of their hash.
    chosen = fitting.mapInPandas(cut, "window binary").distinct().orderBy(F.xxhash64("window"), "window").limit(TRAINER_WINDOWS)
    return _dictionary(sorted(bytes(r[0]) for r in chosen.collect()), size)


def _dictionary(windows: list[bytes], size: int) -> bytes:
    """Content of a dictionary trained by zstandard, its most useful words last."""
    try:
        made = zstandard.train_dictionary(size, windows, k=4 * CODE, d=8).as_bytes()
    except zstandard.ZstdError:               # too little text to train on
        made = b"".join(windows)[-size:]
    return made


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row: the probability of label 1.  NULL counts as
    the empty text, which has one empty window; rows pass one to one."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind, score = source.schema["id"].dataType.simpleString(), _scorer(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in score(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(found)], ["id", "score"])

    return source.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, model: Model, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows that score below ``threshold``, all columns as they are; NULL
    counts as the empty text, and repeated rows stay."""
    score = _scorer(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in score(batches, text_col):
            yield part.filter(pa.array(found < threshold))

    return docs.mapInArrow(run, docs.schema)


def _scorer(docs: DataFrame, model: Model):
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        model = shared.value
        pairs = model.pairs()
        for batch in batches:
            for part in slices(batch, text_col, SLICE_BYTES):
                x = (document_features(texts_of(part, text_col), pairs) - model.mean) / model.scale
                yield part, 1 / (1 + np.exp(-np.clip(model.weights[0] + x @ model.weights[1:], -30, 30)))

    return score
