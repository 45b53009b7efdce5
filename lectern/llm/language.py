"""Language identification with spans.

Words are runs of letters.  The script of a word's first letter narrows its
candidate languages to those that the training texts write in that script.
Every candidate scores a word by naive Bayes over hashed byte n-grams of the
word with its borders.  Viterbi over a text's words, with a penalty for each
switch, labels spans of mixed-language text; the language with the most
letters is the text's label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import is_training, slices

UNDETERMINED = "und"
NOT_LETTERS = r"[^\p{L}\p{M}]+\p{M}*|\A\p{M}+"      # a word begins with a letter
GRAMS = (3, 4)                # bytes of an n-gram
BUCKETS = 1 << 15             # hash buckets for each n-gram size
SWITCH_PENALTY = 12.0         # nats a change of language costs
SMOOTHING = 0.5
MIN_SCRIPT_SHARE = 0.005      # of a language's words, to be a candidate in a script
MAX_LANGUAGES = 512           # bound of the model: languages x n-gram buckets
SLICE_BYTES = 8 << 20
CELLS = 4 << 20               # words x texts x languages of one Viterbi run

# Code point ranges of scripts (first, last, name).
SCRIPTS = (
    (0x0041, 0x024F, "latin"), (0x0250, 0x02AF, "latin"), (0x0370, 0x03FF, "greek"), (0x0400, 0x052F, "cyrillic"),
    (0x0530, 0x058F, "armenian"), (0x0590, 0x05FF, "hebrew"), (0x0600, 0x077F, "arabic"), (0x08A0, 0x08FF, "arabic"),
    (0x0900, 0x097F, "devanagari"), (0x0980, 0x09FF, "bengali"), (0x0A00, 0x0A7F, "gurmukhi"), (0x0A80, 0x0AFF, "gujarati"),
    (0x0B80, 0x0BFF, "tamil"), (0x0C00, 0x0C7F, "telugu"), (0x0C80, 0x0CFF, "kannada"), (0x0D00, 0x0D7F, "malayalam"),
    (0x0E00, 0x0E7F, "thai"), (0x10A0, 0x10FF, "georgian"), (0x1100, 0x11FF, "hangul"), (0x1E00, 0x1EFF, "latin"),
    (0x1F00, 0x1FFF, "greek"), (0x3040, 0x30FF, "kana"), (0x3400, 0x9FFF, "han"), (0xAC00, 0xD7AF, "hangul"),
    (0xF900, 0xFAFF, "han"), (0xFB50, 0xFDFF, "arabic"), (0x20000, 0x3FFFF, "han"),
)
SCRIPT_NAMES = sorted({name for _, _, name in SCRIPTS}) + ["other"]
FEATURES = len(GRAMS) * BUCKETS


def script_of(letter: str) -> int:
    point = ord(letter) if letter else 0
    name = next((s for a, b, s in SCRIPTS if a <= point <= b), "other")
    return SCRIPT_NAMES.index(name)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, index of every word, offsets of the texts)."""
    lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), NOT_LETTERS)
    offsets = np.asarray(lists.offsets)[: len(texts) + 1].astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    index, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    offsets -= offsets[0]
    if (blank := words.index("").as_py()) >= 0:      # before the first and after the last word
        keep = index != blank
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        index = index[keep]
    return words, index, offsets


def features(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of every n-gram, word of every n-gram, script of every word)."""
    bordered = pc.binary_join_element_wise(" ", words, " ", "").cast(pa.large_binary())
    ends = np.cumsum(pc.binary_length(bordered).to_numpy())
    data = np.frombuffer(b"".join(bordered.to_pylist()), np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(words)), np.diff(ends, prepend=0))
    buckets, owners = [], []
    for k, size in enumerate(GRAMS):
        count = len(data) - size + 1
        if count <= 0:
            continue
        code = np.zeros(count, np.uint32)
        for j in range(size):
            code = (code << np.uint32(8)) | data[j:count + j]
        inside = owner[:count] == owner[size - 1:]
        hashed = (code * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
        buckets.append(hashed[inside].astype(np.int64) + k * BUCKETS)
        owners.append(owner[:count][inside])
    first = pc.utf8_slice_codeunits(words, 0, 1).dictionary_encode()
    known = np.array([script_of(c) for c in first.dictionary.to_pylist()], np.int64)
    scripts = known[first.indices.to_numpy(zero_copy_only=False)] if len(words) else known
    empty = [np.empty(0, np.int64)]
    return np.concatenate(buckets or empty), np.concatenate(owners or empty), scripts


@dataclass
class Model:
    languages: list[str]
    logs: np.ndarray           # languages x FEATURES, log probability
    allowed: np.ndarray        # scripts x languages

    def word_scores(self, words: pa.Array) -> np.ndarray:
        """words x languages; not a candidate: well below the worst candidate.
        A word in a script of no known language scores 0 everywhere."""
        buckets, owners, scripts = features(words)
        scores = np.stack([np.bincount(owners, row[buckets], len(words)) for row in self.logs], axis=1)
        allowed = self.allowed[scripts]
        some = allowed.any(axis=1, keepdims=True)
        worst = np.where(allowed, scores, np.inf).min(axis=1, keepdims=True)
        return np.where(some, np.where(allowed, scores, np.where(some, worst, 0) - 2 * SWITCH_PENALTY), 0.0)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Count n-grams and scripts per language over every training row: text
    and language not NULL and the id outside the held-out fold.  The model
    (a vector of FEATURES sums for each of at most MAX_LANGUAGES languages) is
    all that reaches the driver."""
    width = FEATURES + len(SCRIPT_NAMES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, total in totals.items():
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()),
                                                  pa.array(total[at].astype(np.int64))], ["lang", "feature", "n"])

        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                langs = part.column("lang")
                for lang in pc.unique(langs).to_pylist():
                    words, index, _ = split_words(part.column("text").filter(pc.equal(langs, lang)))
                    times = np.bincount(index, minlength=len(words)).astype(np.float64)
                    buckets, owners, scripts = features(words)
                    total = totals.setdefault(lang, np.zeros(width))
                    total[:FEATURES] += np.bincount(buckets, times[owners], FEATURES)
                    total[FEATURES:] += np.bincount(scripts, times, len(SCRIPT_NAMES))
            if len(totals) > 64:
                yield from rows()
                totals = {}
        yield from rows()

    source = docs.filter(is_training(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    def vector(group: pd.DataFrame) -> pd.DataFrame:
        row = np.zeros(width, np.float32)
        row[group["feature"].to_numpy()] = group["n"].to_numpy()
        return pd.DataFrame({"lang": group["lang"].iloc[:1], "counts": [row.tobytes()]})

    sums = source.mapInArrow(count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    # A group has ``width`` rows at most; the driver gets one row for each language.
    found = sorted(map(tuple, sums.groupBy("lang").applyInPandas(vector, "lang string, counts binary").limit(MAX_LANGUAGES + 1).collect()))
    languages = [lang for lang, _ in found]
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more languages than {MAX_LANGUAGES}, the bound of the model")
    table = np.array([np.frombuffer(c, np.float32) for _, c in found], np.float64).reshape(len(found), width)
    logs = np.empty((len(languages), FEATURES), np.float32)
    for k in range(len(GRAMS)):
        part = table[:, k * BUCKETS:(k + 1) * BUCKETS] + SMOOTHING
        logs[:, k * BUCKETS:(k + 1) * BUCKETS] = np.log(part / part.sum(axis=1, keepdims=True))
    scripts = table[:, FEATURES:]
    share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
    return Model(languages, logs, (share >= MIN_SCRIPT_SHARE).T.copy())


def viterbi(scores: np.ndarray, index: np.ndarray, offsets: np.ndarray, penalty: float) -> np.ndarray:
    """Language number of every word: the best path of each text, texts of
    like length side by side.  Ties take the lower number and stay."""
    k, lengths = scores.shape[1], np.diff(offsets)
    padded = np.concatenate([scores, np.zeros((1, k))])
    labels = np.zeros(len(index), np.int64)
    order = np.argsort(lengths, kind="stable")[::-1]
    order = order[lengths[order] > 0]
    at = 0
    while at < len(order):
        longest = int(lengths[order[at]])
        group = order[at:at + max(1, CELLS // (longest * k))]
        at += len(group)
        steps, lanes = np.arange(longest)[:, None], np.arange(len(group))
        inside = steps < lengths[group]
        where = np.where(inside, offsets[group] + steps, 0)
        words = np.where(inside, index[where], len(scores))
        value = padded[words[0]]
        source = np.zeros(words.shape, np.int16)
        switched = np.zeros((*words.shape, k), bool)
        for t in range(1, longest):
            source[t] = value.argmax(axis=1)
            change = value[lanes, source[t]][:, None] - penalty
            np.greater(change, value, out=switched[t])
            value = np.maximum(value, change) + padded[words[t]]
        path = np.zeros(words.shape, np.int64)
        path[-1] = value.argmax(axis=1)
        for t in range(longest - 1, 0, -1):
            path[t - 1] = np.where(switched[t, lanes, path[t]], source[t], path[t])
        labels[where[inside]] = path[inside]
    return labels


def _label(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(language number and text of every word, offsets, language number of
    every text, its share of the letters); without letters the share is 0."""
    words, index, offsets = split_words(texts)
    n, k = len(texts), len(model.languages)
    labels = viterbi(model.word_scores(words), index, offsets, SWITCH_PENALTY)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    letters = pc.utf8_length(pc.replace_substring_regex(words, r"\p{M}", "")).to_numpy(zero_copy_only=False)[index]
    sums = np.bincount(owner * k + labels, letters, n * k).reshape(n, k)
    best = sums.argmax(axis=1)
    return labels, owner, offsets, best, sums[np.arange(n), best] / np.maximum(sums.sum(axis=1), 1)


_FIELDS = "lang_pred string, score double, spans array<struct<lang:string,first_word:int,n_words:int>>"
_SPANS = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("n_words", pa.int32())]))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """(id, lang_pred, score[, spans]) of every row.

    ``score`` is the share of the letters in spans of ``lang_pred``; ties go
    to the first language by name.  A NULL text, or one without a letter, is
    ``und`` with score 0; so is everything if nothing was learnt.  Rows pass
    one to one, repeated rows and NULL ids too.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    fields = _FIELDS if spans else _FIELDS.rpartition(", spans")[0]
    if not model.languages:
        blank = source.select("id", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
        blank = blank.withColumn("spans", F.expr(f"CAST(array() AS {_FIELDS.rpartition(' ')[2]})")) if spans else blank
        return blank.withColumnRenamed("id", id_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*shared.value.languages, UNDETERMINED], object)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                labels, owner, offsets, best, score = _label(part.column("text"), shared.value)
                best = np.where(score > 0, best, len(names) - 1)
                columns = [part.column("id"), pa.array(names[best], pa.string()), pa.array(score)]
                if spans:
                    new = (labels[1:] != labels[:-1]) | (owner[1:] != owner[:-1])
                    starts = np.flatnonzero(np.concatenate([[len(labels) > 0], new])[:len(labels)])
                    items = [{"lang": names[labels[a]], "first_word": int(a - offsets[owner[a]]), "n_words": int(b - a)}
                             for a, b in zip(starts, np.append(starts[1:], len(labels)))]
                    cuts = np.concatenate([[0], np.cumsum(np.bincount(owner[starts], minlength=part.num_rows))])
                    columns.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(items, _SPANS.value_type)))
                yield pa.RecordBatch.from_arrays(columns, ["id", "lang_pred", "score", *["spans"] * spans])

    return source.mapInArrow(run, f"id {kind}, {fields}").withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows with a language, their ``lang`` set to the one found; NULL texts
    and texts without a letter go, and everything if nothing was learnt.
    The label is found beside the row, so nothing is joined."""
    names = docs.columns
    if not model.languages:
        return docs.filter(F.lit(False))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.array(shared.value.languages, object)
        for batch in batches:
            for part in slices(batch, text_col, SLICE_BYTES):
                _, _, _, best, score = _label(part.column(text_col), shared.value)
                found = pa.array(known[best], pa.string())
                columns = [found if name == lang_col else part.column(i) for i, name in enumerate(names)]
                yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(score > 0))

    return docs.mapInArrow(run, docs.schema)
