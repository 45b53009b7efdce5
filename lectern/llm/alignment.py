"""Alignment of two tokenizers over a corpus, in Arrow.

Both encodings of a text run over the same bytes.  Flattened ids of a slice
of documents, their parents, and segmented cumulative sums of the tokens'
byte lengths give each token's end; an Acero hash join on (document, end)
finds the ends that both share.  Shared ends cut the tokens into groups, and
the two tokens that end there are linked.  ``Table.group_by`` counts linked
id pairs in each slice and Spark adds those counts up for the corpus.

Corpus counts come back to the documents in two ways that together cover
every pair: the most frequent pairs, at most ``HEAD_PAIRS``, are sent to all
executors; the others, each of them rare, are joined by Spark.  So a pair
that holds a large share of all links is never shuffled.

Texts are cut before single spaces and each distinct piece of a slice is
encoded once: no piece of the second vocabulary holds a space after another
character (checked), and the first one's word pattern cuts before it, too.
Texts where white space stands beside a space are encoded whole.

Defined results: NULL and empty texts, and texts that one of the tokenizers
does not give back byte for byte, have no tokens: zeros and an empty digest.
Rows pass one to one, repeated rows, repeated and NULL ids included; each
row counts.  Only the two named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.bpe import LibraryEncoder, Vocabulary
from lectern.llm.common import save, slices

SLICE_BYTES = 4 << 20         # text aligned at once (one document at least)
HEAD_PAIRS = 1_000_000        # pairs whose counts are sent to every executor
PARTIAL_PAIRS = 500_000       # pairs a task counts before it hands them on
_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_WHOLE = rf"{_SPACE} | {_SPACE}|\A{_SPACE}|{_SPACE}\z"


class PlainBytePairs(LibraryEncoder):
    """The tokenizers library's encoder; special tokens' strings are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        self.special = {}
        vocabulary = Vocabulary(path)
        self.bytes = pa.array(vocabulary.bytes, pa.binary())

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids


class Pieces:
    """The sentencepiece library's encoder; it adds the space before a text."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(size)]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece holds a space after another character: texts cannot be cut at spaces")
        self.bytes = pa.array([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
                               for i, p in enumerate(pieces)], pa.binary())

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.model.encode(words, num_threads=1)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.uint32, int(sizes.sum())), sizes

    def whole(self, text: str) -> list[int]:
        return self.model.encode(text)


_KEPT: dict[tuple[type, str], object] = {}


def _encoder(kind: type, path: str):
    """One per worker process, kept between tasks."""
    if (kind, path) not in _KEPT:
        _KEPT[kind, path] = kind(path)
    return _KEPT[kind, path]


def _gather(ids: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the listed pieces one after another, and how many each has."""
    starts, lengths = np.cumsum(sizes) - sizes, sizes[index]
    ends = np.cumsum(lengths)
    at = np.repeat(starts[index] - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)
    return ids[at], lengths


def encode_both(texts: pa.Array, first: PlainBytePairs, second: Pieces) -> list[pa.ListArray]:
    """Ids of space + text by ``first`` and of text by ``second``; none for empty texts."""
    whole = pc.match_substring_regex(texts, _WHOLE)
    lists = pc.split_pattern(pc.if_else(whole, "", texts), " ")
    bounds = np.asarray(lists.offsets).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    index, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
    out = []
    for encoder, mark in ((first, " "), (second, "")):
        # The empty piece is that of an empty text (or one encoded whole).
        ids, sizes = encoder([mark + w if w else "" for w in words])
        alone = [encoder.whole(mark + texts[i].as_py()) for i in np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist()]
        flat, lengths = _gather(ids, sizes, index)
        ends = np.concatenate([[0], np.cumsum(lengths)])[bounds - bounds[0]]
        if alone:
            per_text = np.diff(ends)
            rows = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
            pieces, done = [], 0
            for row, own in zip(rows.tolist(), alone):
                pieces += [flat[done:ends[row]], np.array(own, np.uint32)]
                done, per_text[row] = ends[row], len(own)
            flat = np.concatenate([*pieces, flat[done:]])
            ends = np.concatenate([[0], np.cumsum(per_text)])
        out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int32))))
    return out


def _differs(lists: pa.ListArray, table: pa.Array, texts: pa.Array) -> np.ndarray:
    """True for documents whose tokens' bytes are not space + text."""
    taken = table.take(lists.flatten()).cast(pa.large_binary())
    ends = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1)[np.asarray(lists.offsets)]
    data = taken.buffers()[2]
    got = memoryview(data.to_pybytes() if data else b"")
    return np.array([got[a:b] != b" " + t if t else a != b for a, b, t in
                     zip(ends[:-1].tolist(), ends[1:].tolist(), texts.cast(pa.binary()).to_pylist())], bool)


def _ends(lists: pa.ListArray, lengths: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(parent document, byte offset of its end) of every token."""
    parents = pc.list_parent_indices(lists).to_numpy().astype(np.int64)
    sums = pc.cumulative_sum(lengths.take(lists.flatten())).to_numpy(zero_copy_only=False).astype(np.int64)
    before = np.concatenate([[0], sums])[np.asarray(lists.offsets)[:-1]]
    return parents, sums - before[parents]


def _without(lists: pa.ListArray, drop: np.ndarray) -> pa.ListArray:
    """The lists of the marked documents emptied."""
    if not drop.any():
        return lists
    sizes = np.diff(np.asarray(lists.offsets))
    flat = lists.flatten().filter(pa.array(np.repeat(~drop, sizes)))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(drop, 0, sizes))]), pa.int32()), flat)


def _grouped(lists: pa.ListArray, last: np.ndarray) -> pa.Array:
    """Ids in decimal, joined by commas within groups that end at ``last``."""
    offsets = pa.array(np.concatenate([[0], last + 1]), pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, lists.flatten().cast(pa.string())), ",")


def align(texts: pa.Array, first: PlainBytePairs, second: Pieces) -> dict[str, np.ndarray | pa.Array]:
    """Alignment of a slice of texts; ``pairs``/``times`` list each document's
    distinct linked id pairs (first id * size of the second vocabulary + second
    id, rising) and how often they are linked in it."""
    texts = pc.fill_null(texts, "")
    a, b = encode_both(texts, first, second)
    drop = _differs(a, first.bytes, texts) | _differs(b, second.bytes, texts)
    a, b = _without(a, drop), _without(b, drop)
    sides = []
    for lists, table, name in ((a, first.bytes, "a"), (b, second.bytes, "b")):
        parents, ends = _ends(lists, pc.binary_length(table).cast(pa.int64()))
        key = parents << 40 | ends
        sides.append(pa.table({"key": key, name: np.arange(len(key))}))
    links = sides[0].join(sides[1], "key", join_type="inner", use_threads=False)
    last_a = links["a"].to_numpy()
    order = np.argsort(last_a, kind="stable")
    last_a, last_b = last_a[order], links["b"].to_numpy()[order]
    document = links["key"].to_numpy()[order] >> 40
    n = len(texts)
    per_document = np.bincount(document, minlength=n).astype(np.int64)
    joined = pc.binary_join_element_wise(_grouped(a, last_a), _grouped(b, last_b), "|")
    bounds = pa.array(np.concatenate([[0], np.cumsum(per_document)]), pa.int32())
    groups = pc.binary_join(pa.ListArray.from_arrays(bounds, joined), ";").to_pylist()
    size = len(second.bytes)
    pair = a.flatten().to_numpy()[last_a].astype(np.int64) * size + b.flatten().to_numpy()[last_b]
    width = len(first.bytes) * size
    counted = pa.table({"key": document * width + pair}).group_by("key", use_threads=False).aggregate([([], "count_all")])
    keys, times = counted["key"].to_numpy(), counted["count_all"].to_numpy()
    order = np.argsort(keys)
    keys, times = keys[order], times[order]
    ends = np.searchsorted(keys, np.arange(n + 1) * width).astype(np.int32)
    return {"n_a": np.diff(np.asarray(a.offsets)), "n_b": np.diff(np.asarray(b.offsets)), "n_groups": per_document, "n_links": per_document,
            "groups_sha256": pa.array([hashlib.sha256(g.encode()).hexdigest() if k else "" for g, k in zip(groups, per_document.tolist())]),
            "pairs": pa.ListArray.from_arrays(pa.array(ends), pa.array(keys % width if len(keys) else keys.astype(np.int64))),
            "times": pa.ListArray.from_arrays(pa.array(ends), pa.array(times.astype(np.int32)))}


_COUNTS = "n_a long, n_b long, n_groups long, n_links long"


def align_documents(docs: DataFrame, first_path: str, second_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, token, group and link counts, the digest of
    its groups and its linked pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = _encoder(PlainBytePairs, first_path), _encoder(Pieces, second_path)
        for batch in batches:
            for rows in slices(batch, "text", SLICE_BYTES):
                found = align(rows.column("text"), first, second)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("id"), *[pa.array(v, pa.int64()) if isinstance(v, np.ndarray) else v for v in found.values()]],
                    ["id", *found])
                pa.default_memory_pool().release_unused()

    source = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, {_COUNTS}, groups_sha256 string, pairs array<long>, times array<int>")


def pair_counts(aligned: DataFrame, second_size: int) -> DataFrame:
    """(pair, n, best): links of each id pair in the corpus, and whether no
    pair with the same second id has more.  Partial counts per task in Arrow."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            own = pa.table({"pair": batch.column("pairs").flatten(), "n": batch.column("times").flatten().cast(pa.int64())})
            held = own if held is None else pa.concat_tables([held, own])
            held = held.group_by("pair", use_threads=False).aggregate([("n", "sum")]).rename_columns(["pair", "n"])
            if held.num_rows > PARTIAL_PAIRS:
                yield from held.to_batches()
                held = None
        if held is not None:
            yield from held.to_batches()

    partial = aligned.select("pairs", "times").mapInArrow(run, "pair long, n long")
    counts = save(partial.groupBy("pair").agg(F.sum("n").alias("n")), "alignment-counts")
    second = F.col("pair") % F.lit(second_size)
    # One row per id of the second vocabulary, so its size bounds the broadcast.
    most = counts.groupBy(second.alias("second")).agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), second == F.col("second")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _head_from(counts: DataFrame, limit: int) -> int:
    """Smallest power of two such that at most ``limit`` pairs have that many links."""
    classes = {int(r["c"]): r["k"] for r in
               counts.groupBy(F.floor(F.log2("n")).alias("c")).agg(F.count(F.lit(1)).alias("k")).collect()}
    total, start = 0, 1 + max(classes, default=-1)
    for c in sorted(classes, reverse=True):
        total += classes[c]
        if total > limit:
            break
        start = c
    return 1 << start


def cross_tokenizer_alignment(docs: DataFrame, first_path: str, second_path: str, id_col: str = "doc_id", text_col: str = "text",
                              head_pairs: int | None = None) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_best (links
    whose pair is the commonest of its second id, ties included), count_sum
    (corpus counts added over the links) and groups_sha256."""
    spark = docs.sparkSession
    second_size = len(_encoder(Pieces, second_path).bytes)
    aligned = save(align_documents(docs, first_path, second_path, id_col, text_col)
                   .withColumn("row", F.monotonically_increasing_id()), "alignment")
    counts = save(pair_counts(aligned, second_size), "alignment-pairs")
    head_from = _head_from(counts, HEAD_PAIRS if head_pairs is None else head_pairs)
    head = counts.filter(F.col("n") >= head_from).toArrow().sort_by("pair")
    known = spark.sparkContext.broadcast(tuple(head[c].to_numpy().astype(np.int64) for c in ("pair", "n", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = known.value
        for batch in batches:
            mine, times = batch.column("pairs").flatten().to_numpy(), batch.column("times").flatten().to_numpy().astype(np.int64)
            offsets = np.asarray(batch.column("pairs").offsets).astype(np.int64)
            offsets = offsets - offsets[0]
            at = np.minimum(np.searchsorted(pairs, mine), max(0, len(pairs) - 1))
            hit = pairs[at] == mine if len(pairs) else np.zeros(len(mine), bool)
            sums = []
            for table in (best, n):
                total = np.concatenate([[0], np.cumsum(np.where(hit, table[at] * times, 0) if len(pairs) else np.zeros(len(mine), np.int64))])
                sums.append(pa.array(total[offsets[1:]] - total[offsets[:-1]], pa.int64()))
            rest = pa.array(np.concatenate([[0], np.cumsum(~hit)])[offsets], pa.int32())
            left = [pa.ListArray.from_arrays(rest, pa.array(v[~hit])) for v in (mine, times)]
            kept = ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *sums, *left],
                                             [*kept, "n_best", "count_sum", "rest", "rest_times"])

    kind = aligned.schema["id"].dataType.simpleString()
    scored = save(aligned.mapInArrow(run, f"row long, id {kind}, {_COUNTS}, groups_sha256 string, n_best long, count_sum long, "
                                          "rest array<long>, rest_times array<long>"), "alignment-scored")
    tail = (scored.select("row", F.explode(F.arrays_zip("rest", "rest_times")).alias("r"))
            .select("row", F.col("r.rest").alias("pair"), F.col("r.rest_times").alias("times"))
            .join(counts.filter(F.col("n") < head_from), "pair").groupBy("row")
            .agg(F.sum(F.col("best").cast("long") * F.col("times")).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more_sum")))
    return scored.join(tail, "row", "left").select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links",
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"), "groups_sha256")
