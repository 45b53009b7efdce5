"""Benchmark decontamination: rare n-gram seeds, then local alignment.

1. Words of the test items are numbered.  One pass over all documents counts,
   for every word n-gram of the items, the documents that hold it.
2. The seeds of an item are its n-grams but for the commonest tenth, which
   are seeds too if at most ``RARE`` documents hold them, and so that no
   ``PASSAGE`` words are without a seed.  Rarity is relative
   to the item: a passage copied into a third of all documents keeps its
   seeds, and so does an edited copy whose surviving n-grams are the only ones
   that occur at all.
3. A second pass finds seeds in each document.  Hits of one item that lie
   close together on close diagonals open one window of the text, wide enough
   for the whole item, and Smith-Waterman aligns window and item by words.
   A score of at least ``min_score`` of the item's best possible score
   is a leak.  So is a part of any longer item: a stretch that scores as much
   as ``PASSAGE`` equal words when each difference costs two of them.

Words are runs of letters, marks and digits; scripts written without spaces
count a word a character.  An item of fewer than GRAM words is one n-gram of
all its words and is found wherever a text holds them in a row, so an item of
one word is in every text with that word.

Texts never leave the task that reads them, so a passage that many documents
share gathers nowhere.  Items are handled in blocks of at most
``block_words`` words: what is sent to the executors has that bound, and
more test items mean more passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import slices

GRAM = 3                    # words of a seed, or all words of a shorter item
COMMON_FROM, RARE = 0.9, 100      # quantile of an item's document counts; documents
MATCH, MISMATCH, GAP = 2, -1, -1
MIN_SCORE = 0.5             # of MATCH x words of the item
PASSAGE, DIFFERENCE = 20, -2      # words of a part that is a leak whatever the item's length; cost there, of 1 a word
STRETCH = (PASSAGE - GRAM + 2) // 2     # n-grams; any PASSAGE words hold all of one such run
BLOCK_WORDS = 500_000       # words of test items sent out at once
SLICE_BYTES = 8 << 20
NOT_WORDS = r"[^\p{L}\p{M}\p{N}]+"
UNSPACED = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Bopomofo}\p{Yi}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}\p{Javanese}\p{Balinese}\p{Tai_Le}\p{New_Tai_Lue}\p{Tai_Tham}\p{Tai_Viet}])"


def normalised_words(text: str) -> list[str]:
    """Lower-case runs of letters, marks and digits; single characters in
    scripts without spaces."""
    return [w for w in _split(pa.array([text]))[0].as_py() if w]


def _split(texts: pa.Array) -> pa.Array:
    lower = pc.utf8_lower(texts)
    if pc.any(pc.match_substring_regex(lower, UNSPACED)).as_py():
        lower = pc.replace_substring_regex(lower, UNSPACED, r" \1 ")
    return pc.split_pattern_regex(lower, NOT_WORDS)


@dataclass
class Block:
    """Items of one block, their words numbered from 1; 0 is any other word."""
    item_ids: list
    items: list[np.ndarray]
    vocabulary: dict[str, int]
    grams: np.ndarray            # sorted keys of the items' n-grams
    lengths: list[int]           # words that these have: GRAM, or fewer for shorter items
    seeds: np.ndarray | None = None        # the n-grams that are seeds, sorted
    seed_rows: np.ndarray | None = None    # (n-gram, item, position in it), sorted

    @classmethod
    def of(cls, rows: list[tuple]) -> Block:
        vocabulary: dict[str, int] = {}
        items = [np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words], np.int64) for _, words in rows]
        grams = [gram_keys(i, len(vocabulary))[0] for i in items]
        return cls([r[0] for r in rows], items, vocabulary, np.unique(np.concatenate(grams or [np.empty(0, np.int64)])),
                   sorted({min(GRAM, len(i)) for i in items}))


def gram_keys(words: np.ndarray, size: int, length: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(key, position) of the n-grams made of known words only.  They have
    ``length`` words, as a rule GRAM or the text's fewer, and are padded with 0."""
    length = length or max(1, min(GRAM, len(words)))
    runs = [words[i:max(0, len(words) - length + 1) + i] for i in range(length)]
    known = np.flatnonzero(np.logical_and.reduce([r > 0 for r in runs])) if len(words) >= length else np.empty(0, np.int64)
    return _key([*(r[known] for r in runs), *[np.zeros(len(known), np.int64)] * (GRAM - length)], size), known


def _key(runs: list[np.ndarray], size: int) -> np.ndarray:
    """Exact number of an n-gram: block_words ** GRAM stays below 2 ** 63."""
    key = np.zeros(len(runs[0]), np.int64)
    for run in runs:
        key = key * (size + 1) + run
    return key


def word_numbers(texts: pa.Array, vocabulary: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words (0: not in any item), offsets of the texts."""
    lists = _split(pc.fill_null(texts, ""))
    offsets = np.asarray(lists.offsets)[: len(texts) + 1].astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    get = vocabulary.get
    numbers = np.array([get(w, 0) if w else -1 for w in coded.dictionary.to_pylist()], np.int64)
    words = numbers[coded.indices.to_numpy(zero_copy_only=False)] if len(numbers) else np.empty(0, np.int64)
    keep = words >= 0                      # blanks before the first and after the last word
    return words[keep], np.concatenate([[0], np.cumsum(keep)])[offsets - offsets[0]]


def align(window: np.ndarray, item: np.ndarray, match: int = MATCH, mismatch: int = MISMATCH, gap: int = GAP) -> tuple[int, int, int]:
    """Best local alignment: (score, first, last + 1) of the window's part.

    Row by row; the gap along a row is a running maximum, so each row is a
    few numpy operations.  Number 0 never matches."""
    n = len(window)
    ramp = -gap * np.arange(n + 1)
    row, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best = (0, 0, 0)
    for word in item:
        diagonal = row[:-1] + np.where((window == word) & (window > 0), match, mismatch)
        new, begin = np.zeros(n + 1, np.int64), np.arange(n + 1)
        up = row[1:] + gap
        take = np.maximum(diagonal, up)
        origin = np.where(diagonal >= up, start[:-1], start[1:])
        positive = take > 0
        new[1:][positive] = take[positive]
        begin[1:][positive] = origin[positive]
        lifted = new + ramp
        source = np.maximum.accumulate(lifted)
        first = np.maximum.accumulate(np.where(lifted == source, np.arange(n + 1), 0))
        along = source - ramp
        start = np.where(along > new, begin[first], begin)
        row = np.maximum(new, along)
        at = int(row.argmax())
        if row[at] > best[0]:
            best = (int(row[at]), int(start[at]), at)
    return best


def count_grams(docs: DataFrame, block: Block) -> dict[int, int]:
    """Documents that hold each n-gram of the block, over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        total = np.zeros(len(block.grams), np.int64)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                at, owner, _ = _hits(part.column("text"), block, block.grams)
                distinct = np.unique(owner * max(1, len(block.grams)) + at)
                total += np.bincount(distinct % max(1, len(block.grams)), minlength=len(block.grams))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], ["gram", "n"])

    counted = docs.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r["gram"]: r["n"] for r in counted.collect()}        # a row for each n-gram of the block at most


def _hits(texts: pa.Array, block: Block, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in the sorted table, text, word position) of the n-grams found."""
    words, offsets = word_numbers(texts, block.vocabulary)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    found = []
    for length in block.lengths:
        key, at = gram_keys(words, len(block.vocabulary), length)
        inside = owner[at] == owner[at + length - 1]
        found.append((key[inside], at[inside]))
    key, at = (np.concatenate(x) for x in zip(*found))
    if not len(table) or not len(key):
        empty = np.empty(0, np.int64)
        return empty, empty, empty
    place = np.minimum(np.searchsorted(table, key), len(table) - 1)
    hit = table[place] == key
    return place[hit], owner[at[hit]], at[hit] - offsets[owner[at[hit]]]


def choose_seeds(block: Block, counts: dict[int, int]) -> Block:
    """Keep of each item the n-grams that are rare for it."""
    rows = []
    for number, item in enumerate(block.items):
        key, at = gram_keys(item, len(block.vocabulary))
        if len(key):
            n = np.array([counts.get(int(p), 0) for p in np.searchsorted(block.grams, key)])
            rare = n <= max(RARE, np.quantile(n, COMMON_FROM))
            for start in range(0, len(n), STRETCH):
                if not rare[start:start + STRETCH].any():
                    rare[start + n[start:start + STRETCH].argmin()] = True
            rows.append(np.stack([key[rare], np.full(rare.sum(), number), at[rare]], axis=1))
    found = np.concatenate(rows) if rows else np.empty((0, 3), np.int64)
    block.seed_rows = found[np.lexsort(found.T[::-1])]
    block.seeds = np.unique(found[:, 0])
    return block


def is_leak(window: np.ndarray, item: np.ndarray, score: int, min_score: float) -> bool:
    """Whether the window, whose best alignment has ``score``, holds enough of
    the item as a whole, or a long and good part of it.  Such a part has
    MATCH x PASSAGE by the ordinary scores too."""
    return score >= min_score * MATCH * len(item) or (
        score >= MATCH * PASSAGE and align(window, item, 1, DIFFERENCE, DIFFERENCE)[0] >= PASSAGE)


def _windows(part_texts: pa.Array, block: Block, min_score: float) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, score, first word, last word + 1) of the best alignment of
    each text with each item that it leaks."""
    place, owner, at = _hits(part_texts, block, block.seeds)
    if not len(place):
        return
    words, offsets = word_numbers(part_texts, block.vocabulary)
    low = np.searchsorted(block.seed_rows[:, 0], block.seeds[place], side="left")
    times = np.searchsorted(block.seed_rows[:, 0], block.seeds[place], side="right") - low
    row = np.repeat(low - (np.cumsum(times) - times), times) + np.arange(times.sum())
    owner, at = np.repeat(owner, times), np.repeat(at, times)
    item, diagonal = block.seed_rows[row, 1], at - block.seed_rows[row, 2]
    order = np.lexsort((diagonal, item, owner))
    owner, item, diagonal = owner[order], item[order], diagonal[order]
    sizes = np.array([len(i) for i in block.items])
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > sizes[item[1:]] // 2)
    starts = np.flatnonzero(new)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(owner)]):
        text, number = int(owner[a]), int(item[a])
        size, length = int(sizes[number]), int(offsets[text + 1] - offsets[text])
        first = max(0, int(diagonal[a]) - size // 2)
        last = min(length, int(diagonal[b - 1]) + size + size // 2)
        window = words[offsets[text] + first:offsets[text] + last]
        score, begin, end = align(window, block.items[number])
        found = (score, -(first + begin), first + end)
        if found > best.get((text, number), (0, 0, 0)) and is_leak(window, block.items[number], score, min_score):
            best[text, number] = found
    for (text, number), (score, begin, end) in sorted(best.items()):
        yield text, number, score, -begin, end


def item_blocks(items: DataFrame, item_col: str, text_col: str, block_words: int) -> Iterator[Block]:
    """Items in blocks of at most ``block_words`` words (one item at least),
    streamed to the driver a partition at a time.  NULL texts and texts
    without a word are no items."""
    rows, held = [], 0
    for r in items.select(F.col(item_col).alias("id"), F.col(text_col).alias("text")).filter("text IS NOT NULL").orderBy("id", "text").toLocalIterator():
        if words := normalised_words(r["text"]):
            if rows and held + len(words) > block_words:
                yield Block.of(rows)
                rows, held = [], 0
            rows.append((r["id"], words))
            held += len(words)
    if rows:
        yield Block.of(rows)


def leaks(docs: DataFrame, items: DataFrame, min_score: float = MIN_SCORE, block_words: int = BLOCK_WORDS,
          id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item_id, score, first_word, n_words): a row for each document row
    and item whose best alignment reaches ``min_score`` of the item's best
    possible score, or that hold a long part of it (``is_leak``; the score is
    then lower).  NULL and empty texts have none; repeated rows and repeated
    items give a row each; an empty table gives no rows."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    kind = source.schema["id"].dataType.simpleString()
    item_kind = items.schema[item_col].dataType
    schema = f"id {kind}, item_id {item_kind.simpleString()}, score double, first_word int, n_words int"
    found = None
    for block in item_blocks(items, item_col, item_text_col, block_words):
        block = choose_seeds(block, count_grams(source.select("text"), block))
        part = source.mapInArrow(_finder(spark.sparkContext.broadcast(block), min_score), schema)
        found = part if found is None else found.union(part)
    found = spark.createDataFrame([], schema) if found is None else found
    return found.withColumnsRenamed({"id": id_col, "item_id": item_col})


def _finder(shared, min_score: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                rows = [(text, number, score / (MATCH * len(block.items[number])), begin, end - begin)
                        for text, number, score, begin, end in _windows(part.column("text"), block, min_score)]
                if rows:
                    text, number, score, begin, size = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id").take(pa.array(text)), pa.array([block.item_ids[i] for i in number]),
                         pa.array(score, pa.float64()), pa.array(begin, pa.int32()), pa.array(size, pa.int32())],
                        ["id", "item_id", "score", "first_word", "n_words"])
    return run


def drop_contaminated(docs: DataFrame, items: DataFrame, min_score: float = MIN_SCORE, block_words: int = BLOCK_WORDS,
                      text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a leak of any item, decided in the task
    that reads them; NULL and empty texts stay, columns are unchanged."""
    for block in item_blocks(items, item_col, item_text_col, block_words):
        block = choose_seeds(block, count_grams(docs.select(F.col(text_col).alias("text")).filter("text IS NOT NULL"), block))
        docs = docs.mapInArrow(_dropper(docs.sparkSession.sparkContext.broadcast(block), min_score, text_col), docs.schema)
    return docs


def _dropper(shared, min_score: float, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            for part in slices(batch, text_col, SLICE_BYTES):
                clean = np.ones(part.num_rows, bool)
                for text, *_ in _windows(part.column(text_col), block, min_score):
                    clean[text] = False
                yield part.filter(pa.array(clean))
    return run
