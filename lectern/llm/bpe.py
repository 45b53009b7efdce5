"""Byte-level BPE, speculate and verify.

A greedy longest match proposes the tokens of a word.  A proposal is the
true encoding exactly when every adjacent pair of its tokens is
*compatible*, that is when encoding the pair's joined bytes gives the same
pair back.  All pairs of all proposals of a batch are tested together
against a table of known pairs; only words with an incompatible pair run
the exact merge loop.

Texts are cut before every single space.  Where no white space stands
before a space, each such chunk encodes alone as it does in place, so a
batch is encoded once per distinct chunk (Arrow's dictionary encoding) and
the ids are gathered with numpy.  Any other text (white-space runs, special
tokens, characters outside ``_PLAIN``) is cut by the tokenizers library's
own pre-tokenizer; its words go through the same encoder.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import os
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from lectern.llm.common import slices

# The word pattern of this family of vocabularies.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# Characters whose letter/number class is the same in every Unicode release.
_PLAIN = (r"\t-\r -~\x{A1}-\x{24F}\x{391}-\x{3A1}\x{3A3}-\x{3FF}\x{400}-\x{481}\x{48A}-\x{52F}\x{621}-\x{63A}"
          r"\x{641}-\x{64A}\x{2010}-\x{2027}\x{2030}-\x{205E}\x{3041}-\x{3096}\x{30A1}-\x{30FA}"
          r"\x{4E00}-\x{9FA5}\x{AC00}-\x{D7A3}")
_SPECIAL_MARK = r"<\|"
UNSAFE = rf"[\t-\r ] |{_SPECIAL_MARK}|[^{_PLAIN}]"

SLICE_BYTES = 8 << 20         # text handled at once
JOINED = 2000                 # words the library encodes as one text
MAX_PAIRS = 4_000_000         # known pairs of tokens per worker


def byte_alphabet() -> dict[str, int]:
    """Character used in the vocabulary file for each byte: printable bytes
    stand for themselves, the others are numbered from U+0100 upward."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens and merges of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()

        def raw(token: str) -> bytes:
            return bytes(alphabet[c] for c in token)

        self.ids = {raw(token): i for token, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        size = 1 + max([*self.ids.values(), *self.special.values()])
        self.bytes: list[bytes] = [b""] * size
        for token, i in self.ids.items():
            self.bytes[i] = token
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = (raw(t) for t in (merge.split(" ") if isinstance(merge, str) else merge))
            self.merges[self.ids[left], self.ids[right]] = (rank, self.ids[left + right])
        self.longest = max(map(len, self.ids))

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        ids, at, end = [], 0, len(word)
        while at < end:
            stop = min(end, at + self.longest)
            while (token := self.ids.get(word[at:stop])) is None:
                stop -= 1
            ids.append(token)
            at = stop
        return ids

    def merge(self, word: bytes) -> list[int]:
        """Exact BPE: lowest rank first, leftmost among equals, in n log n."""
        ids = [self.ids[word[i:i + 1]] for i in range(len(word))]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        merges, gone, queue = self.merges, len(ids), []
        for i in range(len(ids) - 1):
            if found := merges.get((ids[i], ids[i + 1])):
                queue.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, i, left, right, joined = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j >= gone or ids[j] != right:
                continue                                  # one side has merged since
            ids[i], ids[j] = joined, -1
            after[i] = k = after[j]
            if k < gone:
                before[k] = i
                if found := merges.get((joined, ids[k])):
                    heapq.heappush(queue, (found[0], i, joined, ids[k], found[1]))
            if (h := before[i]) >= 0 and (found := merges.get((ids[h], joined))):
                heapq.heappush(queue, (found[0], h, ids[h], joined, found[1]))
        return [i for i in ids if i >= 0]


class SpeculativeEncoder:
    """Encodes lists of words by proposal, pair check and, where needed, merging."""

    memo_entries = 500_000        # words remembered per worker before starting afresh

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.special = self.vocabulary.special
        self.pairs = np.empty(0, np.int64)      # known pairs, sorted
        self.fits = np.empty(0, bool)
        self.merged = 0                         # words that needed exact merging

    def _learn(self, pairs: np.ndarray) -> None:
        v, size = self.vocabulary, len(self.vocabulary.bytes)
        fits = [v.merge(v.bytes[p // size] + v.bytes[p % size]) == [p // size, p % size] for p in pairs.tolist()]
        pairs, fits = np.concatenate([self.pairs, pairs]), np.concatenate([self.fits, np.array(fits, bool)])
        order = np.argsort(pairs)
        self.pairs, self.fits = pairs[order], fits[order]

    def _known(self, pairs: np.ndarray) -> np.ndarray:
        """Positions in the table, -1 for unknown pairs."""
        if not len(self.pairs):
            return np.full(len(pairs), -1)
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pairs, at, -1)

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, how many each word has)."""
        if len(self.pairs) > MAX_PAIRS:
            self.pairs, self.fits = self.pairs[:0], self.fits[:0]
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        proposals = [self.vocabulary.propose(w) for w in raw]
        ids, sizes = _flat(proposals)
        owner = np.repeat(np.arange(len(words)), sizes)
        inside = owner[1:] == owner[:-1]
        pairs, owner = (ids[:-1].astype(np.int64) * len(self.vocabulary.bytes) + ids[1:])[inside], owner[1:][inside]
        if not len(pairs):
            return ids, sizes
        distinct, index = np.unique(pairs, return_inverse=True)
        if len(new := distinct[self._known(distinct) < 0]):
            self._learn(new)
        bad = np.unique(owner[~self.fits[self._known(distinct)][index]])
        for k in bad.tolist():
            proposals[k] = self.vocabulary.merge(raw[k])
        self.merged += len(bad)
        return _flat(proposals) if len(bad) else (ids, sizes)


def _strings(texts: pa.Array) -> list[str]:
    """The strings of an array without NULLs, converted together: ``to_pylist``
    makes a scalar object of each first."""
    return texts.to_numpy(zero_copy_only=False).tolist()


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(itertools.chain.from_iterable(lists), np.uint32, int(sizes.sum())), sizes


class LibraryEncoder:
    """The same interface over the tokenizers library's own encoder."""

    memo_entries = 900_000        # it holds no vocabulary of its own in Python

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"     # Spark's tasks already use the cores
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}

        self.lengths = np.zeros(self.tokenizer.get_vocab_size(), np.int64)      # bytes of a token: a character stands for each
        for token, i in self.tokenizer.get_vocab().items():
            self.lengths[i] = len(token)

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # Words that bring their space are cut apart again when joined, so the
        # library gets a few long texts; byte counts tell the words' tokens.
        joins = [len(w) > 1 and w[0] == " " and not w[1].isspace() for w in words]
        together = [w for w, j in zip(words, joins) if j]
        texts = ["".join(together[i:i + JOINED]) for i in range(0, len(together), JOINED)]
        encode = self.tokenizer.encode_batch_fast
        ids = np.concatenate([np.empty(0, np.uint32), *[np.array(e.ids, np.uint32) for e in encode(texts, add_special_tokens=False)]])
        ends = np.cumsum(np.fromiter((len(w.encode()) for w in together), np.int64, len(together)))
        last = np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1
        if len(ends) and not np.array_equal(np.cumsum(self.lengths[ids])[last - 1], ends):
            raise AssertionError("a token crosses the border of two words")
        apart = [w for w, j in zip(words, joins) if not j]
        rest, rest_sizes = _flat([e.ids for e in encode(apart, add_special_tokens=False)])
        # Back into the order of the words.
        joins = np.array(joins, bool)
        order = np.argsort(~joins, kind="stable")
        sizes = np.empty(len(words), np.int64)
        sizes[order] = np.concatenate([np.diff(last, prepend=0), rest_sizes])
        starts = np.empty(len(words), np.int64)
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        return np.concatenate([ids, rest])[at], sizes


class BatchEncoder:
    """Token ids of whole texts, each distinct word encoded once."""

    def __init__(self, encode_words: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.encode_words = encode_words
        self.special = encode_words.special
        self.memo: dict[str, bytes] = {}       # word -> ids as 32-bit integers
        self.cutter = ByteLevel(add_prefix_space=False, use_regex=True)

    def _ids(self, words: list[str]) -> list[bytes]:
        """Ids of words, new ones encoded together."""
        found = list(map(self.memo.get, words))
        missing = [i for i, ids in enumerate(found) if ids is None]
        if missing:
            if len(self.memo) > self.encode_words.memo_entries:
                self.memo.clear()
            new = list({words[i] for i in missing})
            ids, sizes = self.encode_words(new)
            data, ends = ids.astype(np.uint32).tobytes(), (4 * np.cumsum(sizes)).tolist()
            self.memo.update(zip(new, [data[a:b] for a, b in zip([0, *ends], ends)]))
            get = self.memo.__getitem__
            for i in missing:
                found[i] = get(words[i])
        return found

    def _chunks(self, chunks: list[str]) -> tuple[bytes, np.ndarray]:
        """Ids, and how many each chunk has, of chunks that start with their one
        space and end in no white space: joined, they are cut into the same words."""
        words = WORDS.findall("".join(chunks))
        ids = self._ids(words)
        last = np.searchsorted(np.cumsum(np.fromiter(map(len, words), np.int64, len(words))),
                               np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks))))
        sizes = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 4)
        return b"".join(ids), np.diff(sizes[last], prepend=0) if len(chunks) else last

    def _alone(self, chunks: list[str]) -> list[bytes]:
        """Ids of texts that only encode as in place when taken one by one."""
        words = [WORDS.findall(c) for c in chunks]
        ids = iter(self._ids([w for ws in words for w in ws]))
        return [b"".join([next(ids) for _ in ws]) for ws in words]

    def _whole(self, text: str) -> bytes:
        """Ids of any text: special tokens, then the library's own word cuts."""
        parts = [text]
        for token in sorted(self.special, key=len, reverse=True):
            parts = [x for p in parts for x in ([p] if p in self.special else _split_keep(p, token))]
        out = []
        for part in parts:
            if part in self.special:
                out.append(array("I", [self.special[part]]).tobytes())
            elif part:
                out += self._ids([part[a:b] for _, (a, b) in self.cutter.pre_tokenize_str(part)])
        return b"".join(out)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, offsets of the texts)."""
        texts = pc.fill_null(texts, "")
        unsafe = np.flatnonzero(pc.match_substring_regex(texts, UNSAFE).to_numpy(zero_copy_only=False))
        whole = {int(i): self._whole(texts[int(i)].as_py()) for i in unsafe}
        if whole:
            mask = np.zeros(len(texts), bool)
            mask[unsafe] = True
            texts = pc.if_else(pa.array(mask), "", texts)
        lists = pc.split_pattern(texts, " ")
        offsets = np.asarray(lists.offsets)[: len(texts) + 1].astype(np.int64)
        flat = lists.flatten()
        offsets = offsets - offsets[0]
        coded = flat.dictionary_encode()
        index = coded.indices.to_numpy().astype(np.int64)
        first = offsets[:-1]
        # A chunk stands with its space, the first of a text has none.  Last
        # chunks may end in white space; those, too, are taken one by one.
        spaced = pc.binary_join_element_wise("", coded.dictionary, " ")
        odd = pc.match_substring_regex(spaced, r"[\t-\r ]\z").to_numpy(zero_copy_only=False)
        joined, counts = self._chunks(_strings(spaced.filter(pa.array(~odd))))
        single = self._alone(_strings(spaced.filter(pa.array(odd))))
        firsts = self._alone(_strings(flat.take(pa.array(first))))
        for i, own in whole.items():
            firsts[i] = own
        place = np.empty(len(odd), np.int64)
        place[~odd] = np.arange(len(counts))
        place[odd] = len(counts) + np.arange(len(single))
        index = place[index]
        index[first] = len(odd) + np.arange(len(first))
        apart = single + firsts
        sizes = np.concatenate([counts, np.fromiter(map(len, apart), np.int64, len(apart)) // 4])
        store = np.frombuffer(b"".join([joined, *apart]), np.uint32)
        starts = np.cumsum(sizes) - sizes
        lengths = sizes[index]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat((starts[index] - (ends - lengths)).astype(np.int32), lengths)
        at += np.arange(total, dtype=np.int32)
        bounds = np.concatenate([[0], ends])[offsets]
        pa.default_memory_pool().release_unused()
        return store[at], bounds


class ChunkEncoder(BatchEncoder):
    """The same over the tokenizers library, which cuts words itself: chunks,
    not words, are remembered, and new ones go to the library as they are.
    When the memo is half full it becomes the older one, which frequent
    chunks leave again on their next use."""

    def __init__(self, encode_words: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        super().__init__(encode_words)
        self.older: dict[str, bytes] = {}

    def _chunks(self, chunks: list[str]) -> tuple[bytes, np.ndarray]:
        if len(self.memo) > self.encode_words.memo_entries // 2:
            self.older, self.memo = self.memo, {}
        found = list(map(self.memo.get, chunks))
        missing = []
        for i, ids in enumerate(found):
            if ids is None:
                if (ids := self.older.get(chunks[i])) is None:
                    missing.append(i)
                else:
                    self.memo[chunks[i]] = found[i] = ids
        if missing:
            ids, sizes = self.encode_words([chunks[i] for i in missing])
            data, ends = ids.astype(np.uint32, copy=False).tobytes(), (4 * np.cumsum(sizes)).tolist()
            start = 0
            for i, end in zip(missing, ends):
                self.memo[chunks[i]] = found[i] = data[start:end]
                start = end
        return b"".join(found), np.fromiter(map(len, found), np.int64, len(found)) // 4


def _split_keep(text: str, token: str) -> list[str]:
    pieces = text.split(token)
    return [x for i, p in enumerate(pieces) for x in ((token, p) if i else (p,))]


_ENCODERS: dict[tuple[type, str], BatchEncoder] = {}


def batch_encoder(kind: type, path: str) -> BatchEncoder:
    """One encoder per worker process, kept between tasks."""
    if (kind, path) not in _ENCODERS:
        _ENCODERS[kind, path] = (ChunkEncoder if kind is LibraryEncoder else BatchEncoder)(kind(path))
    return _ENCODERS[kind, path]


def decode(vocabulary: Vocabulary, ids: np.ndarray) -> str:
    """Text of token ids, special tokens included."""
    return b"".join(map(vocabulary.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, token_ids array<int>) of every row; a NULL or empty text has no ids.

    Rows pass one to one: repeated rows, repeated ids and NULL ids stay.
    Only the two named columns are read, so other columns cannot clash.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = batch_encoder(SpeculativeEncoder, path)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                ids, bounds = encoder(part.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("id"), lists], ["id", "token_ids"])

    source = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, token_ids array<int>").withColumnRenamed("id", id_col)


def roundtrip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every row: (id, n_tokens, ids_sha256, decoded_sha256).

    The decoded text comes from the ids alone.  NULL and empty texts have no
    ids and decode to the empty text; rows pass one to one.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = batch_encoder(SpeculativeEncoder, path)
        vocabulary = encoder.encode_words.vocabulary
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                ids, bounds = encoder(part.column("text"))
                each = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([
                    part.column("id"),
                    pa.array(np.diff(bounds), pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in each], pa.string()),
                    pa.array([hashlib.sha256(decode(vocabulary, x).encode()).hexdigest() for x in each], pa.string()),
                ], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    source = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    kind = source.schema["id"].dataType.simpleString()
    return (source.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
            .withColumnRenamed("id", id_col))
