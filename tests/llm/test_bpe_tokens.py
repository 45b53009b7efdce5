"""Token ids and token files against the tokenizers library."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lectern.llm import bpe, token_store
from tests.llm.conftest import ODD

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = bpe.BatchEncoder(bpe.SpeculativeEncoder(PATH))


def ids_of(text: str) -> list[int]:
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\taAthe'sd1<|>.,éß日😀 "), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=6))
def test_ids_equal_the_librarys(texts):
    ids, bounds = ENCODER(pa.array(texts, pa.string()))
    for text, a, b in zip(texts, bounds[:-1], bounds[1:]):
        assert ids[a:b].tolist() == ids_of(text)
        assert bpe.decode(ENCODER.encode_words.vocabulary, ids[a:b]) == LIBRARY.decode(ids_of(text), skip_special_tokens=False)


def test_words_joined_for_the_library_come_apart():
    words = [" the", "a", " ,", " 12", "\n", " ", "  ", " née", ",", " <|", " 日本", "'s"] + [f" word{i}" for i in range(5000)]
    ids, sizes = bpe.LibraryEncoder(PATH)(words)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [ids_of(w) for w in words]


def test_proposals_fail_and_are_merged():
    encoder = bpe.SpeculativeEncoder(PATH)
    rng = random.Random(4)
    words = sorted({"".join(rng.choice(["th", "tion", "er", "ing", "ou", "ble", "an"]) for _ in range(rng.randint(1, 7))) for _ in range(2000)})
    ids, sizes = encoder(words)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [ids_of(w) for w in words]
    assert 0 < encoder.merged < len(words)


def test_one_long_word_is_merged_exactly():
    word = "ab" * 4000 + "thethe" * 500
    vocabulary = ENCODER.encode_words.vocabulary
    assert vocabulary.merge(word.encode()) == ids_of(word)


def test_roundtrip_digests_of_odd_rows(documents):
    docs = documents(*ODD).withColumnRenamed("source", "token_ids")
    got = bpe.roundtrip_digests(docs, PATH).collect()
    want = []
    for doc_id, text in ODD:
        ids = ids_of(text)
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    assert Counter(map(tuple, got)) == Counter(want)
    encoded = bpe.encode_documents(docs, PATH).collect()
    assert Counter((r["doc_id"], tuple(r["token_ids"])) for r in encoded) == Counter((i, tuple(ids_of(t))) for i, t in ODD)


def test_empty_table(documents, spark):
    none = documents((1, "x")).filter("false")
    assert bpe.roundtrip_digests(none, PATH).count() == 0
    folder = token_store.token_folder(spark)
    token_store.write_tokens(none, folder, PATH, 2)
    assert token_store.read_documents(spark, folder).count() == 0


@pytest.mark.parametrize("n", [0, 1, 7, 511, 512, 513, 5000])
def test_wavelet_matrix_answers_like_a_list(n):
    rng = np.random.default_rng(n)
    values = rng.integers(0, 50, n) * 1013
    matrix = token_store.WaveletMatrix.from_bytes(token_store.WaveletMatrix.build(values, 16).to_bytes())
    assert matrix.values().tolist() == values.tolist()
    for i in range(0, n, max(1, n // 40)):
        assert matrix.access(i) == values[i]
        assert matrix.rank(int(values[i]), i) == int((values[:i] == values[i]).sum())
        assert matrix.count(int(values[i]), i // 2, i) == int((values[i // 2:i] == values[i]).sum())
    for symbol in {0, 1013, 7 * 1013, 65535}:
        assert matrix.occurrences(symbol) == np.flatnonzero(values == symbol).tolist()
    with pytest.raises(IndexError):
        matrix.access(n)


def test_token_files_read_back(documents, spark, monkeypatch):
    monkeypatch.setattr(token_store, "BLOCK_TOKENS", 2000)
    rows = [(i, f"text number {i} " * (i % 90)) for i in range(400)] + ODD
    docs = documents(*rows).repartition(5)
    folder = token_store.token_folder(spark)
    token_store.write_tokens(docs, folder, PATH, 2)
    got = sorted(map(tuple, token_store.read_documents(spark, folder).collect()), key=lambda r: r[1])
    assert [r[0] is None for r in got] == sorted([r[0] is None for r in got], reverse=True)
    known = [r[0] for r in got if r[0] is not None]
    assert known == sorted(known)
    start = 0
    for _, at, n, _ in got:
        assert at == start
        start += n
    want = Counter((i, len(ids_of(t)) + 1, zlib.crc32(np.array([*ids_of(t), 2], "<u4").tobytes())) for i, t in rows)
    assert Counter((r[0], r[2], r[3]) for r in got) == want
    blocks = token_store.open_tokens(spark, folder).orderBy("start").collect()
    assert len(blocks) > 1 and [b["start"] for b in blocks] == [0, *np.cumsum([b["n_tokens"] for b in blocks])[:-1].tolist()]
    first = token_store.WaveletMatrix.from_bytes(bytes(blocks[0]["matrix"]))
    assert first.count(2) == len(blocks[0]["doc_ids"])


def test_lookups_over_a_token_folder_equal_lists(documents, spark):
    rng = random.Random(3)
    words = ["river", "stone", "lamp", "quartz", "of", "the", "the", "the"]
    docs = documents(*ODD, *[(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(100, 400)], (50, "the lamp " * 150_000))
    folder = token_store.token_folder(spark)
    token_store.write_tokens(docs.repartition(4), folder, PATH, 2)
    stream = np.concatenate([token_store.WaveletMatrix.from_bytes(bytes(r["matrix"])).values()
                             for r in token_store.open_tokens(spark, folder).orderBy("start").collect()]).tolist()
    assert spark.read.parquet(folder).count() > 1 and len(stream) > token_store.BLOCK_TOKENS
    lamp, rare = ids_of(" lamp")[0], ids_of(" quartz")[0]
    symbols = [lamp, rare, 2, 49_999, 1 << 20]
    counts = Counter(stream)
    assert dict(map(tuple, token_store.count_tokens(spark, folder, symbols).collect())) == {s: counts[s] for s in symbols}
    found = sorted(map(tuple, token_store.find_tokens(spark, folder, [rare, 2, lamp, rare]).collect()))
    assert found == sorted((t, i) for i, t in enumerate(stream) if t in (rare, 2, lamp))
    places = [0, len(stream) - 1, len(stream), -1, 1 << 40, None, *rng.choices(range(len(stream)), k=300)]
    asked = spark.createDataFrame([(p,) for p in places], "position long")
    got = sorted(map(tuple, token_store.tokens_at(spark, folder, asked).collect()))
    assert got == sorted({(p, stream[p]) for p in places if p is not None and 0 <= p < len(stream)})


def test_lookups_in_an_empty_folder(documents, spark):
    folder = token_store.token_folder(spark)
    token_store.write_tokens(documents((1, "x")).limit(0), folder, PATH, 2)
    assert token_store.count_tokens(spark, folder, [5]).collect() == [(5, 0)]
    assert token_store.find_tokens(spark, folder, [5]).count() == 0
    assert token_store.tokens_at(spark, folder, spark.createDataFrame([(0,)], "position long")).count() == 0
