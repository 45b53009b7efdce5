"""Cross-tokenizer alignment against a plain loop over tokens."""

from __future__ import annotations

import hashlib
from collections import Counter

import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lectern.llm import alignment
from lectern.llm.queries import PIECES, VOCABULARY, op13_tokenizer_alignment
from tests.llm.conftest import ODD

# Fixed by the formats: byte-level alphabet and byte pieces.
_OWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_ALPHABET = {chr(b): b for b in _OWN} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in _OWN)}


def brute(rows):
    first = Tokenizer.from_file(VOCABULARY)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a_bytes = lambda i: bytes(_ALPHABET[c] for c in first.id_to_token(i))
    b_bytes = lambda i: (bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i)
                         else second.id_to_piece(i).replace("▁", " ").encode())
    found, counts = [], Counter()
    for doc_id, text in rows:
        a, b = first.encode(f" {text or ''}", add_special_tokens=False).ids, second.encode(text or "")
        whole = f" {text}".encode()
        if not text or b"".join(map(a_bytes, a)) != whole or b"".join(map(b_bytes, b)) != whole:
            found.append((doc_id, [], [], [], ""))
            continue
        ends = []
        for ids, raw in ((a, a_bytes), (b, b_bytes)):
            at, own = 0, {}
            for place, i in enumerate(ids):
                at += len(raw(i))
                own[at] = place
            ends.append(own)
        groups, links, done = [], [], (0, 0)
        for end in sorted(ends[0].keys() & ends[1].keys()):
            i, j = ends[0][end], ends[1][end]
            groups.append(",".join(map(str, a[done[0]:i + 1])) + "|" + ",".join(map(str, b[done[1]:j + 1])))
            links.append((a[i], b[j]))
            done = i + 1, j + 1
        counts.update(links)
        found.append((doc_id, a, b, links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = Counter()
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    return Counter((d, len(a), len(b), len(x), len(x), sum(counts[p] == most[p[1]] for p in x), sum(counts[p] for p in x), digest)
                   for d, a, b, x, digest in found)


SPACES = [(20, " lead"), (21, "tail "), (22, "a  b"), (23, "▁x"), (24, "a\n b"), (25, "a \nb"), (26, "a\n \nb c"), (27, "x　 y"),
          (28, "a\n\n b\n c"), (29, "<unk> <s> <0x41> </s>"), (30, "x\x00y \r\n z;\r"), (31, "a b\n\n"), (32, "\na b"), (33, "ﬁ é é ½")]


@pytest.mark.parametrize("head", [None, 0, 7])
def test_alignment_equals_the_plain_loop(documents, head):
    rows = [*ODD, *SPACES, *[(100 + i, "the same words again and again, " * (i % 7)) for i in range(30)]]
    docs = documents(*rows).withColumnsRenamed({"lang": "pair", "source": "row", "n_chars": "n"})
    got = alignment.cross_tokenizer_alignment(docs, VOCABULARY, PIECES, head_pairs=head)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, got.collect())) == brute(rows)


def test_slices_and_tasks_do_not_matter(documents, monkeypatch):
    rows = [(i, f"document {i % 9} holds naïve {'words ' * (i % 5)}and {i * 7919} numbers") for i in range(60)]
    monkeypatch.setattr(alignment, "SLICE_BYTES", 100)
    monkeypatch.setattr(alignment, "PARTIAL_PAIRS", 3)
    got = alignment.cross_tokenizer_alignment(documents(*rows).repartition(5), VOCABULARY, PIECES)
    assert Counter(map(tuple, got.collect())) == brute(rows)


def test_tables_without_tokens(documents):
    assert alignment.cross_tokenizer_alignment(documents((1, "x")).filter("false"), VOCABULARY, PIECES).count() == 0
    got = alignment.cross_tokenizer_alignment(documents((1, None), (2, "")), VOCABULARY, PIECES).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_pieces_are_encoded_as_in_place():
    first, second = alignment.PlainBytePairs(VOCABULARY), alignment.Pieces(PIECES)
    texts = [t or "" for _, t in [*ODD, *SPACES]]
    a, b = alignment.encode_both(pa.array(texts), first, second)
    assert a.to_pylist() == [first.whole(f" {t}") if t else [] for t in texts]
    assert b.to_pylist() == [second.whole(t) for t in texts]


def test_query_over_the_tables(spark, sf_small):
    from lectern.llm.common import ship
    ship(spark)
    rows = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()
    assert Counter(map(tuple, op13_tokenizer_alignment(spark, sf_small).collect())) == brute([tuple(r) for r in rows])
