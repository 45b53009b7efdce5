"""Language, toxicity, quality and decontamination."""

from __future__ import annotations

import random

import numpy as np
import pytest

from lectern.llm import decontaminate, language, quality, toxicity
from lectern.llm.common import is_held_out, table
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.01"
SYLLABLES = {"aa": ["lo", "mi", "na", "ru"], "bb": ["kt", "schw", "ung", "pfe"], "ru": ["да", "ко", "не"], "el": ["αλ", "ος", "μη"]}


def sentence(lang: str, n: int, rng: random.Random) -> str:
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def model(documents):
    rng = random.Random(5)
    return language.train(documents(*[(i, sentence(lang, 40, rng), lang) for i, lang in enumerate(list(SYLLABLES) * 30)],
                                    (9001, None, "aa"), (None, "lo mi na", "zz"), (9002, "x y", None)))


def brute_path(scores: np.ndarray, penalty: float) -> tuple[float, list[int]]:
    """Best path by trying all."""
    best = (-np.inf, [])
    n, k = scores.shape
    for code in range(k ** n):
        path = [code // k ** t % k for t in range(n)]
        value = sum(scores[t, p] for t, p in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))
        best = max(best, (value, path))
    return best


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(2)
    for _ in range(20):
        n = int(rng.integers(1, 8))
        scores = rng.normal(size=(n, 3)) * 3
        labels = language.viterbi(scores, np.arange(n), np.array([0, n]), 2.0)
        value = scores[np.arange(n), labels].sum() - 2.0 * (labels[1:] != labels[:-1]).sum()
        assert value == pytest.approx(brute_path(scores, 2.0)[0])


def test_texts_of_different_length_do_not_mix(monkeypatch):
    rng = np.random.default_rng(3)
    scores, index = rng.normal(size=(50, 4)) * 4, rng.integers(0, 50, 900)
    offsets = np.array([0, 0, 5, 6, 406, 406, 900])
    together = language.viterbi(scores, index, offsets, 3.0)
    for a, b in zip(offsets[:-1], offsets[1:]):
        assert together[a:b].tolist() == language.viterbi(scores, index[a:b], np.array([0, b - a]), 3.0).tolist()
    monkeypatch.setattr(language, "CELLS", 1)
    assert language.viterbi(scores, index, offsets, 3.0).tolist() == together.tolist()


def test_mixed_text_gets_spans(documents, model):
    assert model.languages == sorted(SYLLABLES)
    rng = random.Random(8)
    text = sentence("aa", 30, rng) + ". " + sentence("bb", 20, rng) + "; " + sentence("ru", 10, rng) + " " + sentence("el", 8, rng)
    row = language.identify(documents((1, text)), model).first()
    assert [(s["lang"], s["first_word"], s["n_words"]) for s in row["spans"]] == [("aa", 0, 30), ("bb", 30, 20), ("ru", 50, 10), ("el", 60, 8)]
    assert row["lang_pred"] in SYLLABLES and 0 < row["score"] < 1


def test_language_of_odd_rows(documents, model):
    docs = documents(*ODD, (30, "12345 !!! ́́"), (31, "漢字")).withColumnRenamed("source", "score")
    found = language.identify(docs, model).collect()
    assert len(found) == len(ODD) + 2
    for r in found:
        blank = r["doc_id"] in (1, 2, 3, 30) or r["doc_id"] is None and r["score"] == 0
        assert (r["lang_pred"] == "und") == blank and (r["score"] == 0) == blank and (not r["spans"]) == blank
    kept = language.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["lang_pred"] != "und" for r in found)
    untaught = language.train(docs.filter("false"))
    assert {r["lang_pred"] for r in language.identify(docs, untaught).collect()} == {"und"}
    assert language.keep_identified(docs, untaught).count() == 0
    assert language.identify(docs.filter("false"), model).count() == 0


def test_language_of_held_out_documents(spark, documents):
    docs = table(spark, SF, "documents", "doc_id", "text", "lang")
    found = language.identify(docs, language.train(docs), spans=False).join(docs.select("doc_id", "lang"), "doc_id")
    held = found.filter(is_held_out("doc_id"))
    assert held.filter("lang_pred = lang").count() >= 0.99 * held.count() > 100


def test_windows_cover_every_text():
    for _, text in ODD:
        data = toxicity.normalised(text or "")
        assert len(data) % toxicity.CODE == 0
        counts = max(1, -(-(len(data) - (toxicity.WINDOW - toxicity.STEP)) // toxicity.STEP))
        assert (counts - 1) * toxicity.STEP + toxicity.WINDOW >= len(data)
    code = toxicity.normalised
    compressors = toxicity.Model(code("some text " * 9), {0: b"", 1: code("Idiot")}).compressors()
    texts = ["a calm text about the sea. " * 30 + " idiot " + "more of the sea. " * 30, "a calm text about the sea, idiotic. " * 60, ""]
    saved, first = toxicity.distances(texts, compressors)
    alone = [toxicity.distances([t], compressors)[0].tolist() for t in texts]
    assert saved.tolist() == sum(alone, []) and first.tolist() == [0, len(alone[0]), len(alone[0]) + len(alone[1])]
    assert max(alone[0]) > 0 >= max(alone[1])


def test_windows_of_one_document_by_hand():
    """Window lengths again, one plain compression at a time."""
    code = toxicity.normalised
    model = toxicity.Model(code("the sea was calm and the boat came home "), {0: code("pleasant"), 1: code("rotten scum")},
                           {0: code("harbour"), 1: code("scum")})
    text = "The rotten boat came home, scum! " * 7 + "and the sea was calm " * 9
    expected = []
    for pair in model.pairs():
        data, own = code(text), []
        for at in range(0, max(1, len(data) - (toxicity.WINDOW - toxicity.STEP)), toxicity.STEP):
            window = data[at:at + toxicity.WINDOW]
            own.append(len(pair[0].compress(window)) - len(pair[1].compress(window)))
        expected.append(own)
    *found, first = toxicity.distances([text], *model.pairs())
    assert [f.tolist() for f in found] == expected and first.tolist() == [0]
    x = toxicity.document_features([text], model.pairs())[0]
    trained, typical = map(np.array, expected)
    assert np.allclose(x, [trained.max(), trained.mean(), (trained > 0).mean(), typical.max(), np.log1p((typical > 0).sum()),
                           np.log1p(np.maximum(typical, 0).sum()), (typical > 0).mean()])


def test_toxicity_of_held_out_documents(spark, documents):
    big = "/root/testdata/sf0.1"          # the smaller tables have two toxic documents of some languages
    docs, labels = table(spark, big, "documents", "doc_id", "text", "lang"), table(spark, big, "labels")
    model = toxicity.train(docs, labels)
    rows = toxicity.score_texts(docs, model).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").filter(is_held_out("doc_id")).collect()
    clean = [r["score"] >= 0.3 for r in rows if not r["toxic"]]
    assert sum(clean) <= 0.02 * len(clean)
    for lang in ("en", "de", "es", "fr"):
        toxic = [r["score"] >= 0.3 for r in rows if r["toxic"] and r["lang"] == lang]
        assert sum(toxic) >= 0.9 * len(toxic) > 9, lang
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_toxic_words_that_ordinary_text_also_uses_are_learnt(documents, spark):
    """The words are in too many ordinary documents to pass as typical: the trained pair finds them."""
    rng = random.Random(4)
    nasty = [sentence("bb", 1, rng) + sentence("bb", 1, rng) + "q" for _ in range(20)]
    rows, labels = [], []
    for i in range(1200):
        words = sentence("aa", 60, rng).split()
        toxic = i % 3 == 0
        for word in rng.sample(nasty, 12 if toxic else rng.choice([0, 1, 2])):
            words.insert(rng.randrange(len(words)), word)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, labels = documents(*rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert not model.typical[1]
    held = toxicity.score_texts(docs, model).join(labels, "doc_id").filter(is_held_out("doc_id")).collect()
    toxic, ordinary = ([r["score"] >= 0.3 for r in held if r["toxic"] == k] for k in (1, 0))
    assert sum(toxic) >= 0.9 * len(toxic) > 50 and sum(ordinary) <= 0.1 * len(ordinary)


def test_toxicity_and_quality_of_odd_rows(documents, spark):
    docs = documents(*ODD).withColumnRenamed("source", "label")
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    odd = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (3, None, None), (None, 1, 1), (12, 0, 0), (8, 7, 7)], "doc_id long, toxic int, quality int")
    for labels in (none, odd):
        stats = quality.document_statistics(docs)
        tox, good = toxicity.train(docs, labels), quality.train(stats, labels)
        for found in (toxicity.score_texts(docs, tox), quality.score(stats, good)):
            scores = [r["score"] for r in found.collect()]
            assert len(scores) == len(ODD) and all(0 <= s <= 1 for s in scores)
        kept = toxicity.drop_toxic(docs, tox, 2.0)
        assert kept.columns == docs.columns and kept.count() == len(ODD)
    assert toxicity.score_texts(docs.filter("false"), tox).count() == 0
    assert quality.score(quality.document_statistics(docs.filter("false")), good).count() == 0


def test_quadratic_discriminant_against_numpy(spark):
    docs, labels = quality.document_statistics(table(spark, SF, "documents", "doc_id", "text")), table(spark, SF, "labels")
    model = quality.train(docs, labels)
    rows = docs.join(labels, "doc_id").filter(~is_held_out("doc_id")).collect()
    x, y = np.array([r["x"] for r in rows]), np.array([r["quality"] for r in rows])
    spread = {k: np.cov(x[y == k].T, bias=True) for k in (0, 1)}
    pooled = sum(spread[k] * (y == k).sum() for k in (0, 1)) / len(y)
    density = []
    for k in (0, 1):
        own = 0.8 * spread[k] + 0.2 * pooled
        own = 0.9 * own + 0.1 * np.diag(np.diag(own)) + 1e-3 * np.eye(len(own))
        off = x - x[y == k].mean(axis=0)
        density.append(np.log((y == k).mean()) - 0.5 * np.linalg.slogdet(own)[1] - 0.5 * np.einsum("ij,jk,ik->i", off, np.linalg.inv(own), off))
    assert np.allclose(model.log_density(1, x) - model.log_density(0, x), density[1] - density[0], rtol=1e-6, atol=1e-6)
    held = quality.score(docs, model).join(labels, "doc_id").filter(is_held_out("doc_id")).collect()
    right = [(r["score"] >= 0.7) == bool(r["quality"]) for r in held]
    assert sum(right) >= 0.95 * len(right)


def brute_align(window: list[int], item: list[int]) -> int:
    best, row = 0, [0] * (len(window) + 1)
    for word in item:
        new = [0]
        for j, other in enumerate(window):
            hit = decontaminate.MATCH if other == word and other > 0 else decontaminate.MISMATCH
            new.append(max(0, row[j] + hit, row[j + 1] + decontaminate.GAP, new[j] + decontaminate.GAP))
        best, row = max(best, *new), new
    return best


def test_alignment_equals_the_recurrence():
    rng = random.Random(6)
    for _ in range(60):
        item = [rng.randint(1, 9) for _ in range(rng.randint(1, 25))]
        window = [w if rng.random() < 0.7 else rng.randint(0, 9) for w in item * rng.randint(1, 3) if rng.random() < 0.8]
        score, begin, end = decontaminate.align(np.array(window, np.int64), np.array(item, np.int64))
        assert score == brute_align(window, item)
        assert score == brute_align(window[begin:end], item)


def test_edited_copies_are_found(documents, spark):
    rng = random.Random(7)
    words = [sentence("aa", 1, rng) + str(i) for i in range(4000)]
    items = [" ".join(rng.sample(words, rng.randint(20, 60))) for _ in range(30)]
    rows, expected = [], set()
    for i in range(300):
        text = rng.choices(words, k=rng.randint(0, 200))
        if i % 3 == 0:
            for number in rng.sample(range(30), 1 + i % 2):
                copy = [w if rng.random() > 0.1 else "changed" for w in items[number].split() if rng.random() > 0.05]
                text = copy + text if rng.random() < 0.5 else text + copy
                expected.add((i, number))
        rows.append((i, " ".join(text)))
    table_ = spark.createDataFrame([*enumerate(items), (30, None), (31, "  ..."), (32, "")], "item_id long, text string")
    docs = documents(*rows, *[(1000 + i, t) for i, t in ODD if i is not None], (None, items[3])).withColumnRenamed("source", "item_id")
    number = {w: k + 1 for k, w in enumerate(sorted({w for t in items for w in decontaminate.normalised_words(t)}))}
    brute = set()
    for i, text in rows:
        window = np.array([number.get(w, 0) for w in decontaminate.normalised_words(text)], np.int64)
        for k, item in enumerate(items):
            coded = np.array([number[w] for w in decontaminate.normalised_words(item)], np.int64)
            if decontaminate.align(window, coded)[0] >= decontaminate.MIN_SCORE * decontaminate.MATCH * len(coded):
                brute.add((i, k))
    assert expected <= brute
    for block_words in (500_000, 100):
        found = decontaminate.leaks(docs, table_, block_words=block_words).collect()
        assert {tuple(r)[:2] for r in found} == brute | {(None, 3)}
        clean = decontaminate.drop_contaminated(docs, table_, block_words=block_words)
        assert clean.columns == docs.columns
        assert clean.count() == docs.count() - 1 - len({i for i, _ in brute})
    assert decontaminate.leaks(docs, table_.filter("false")).count() == 0
    assert decontaminate.leaks(docs.filter("false"), table_).count() == 0
    assert decontaminate.drop_contaminated(docs.filter("false"), table_).count() == 0


def test_a_passage_shared_by_most_documents_keeps_its_seeds(documents, spark):
    rng = random.Random(9)
    item = sentence("aa", 30, rng)
    rows = [(i, item if i % 4 else sentence("bb", 60, rng)) for i in range(200)]
    found = decontaminate.leaks(documents(*rows), spark.createDataFrame([(5, item), (6, "lo na")], "item_id long, text string")).filter("item_id = 5")
    assert sorted(r["doc_id"] for r in found.collect()) == [i for i in range(200) if i % 4]


def test_parts_of_long_items_are_leaks(documents, spark):
    rng = random.Random(12)
    words = [sentence("aa", 1, rng) + str(i) for i in range(3000)]
    items = [rng.sample(words, n) for n in (59, 300, 300, 300)]
    other = lambda n: rng.choices(words, k=n)
    edited = [w if k % 10 else "changed" for k, w in enumerate(items[1][100:140])]
    rows = [(0, 0, items[0][30:59]), (1, 1, items[1][:25]), (2, 1, items[1][275:]), (3, 1, edited), (4, 2, items[2][140:160]),
            (5, None, items[1][:9]), (6, None, [w for k, w in enumerate(items[2]) if k % 2 == 0][:60]), (7, None, [])]
    # A part in so many documents that its n-grams are the commonest tenth of its item.
    rows += [(100 + i, 3, items[3][50:72]) for i in range(150)]
    docs = documents(*[(i, " ".join(other(40) + part + other(40))) for i, _, part in rows])
    table_ = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    expected = sorted((i, k) for i, k, _ in rows if k is not None)
    assert sorted(tuple(r)[:2] for r in decontaminate.leaks(docs, table_).collect()) == expected
    assert decontaminate.drop_contaminated(docs, table_).count() == len(rows) - len(expected)


def test_short_items_and_scripts_without_spaces(documents, spark):
    chinese, thai = "今天天气很好，我们去公园散步", "วันนี้อากาศดีมาก เราไปเดินเล่น"
    items = [(1, "lo na"), (2, chinese), (3, "ungpfe"), (4, thai), (5, "日本")]
    rows = [(0, "mi Lo, na ru mi"), (1, "na lo mi ru"), (2, f"前言说明{chinese}。后记"), (3, f"x {chinese.replace('公', '花')} y"), (4, "a ungpfe b c"),
            (5, f"คำนำ{thai}ต่อ"), (6, "在日本的人"), (7, "日 x 本 ungpf ungpfee"), (8, "lo"), (9, "na"), (10, "lo. mi na"), (11, "lo na")]
    expected = [(0, 1), (2, 2), (3, 2), (4, 3), (5, 4), (6, 5), (11, 1)]
    docs, table_ = documents(*rows), spark.createDataFrame(items, "item_id long, text string")
    for block_words in (500_000, 1):
        assert sorted(tuple(r)[:2] for r in decontaminate.leaks(docs, table_, block_words=block_words).collect()) == expected
        kept = decontaminate.drop_contaminated(docs, table_, block_words=block_words)
        assert sorted(r["doc_id"] for r in kept.collect()) == [1, 7, 8, 9, 10]
