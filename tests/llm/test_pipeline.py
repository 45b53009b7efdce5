"""The corpus pipeline on a planted corpus, stage by stage against brute force."""

from __future__ import annotations

import random
import uuid

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as E
import corpus_pipeline
from lectern.llm import decontaminate
from lectern.llm.queries import queries
from lectern.session import ensure_checkpoint_dir
from tests.llm.conftest import DOCS
from tests.llm.test_simhash import brute_components, brute_fingerprint

INSULTS = ["blockhead", "nitwit", "dunce", "muttonhead"]


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(["ta", "ri", "no", "shel", "ber", "und", "ka"]) for _ in range(rng.randint(2, 4))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng, folder = random.Random(11), tmp_path_factory.mktemp("corpus")
    items = [prose(rng, 30) for _ in range(5)]
    rows, labels, kinds = [], [], {}
    for i in range(600):
        kind = "clean"
        text = prose(rng, rng.randint(30, 120))
        if i % 6 == 1:
            words = text.split()
            for _ in range(8):
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
            text, kind = " ".join(words), "toxic"
        elif i % 60 == 2:
            text, kind = f"{text} {items[i % 5]} {prose(rng, 20)}", "leak"
        elif i % 60 == 3:
            text, kind = rows[-3][1], "copy"
        elif i % 60 == 4:
            text, kind = ["12345 !!!", "", None][i % 3], "blank"
        rows.append((i, text, "en" if i % 5 else None, f"s{i % 3}", len(text or "")))
        kinds[i] = kind
        if kind in ("clean", "toxic"):
            labels.append((i, 1, int(kind == "toxic")))
    rows += [rows[0], rows[0], (None, prose(rng, 40), "en", "s0", 1)]
    spark.createDataFrame(rows, DOCS).repartition(5).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, kinds, items


def test_stages_are_the_registered_ones():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "toxicity", "SimHash near-dedup", "benchmark decontamination", "BPE encoding"]
    assert "pipeline" in E.queries() and corpus_pipeline.ORACLE_SQL is None
    assert set(queries()) <= set(E.queries())


def test_each_stage_on_what_its_predecessor_kept(spark, corpus):
    folder, rows, kinds, items = corpus
    base = f"{ensure_checkpoint_dir(spark)}/pipeline-test-{uuid.uuid4().hex}"
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if number < 4:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        out.write.parquet(f"{base}/{number}")
        docs = spark.read.parquet(f"{base}/{number}")
        kept.append(docs.collect())
    language, toxicity, simhash, clean, encoded = kept
    assert sorted(r.doc_id for r in language if r.doc_id is not None) == sorted(i for i, t, *_ in rows if i is not None and kinds[i] != "blank")
    assert all(r.lang == "en" for r in language)
    ids = {r.doc_id for r in toxicity}
    toxic = [i for i in kinds if kinds[i] == "toxic"]
    innocent = [i for i in kinds if kinds[i] not in ("toxic", "blank")]
    assert sum(i in ids for i in toxic) <= 0.05 * len(toxic) and sum(i in ids for i in innocent) >= 0.98 * len(innocent)
    # Near-duplicates: one row of each component, the smallest id.
    prints = {(r.doc_id, r.text): brute_fingerprint(r.text) for r in toxicity}
    root = brute_components(list(prints.values()), 4)
    least: dict[int, int] = {}
    for (i, _), p in prints.items():
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    assert sorted(r.doc_id for r in simhash if r.doc_id is not None) == sorted(least.values())
    assert sum(r.doc_id is None for r in simhash) == 1
    # Decontamination: what the plain alignment of whole texts with all items leaves.
    number = {w: k + 1 for k, w in enumerate(sorted({w for t in items for w in decontaminate.normalised_words(t)}))}

    def leaks(text: str) -> bool:
        import numpy as np
        window = np.array([number.get(w, 0) for w in decontaminate.normalised_words(text)], np.int64)
        coded = [np.array([number[w] for w in decontaminate.normalised_words(t)], np.int64) for t in items]
        return any(decontaminate.align(window, c)[0] >= decontaminate.MIN_SCORE * decontaminate.MATCH * len(c) for c in coded)

    assert sorted((r.doc_id or -1) for r in clean) == sorted((r.doc_id or -1) for r in simhash if not leaks(r.text))
    assert not {i for i in kinds if kinds[i] == "leak"} & {r.doc_id for r in clean}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in clean}
    assert {r.doc_id: r.n_tokens for r in encoded} == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()), key=repr) == sorted(map(tuple, encoded), key=repr)


def test_empty_tables(spark, corpus, tmp_path):
    folder = corpus[0]
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").filter("false").coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for query in queries().values():
        assert query(spark, str(tmp_path)).count() == 0


def test_queries_match_their_sql(spark):
    import duckdb

    from lectern.llm.oracle import oracle_sql
    from lectern.plans.compare import differences, type_differences
    folder = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for name in ("documents", "pages", "embeddings"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    for name, sql in oracle_sql().items():
        found = queries()[name](spark, folder)
        relation = duck.sql(sql)
        assert type_differences(found.schema, relation.columns, relation.types) == {}
        result = duck.execute(sql)
        assert differences(found.columns, [tuple(r) for r in found.collect()], [c[0] for c in result.description], result.fetchall()) == []
