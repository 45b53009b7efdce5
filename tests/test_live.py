"""Kept answers, the live stage table and the completion stream."""

from __future__ import annotations

import json
import re

import pytest
from pyspark.sql import functions as F

from lectern.operators import answers as AN
from lectern.operators import summaries as M
from lectern.operators import vocabulary as V
from lectern.plans import catalog
from lectern.sources import adapters as A
from lectern.streaming import stages as SG
from lectern.streaming import uploads as ST

from .conftest import SF_SMALL
from .test_plans import rows_of, scattered  # noqa: F401

LONG = "A sentence of the first kind stands here. " + "More words follow it without an end " * 12
SUBMISSIONS = "user_id string, submission_id bigint, paragraphs array<struct<paragraph_number int, text string>>"


def submissions(spark, texts: dict):
    rows = [(user, number, None if ps is None else [(i, p) for i, p in enumerate(ps)]) for (user, number), ps in texts.items()]
    return spark.createDataFrame(rows, SUBMISSIONS)


def model_writing(folder):
    """A model that notes each call in ``folder``."""
    def model(frame):
        import uuid
        out = []
        for prompt in frame["user_prompt"]:
            (folder / uuid.uuid4().hex).write_text("call")
            numbers = [int(n) for n in re.findall(r"---PARAGRAPH (\d+)---", prompt)]
            bad = "UNANSWERABLE" in prompt and len(list(folder.iterdir())) < 4
            out.append("no json" if bad else json.dumps({"summaries": [{"paragraph_number": n, "summary": f"about {n}"} for n in numbers]}))
        import pandas as pd
        return pd.Series(out)
    return model


def test_equal_prompts_are_asked_once_and_never_again(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    store, model = str(tmp_path / "store"), model_writing(calls)
    subs = submissions(spark, {("a", 1): [LONG, "short"], ("b", 2): [LONG, "other"], (None, None): [LONG],
                               ("c", 3): ["short only"], ("c", 4): [], ("c", 5): None, ("d", 6): [LONG + " different"]})
    first = AN.answer(subs, store, model)
    assert len(list(calls.iterdir())) == 2
    again = AN.answer(subs, store, model)
    assert len(list(calls.iterdir())) == 2 and rows_of(again) == rows_of(first)
    told = {(r.submission_id, r.paragraph_number): r.summary for r in M.summary_rows(again).collect()}
    assert told == {(1, 0): "about 1", (1, 1): "short", (2, 0): "about 1", (2, 1): "other", (None, 0): "about 1",
                    (3, 0): "short only", (6, 0): "about 1"}
    more = AN.answer(subs.unionByName(submissions(spark, {("e", 7): [LONG + " new"]})), store, model)
    assert len(list(calls.iterdir())) == 3 and more.count() == 8


def test_invalid_answers_are_not_kept(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    store, model = str(tmp_path / "store"), model_writing(calls)
    subs = submissions(spark, {("a", 1): ["UNANSWERABLE " + LONG]})
    for _ in range(3):
        failed = AN.answer(subs, store, model)
        assert M.summary_rows(failed).count() == 0
        assert [r.status for r in M.verdicts(failed).collect()] == ["invalid json"]
    assert M.summary_rows(AN.answer(subs, store, model)).count() == 1
    assert len(list(calls.iterdir())) == 4 and AN.read_store(spark, store).count() == 1


def test_kept_answers_equal_plain_ones(spark, tmp_path):
    subs = A.paragraph_lists(A.documents(spark, SF_SMALL))
    plain = M.answer(subs)
    assert rows_of(AN.answer(subs, str(tmp_path / "store"))) == rows_of(plain)


def test_empty_submissions_leave_an_empty_store(spark, tmp_path):
    assert AN.answer(submissions(spark, {}), str(tmp_path / "store")).count() == 0
    assert AN.read_store(spark, str(tmp_path / "store")).count() == 0


def test_live_state_equals_batch_over_scattered_redelivered_files(spark, scattered, tmp_path):  # noqa: F811
    base = str(tmp_path / "base")
    SG.accept_events(spark, scattered, base, files_per_trigger=2)
    files = len(spark.read.parquet(f"{base}/accepted").inputFiles())
    table = SG.run_live_state(spark, scattered, base, compact_every=2, accepted_per_trigger=files // 4)
    assert (tmp_path / "base/state/epoch=2/snapshot=1").is_dir()
    assert rows_of(table) == rows_of(catalog.queries()["stage_state"](spark, SF_SMALL))


def test_live_state_goes_on_after_a_restart_and_ignores_late_copies(spark, tmp_path):
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    folder, base = tmp_path / "in", str(tmp_path / "base")
    target = f"{folder}/events.parquet"
    events.filter("event_id % 3 = 0").coalesce(2).write.parquet(target)
    SG.run_live_state(spark, str(folder), base)
    events.filter("event_id % 3 <> 0").coalesce(2).write.mode("append").parquet(target)
    events.coalesce(1).write.mode("append").parquet(target)                     # every event a second time
    table = SG.run_live_state(spark, str(folder), base, files_per_trigger=2)
    assert rows_of(table) == rows_of(catalog.queries()["stage_state"](spark, SF_SMALL))
    assert spark.read.parquet(f"{base}/accepted").count() == events.count()
    before = rows_of(table)
    assert rows_of(SG.run_live_state(spark, str(folder), base)) == before
    # One state row a user, however many events.
    metadata = spark.read.format("statestore").load(f"{base}/state-checkpoint")
    assert metadata.count() == len(before)


def test_a_replayed_micro_batch_accepts_nothing_twice(spark, tmp_path):
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    events.write.parquet(f"{tmp_path}/in/events.parquet")
    SG.accept_events(spark, f"{tmp_path}/in", f"{tmp_path}/base")
    (tmp_path / "base/accept/_checkpoint/commits/0").unlink()                   # as if stopped before the commit
    (tmp_path / "base/accept/_checkpoint/commits/.0.crc").unlink(missing_ok=True)
    SG.accept_events(spark, f"{tmp_path}/in", f"{tmp_path}/base")
    assert spark.read.parquet(f"{tmp_path}/base/accepted").count() == events.count()


def test_completion_stream_equals_batch(spark, scattered):  # noqa: F811
    docs = A.documents(spark, SF_SMALL)
    lemma_map = V.prepare_lemma_map(V.corpus_statistics(docs, A.quality_ids(spark, SF_SMALL)))
    stages = ST.run_document_stages(spark, scattered, lemma_map, files_per_trigger=2)
    guide = SG.run_completed_guides(spark, stages, files_per_trigger=1)
    want = catalog.study_guide(spark, SF_SMALL)
    assert rows_of(guide.withColumn("vocabulary", F.array_join("vocabulary", " "))) == rows_of(want)


def test_guides_wait_for_the_later_stage_in_any_order(spark, tmp_path):
    stages, base = str(tmp_path / "stages-base"), str(tmp_path / "base")

    def report(epoch, rows, words=(), told=()):
        for name, data, schema in (("vocabulary", words, ST.VOCABULARY_SCHEMA), ("summaries", told, ST.SUMMARIES_SCHEMA),
                                   ("stages", rows, ST.STAGES_SCHEMA)):
            spark.createDataFrame(list(data), schema).coalesce(1).write.parquet(f"{stages}/{name}/epoch={epoch}")

    def guides():
        return sorted((r.submission_id, r.paragraph_index, r.vocabulary, r.summary)
                      for r in SG.run_completed_guides(spark, stages, base).collect())

    assert guides() == []
    report(0, [("u", 1, 4), ("u", 2, 2)], words=[("u", 2, 0, "late", 1)], told=[("u", 1, 0, "start", "one")])
    assert guides() == []
    report(1, [("u", 1, 2)], words=[("u", 1, 1, "word", 1)])
    one = [(1, 0, [], "one"), (1, 1, ["word"], "")]
    assert guides() == one
    report(2, [("u", 2, 4), ("u", 1, 2), ("u", 1, 4), ("u", 3, 4)], told=[("u", 2, 0, "s", "two"), ("u", 3, 0, "s", "three")])
    assert guides() == [*one, (2, 0, ["late"], "two")]
    assert guides() == [*one, (2, 0, ["late"], "two")]
