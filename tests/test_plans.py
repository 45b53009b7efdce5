"""Physical-plan checks: no Python on the hot path, no cartesian joins,
filters and projections reach the scan, the token join is broadcast."""

from __future__ import annotations

import contextlib
import io

import pytest

import __spark_entry__ as E
from lectern.plans import catalog

from .conftest import SF_SMALL

PLAN_ONLY = sorted(n for n in catalog.queries() if not n.startswith("streamed_"))


def plan_of(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", PLAN_ONLY)
def test_no_python_and_no_cartesian(spark, name):
    plan = plan_of(E.queries()[name](spark, SF_SMALL))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "CartesianProduct",
                "BroadcastNestedLoopJoin"):
        assert bad not in plan, f"{name}: {bad}"


def test_flagship_scan_is_pruned_and_filtered(spark):
    from lectern.plans.catalog import vocabulary_report
    plan = plan_of(vocabulary_report(spark, SF_SMALL, lang="en"))
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string,source:string>" in plan


def test_vocabulary_aggregates_are_hash_based(spark):
    for name in ("vocabulary_report", "vocabulary_table"):
        plan = plan_of(E.queries()[name](spark, SF_SMALL))
        assert "HashAggregate" in plan and "SortAggregate" not in plan, name


def test_top_k_is_limited_before_the_shuffle(spark):
    plan = plan_of(E.queries()["recent_submissions"](spark, SF_SMALL))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_stream_replay_is_idempotent(spark):
    from lectern.session import ensure_checkpoint_dir
    from lectern.streaming import uploads as ST
    base = ensure_checkpoint_dir(spark).rstrip("/") + "/streams/replay-test"
    first = sorted(map(tuple, ST.run_stage_state(spark, SF_SMALL, base)[0].collect()))
    again = sorted(map(tuple, ST.run_stage_state(spark, SF_SMALL, base)[0].collect()))
    assert first == again and len(first) > 0


def test_bucketed_tables_join_on_doc_id_without_shuffling_text(spark, tmp_path):
    from lectern.operators import vocabulary as V
    from lectern.sources import adapters as A
    from lectern.sources.tables import save_bucketed
    docs = save_bucketed(A.documents(spark, SF_SMALL), "docs_by_id", "doc_id", 4, str(tmp_path / "docs"))
    ids = save_bucketed(A.quality_ids(spark, SF_SMALL), "quality_ids_by_id", "doc_id", 4, str(tmp_path / "ids"))
    # As if the id list were too large to broadcast: no size-based broadcast at all.
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stats = V.corpus_statistics(docs, ids)
        plan = plan_of(stats)
        assert "SortMergeJoin" in plan and "Exchange hashpartitioning(doc_id" not in plan, plan
        got = sorted(map(tuple, stats.select("lang", "word", "n", "in_lexicon").collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    plain = V.corpus_statistics(A.documents(spark, SF_SMALL), A.quality_ids(spark, SF_SMALL))
    assert got == sorted(map(tuple, plain.select("lang", "word", "n", "in_lexicon").collect()))


@pytest.fixture(scope="module")
def scattered(spark, tmp_path_factory):
    """events and documents as six shuffled part files each, half of the events
    delivered a second time in a later file."""
    from pyspark.sql import functions as F
    folder = tmp_path_factory.mktemp("scattered")
    for name in ("events", "documents", "labels"):
        df = spark.read.parquet(f"{SF_SMALL}/{name}.parquet")
        df.repartition(6, F.xxhash64(df.columns[0])).write.parquet(f"{folder}/{name}.parquet")
        if name == "events":
            df.filter("event_id % 2 = 0").coalesce(1).write.mode("append").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def rows_of(df, *drop) -> list:
    return sorted(map(tuple, df.drop(*drop).collect()), key=repr)


def test_streams_equal_batch_on_any_layout(spark, scattered):
    from pyspark.sql import functions as F

    from lectern.streaming import uploads as ST
    q = catalog.queries()
    table, failed = ST.run_stage_state(spark, scattered, files_per_trigger=1)
    assert rows_of(table) == rows_of(q["stage_state"](spark, SF_SMALL))
    assert rows_of(failed) == rows_of(spark.read.parquet(f"{SF_SMALL}/events.parquet").filter("event_type = 'error'").select(
        "user_id", "event_id", "ts", F.lit("stage reported an error")))
    assert rows_of(ST.run_upload_rate(spark, scattered, files_per_trigger=1)) == rows_of(q["upload_rate"](spark, SF_SMALL))
    keys, quarantine = ST.run_upload_keys(spark, scattered, files_per_trigger=1)
    assert rows_of(keys.unionByName(quarantine)) == rows_of(q["object_key_parse"](spark, SF_SMALL))


def test_document_stream_equals_batch_on_any_layout(spark, scattered):
    assert rows_of(catalog.streamed_study_guide(spark, scattered, files_per_trigger=2)) == rows_of(catalog.study_guide(spark, SF_SMALL))
