"""Live stage table and completion stream.

``run_live_state`` keeps the stage table of X3 in two chained streams.  The
first accepts each event once: ids are looked up in the accepted events
themselves, which lie in one folder a day, so a micro-batch reads the days of
its own events only and no state store holds ids.  A redelivered event carries
the time of its first delivery, so the rule is exact however late it comes.
The second is a streaming aggregation in update mode on the RocksDB state
store, one row a user, whose changed rows are upserted; every COMPACT_EVERY
micro-batches the upserts are folded into one snapshot.

``run_completed_guides`` joins the vocabulary stage's reports with the summary
stage's as two streams; a submission's guide is written once, by the
micro-batch in which the later of its two stages arrives.

Micro-batches write folders of their own number: a replayed one leaves a
finished folder as it is or rewrites the same rows.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import guide as G
from lectern.operators import keyed as K
from lectern.sources import adapters as A
from lectern.streaming import uploads as ST

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COMPACT_EVERY = 20
ACCEPTED_SCHEMA = f"{ST.EVENTS_SCHEMA}, epoch INT, day DATE"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams started inside keep their state in RocksDB."""
    old = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, old)


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _finished(spark: SparkSession, folder: str) -> bool:
    system, path = _path(spark, f"{folder}/_SUCCESS")
    return system.exists(path)


def _make(spark: SparkSession, folder: str) -> str:
    system, path = _path(spark, folder)
    system.mkdirs(path)
    return folder


# X3, X4 ----------------------------------------------------------------------

def accept_events(spark: SparkSession, sf_dir: str, base: str, files_per_trigger: int = ST.FILES_PER_TRIGGER) -> str:
    """Write every event once below ``base/accepted/epoch=N/day=D``; return the folder."""
    folder = _make(spark, f"{base}/accepted")

    def accept(batch: DataFrame, epoch_id: int) -> None:
        own = f"{folder}/epoch={epoch_id}"
        if _finished(spark, own):
            return
        day = F.coalesce(F.to_date("ts"), F.lit("0001-01-01").cast("date"))
        events = batch.dropDuplicates(["event_id"]).withColumn("day", day)
        earlier = (spark.read.schema(ACCEPTED_SCHEMA).parquet(folder).filter(F.col("epoch") < epoch_id)
                   .select(F.col("event_id").alias("_id"), F.col("day").alias("_day")))
        days = [r.day for r in events.select("day").distinct().collect()]      # a row a day of the batch
        seen = earlier.filter(F.col("_day").isin(days)) if days else earlier.limit(0)
        known = F.col("event_id").eqNullSafe(F.col("_id")) & (F.col("day") == F.col("_day"))
        # Rebalanced by day: few files a day, and a hot day is split.
        events.join(seen, known, "left_anti").hint("rebalance", F.col("day")).write.mode("overwrite").partitionBy("day").parquet(own)

    ST._drain(ST.event_stream(spark, sf_dir, files_per_trigger), f"{base}/accept", accept)
    return folder


def latest_state(spark: SparkSession, folder: str) -> DataFrame:
    """The stage table: each user's last upsert since and with the last snapshot."""
    log = ST.read_sink(spark, folder, ST.STATE_SCHEMA)
    newest = F.max_by(F.struct("state_sum", "state_mask"), "epoch")
    snapshots = [int(name.split("=")[1]) for name in _folders(spark, folder) if _finished(spark, f"{folder}/{name}/snapshot=1")]
    if snapshots:
        log = log.filter(F.col("epoch") >= max(snapshots))
    return log.groupBy("user_id").agg(newest.alias("s")).select("user_id", "s.state_sum", "s.state_mask")


def _folders(spark: SparkSession, folder: str) -> list[str]:
    system, path = _path(spark, folder)
    if not system.exists(path):
        return []
    names = [status.getPath().getName() for status in system.listStatus(path)]
    return [n for n in names if n.startswith("epoch=")]


def run_live_state(spark: SparkSession, sf_dir: str, base: str | None = None,
                   files_per_trigger: int = ST.FILES_PER_TRIGGER, compact_every: int = COMPACT_EVERY,
                   accepted_per_trigger: int = ST.FILES_PER_TRIGGER) -> DataFrame:
    """Run both streams over what is available; return (user_id, state_sum,
    state_mask).  Called again with the same ``base`` it goes on from there.
    ``accepted_per_trigger`` bounds the second stream's micro-batches, whose
    files are the small ones of the first."""
    base = base or ST._base(spark, "live-state")
    accepted = accept_events(spark, sf_dir, base, files_per_trigger)
    table = f"{base}/state"

    def upsert(batch: DataFrame, epoch_id: int) -> None:
        own = f"{table}/epoch={epoch_id}"
        fold = epoch_id > 0 and epoch_id % compact_every == 0
        if fold:
            # Rows of this micro-batch win over the table before it.
            before = latest_state(spark, table).join(batch.select(F.col("user_id").alias("_user")),
                                                     F.col("user_id").eqNullSafe(F.col("_user")), "left_anti")
            batch = batch.unionByName(before)
        batch.write.mode("overwrite").parquet(f"{own}/snapshot={int(fold)}")

    events = (spark.readStream.schema(ACCEPTED_SCHEMA).option("maxFilesPerTrigger", accepted_per_trigger).parquet(accepted))
    state = K.accumulate_state(A.stage_rows(events).filter(~F.col("failed")), ["user_id"])
    with rocksdb(spark):
        (state.writeStream.outputMode("update").option("checkpointLocation", f"{base}/state-checkpoint")
         .foreachBatch(upsert).trigger(availableNow=True).start().awaitTermination())
    return latest_state(spark, table)


# X2, D1 ----------------------------------------------------------------------

GUIDE_SCHEMA = ("user_id STRING, submission_id BIGINT, paragraph_index INT, vocabulary ARRAY<STRING>, "
                "summary STRING, paragraph_start STRING")
_REPORT_SCHEMA = f"{ST.STAGES_SCHEMA}, epoch INT"
_KEY = ["user_id", "submission_id"]


def run_completed_guides(spark: SparkSession, stages_base: str, base: str | None = None,
                         files_per_trigger: int = ST.FILES_PER_TRIGGER) -> DataFrame:
    """Guides of the submissions whose vocabulary and summary stages both
    reported below ``stages_base`` (the output of ``run_document_stages``,
    complete or growing), in whichever order; repeated reports change nothing.

    A stage writes its rows in the micro-batch that reports them, so a guide
    reads only the two folders named by its reports.  The join's state is a
    key and a number for each report."""
    base = base or ST._base(spark, "completed-guides")
    reports = _make(spark, f"{stages_base}/stages")

    def stage(bit: int, name: str) -> DataFrame:
        rows = spark.readStream.schema(_REPORT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(reports)
        return rows.filter(F.col("bit") == bit).select(
            F.col("user_id").alias(f"{name}_user"), F.col("submission_id").alias(f"{name}_submission"),
            F.col("epoch").alias(f"{name}_epoch"))

    words, told = stage(K.STAGE_VOCABULARY, "v"), stage(K.STAGE_SUMMARIES, "s")
    both = words.join(told, (F.col("v_user") == F.col("s_user")) & (F.col("v_submission") == F.col("s_submission"))).select(
        F.col("v_user").alias("user_id"), F.col("v_submission").alias("submission_id"), "v_epoch", "s_epoch")

    def emit(batch: DataFrame, epoch_id: int) -> None:
        if _finished(spark, f"{base}/guide/epoch={epoch_id}"):
            return
        before = ST.read_sink(spark, f"{base}/done", f"{_SUBMISSION_SCHEMA}, v_epoch INT, s_epoch INT").filter(F.col("epoch") < epoch_id)
        # A repeated report names a folder with the same rows: the first counts.
        first = (batch.groupBy(*_KEY).agg(F.min("v_epoch").alias("v_epoch"), F.min("s_epoch").alias("s_epoch"))
                 .join(before, _KEY, "left_anti"))
        first.write.mode("overwrite").parquet(f"{base}/done/epoch={epoch_id}")
        done = spark.read.schema(f"{_SUBMISSION_SCHEMA}, v_epoch INT, s_epoch INT").parquet(f"{base}/done/epoch={epoch_id}")

        def rows(name: str, schema: str, of: str) -> DataFrame:
            written = ST.read_sink(spark, f"{stages_base}/{name}", schema)
            return written.join(done.select(*_KEY, F.col(of).alias("epoch")), [*_KEY, "epoch"], "left_semi").drop("epoch")

        guide = G.study_guide(rows("vocabulary", ST.VOCABULARY_SCHEMA, "v_epoch"), rows("summaries", ST.SUMMARIES_SCHEMA, "s_epoch"),
                              done.withColumn("state", F.lit(K.STATE_COMPLETE)))
        guide.write.mode("overwrite").parquet(f"{base}/guide/epoch={epoch_id}")

    with rocksdb(spark):
        (both.writeStream.outputMode("append").option("checkpointLocation", f"{base}/checkpoint")
         .foreachBatch(emit).trigger(availableNow=True).start().awaitTermination())
    return ST.read_sink(spark, f"{base}/guide", GUIDE_SCHEMA).drop("epoch")


_SUBMISSION_SCHEMA = "user_id STRING, submission_id BIGINT"
