"""Structured Streaming jobs.

* X1 upload-event stream: a file source over the events table, decoded
  (S4) and parsed (S3) statelessly in each micro-batch.
* X2 fan-out: one ``foreachBatch`` persists the micro-batch once and
  writes every branch from it: valid keys and quarantine for upload
  events; vocabulary rows, summary rows and stage reports for newly
  arrived documents (``run_document_stages``), paragraphs computed once.
* X3 stage state, Z3 rate: each micro-batch adds its sums per key to a log,
  and the table is the log summed up.  No event is ever too late.
* X4 delivery: ``dropDuplicates(event_id)`` without a watermark drops every
  redelivered event, however late; its state holds the ids seen.  Failed
  stage reports go to a quarantine table instead of being acknowledged away;
  every sink write is keyed by the micro-batch id and overwrites its own
  folder, so a replayed batch after a failure rewrites the same rows.

State, offsets and outputs live under the session's reliable checkpoint
folder (``spark.checkpoint.dir``).  ``files_per_trigger`` bounds a micro-batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import keyed as K
from lectern.operators.product import RATE_LIMIT_PER_MINUTE
from lectern.session import ensure_checkpoint_dir
from lectern.sources import adapters as A
from lectern.sources import notifications as N

EVENTS_SCHEMA = ("event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
                 "value DOUBLE, props STRING")
FILES_PER_TRIGGER = 100


def table_stream(spark: SparkSession, sf_dir: str, name: str, schema: str,
                 files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    """File stream over a table stored either as one Parquet file
    (``<dir>/<name>.parquet``: the folder is watched for that file) or as a
    folder of part files (the folder itself is watched)."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    single_file = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile()
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if single_file:
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return reader.parquet(path)


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    """X1 source: new event files as they arrive."""
    return table_stream(spark, sf_dir, "events", EVENTS_SCHEMA, files_per_trigger)


def deduplicated(events: DataFrame) -> DataFrame:
    """Redelivered events (same ``event_id``) dropped, whenever they come."""
    return events.dropDuplicates(["event_id"])


def upload_keys(events: DataFrame) -> DataFrame:
    """Object puts -> (user_id, submission_id) or a quarantine reason."""
    return N.parse_object_keys(N.decode_notifications(A.notification_messages(events))).drop("event_name")


def _epoch_writer(base: str, branches: dict[str, Callable[[DataFrame], DataFrame]]):
    """foreachBatch body: persist once, write each branch to ``base/name/epoch=N``."""
    def write(batch: DataFrame, epoch_id: int) -> None:
        batch.persist()
        try:
            for name, select in branches.items():
                (select(batch).write.mode("overwrite")
                 .parquet(f"{base}/{name}/epoch={epoch_id}"))
        finally:
            batch.unpersist()
    return write


def _drain(stream: DataFrame, base: str, write) -> None:
    """Run a stream over what is available now."""
    (stream.writeStream.option("checkpointLocation", f"{base}/_checkpoint")
     .foreachBatch(write).trigger(availableNow=True).start().awaitTermination())


def read_sink(spark: SparkSession, path: str, schema) -> DataFrame:
    """A sink folder, or no rows of ``schema`` if no micro-batch wrote it."""
    from pyspark.errors import AnalysisException
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema).withColumn("epoch", F.lit(None).cast("int"))


def _base(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"


# X3 ------------------------------------------------------------------------

STATE_SCHEMA = "user_id BIGINT, state_sum BIGINT, state_mask INT"
FAILURE_SCHEMA = "user_id BIGINT, event_id BIGINT, ts TIMESTAMP_NTZ, reason STRING"


def stage_state(events: DataFrame) -> DataFrame:
    """(user_id, state_sum, state_mask) over the reports that did not fail."""
    return K.accumulate_state(A.stage_rows(events).filter(~F.col("failed")), ["user_id"])


def stage_failures(events: DataFrame) -> DataFrame:
    """Failed stage reports, kept with a reason instead of being acked away."""
    return (A.stage_rows(events).filter(F.col("failed"))
            .select("user_id", "event_id", "ts", F.lit("stage reported an error").alias("reason")))


def run_stage_state(spark: SparkSession, sf_dir: str, base: str | None = None,
                    files_per_trigger: int = FILES_PER_TRIGGER) -> tuple[DataFrame, DataFrame]:
    """Run X1+X3+X4 to completion over what is available; return (state
    table, failed reports)."""
    base = base or _base(spark, "stage-state")
    _drain(deduplicated(event_stream(spark, sf_dir, files_per_trigger)), base,
           _epoch_writer(base, {"state": stage_state, "quarantine": stage_failures}))
    log = read_sink(spark, f"{base}/state", STATE_SCHEMA)
    table = log.groupBy("user_id").agg(F.sum("state_sum").alias("state_sum"), F.bit_or("state_mask").alias("state_mask"))
    return table, read_sink(spark, f"{base}/quarantine", FAILURE_SCHEMA).drop("epoch")


# X1, X2 --------------------------------------------------------------------

KEYS_SCHEMA = "event_id BIGINT, bucket STRING, key STRING, user_id STRING, submission_id STRING, reason STRING"


def run_upload_keys(spark: SparkSession, sf_dir: str, base: str | None = None,
                    files_per_trigger: int = FILES_PER_TRIGGER) -> tuple[DataFrame, DataFrame]:
    """Run X1+X2: return (valid keys, quarantine) written by the fan-out."""
    base = base or _base(spark, "upload-keys")
    columns = ["event_id", "bucket", "key", "user_id", "submission_id", "reason"]
    _drain(upload_keys(deduplicated(event_stream(spark, sf_dir, files_per_trigger))).select(*columns), base, _epoch_writer(base, {
        "keys": lambda b: b.filter(F.col("reason").isNull()),
        "quarantine": lambda b: b.filter(F.col("reason").isNotNull())}))
    return tuple(read_sink(spark, f"{base}/{name}", KEYS_SCHEMA).select(*columns) for name in ("keys", "quarantine"))


# Z3 ------------------------------------------------------------------------

RATE_SCHEMA = "user_id BIGINT, window_start TIMESTAMP_NTZ, uploads BIGINT"


def run_upload_rate(spark: SparkSession, sf_dir: str, base: str | None = None, limit: int = RATE_LIMIT_PER_MINUTE,
                    files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    """Z3 as a stream: uploads per user per tumbling minute.  A minute's count
    is the sum over the micro-batches that saw it."""
    base = base or _base(spark, "upload-rate")

    def counts(batch: DataFrame) -> DataFrame:
        puts = batch.filter(F.col("event_type") == "click")
        return puts.groupBy("user_id", F.window("ts", "1 minute").alias("w")).agg(F.count(F.lit(1)).alias("uploads")).select(
            "user_id", F.col("w.start").alias("window_start"), "uploads")

    _drain(deduplicated(event_stream(spark, sf_dir, files_per_trigger)), base, _epoch_writer(base, {"rate": counts}))
    total = F.sum("uploads")
    return read_sink(spark, f"{base}/rate", RATE_SCHEMA).groupBy("user_id", "window_start").agg(
        total.alias("uploads"), (total > limit).alias("over_limit"))


# --------------------------------------------------------------------------
# X1 + X2: documents stream -> paragraphs -> vocabulary and summaries
# --------------------------------------------------------------------------

DOCUMENTS_SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"

# Output schemas of the document pipeline's stage tables.
VOCABULARY_SCHEMA = "user_id STRING, submission_id BIGINT, paragraph_number INT, word STRING, rank INT"
SUMMARIES_SCHEMA = ("user_id STRING, submission_id BIGINT, paragraph_number INT, "
                    "paragraph_start STRING, summary STRING")
STAGES_SCHEMA = "user_id STRING, submission_id BIGINT, bit INT"


def document_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    return table_stream(spark, sf_dir, "documents", DOCUMENTS_SCHEMA, files_per_trigger)


def run_document_stages(spark: SparkSession, sf_dir: str, lemma_map: DataFrame, base: str | None = None,
                        files_per_trigger: int = FILES_PER_TRIGGER) -> str:
    """Each micro-batch of new documents is split into paragraphs once
    (persisted), then both stages run from it: vocabulary rows (V13/V14)
    and summary rows (M1-M10), plus the stage reports each stage emits.
    Every output folder is keyed by the batch id (replays overwrite).
    Returns the base folder holding ``vocabulary``, ``summaries``, ``stages``."""
    from lectern.operators import summaries as M
    from lectern.operators import vocabulary as V
    from lectern.operators.joins import split_repeated

    base = base or _base(spark, "documents")

    def fan_out(batch: DataFrame, epoch_id: int) -> None:
        lists = A.paragraph_lists(batch.select("doc_id", "source", "lang", "text")).persist()
        try:
            subs = lists.select("user_id", "submission_id")
            once, again = map(A.long_form, split_repeated(lists, ["user_id", "submission_id"]))
            words = V.vocabulary_rows(V.ranked_words(once, lemma_map=lemma_map, repeated=again, sentences=False))
            rows, verdicts = M.summarise(lists)
            done = subs.join(M.failed_submissions(verdicts), ["user_id", "submission_id"], "left_anti")
            stages = (subs.select("*", F.explode(F.array(*[F.lit(b) for b in (
                K.STAGE_RECEIVED, K.STAGE_PARAGRAPHS, K.STAGE_VOCABULARY)])).alias("bit"))
                .unionByName(done.withColumn("bit", F.lit(K.STAGE_SUMMARIES))))
            for name, df in (("vocabulary", words), ("summaries", rows), ("stages", stages)):
                df.write.mode("overwrite").parquet(f"{base}/{name}/epoch={epoch_id}")
        finally:
            lists.unpersist()

    _drain(document_stream(spark, sf_dir, files_per_trigger), base, fan_out)
    return base
