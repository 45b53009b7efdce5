"""Keyed-table operators (K1-K11): the data semantics of the result tables.

Tables are DataFrames keyed by ``(user_id, ...)``; reads by key are
filters (pushed into the Parquet scan when the table is stored), writes
are unions resolved by ``last write wins`` aggregation, deletes are
anti joins.  The string sort keys of the original layout exist only at
the boundary (K1 encode, K2 decode).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.joins import materialise

# Sort-key layouts and the stage bits of a submission.
VOCAB_PREFIX = "VOCAB"
SUMMARY_PREFIX = "SUMMARY"
KEY_SEP = "#"
STAGE_RECEIVED, STAGE_PARAGRAPHS, STAGE_VOCABULARY, STAGE_SUMMARIES = 0, 1, 2, 4
STATE_COMPLETE = STAGE_RECEIVED | STAGE_PARAGRAPHS | STAGE_VOCABULARY | STAGE_SUMMARIES


# K1 ----------------------------------------------------------------------

def vocab_key(submission_id, paragraph_number, word) -> Column:
    return F.concat_ws(KEY_SEP, F.lit(VOCAB_PREFIX), submission_id.cast("string"),
                       paragraph_number.cast("string"), word)


def summary_key(submission_id, paragraph_number) -> Column:
    return F.concat_ws(KEY_SEP, F.lit(SUMMARY_PREFIX), submission_id.cast("string"),
                       paragraph_number.cast("string"))


# K2 ----------------------------------------------------------------------

def decode_keys(df: DataFrame, key_col: str, n_parts: int) -> DataFrame:
    """Split ``key_col`` on ``#``; valid rows have exactly ``n_parts`` parts
    and an integer paragraph number (third part).  The prefix is not checked.

    Adds ``submission_id``, ``paragraph_number``, ``word`` (vocabulary keys
    only) and ``reason`` (NULL for valid rows; the quarantine reason
    otherwise).
    """
    parts = F.split(F.col(key_col), KEY_SEP, -1)
    number = F.get(parts, 2).try_cast("int")
    reason = (F.when(F.size(parts) != n_parts, F.lit(f"expected {n_parts} parts"))
              .when(number.isNull(), F.lit("paragraph number is not an integer")))
    out = df.select("*", F.get(parts, 1).alias("submission_id"),
                    F.when(reason.isNull(), number).alias("paragraph_number"),
                    reason.alias("reason"))
    if n_parts == 4:
        out = out.withColumn("word", F.when(F.col("reason").isNull(), F.get(parts, 3)))
    return out


def split_valid(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantine rows)."""
    return decoded.filter(F.col("reason").isNull()), decoded.filter(F.col("reason").isNotNull())


# K3, K4 ------------------------------------------------------------------

def upsert(current: DataFrame | None, writes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Last write wins per ``key``; ``order`` columns decide which write is last.

    An aggregation (partial per map task), not a window, so a key written
    many times never lands in one partition as whole rows.
    """
    both = writes if current is None else current.unionByName(writes, allowMissingColumns=True)
    values = [c for c in both.columns if c not in key]
    latest = F.max_by(F.struct(*values), F.struct(*order, *[c for c in values if c not in order]))
    return both.groupBy(*key).agg(latest.alias("_v")).select(*key, *[F.col(f"_v.{c}").alias(c) for c in values])


def with_write_time(df: DataFrame, run_ts: int) -> DataFrame:
    """K4: rows of one bulk insert share the run's ``created_at``."""
    return df.withColumn("created_at", F.lit(run_ts).cast("bigint"))


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """K4: bulk insert (append) into a Parquet table.  Rows are clustered by the
    user, so a user's reads skip files by their statistics; with
    ``partition_by`` (for few users) each value has a folder of its own.
    Ranges are found by a sample, a pass of its own over the rows: these are
    stored first, so that what made them runs once."""
    if partition_by:
        df.repartition(*partition_by).write.mode("append").partitionBy(*partition_by).parquet(path)
    else:
        materialise(df, "append").repartitionByRange("user_id").sortWithinPartitions("user_id").write.mode("append").parquet(path)


# K5-K9 -------------------------------------------------------------------

def lookup(table: DataFrame, requests: DataFrame, key: list[str]) -> DataFrame:
    """K5 bulk form: every request with its row, or NULLs (``found`` false)."""
    marked = table.withColumn("_found", F.lit(True))
    return (requests.join(marked, key, "left")
            .withColumn("found", F.coalesce("_found", F.lit(False))).drop("_found"))


def scan_user(table: DataFrame, user_id: str) -> DataFrame:
    """K6: one user's rows (a pushed-down equality filter)."""
    return table.filter(F.col("user_id") == user_id)


def scan_prefix(table: DataFrame, key_col: str, group: list[str]) -> DataFrame:
    """K7: rows of each group in byte order of the sort key, as ``scan_position``
    (so paragraph 10 precedes paragraph 2)."""
    w = Window.partitionBy(*group).orderBy(F.col(key_col))
    return table.withColumn("scan_position", F.row_number().over(w))


def prefix_scan(table: DataFrame, user_id: str, key_col: str, prefix: str) -> DataFrame:
    """K7 point form: one user's rows whose sort key starts with ``prefix``,
    in byte order of the key (both filters reach a Parquet scan)."""
    return (table.filter((F.col("user_id") == user_id) & F.col(key_col).startswith(prefix))
            .orderBy(key_col))


def filter_filename(table: DataFrame, user_id: str, filename: str) -> DataFrame:
    """K8."""
    return scan_user(table, user_id).filter(F.col("filename") == filename)


def delete(table: DataFrame, tombstones: DataFrame, key: list[str]) -> DataFrame:
    """K9: rows whose key is not in ``tombstones``."""
    return table.join(tombstones.select(*key).distinct(), key, "left_anti")


# K10, K11 ----------------------------------------------------------------

def accumulate_state(stage_events: DataFrame, key: list[str]) -> DataFrame:
    """``state_sum`` adds every stage bit received (the original's
    arithmetic add, so a redelivered stage overshoots); ``state_mask`` is
    the idempotent OR.  Map-side partial aggregation keeps hot keys cheap."""
    return (stage_events.groupBy(*key)
            .agg(F.sum("bit").cast("bigint").alias("state_sum"),
                 F.bit_or("bit").cast("int").alias("state_mask")))


def set_attribute(table: DataFrame, updates: DataFrame, key: list[str], name: str,
                  ts_col: str = "ts") -> DataFrame:
    """The latest update per key sets ``name`` (absent keys keep NULL)."""
    latest = updates.groupBy(*key).agg(F.max_by(F.col(name), F.struct(ts_col, name)).alias("_new"))
    out = table.join(latest, key, "left")
    if name in table.columns:
        return out.withColumn(name, F.coalesce("_new", F.col(name))).drop("_new")
    return out.withColumnRenamed("_new", name)
