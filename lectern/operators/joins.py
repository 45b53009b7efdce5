"""Computing an intermediate result once.

``materialise`` writes a DataFrame as Parquet below the shared checkpoint
folder and reads it back: later plans start from files with column pruning,
pushdown and size statistics (from which Spark decides what to broadcast), and
a lost executor loses nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import ensure_checkpoint_dir


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Compute ``df`` once into the shared folder (lineage ends there)."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BROADCAST_BYTES = 48 << 20    # of files; some 300 MB as a hash table


def is_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the files that the stored table ``df`` reads are at most ``limit``
    bytes together."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint for a small stored table; a larger one is left to Spark."""
    return F.broadcast(df) if is_small(df, limit) else df


def split_repeated(rows: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows whose key stands on one row only, the others); NULL keys are values.

    What belongs to a key of the first needs no shuffle.  Only keys are counted
    and stored, so the rows' other columns do not move while the repeated keys
    are few."""
    counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.struct(*key).alias("_key"))
    repeated = broadcast_if_small(materialise(counts, "repeated-keys"))
    same = F.struct(*key) == F.col("_key")
    return rows.join(repeated, same, "left_anti"), rows.join(repeated, same, "left_semi")
