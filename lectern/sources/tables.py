"""Driver-table loader with explicit column projection.

Every reader names the columns it needs, so the Parquet scan's
``ReadSchema`` only contains those and filters placed after it are
pushed into the scan by Catalyst.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


# Text tables: (id that keys their rows, the text column).
TEXT_KEYS = {"documents": ("doc_id", "text"), "pages": ("page_id", "html"), "conversations": ("conv_id", "text")}
# A user who knows that a text table is stored as one row group, which one task
# must read, sets the number of partitions its rows are dealt to; unset (the
# default, and right for large tables) the text passes run where the scan runs.
PARTITIONS_CONF = "lectern.scan.partitions"


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(table_path(sf_dir, name))
    df = df.select(*columns) if columns else df
    dealt = spark.conf.get(PARTITIONS_CONF, None)
    key, text = TEXT_KEYS.get(name, (None, None))
    return df.repartition(int(dealt), key) if dealt and {key, text} <= set(df.columns) else df


def save_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str) -> DataFrame:
    """Store ``df`` as a table bucketed and sorted by ``key`` at ``path``.

    Tables bucketed the same way on the same key join and aggregate on that
    key without a shuffle: the documents and their labels stored this way
    let the lexicon flag be joined on ``doc_id`` without moving any text,
    even when the id list is too large to broadcast.
    """
    (df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
     .option("path", path).saveAsTable(table))
    return df.sparkSession.table(table)
