"""Helpers shared by the operators of this sub-package."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import ensure_checkpoint_dir
from lectern.sources.tables import table_path

# Fixed by the task: white space that separates words, and the held-out fold.
WORD = r"[^\x20\x09-\x0D]+"
FOLDS, HELD_OUT_FOLD = 4, 2


def fold(id_col: str) -> Column:
    """crc32 of the id's decimal text modulo 4 (NULL for a NULL id)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def is_held_out(id_col: str) -> Column:
    """True for the held-out fold; a NULL id is in no fold, so false."""
    return F.coalesce(fold(id_col) == HELD_OUT_FOLD, F.lit(False))


def is_training(id_col: str) -> Column:
    """Rows a model may learn from; a row without an id is never one."""
    return F.coalesce(fold(id_col) != HELD_OUT_FOLD, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet below the shared checkpoint folder and
    read it back: lineage ends there and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, text: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut a record batch into runs of rows of at most ``max_bytes`` of text
    (one row at least), so working memory follows the text, not the row count."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > max_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, text: str) -> list[str]:
    """The text column as strings, NULL as the empty text."""
    return [t or "" for t in batch.column(text).to_pylist()]


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package's modules to the executors, once per application:
    they need not have it installed or share a folder with the driver."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="lectern-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)
