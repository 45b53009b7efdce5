"""Proportional stratified interleaving.

Rows are shuffled by a seeded hash within their source and ranked; the rank
becomes a fraction of the source's size, all rows are sorted by that fraction,
and the order is cut into shards of equal row counts.  Every stretch of the
order holds the sources in proportion, so every shard matches the mixture.

No source and no fraction is ranked in one task.  Rows are range-partitioned
by (source, hash, ...) with the row's own number last, so equal rows, rows
without an id and sources of any size are cut anywhere; a rank is the rows of
the source in earlier partitions plus the place in the partition.  The same
is done once more by (fraction, ...) for the place in the whole order.  Only
counts per partition and source go through windows.  Each sorted table is
written before it is counted, so that counts and rows come from one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import save

SEED = 20
BUCKETS = 4096          # the first sort key of a source's rows is their hash modulo this


def shard_assignment(docs: DataFrame, shards: int, seed: int = SEED, id_col: str = "doc_id",
                     text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row.

    Row counts of shards differ by one at most (the larger come first); slots
    count from 0 in each.  A NULL source is a source of its own.  A NULL text
    has size 1 and the checksum of the empty text.  Repeated rows keep a row
    each; they are interchangeable, as ties end with size and checksum.
    """
    placed = _placed(docs, shards, seed, id_col, text_col, source_col)
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot")


def _placed(docs: DataFrame, shards: int, seed: int, id_col: str, text_col: str, source_col: str, *carried: Column) -> DataFrame:
    """``id``, ``size``, ``text_crc32``, ``shard`` and ``slot`` of every row,
    with what is ``carried`` of it."""
    utf8 = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), (F.octet_length(utf8) + F.lit(1)).cast("long").alias("size"),
        F.crc32(utf8).alias("text_crc32"), digest.alias("digest"), *carried)
    rows = rows.withColumn("bucket", (F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") % BUCKETS).cast("int"))
    ties = ["digest", "id", "size", "text_crc32"]
    rows = rows.withColumn("row", F.monotonically_increasing_id())

    ranked = _numbered(rows, "source", "bucket", *ties, "row")
    parts = ranked.groupBy("source", "part").agg(F.count(F.lit(1)).alias("n"), F.min("index").alias("start"))
    by_source = Window.partitionBy("source")
    parts = parts.select(F.col("source").alias("of"), F.col("part").alias("in"), "start", F.sum("n").over(by_source).alias("total"),
                         (F.sum("n").over(by_source.orderBy("part")) - F.col("n")).alias("before"))
    ranked = ranked.join(parts, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in")))
    rank = F.col("before") + F.col("index") - F.col("start") + 1
    # rank - 1/2 over the source's rows, never 1; whole numbers up to the one division keep it exact to the last bit.
    ranked = ranked.withColumn("fraction", (2 * rank - 1) / (2 * F.col("total"))).drop("of", "in", "start", "total", "before", "part", "index")

    placed = _numbered(ranked, "fraction", "source", *ties, "row")
    parts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy("part")            # a row for each partition
    parts = parts.select(F.col("part").alias("in"), (F.sum("n").over(order) - F.col("n")).alias("ahead"),
                         F.sum("n").over(Window.partitionBy()).alias("all_rows"))
    placed = placed.join(F.broadcast(parts), F.col("part") == F.col("in")).withColumn("position", F.col("ahead") + F.col("index"))

    small = F.expr(f"all_rows div {shards}")
    larger = F.col("all_rows") % shards
    edge = larger * (small + 1)
    placed = placed.withColumn("small", small).withColumn("larger", larger).withColumn("edge", edge)
    first = F.col("position") < F.col("edge")
    shard = F.when(first, F.expr("position div (small + 1)")).otherwise(F.expr("larger + (position - edge) div greatest(small, 1)"))
    slot = F.when(first, F.expr("position % (small + 1)")).otherwise(F.expr("(position - edge) % greatest(small, 1)"))
    return placed.withColumn("shard", shard.cast("int")).withColumn("slot", slot.cast("long"))


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """The rows range-partitioned and sorted by ``order``, written, with ``part``
    and ``index`` (from 0) of each."""
    number = F.monotonically_increasing_id()       # partition and place in it, of the sorted rows
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", number)
    return save(placed, "shard-order").withColumn("index", F.col("part").bitwiseAND((1 << 33) - 1)).withColumn("part", F.shiftright("part", 33))


def write_shards(docs: DataFrame, folder: str, shards: int, seed: int = SEED, id_col: str = "doc_id",
                 text_col: str = "text", source_col: str = "source") -> None:
    """Write the rows under ``shard=k`` folders, each file a stretch of slots
    in order.  Each row goes with its own place, so that repeated rows and
    rows without an id are written once each; the text is dealt three times.
    Columns of ``docs`` that are named shard or slot are written as own_shard
    and own_slot."""
    row = F.struct(*(F.col(f"`{c}`").alias(f"own_{c}" if c in ("shard", "slot") else c) for c in docs.columns)).alias("__row")
    rows = _placed(docs, shards, seed, id_col, text_col, source_col, row).select(
        "__row.*", F.col("shard").alias("__shard"), F.col("slot").alias("__slot"))
    rows = rows.repartitionByRange("__shard", "__slot").sortWithinPartitions("__shard", "__slot")
    rows.withColumnsRenamed({"__shard": "shard", "__slot": "slot"}).write.partitionBy("shard").parquet(folder)
