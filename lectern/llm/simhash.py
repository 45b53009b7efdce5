"""SimHash near-duplicates by segment popcounts and a grid range join.

Fingerprint: every word shingle's XXH64 votes on 64 bits.  The fingerprint's
32 segments of two bits are embedded by their popcounts (0, 1 or 2); the
Manhattan distance of two embeddings never exceeds the bit distance of the
fingerprints.  Popcounts are kept in unary (0 -> 00, 1 -> 01, 2 -> 11), so that
distance is one XOR and one bit count.

Grid: the segments are dealt into ``max_bits + 3`` blocks.  Two fingerprints
within ``max_bits`` differ in at most that many blocks, so they agree on the
popcounts of three blocks at least.  Each choice of three blocks is one grid
whose cell is the popcounts in those blocks; every linked pair meets in a
cell of some grid, and in a cell the Manhattan bound, then the exact bit
distance, decide.

Cells: rows of one cell are joined.  A cell with more than ``dense`` distinct
fingerprints is cut into runs instead; each pair of runs is compared in its
own group and gives only a spanning forest of its links, so a large group of
near copies never emits all its pairs, no cell is dropped, and no group is
larger than two runs.

Links become components by alternating large-star and small-star steps, each
written to the shared folder.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import save, slices, texts_of

SEED = 42                      # fixed by the contract
BLOCK = 1 << 18                # bytes of a text counted at once
DENSE = 64                     # fingerprints of a cell beyond which it is cut into runs
RUN = 2048                     # about so many fingerprints in a run of a dense cell
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_DIGEST = functools.partial(xxhash.xxh64_intdigest, seed=SEED)


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64-bit SimHash; a bit is set if it is set in over half the shingles.

    Bytes lower only A-Z and split at the contract's white space.  The text is
    taken BLOCK bytes at a time, the last words of a block going on to the
    next, so memory does not grow with its shingles."""
    data, votes, count = (text or "").encode(), np.zeros(64, np.int64), 0
    carry: list[bytes] = []
    at = 0
    while at < len(data):
        cut = _SPACE.search(data, min(at + BLOCK, len(data)))
        end = cut.start() if cut else len(data)
        words = carry + data[at:end].lower().split()
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
        hashes = np.fromiter(map(_DIGEST, grams), np.uint64)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
        count += len(hashes)
        carry = words[-(shingle - 1):] if shingle > 1 else []
        at = end
    if not count:
        return _DIGEST(b" ".join(words)) if data and words else 0
    return int.from_bytes(np.packbits(2 * votes > count, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, bits) of every row; ``bits`` is the fingerprint as a
    signed 64-bit integer, ``text_hash`` tells rows of one id apart."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 16 << 20):
                bits = np.array([fingerprint(t, shingle) for t in texts_of(part, "text")], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("text_hash"), pa.array(bits)],
                                                 ["id", "text_hash", "bits"])

    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, text_hash long, bits long")


def popcounts(bits: Column) -> Column:
    """Popcounts of the 32 two-bit segments, each in unary."""
    low = F.lit(0x5555555555555555)
    shifted = F.shiftrightunsigned(bits, 1)
    either, both = bits.bitwiseOR(shifted).bitwiseAND(low), bits.bitwiseAND(shifted).bitwiseAND(low)
    return either.bitwiseOR(F.shiftleft(both, 1))


def grids(max_bits: int) -> list[int]:
    """Bit masks (signed) of the grids: every choice of three of the blocks."""
    blocks = max_bits + 3
    if not 0 <= max_bits <= 29:
        raise ValueError("max_bits must be from 0 to 29")
    masks = [0] * blocks
    for segment in range(32):
        masks[segment * blocks // 32] |= 3 << 2 * segment
    chosen = [sum(c) for c in itertools.combinations(masks, 3)]
    return [m - (1 << 64) if m >> 63 else m for m in chosen]


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(points: DataFrame, max_bits: int, dense: int = DENSE, run: int = RUN) -> DataFrame:
    """(a, b) pairs of distinct fingerprints whose components are those of all
    links of at most ``max_bits`` bits.  ``points`` has the distinct ``bits``.

    In cells of at most ``dense`` fingerprints every link is emitted; larger
    cells emit spanning forests, which lose no connection."""
    masks = grids(max_bits)
    with_counts = points.select("bits", popcounts(F.col("bits")).alias("counts"))
    grid = F.explode(F.array(*[
        F.xxhash64(F.lit(k), F.col("counts").bitwiseAND(F.lit(m))) for k, m in enumerate(masks)])).alias("cell")
    cells = with_counts.select(grid, "bits", "counts")
    size = F.count(F.lit(1)).over(Window.partitionBy("cell"))
    sized = save(cells.withColumn("size", size).filter("size > 1"), "cells")
    sparse = sized.filter(F.col("size") <= dense).select("cell", "bits", "counts")
    left, right = sparse.alias("l"), sparse.alias("r")
    near = left.join(right, (F.col("l.cell") == F.col("r.cell")) & (F.col("l.bits") < F.col("r.bits"))
                     & (distance(F.col("l.counts"), F.col("r.counts")) <= max_bits)
                     & (distance(F.col("l.bits"), F.col("r.bits")) <= max_bits))
    near = near.select(F.col("l.bits").alias("a"), F.col("r.bits").alias("b"))
    return near.union(_dense_links(sized.filter(F.col("size") > dense), max_bits, run)).distinct()


def _dense_links(cells: DataFrame, max_bits: int, run: int) -> DataFrame:
    """Spanning forests of the links within each pair of runs of a dense cell."""
    runs = F.ceil(F.col("size") / F.lit(run)).cast("int")
    mine = F.pmod(F.xxhash64("bits"), runs).cast("int")
    dealt = cells.withColumn("runs", runs).withColumn("mine", mine)
    other = F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("other")
    dealt = dealt.select("cell", "bits", "counts", "mine", other).select(
        "cell", "bits", "counts", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"))

    def forest(group: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(group["bits"].to_numpy(), kind="stable")
        bits = group["bits"].to_numpy()[order].view(np.uint64)
        counts = group["counts"].to_numpy()[order].view(np.uint64)
        out: list[tuple[int, int]] = []
        todo = np.ones(len(bits), bool)      # not yet reached
        while todo.any():
            frontier = [int(np.flatnonzero(todo)[0])]
            todo[frontier[0]] = False
            while frontier:
                at = frontier.pop()
                rest = np.flatnonzero(todo)
                rest = rest[np.bitwise_count(counts[rest] ^ counts[at]) <= max_bits]
                rest = rest[np.bitwise_count(bits[rest] ^ bits[at]) <= max_bits]
                todo[rest] = False
                out += [(at, int(k)) for k in rest]
                frontier += rest.tolist()
        signed = bits.view(np.int64)
        pairs = np.array(out, np.int64).reshape(-1, 2)
        a, b = signed[pairs[:, 0]], signed[pairs[:, 1]]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return dealt.groupBy("cell", "low", "high").applyInPandas(forest, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component, for nodes with a link.

    Large-star joins each node's larger neighbours to its smallest, small-star
    its smaller ones; both keep connections, and the edges end as stars."""
    def star(pairs: DataFrame, large: bool) -> DataFrame:
        least = pairs.groupBy("u").agg(F.min("v").alias("m"))
        if large:
            least = least.select("u", F.least("u", "m").alias("m"))
        joined = pairs.join(least, "u")
        if large:
            out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")) \
                .select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        return out.filter("u <> v").distinct()

    def state(pairs: DataFrame) -> tuple[int, int | None]:
        return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = state(now)
    while before[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        now = save(star(star(both, large=True), large=False), "edges")
        after = state(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def _rooted(docs: DataFrame, shingle: int, max_bits: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, text_hash, bits) of every row, and (bits, first_id, root): the
    component of every fingerprint."""
    rows = save(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    points = save(rows.groupBy("bits").agg(F.min("id").alias("first_id")), "points")
    root = components(links(points, max_bits))
    return rows, points.join(root.withColumnRenamed("node", "bits"), "bits", "left").select(
        "bits", "first_id", F.coalesce("root", "bits").alias("root"))


def simhash_components(docs: DataFrame, shingle: int = 4, max_bits: int = 4,
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) of every row.

    ``component_id`` is the smallest id reachable over links of at most
    ``max_bits`` differing bits.  NULL and empty texts have fingerprint zero
    and link like any other.  Repeated rows and repeated ids keep their rows.
    A NULL id is never a component's id unless the whole component has none.
    """
    rows, points = _rooted(docs, shingle, max_bits, id_col, text_col)
    least = points.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = points.join(least, "root").select("bits", "component_id")
    return rows.join(known, "bits").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component: that of the smallest id (a NULL id
    only where there is no other), then of the smallest text hash; of repeated
    rows one stays.  Columns are unchanged."""
    rows, points = _rooted(docs, shingle, max_bits, id_col, text_col)
    first = F.min(F.struct(F.col("id").isNull(), "id", "text_hash")).alias("first")
    # A third of the rows may share a fingerprint: rows meet per fingerprint first.
    keepers = rows.groupBy("bits").agg(first).join(points.select("bits", "root"), "bits").groupBy("root").agg(
        F.min("first").alias("first")).select(*_row_key(F.col("first.id"), F.col("first.text_hash")))
    keyed = docs.select("*", *_row_key(F.col(id_col), F.xxhash64(F.col(text_col))))
    # The same columns join and remove repeats, so the texts move once.
    return keyed.join(keepers, list(_KEY), "left_semi").dropDuplicates(list(_KEY)).select(
        *[F.col(f"`{c}`") for c in docs.columns])


_KEY = ("__llm_id", "__llm_no_id", "__llm_text_hash")


def _row_key(row_id: Column, text_hash: Column) -> list[Column]:
    """Id and text of a row as columns without NULLs."""
    return [c.alias(name) for c, name in zip(
        (F.coalesce(row_id.cast("string"), F.lit("")), row_id.isNull(), text_hash), _KEY)]
