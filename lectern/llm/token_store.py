"""Token files: a wavelet matrix per block of documents.

Documents are range-partitioned by id; each partition becomes one shard
file that holds its token stream, in id order, as a run of blocks.  A block
is a wavelet matrix: one bit plane per bit of the token id, most significant
first, each plane stably partitioned by the plane before it, with the number
of ones before every 512th bit kept beside it.  Access, rank, select,
counting and occurrence lookup work on the block as stored; the codec of the
file (zstandard) compresses blocks and directory together.

File format (Parquet, one row per block): ``part`` and ``block`` order the
blocks, ``doc_ids`` and ``doc_tokens`` list the block's documents, ``n_tokens``
its length and ``matrix`` the bytes of :class:`WaveletMatrix`.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.bpe import SLICE_BYTES, LibraryEncoder, batch_encoder
from lectern.llm.common import slices
from lectern.session import ensure_checkpoint_dir

BLOCK_TOKENS = 1 << 18       # a block ends with the document that reaches this
RANK_EVERY = 512             # bits between two entries of the rank directory
SELECT_COST = 64             # tokens whose rebuilding costs as much as one select
_MAGIC = 0x314D5754


class WaveletMatrix:
    """Succinct sequence of unsigned integers below ``2 ** planes``."""

    def __init__(self, n: int, planes: np.ndarray, ranks: np.ndarray, zeros: np.ndarray):
        self.n, self.planes, self.ranks, self.zeros = n, planes, ranks, zeros

    @classmethod
    def build(cls, values: np.ndarray, planes: int) -> WaveletMatrix:
        n, now = len(values), np.ascontiguousarray(values, np.uint32)
        if planes <= 16:
            now = now.astype(np.uint16)
        rows, zeros = [], []
        for bit in range(planes - 1, -1, -1):
            ones = (now & now.dtype.type(1 << bit)).astype(bool)
            rows.append(np.packbits(ones, bitorder="little"))
            one_at, zero_at = np.flatnonzero(ones), np.flatnonzero(~ones)
            zeros.append(len(zero_at))
            if not bit:
                break                                     # nobody reads the order after the last plane
            after = np.empty_like(now)
            np.take(now, zero_at, out=after[:len(zero_at)], mode="clip")
            np.take(now, one_at, out=after[len(zero_at):], mode="clip")
            now = after
        packed = np.stack(rows) if planes else np.empty((0, 0), np.uint8)
        return cls(n, packed, cls._directory(packed), np.array(zeros, np.uint32))

    @staticmethod
    def _directory(planes: np.ndarray) -> np.ndarray:
        step = RANK_EVERY // 8
        width = -(-planes.shape[1] // step) * step
        padded = np.zeros((len(planes), width), np.uint8)
        padded[:, :planes.shape[1]] = planes
        ones = np.bitwise_count(padded).reshape(len(planes), -1, step).sum(axis=2, dtype=np.uint32)
        return np.concatenate([np.zeros((len(planes), 1), np.uint32), np.cumsum(ones, axis=1, dtype=np.uint32)], axis=1)

    def to_bytes(self) -> bytes:
        head = np.array([_MAGIC, self.n & 0xFFFFFFFF, self.n >> 32, len(self.planes)], "<u4")
        return b"".join(x.tobytes() for x in (head, self.zeros.astype("<u4"), self.ranks.astype("<u4"), self.planes))

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        magic, low, high, planes = np.frombuffer(data, "<u4", 4).tolist()
        if magic != _MAGIC:
            raise ValueError("not a wavelet matrix")
        n = low | high << 32
        width = -(-n // 8)
        entries = 1 + -(-width // (RANK_EVERY // 8))
        at = 16
        zeros = np.frombuffer(data, "<u4", planes, at)
        at += 4 * planes
        ranks = np.frombuffer(data, "<u4", planes * entries, at).reshape(planes, entries)
        at += 4 * planes * entries
        return cls(n, np.frombuffer(data, np.uint8, planes * width, at).reshape(planes, width), ranks, zeros)

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level, i >> 3]) >> (i & 7) & 1

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        block = i // RANK_EVERY
        row, at = self.planes[level], block * RANK_EVERY // 8
        count = int(self.ranks[level, block]) + int(np.bitwise_count(row[at:i >> 3]).sum())
        return count + ((int(row[i >> 3]) & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else 0)

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(len(self.planes)):
            bit, ones = self._bit(level, i), self._ones(level, i)
            value = value << 1 | bit
            i = int(self.zeros[level]) + ones if bit else i - ones
        return value

    def _range(self, symbol: int, start: int, stop: int) -> tuple[int, int]:
        """Where the occurrences of ``symbol`` in [start, stop) end up."""
        if not 0 <= symbol < 1 << len(self.planes):
            return 0, 0
        for level in range(len(self.planes)):
            a, b = self._ones(level, start), self._ones(level, stop)
            if symbol >> (len(self.planes) - 1 - level) & 1:
                start, stop = int(self.zeros[level]) + a, int(self.zeros[level]) + b
            else:
                start, stop = start - a, stop - b
        return start, stop

    def rank(self, symbol: int, i: int) -> int:
        """Occurrences of ``symbol`` among the first ``i`` tokens."""
        a, b = self._range(symbol, 0, min(max(i, 0), self.n))
        return b - a

    def count(self, symbol: int, start: int = 0, stop: int | None = None) -> int:
        stop = self.n if stop is None else min(stop, self.n)
        a, b = self._range(symbol, min(start, stop), stop)
        return b - a

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) ``bit`` of a plane."""
        ranks = self.ranks[level].astype(np.int64)
        before = ranks if bit else np.arange(len(ranks)) * RANK_EVERY - ranks
        block = int(np.searchsorted(before, k, side="right")) - 1
        at = block * RANK_EVERY // 8
        bits = np.unpackbits(self.planes[level, at:at + RANK_EVERY // 8], bitorder="little")
        return block * RANK_EVERY + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def select(self, symbol: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of ``symbol``."""
        start, stop = self._range(symbol, 0, self.n)
        if not 0 <= k < stop - start:
            raise IndexError(k)
        at = start + k
        for level in range(len(self.planes) - 1, -1, -1):
            bit = symbol >> (len(self.planes) - 1 - level) & 1
            at = self._select_bit(level, bit, at - int(self.zeros[level]) if bit else at)
        return at

    def occurrences(self, symbol: int) -> list[int]:
        return [self.select(symbol, k) for k in range(self.count(symbol))]

    def values(self) -> np.ndarray:
        """The whole sequence, rebuilt plane by plane from the last one."""
        now = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for level in range(len(self.planes) - 1, -1, -1):
            ones = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            zeros, out = int(self.zeros[level]), np.empty_like(now)
            out[np.flatnonzero(~ones)] = now[:zeros]
            out[np.flatnonzero(ones)] = now[zeros:] | now.dtype.type(1 << (len(self.planes) - 1 - level))
            now = out
        return now.astype(np.uint32)


_SCHEMA = "part int, block int, n_tokens long, doc_ids array<long>, doc_tokens array<long>, matrix binary"
_ARROW = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                    ("doc_tokens", pa.list_(pa.int64())), ("matrix", pa.binary())])


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, end_id: int, planes: int = 16,
                 id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenise every row with the tokenizers library and write shard files.

    Each document is followed by ``end_id``; NULL and empty texts are that id
    alone.  Order is ascending id, NULL ids first; rows with the same id
    follow in the order of their text's hash, repeated rows included.  A block
    holds at most BLOCK_TOKENS ids and one more document, so a worker's
    memory is bounded by the longest text.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = batch_encoder(LibraryEncoder, vocabulary), TaskContext.get().partitionId()
        ids: list[int | None] = []
        pieces: list[np.ndarray] = []
        counts: list[int] = []
        held = block = 0

        def flush() -> pa.RecordBatch:
            matrix = WaveletMatrix.build(np.concatenate(pieces), planes).to_bytes()
            return pa.RecordBatch.from_pylist([{
                "part": part, "block": block, "n_tokens": held, "doc_ids": ids, "doc_tokens": counts, "matrix": matrix}], _ARROW)

        end = np.array([end_id], np.uint32)
        for batch in batches:
            for rows in slices(batch, "text", SLICE_BYTES):
                tokens, bounds = encoder(rows.column("text"))
                if len(tokens) and int(tokens.max()) >> planes:
                    raise ValueError(f"a token id needs more than {planes} bit planes")
                for k, doc_id in enumerate(rows.column("id").to_pylist()):
                    own = tokens[bounds[k]:bounds[k + 1]]
                    pieces += [own, end]
                    ids.append(doc_id)
                    counts.append(len(own) + 1)
                    held += len(own) + 1
                    if held >= BLOCK_TOKENS:
                        yield flush()
                        ids, pieces, counts, held, block = [], [], [], 0, block + 1
        if ids:
            yield flush()

    source = docs.selectExpr(f"CAST(`{id_col}` AS LONG) AS id", f"`{text_col}` AS text")
    ordered = source.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))
    ordered.mapInArrow(run, _SCHEMA).write.option("compression", "zstd").parquet(folder)


def open_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks of a token folder with ``start``, the ids before each block."""
    return spark.read.schema(_SCHEMA).parquet(folder).join(block_starts(spark, folder), ["part", "block"])


def block_starts(spark: SparkSession, folder: str) -> DataFrame:
    """(part, block, start); the matrices are not read."""
    sizes = spark.read.schema(_SCHEMA).parquet(folder).select("part", "block", "n_tokens")
    # One row per shard file is all that the window without a key orders.
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("in_part"))
    before = parts.select("part", (F.sum("in_part").over(Window.orderBy("part")) - F.col("in_part")).alias("before_part"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("block")) - F.col("n_tokens")
    return (sizes.withColumn("inside", inside).join(before, "part")
            .select("part", "block", (F.col("before_part") + F.col("inside")).alias("start")))


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files alone: doc_id, start (ids of all documents
    before it), n_tokens and ids_crc32 (of its ids as little-endian 32-bit)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = {name: batch.column(name)[row].as_py() for name in ("part", "block", "doc_ids", "doc_tokens")}
                data = WaveletMatrix.from_bytes(batch.column("matrix")[row].as_py()).values().astype("<u4")
                counts = np.array(get["doc_tokens"], np.int64)
                ends = np.cumsum(counts)
                crc = [zlib.crc32(data[b - n:b].tobytes()) for b, n in zip(ends.tolist(), counts.tolist())]
                size = len(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([get["part"]] * size, pa.int32()), pa.array([get["block"]] * size, pa.int32()),
                     pa.array(get["doc_ids"], pa.int64()), pa.array(ends - counts, pa.int64()),
                     pa.array(counts, pa.int64()), pa.array(crc, pa.int64())],
                    ["part", "block", "doc_id", "inside", "n_tokens", "ids_crc32"])

    blocks = spark.read.schema(_SCHEMA).parquet(folder).select("part", "block", "doc_ids", "doc_tokens", "matrix")
    documents = blocks.mapInArrow(run, "part int, block int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return (documents.join(block_starts(spark, folder), ["part", "block"])
            .select("doc_id", (F.col("start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"))


def tokens_at(spark: SparkSession, folder: str, positions: DataFrame) -> DataFrame:
    """Access by place: (position, token) for each distinct ``position`` of
    ``positions`` (a place in the order of all shards, from 0); places outside
    the files and NULLs have no row.

    Places meet block starts on cells of BLOCK_TOKENS places, so only the
    matrices of blocks asked for are decoded, and of these the bits on the way
    to each token."""
    spans = open_spans(spark, folder)
    cells = F.explode(F.sequence(_cell(F.col("start")), _cell(F.col("stop") - 1)))
    spans = spans.filter("stop > start").select("*", cells.alias("cell"))
    asked = positions.select(F.col("position").cast("long").alias("position")).filter("position >= 0").distinct()
    hits = asked.withColumn("cell", _cell(F.col("position"))).join(spans, "cell").filter(
        (F.col("position") >= F.col("start")) & (F.col("position") < F.col("stop")))
    # Distinct places of one block are at most its tokens.
    wanted = hits.groupBy("part", "block", "start").agg(F.collect_list(F.col("position") - F.col("start")).alias("at"))
    matrices = spark.read.schema(_SCHEMA).parquet(folder).select("part", "block", "matrix")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                matrix = WaveletMatrix.from_bytes(batch.column("matrix")[row].as_py())
                start, at = batch.column("start")[row].as_py(), batch.column("at")[row].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([start + i for i in at], pa.int64()),
                                                  pa.array([matrix.access(i) for i in at], pa.int64())], ["position", "token"])

    return matrices.join(wanted, ["part", "block"]).select("start", "at", "matrix").mapInArrow(run, "position long, token long")


def _cell(position: Column) -> Column:
    return F.shiftright(position, BLOCK_TOKENS.bit_length() - 1)


def open_spans(spark: SparkSession, folder: str) -> DataFrame:
    """(part, block, start, stop) of every block; the matrices are not read."""
    sizes = spark.read.schema(_SCHEMA).parquet(folder).select("part", "block", "n_tokens")
    return sizes.join(block_starts(spark, folder), ["part", "block"]).select(
        "part", "block", "start", (F.col("start") + F.col("n_tokens")).alias("stop"))


def count_tokens(spark: SparkSession, folder: str, symbols: list[int]) -> DataFrame:
    """(token, n): how often each of ``symbols`` stands in all files, 0 included.
    Each block answers by two ranks a plane; Spark adds the blocks up."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = dict.fromkeys(symbols, 0)
        for batch in batches:
            for data in batch.column("matrix"):
                matrix = WaveletMatrix.from_bytes(data.as_py())
                for symbol in totals:
                    totals[symbol] += matrix.count(symbol)
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int64()), pa.array(list(totals.values()), pa.int64())], ["token", "n"])

    parts = spark.read.schema(_SCHEMA).parquet(folder).select("matrix").mapInArrow(run, "token long, n long")
    none = spark.createDataFrame([(s, 0) for s in symbols], "token long, n long")
    return parts.unionByName(none).groupBy("token").agg(F.sum("n").alias("n"))


def find_tokens(spark: SparkSession, folder: str, symbols: list[int]) -> DataFrame:
    """(token, position): every place of each of ``symbols`` in all files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                matrix, start = WaveletMatrix.from_bytes(batch.column("matrix")[row].as_py()), batch.column("start")[row].as_py()
                frequent = None
                for symbol in dict.fromkeys(symbols):
                    if matrix.count(symbol) * SELECT_COST > matrix.n:
                        # Rebuilding the block costs less than so many selects.
                        frequent = matrix.values() if frequent is None else frequent
                        at = np.flatnonzero(frequent == symbol)
                    else:
                        at = np.array(matrix.occurrences(symbol), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([symbol] * len(at), pa.int64()), pa.array(at + start, pa.int64())],
                                                     ["token", "position"])

    return open_tokens(spark, folder).select("start", "matrix").mapInArrow(run, "token long, position long")


def token_folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/llm-tokens-{uuid.uuid4().hex}"
