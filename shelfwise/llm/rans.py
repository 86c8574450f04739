"""Token ids in binary files, coded by a static range asymmetric numeral system.

File format (a folder that any file system of Spark's can hold)
    ``tables``: one row, ``bits`` and ``freqs``, the frequency of every id as
    little-endian u4, whole numbers that sum to 2**bits; an id that occurs has 1
    at least. The one table is shared by all blocks.
    ``blocks``: one row for each block of whole documents, in ascending order of
    doc_id by (part, block): ``start`` (ids before it), ``doc_ids``, ``lengths``
    (ids of each document), ``payload`` and ``checkpoints``.

A block's ids are dealt in turn to LANES coders, whose 32-bit words share one
stream: id i belongs to lane i % LANES and step i // LANES. Every EVERY steps a
checkpoint holds the lanes' states, the place in the stream, and a crc32 of the
ids up to the next checkpoint; so a reader may start at any checkpoint of any
block, independently of the others, and tells a damaged part from a whole one.

States are 64-bit, in [2**31, 2**63), and give or take 32-bit words.

Defined cases: a null or empty text is its end id alone; rows of one doc_id stand
beside each other, in order of a hash of the text; an empty table gives an empty
folder of blocks; extra columns are ignored; a document longer than BLOCK ids is
a block of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import U64, partitions, scratch, settle, slices
from shelfwise.llm.tokens import encoder

LANES = 1024
EVERY = 64
#: Ids after which a block is closed, at the end of a document.
BLOCK = 1 << 18
BITS = 20
_LOW = U64(1 << 31)


def quantise(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Frequencies that sum to 2**bits, 1 at least for what occurs."""
    counts = np.asarray(counts, dtype=np.float64)
    total, whole = counts.sum(), 1 << bits
    if not total:
        return np.zeros(len(counts), dtype=np.int64)
    if np.count_nonzero(counts) > whole:
        raise ValueError("more symbols than the table has room for")
    freqs = np.where(counts > 0, np.maximum(1, np.floor(counts / total * whole)), 0).astype(np.int64)
    over = int(freqs.sum()) - whole
    order = np.argsort(-freqs, kind="stable")
    while over:  # the largest take the difference, in turn, and stay above 0
        room = freqs[order] - 1 if over > 0 else np.full(len(order), abs(over))
        room[freqs[order] == 0] = 0
        take = np.minimum(room, max(1, abs(over) // 64))
        upto = np.cumsum(take)
        take[upto > abs(over)] = 0
        if not take.any():
            take[np.flatnonzero(room)[0]] = 1
        freqs[order] -= take if over > 0 else -take
        over = int(freqs.sum()) - whole
    return freqs


class Table:
    def __init__(self, freqs: np.ndarray, bits: int):
        self.bits = bits
        self.freqs = np.asarray(freqs).astype(U64)
        self.starts = (np.cumsum(self.freqs) - self.freqs).astype(U64)
        self._symbol = None

    @property
    def symbol(self) -> np.ndarray:
        """The id of every slot."""
        if self._symbol is None:
            self._symbol = np.repeat(np.arange(len(self.freqs), dtype=np.uint32), self.freqs.astype(np.int64))
        return self._symbol


def encode(ids: np.ndarray, table: Table, lanes: int = LANES, every: int = EVERY) -> tuple[bytes, list[tuple[int, bytes, int]]]:
    """The stream, and checkpoints (place in it, states, crc32 of the ids from here to the next)."""
    n = len(ids)
    steps = -(-n // lanes)
    x = np.full(lanes, _LOW, dtype=U64)
    words: list[np.ndarray] = []
    emitted, marks = 0, []
    freqs, starts = table.freqs[ids], table.starts[ids]
    bits, shift = U64(table.bits), U64(63 - table.bits)
    for step in range(steps - 1, -1, -1):  # from the end, as a stack
        begin = step * lanes
        f, s = freqs[begin : begin + lanes], starts[begin : begin + lanes]
        k = len(f)
        y = x[:k]
        full = y >= (f << shift)
        if full.any():
            out = y[full]
            words.append((out & U64(0xFFFFFFFF)).astype("<u4"))
            emitted += len(out)
            y[full] = out >> U64(32)
        q = y // f
        x[:k] = (q << bits) + (y - q * f) + s
        if step % every == 0:
            part = ids[begin : begin + lanes * every].astype("<u4").tobytes()
            marks.append((emitted, x.astype("<u8").tobytes(), zlib.crc32(part)))
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, dtype="<u4")
    return stream.tobytes(), [(emitted - at, states, crc) for at, states, crc in marks[::-1]]


def decode(payload: bytes, checkpoints: list[tuple[int, bytes, int]], n: int, table: Table, first: int = 0, last: int | None = None, lanes: int = LANES, every: int = EVERY) -> np.ndarray:
    """Ids of the parts `first` to `last` (excluded) of a block of n ids, each from its checkpoint and checked."""
    stream = np.frombuffer(payload, dtype="<u4")
    last = len(checkpoints) if last is None else last
    parts = []
    bits, mask = U64(table.bits), U64((1 << table.bits) - 1)
    for part in range(first, last):
        at, states, crc = checkpoints[part]
        x = np.frombuffer(states, dtype="<u8").astype(U64)
        begin, end = part * every * lanes, min(n, (part + 1) * every * lanes)
        ids = np.empty(end - begin, dtype=np.uint32)
        for i in range(0, end - begin, lanes):
            y = x[: min(lanes, end - begin - i)]
            slot = y & mask
            symbol = table.symbol[slot]
            ids[i : i + lanes] = symbol
            y = table.freqs[symbol] * (y >> bits) + slot - table.starts[symbol]
            low = y < _LOW
            k = int(np.count_nonzero(low))
            if k:
                y[low] = (y[low] << U64(32)) | stream[at : at + k]
                at += k
            x[: len(y)] = y
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError(f"checkpoint {part}: the ids don't have the checksum that was written")
        parts.append(ids)
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)


_BLOCK = "part int, block int, start long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary, checkpoints array<struct<place: long, states: binary, crc32: long>>"


def tokenised(docs: DataFrame, tokenizer: str, end_id: int, block: int = BLOCK) -> DataFrame:
    """Blocks of whole documents in ascending order of doc_id, by (part, block): doc_ids, lengths and ids (little-endian)."""
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    d = d.withColumn("h", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    d = d.repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first(), "h", "place").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h", "place")

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, part, number = encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype=coder.dtype)
        doc_ids, lengths, raw, held = [], [], [], 0

        def row() -> pa.RecordBatch:
            nonlocal doc_ids, lengths, raw, held, number
            arrays = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([held], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([np.concatenate(raw).tobytes()], pa.binary())]
            doc_ids, lengths, raw, held, number = [], [], [], 0, number + 1
            return pa.RecordBatch.from_arrays(arrays, ["part", "block", "n_ids", "doc_ids", "lengths", "ids"])

        for batch in slices(batches, "text", 4 << 20):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), coder.encode(batch.column("text"))):
                n = len(ids) + 1
                if held and held + n > block:
                    yield row()
                doc_ids.append(doc_id), lengths.append(n), raw.append(ids), raw.append(end)
                held += n
        if held:
            yield row()

    return d.select("doc_id", "text").mapInArrow(blocks, "part int, block int, n_ids long, doc_ids array<long>, lengths array<long>, ids binary")


def counted(blocks: DataFrame, size: int, dtype: str) -> np.ndarray:
    """How often each id occurs in all blocks."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for ids in batch.column("ids"):
                total += np.bincount(np.frombuffer(ids.as_buffer(), dtype=dtype), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    counts = np.zeros(size, dtype=np.int64)
    for r in blocks.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # the vocabulary at most
        counts[r["id"]] = r["n"]
    return counts


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, bits: int = BITS) -> None:
    """Encode documents to `path`.

    The ids are tokenised once, to a table in the shared folder; their counts
    make the frequency table; the blocks are coded from that table.
    """
    spark = docs.sparkSession
    coder = encoder(tokenizer)
    size, dtype = coder.size, coder.dtype.str
    blocks = settle(tokenised(docs, tokenizer, end_id), "rans-ids")
    freqs = quantise(counted(blocks, size, dtype), bits)
    spark.createDataFrame([(bits, freqs.astype("<u4").tobytes())], "bits int, freqs binary").coalesce(1).write.parquet(f"{path}/tables")
    shared = spark.sparkContext.broadcast((freqs, bits))
    # Ids before each part: as many rows as there are partitions.
    sums = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0).cast("long")).alias("before"))
    within = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("part", "block", F.coalesce(F.sum("n_ids").over(within), F.lit(0).cast("long")).alias("inside")).join(sums, "part").select("part", "block", (F.col("inside") + F.col("before")).alias("start"))
    starts = settle(starts, "rans-starts")  # a row for each block

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(*shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                payload, marks = encode(np.frombuffer(batch.column("ids")[i].as_buffer(), dtype=dtype), table)
                points = pa.array([[{"place": a, "states": s, "crc32": c} for a, s, c in marks]], pa.list_(pa.struct([("place", pa.int64()), ("states", pa.binary()), ("crc32", pa.int64())])))
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*(row.column(c) for c in ("part", "block", "n_ids", "doc_ids", "lengths")), pa.array([payload], pa.binary()), points], ["part", "block", "n_ids", "doc_ids", "lengths", "payload", "checkpoints"])

    coded = blocks.mapInArrow(code, _BLOCK.replace("start long, ", ""))
    coded.join(F.broadcast(starts) if starts.count() <= 1_000_000 else starts, ["part", "block"]).select("part", "block", "start", "n_ids", "doc_ids", "lengths", "payload", "checkpoints").write.option("compression", "none").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Decode a folder: doc_id, start, n_tokens, ids (array<int> would be the ids themselves; here their crc32) per document."""
    return _decoded(spark, path, False)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, and the ids of every document."""
    return _decoded(spark, path, True)


def _decoded(spark: SparkSession, path: str, whole: bool) -> DataFrame:
    r = spark.read.parquet(f"{path}/tables").first()
    shared = spark.sparkContext.broadcast((np.frombuffer(bytes(r["freqs"]), dtype="<u4").astype(np.int64), r["bits"]))

    def documents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(*shared.value)
        for batch in batches:
            for row in batch.to_pylist():
                marks = [(m["place"], m["states"], m["crc32"]) for m in row["checkpoints"]]
                ids = decode(row["payload"], marks, row["n_ids"], table).astype("<u4")
                lengths = np.array(row["lengths"], dtype=np.int64)
                ends = np.cumsum(lengths)
                parts = [ids[e - n : e] for e, n in zip(ends.tolist(), lengths.tolist())]
                last = pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32())) if whole else pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(ends - lengths + row["start"]), pa.array(lengths), last], ["doc_id", "start", "n_tokens", "ids" if whole else "ids_crc32"])

    last = "ids array<int>" if whole else "ids_crc32 long"
    return spark.read.schema(_BLOCK).parquet(f"{path}/blocks").mapInArrow(documents, f"doc_id long, start long, n_tokens long, {last}")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write all documents in the format, read them back: doc_id, start, n_tokens, ids_crc32."""
    path = scratch(docs.sparkSession, "rans")
    write(docs, path, tokenizer, end_id)
    return read(docs.sparkSession, path)
