"""Helpers that the operators of this package share.

Conventions that hold for all of them unless an operator says otherwise:

* an operator selects the columns that it needs when it starts, so extra input
  columns can't clash with its own names;
* a null text counts as the empty text;
* rows that are equal in identifier and text are the same document: each such
  row gets that document's result.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
_MIX = U64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the session names none and runs in one process (master local) a
    temporary one is made and set; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    option = spark.sparkContext._jsc.sc().getCheckpointDir()
    if option.isEmpty():
        if not spark.sparkContext._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shelfwise-"))
        option = spark.sparkContext._jsc.sc().getCheckpointDir()
    return option.get().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Cuts the lineage so that a lost executor costs no more than the reread, and
    so that a Python stage runs once however often its result is used.
    """
    path = scratch(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables that `settle` wrote and that nothing reads any more.

    What a result that is handed out still reads stays until its reader clears the
    shared folder.
    """
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._settled)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about `limit` bytes of `column`, one row at least."""
    for batch in batches:
        values = batch.column(column)
        ends = np.cumsum(np.array(pc.fill_null(pc.binary_length(values), 0), dtype=np.int64))
        begin = 0
        while begin < batch.num_rows:
            base = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end
    trim()


def trim() -> None:
    """Give back what this worker process has freed; it lives on, and may get little of the next task's memory otherwise."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


#: A letter's random number, and the base of the polynomial that a word's hash is.
_LETTERS = mixed(np.arange(1, 257, dtype=U64) * U64(0xA0761D6478BD642F))
_BASE = 0x5851F42D4C957F2D
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n at least."""
    if not len(_POWERS) or len(_POWERS["up"]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        with np.errstate(over="ignore"):
            up, down = (np.cumprod(np.concatenate([[U64(1)], np.full(size - 1, U64(b), dtype=U64)]), dtype=U64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        _POWERS["up"], _POWERS["down"] = up, down
    return _POWERS["up"], _POWERS["down"]


def lower_words(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of a text, with A-Z in lower case, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


def word_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """64-bit hashes of the words of `lower_words`, text by text, computed for all texts together."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    b = np.frombuffer(b" ".join(raw).translate(_LOWER) + b" ", dtype=np.uint8)
    gap = _SPACE[b]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        edge = np.concatenate([[0], edge])
    begin, end = edge[0::2], edge[1::2]
    up, down = _powers(len(b))
    # A word's polynomial is a difference of prefix sums, brought to its own start.
    total = np.concatenate([np.zeros(1, dtype=U64), np.cumsum(_LETTERS[b] * up[: len(b)], dtype=U64)])
    out = mixed((total[end] - total[begin]) * down[begin] + (end - begin).astype(U64))
    starts = np.cumsum([0, *(len(r) + 1 for r in raw)])
    cuts = np.searchsorted(begin, starts).tolist()
    return [out[x:y] for x, y in zip(cuts, cuts[1:])]


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-word windows; fewer words give one window of them all, none give none."""
    size = len(hashes)
    if not size:
        return hashes
    n_here = min(n, size)
    out = np.full(size - n_here + 1, n_here, dtype=U64)
    for i in range(n_here):
        out = (out ^ hashes[i : size - n_here + 1 + i]) * _MIX
        out ^= out >> U64(29)
    return mixed(out)


#: Rows of a few numbers each, some tens of MB at most, that a join may broadcast.
BROADCAST_ROWS = 1_000_000


def checked_broadcast(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """`df`, narrow rows, marked for broadcast if it is counted to have `most` rows at most; else as it is, to be shuffled."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def release(spark: SparkSession) -> None:
    """Let go of what plans that are done have left: shuffle files, and the heaps that grew by them.

    Spark's cleaner removes the files when the driver's JVM collects what referred
    to them, which may be long after; a job of several large shuffles asks for it
    between them, and gives the cleaner, which works beside it, a moment before the
    next writes. Executors' heaps are collected as well, so that the Python workers
    beside them find that memory free again.
    """
    import gc
    import time

    gc.collect()
    spark.sparkContext._jvm.System.gc()
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).selectExpr("java_method('java.lang.System', 'gc')").collect()
    time.sleep(1)
