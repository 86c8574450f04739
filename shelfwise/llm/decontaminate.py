"""Benchmark decontamination: containment search by size-partitioned MinHash.

Benchmark items are partitioned by the size of their shingle set (powers of
two). The items of a partition are sketched by their k smallest hashes, with k
one more than the shingles that an item of that partition may miss at the
threshold; so a document that contains an item to that part has one of its k
minima at least, however long the document is, and the search loses nothing.
Documents look up all their shingles among the minima of each partition whose
items they are large enough to contain; what they find is verified by exact
containment of the shingles themselves.

The items' minima and shingles are broadcast while they are counted to be
`BROADCAST_SHINGLES` at most; above that the same search runs as joins: on the
hash among the minima, and for the documents that found something on the
shingles themselves. Both give the same.

Defined cases: a null text or one without words contains nothing and, as an
item, is found nowhere; texts of fewer than n words are one shingle; repeated
documents are each reported, repeated items too under their item_id; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import U64, lower_words, settle, shingles, slices, word_hashes

WORDS, NUM, DEN = 5, 80, 100
#: Of all items together: about 50 MB with their words.
BROADCAST_SHINGLES = 500_000


def shingle_set(words: list[bytes], n: int) -> dict[bytes, None]:
    """The distinct n-word shingles themselves, in order."""
    if not words:
        return {}
    return dict.fromkeys(b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def minima(size: int, num: int, den: int) -> int:
    """Length of the sketch of items of this size: that of the largest in its partition."""
    largest = (1 << size.bit_length()) - 1
    return largest - -(-largest * num // den) + 1


def _items(benchmark: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """item_id, text, hashes (ascending), size (of the set), minima (how many of the hashes are looked up)."""

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 19):
            texts = batch.column("text").to_pylist()
            found = [np.unique(shingles(h, n)) for h in word_hashes(texts)]
            sizes = [len(shingle_set(lower_words(t), n)) for t in texts]
            k = [min(len(h), minima(size, num, den)) if size else 0 for h, size in zip(found, sizes)]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("text"), pa.array([h.view(np.int64) for h in found], pa.list_(pa.int64())), pa.array(sizes, pa.int32()), pa.array(k, pa.int32())], ["item_id", "text", "hashes", "size", "minima"])

    kind = benchmark.schema["item_id"].dataType.simpleString()
    return benchmark.select("item_id", "text").mapInArrow(find, f"item_id {kind}, text string, hashes array<long>, size int, minima int").where("size > 0")


class _Index:
    """The items, as each worker holds them: for each partition by size its minima."""

    def __init__(self, items: list[tuple], n: int, num: int, den: int):
        self.ids = [i for i, *_ in items]
        self.sets = [frozenset(shingle_set(lower_words(text), n)) for _, text, *_ in items]
        self.parts = []
        of = np.array([size.bit_length() for *_, size, _ in items], dtype=np.int64)
        for size in np.unique(of).tolist():
            here = np.flatnonzero(of == size)
            low = [np.sort(np.array(items[i][2], dtype=np.int64).view(U64))[: items[i][4]] for i in here]
            keys, owner = np.concatenate(low), np.repeat(here, [len(x) for x in low])
            order = np.argsort(keys, kind="stable")
            seen = np.zeros(1 << 20, dtype=bool)  # a first look by 20 bits
            seen[(keys >> U64(44)).astype(np.int64)] = True
            # The smallest item of the partition has 2 ** (size - 1) shingles.
            self.parts.append((-(-(1 << (size - 1)) * num // den), seen, keys[order], owner[order]))

    def candidates(self, hashes: np.ndarray) -> list[int]:
        out, first = set(), (hashes >> U64(44)).astype(np.int64)
        for least, seen, keys, owner in self.parts:
            if len(hashes) < least:  # even if all its shingles are distinct
                continue
            h = hashes[seen[first]]
            if len(h):
                lo, hi = np.searchsorted(keys, h, side="left"), np.searchsorted(keys, h, side="right")
                out.update(int(o) for a, b in zip(lo[lo < hi], hi[lo < hi]) for o in owner[a:b])
        return sorted(out)


def search(docs: DataFrame, benchmark: DataFrame, n: int = WORDS, num: int = NUM, den: int = DEN, most: int = BROADCAST_SHINGLES) -> DataFrame:
    """Every document that contains an item: doc_id, item_id, n_shingles (of the item), n_common, containment."""
    return _search(docs, benchmark, n, num, den, most).drop("text_hash")


def _search(docs: DataFrame, benchmark: DataFrame, n: int, num: int, den: int, most: int) -> DataFrame:
    """The same with text_hash, which tells documents of one identifier apart."""
    docs = docs.select("doc_id", "text", F.xxhash64(docs["text"]).alias("text_hash"))
    items = settle(_items(benchmark, n, num, den), "items")
    total = items.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    out = _by_join(docs, items, n, num, den) if total > most else _by_index(docs, items, n, num, den)
    return out.withColumn("containment", F.col("n_common") / F.col("n_shingles"))


def _by_index(docs: DataFrame, items: DataFrame, n: int, num: int, den: int) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    index = docs.sparkSession.sparkContext.broadcast([(r["item_id"], r["text"], r["hashes"], r["size"], r["minima"]) for r in items.orderBy("item_id", "text").collect()])
    item_kind = items.schema["item_id"].dataType
    item_type = to_arrow_type(item_kind)

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Index(index.value, n, num, den)
        for batch in slices(batches, "text", 1 << 19):
            of, item, size, common = [], [], [], []
            texts = batch.column("text").to_pylist()
            for i, (text, hashes) in enumerate(zip(texts, word_hashes(texts))):
                found = held.candidates(shingles(hashes, n)) if len(hashes) else []
                own = shingle_set(lower_words(text), n).keys() if found else ()
                for j in found:
                    both = len(held.sets[j] & own)
                    if both * den >= len(held.sets[j]) * num:
                        of.append(i), item.append(held.ids[j]), size.append(len(held.sets[j])), common.append(both)
            at = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("text_hash").take(at), pa.array(item, item_type), pa.array(size, pa.int64()), pa.array(common, pa.int64())], ["doc_id", "text_hash", "item_id", "n_shingles", "n_common"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(find, f"doc_id {kind}, text_hash long, item_id {item_kind.simpleString()}, n_shingles long, n_common long")


def _spread(rows: DataFrame, name: str, n: int, shown: bool) -> DataFrame:
    """(name, hash) of every distinct shingle of each row's text, with `shown` (name, shingle): the shingle itself."""

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 19):
            texts = batch.column("text").to_pylist()
            found = [list(shingle_set(lower_words(t), n)) for t in texts] if shown else [np.unique(shingles(h, n)).view(np.int64) for h in word_hashes(texts)]
            of = np.repeat(np.arange(len(found)), [len(x) for x in found])
            values = pa.array([s for x in found for s in x], pa.binary()) if shown else pa.array(np.concatenate(found) if found else np.zeros(0, dtype=np.int64))
            for at in range(0, len(of), 1 << 16):
                yield pa.RecordBatch.from_arrays([batch.column(name).take(pa.array(of[at : at + (1 << 16)])), values.slice(at, 1 << 16)], [name, "shingle" if shown else "hash"])

    return rows.select(name, "text").mapInArrow(find, f"{name} long, " + ("shingle binary" if shown else "hash long"))


def _by_join(docs: DataFrame, items: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """For any number of items. Items and documents go by numbers."""
    rows = settle(docs.withColumn("row", F.monotonically_increasing_id()), "contain-rows")
    items = settle(items.withColumn("item", F.monotonically_increasing_id()), "contain-items")
    low = items.select("item", F.explode(F.expr("slice(array_sort(hashes, (x, y) -> CASE WHEN (x < 0) = (y < 0) THEN CASE WHEN x < y THEN -1 WHEN x > y THEN 1 ELSE 0 END WHEN x < 0 THEN 1 ELSE -1 END), 1, minima)")).alias("hash"))
    pairs = settle(_spread(rows, "row", n, False).join(low, "hash").select("row", "item").distinct(), "contain-pairs")
    # Verification, by the shingles of the documents and items that met.
    met = rows.join(pairs.select("row").distinct(), "row", "left_semi")
    own = pairs.join(_spread(items, "item", n, True), "item")
    common = own.join(_spread(met, "row", n, True), ["row", "shingle"]).groupBy("row", "item").agg(F.count(F.lit(1)).alias("n_common"))
    sizes = own.groupBy("row", "item").agg(F.count(F.lit(1)).alias("n_shingles"))
    found = common.join(sizes, ["row", "item"]).where(F.col("n_common") * den >= F.col("n_shingles") * num)
    found = found.join(items.select("item", "item_id"), "item")
    return found.join(rows.select("row", "doc_id", "text_hash"), "row").select("doc_id", "text_hash", "item_id", "n_shingles", "n_common")


def clean(docs: DataFrame, benchmark: DataFrame, n: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """`docs`, every column, without the documents that contain an item."""
    from shelfwise.llm.common import checked_broadcast

    found = _search(docs, benchmark, n, num, den, BROADCAST_SHINGLES)
    bad = settle(found.select(F.col("doc_id").alias("__bad"), F.col("text_hash").alias("__hash")).distinct(), "contaminated")
    return docs.join(checked_broadcast(bad), docs["doc_id"].eqNullSafe(F.col("__bad")) & (F.xxhash64(docs["text"]) == F.col("__hash")), "left_anti")
