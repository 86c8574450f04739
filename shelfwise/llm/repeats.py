"""Suffix-array deduplication of byte strings, by a depth-limited radix sort.

Every start of a text stands for its suffix, ordered only to a depth of DEPTH
bytes; equal groups at that depth are the repeated strings, and each byte that
one covers, but for the group's first member, goes. Suffixes are sorted by
most-significant digits in three passes, and a pass takes on only the groups in
which the one before left more than one member:

1. Digit one is content, not place: of the DEPTH - GRAM + 1 GRAM-byte strings
   in a suffix's first DEPTH bytes, the one with the smallest hash, its anchor.
   Neighbouring suffixes share their anchor, so it is held once for a run of
   them; suffixes that are equal to the depth have equal anchors at equal places.
2. Digit two is all the bytes that the suffixes of a run cover to the depth. Runs
   that agree in it are equal suffix by suffix; all but the first are removed.
3. Runs that agree in digit one alone - the edges of repeated passages - travel
   with the bytes that they cover to where their anchor is sorted, and are spread
   out there into their suffixes, told apart by all DEPTH bytes.

Strings are equal where 128 bits of hashes are: digits one and two together in the
first passes, two hashes of all DEPTH bytes in the third (10^14 strings, 100 TB of
text, hold a false equal with a probability of 10^-10). The shuffle
of the first two passes carries a row for each run, one in about 32 bytes of
text; copies within a task are settled before it, so a passage that most
documents hold sends one row from each task, not one from each document. A task
takes its rows in order of digit, a lot of whole groups at a time, so what it
holds doesn't grow with the corpus. An
anchor that a task meets with more than HOT different surroundings, as a common
line has, is sorted by digit two and then by all DEPTH bytes from the start, so
that its runs don't meet in one task; everyone else who holds that anchor learns
of it by a mark in its place.

Order is that of doc_id, then place. Defined cases: a null or empty text has no
bytes; a null doc_id comes first; rows equal in doc_id and text are one document
and each get its result, rows of one doc_id with different texts are ordered by a
hash of the text; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import U64, mixed, partitions, release, settle, slices, trim

DEPTH = 100
GRAM = 36
_BASE = U64(0x5851F42D4C957F2D)
_BYTES = mixed(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
#: Base of the second hash of all DEPTH bytes.
_BASE2 = U64(0xDA942042E4DD58B5)
_PLACE = U64((1 << 24) - 1)
#: Bytes hashed at once; their places must fit in 24 bits.
PIECE = 1 << 19
#: Bytes of text whose runs are compared with each other before the shuffle.
CHUNK = 16 << 20
#: Different surroundings of one anchor in a chunk from which it is hot.
HOT = 8
#: Rows, and bytes, of a lot that a task resolves at once; a lot ends where a group does.
LOT, LOT_BYTES = 1 << 18, 32 << 20


def window_hashes(b: np.ndarray, sizes: tuple[int, ...], base: U64 = _BASE) -> list[np.ndarray]:
    """For each size, the hashes of all strings of so many bytes, by doubling."""
    powers, level, n, base = {}, _BYTES[b], 1, int(base)
    tall = max(sizes)
    while n <= tall:
        powers[n] = (level, U64(base))
        if 2 * n > tall or len(level) <= n:
            break
        level = level[:-n] * U64(base) + level[n:]
        base = base * base & 0xFFFFFFFFFFFFFFFF
        n *= 2
    out = []
    for size in sizes:
        if len(b) < size:
            out.append(np.zeros(0, dtype=U64))
            continue
        total, at = None, 0
        for n in sorted(powers, reverse=True):
            while size - at >= n:
                level, base = powers[n]
                part = level[at : len(b) - size + at + 1]
                total = part.copy() if total is None else total * base + part
                at += n
        out.append(mixed(total))
    return out


def lowest(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every `width` neighbours."""
    n = 1
    while 2 * n <= width:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    rest = width - n
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def runs(b: np.ndarray, ends: np.ndarray, depth: int = DEPTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that stand one after the other in b, each ending at one of `ends`: for every run of suffixes its digits one and two, first start and number.

    Starts with less than `depth` bytes to their text's end belong to no run.
    """
    if len(b) < depth:
        return (np.zeros(0, dtype=U64),) * 2 + (np.zeros(0, dtype=np.int64),) * 2
    small, deep = window_hashes(b, (gram, depth))
    # The place in the low bits makes the leftmost of equal grams the anchor.
    anchor = (lowest((small & ~_PLACE) | np.arange(len(small), dtype=U64), depth - gram + 1) & _PLACE).astype(np.int64)
    begins = np.concatenate([[0], ends[:-1]])
    whole = np.zeros(len(b) + 1, dtype=np.int8)
    long_ = ends - begins >= depth
    np.add.at(whole, begins[long_], 1)
    np.add.at(whole, ends[long_] - depth + 1, -1)
    at = np.flatnonzero(np.cumsum(whole[: len(anchor)], dtype=np.int8))
    if not len(at):
        return (np.zeros(0, dtype=U64),) * 2 + (np.zeros(0, dtype=np.int64),) * 2
    of = anchor[at]
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    n = np.diff(np.append(first, len(at)))
    s, a = at[first], of[first]
    one = small[a]
    shape = ((a - s).astype(U64) << U64(32)) + n.astype(U64)
    two = mixed(mixed(deep[s] + shape * _BASE) ^ (deep[s + n - 1] * _BASE))
    return one, two, s, n


def _pieces(texts: list[bytes], depth: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Texts in lots of about PIECE bytes, as (which, place in it, bytes); a longer one in parts that overlap by depth - 1."""
    lot, held = [], 0
    for i, t in enumerate(texts):
        if len(t) < depth:
            continue
        for at in range(0, max(1, len(t) - depth + 1), PIECE):
            part = t[at : at + PIECE + depth - 1]
            if held and held + len(part) > PIECE:
                yield lot
                lot, held = [], 0
            lot.append((i, at, part))
            held += len(part)
    if lot:
        yield lot


def _firsts(one: np.ndarray, two: np.ndarray, key: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether each row is the first, by (key, start), of those that agree in two hashes."""
    order = np.lexsort((start, key, one, two))
    first = np.empty(len(two), dtype=bool)
    t, o = two[order], one[order]
    first[order] = np.concatenate([[True], (t[1:] != t[:-1]) | (o[1:] != o[:-1])]) if len(t) else np.zeros(0, dtype=bool)
    return first


#: What a row of the first shuffle is: a run, one that is known to be removed, a run of a hot anchor, or the mark of such an anchor.
RUN, REMOVED, OF_HOT, MARK = range(4)
_RUNS = ["key", "sort", "one", "two", "place", "kind"]


def _all_runs(docs: DataFrame, depth: int) -> DataFrame:
    """A row for each run: key, digits, place (start * 256 + number), kind, and `sort`, by which it is dealt."""

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def rows() -> pa.RecordBatch:
            key, one, two, place = (np.concatenate(x) for x in zip(*held))
            held.clear()
            first = _firsts(one, two, key, place)
            kind = np.where(first, RUN, REMOVED).astype(np.int8)
            anchors, times = np.unique(one[first], return_counts=True)
            hot = anchors[times > HOT]
            kind[first & np.isin(one, hot)] = OF_HOT
            # Runs of an anchor meet where it is sorted, those of a hot one where digit two is; what is settled goes anywhere.
            sort = np.where(kind == RUN, one, np.where(kind == OF_HOT, two, mixed(key.view(U64) + place.view(U64))))
            none = np.zeros(len(hot), dtype=np.int64)
            columns = [np.append(key, none), np.append(sort, hot).view(np.int64), np.append(one, hot).view(np.int64), np.append(two, none.view(U64)).view(np.int64), np.append(place, none), np.append(kind, np.full(len(hot), MARK, dtype=np.int8))]
            return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), _RUNS)

        for batch in slices(batches, "text", PIECE):
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            keys = batch.column("key").to_numpy()
            for lot in _pieces(texts, depth):
                ends = np.cumsum([len(p) for _, _, p in lot])
                one, two, s, n = runs(np.frombuffer(b"".join(p for _, _, p in lot), dtype=np.uint8), ends, depth)
                which = np.searchsorted(ends, s, side="right")
                starts = ends - np.array([len(p) for _, _, p in lot])
                s = s - starts[which] + np.array([at for _, at, _ in lot])[which]
                held.append((keys[np.array([i for i, _, _ in lot])[which]], one, two, s * 256 + n))
            size += sum(map(len, texts))
            if size >= CHUNK and held:
                yield rows()
                size = 0
        if held:
            yield rows()

    return docs.mapInArrow(find, "key long, sort long, one long, two long, place long, kind byte")


def _lots(batches: Iterable[pa.RecordBatch], by: str) -> Iterator[pa.Table]:
    """Rows in order of `by`, in lots of about LOT rows or LOT_BYTES that hold all rows of each value."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    most, most_bytes = LOT, LOT_BYTES
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= most or size >= most_bytes:
            all_ = pa.Table.from_batches(held)
            value = all_.column(by).to_numpy()
            cut = int(np.searchsorted(value, value[-1]))
            if cut:
                yield all_.slice(0, cut)
            held = all_.slice(cut).combine_chunks().to_batches()
            rows, size = len(value) - cut, sum(b.nbytes for b in held)
            most, most_bytes = max(LOT, 2 * rows), max(LOT_BYTES, 2 * size)  # a group larger than a lot is looked at again when it has doubled
    if held:
        yield pa.Table.from_batches(held)
    trim()


_RESOLVED = ["key", "place", "one", "state"]
#: States of a resolved run: removed, or to be spread out where its anchor is sorted, or (of a hot one) where its bytes are.
GONE, EDGE, HOT_EDGE = range(3)


def _resolved(found: DataFrame) -> DataFrame:
    """Passes one and two: removed runs, and runs to be spread out."""

    def resolve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in _lots(batches, "sort"):
            yield from resolved(*(lot.column(c).to_numpy() for c in ("key", "one", "two", "place", "kind")))

    def resolved(key: np.ndarray, one: np.ndarray, two: np.ndarray, place: np.ndarray, kind: np.ndarray) -> Iterator[pa.RecordBatch]:
        def out(at: np.ndarray, state: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(place[at]), pa.array(one[at]), pa.array(np.full(int(at.sum()), state, dtype=np.int8))], _RESOLVED)

        yield out(kind == REMOVED, GONE)
        marked = np.unique(one[kind == MARK])
        for own in (RUN, OF_HOT):  # runs of one digit two are together in each kind
            mine = np.flatnonzero(kind == own)
            first = _firsts(one[mine], two[mine], key[mine], place[mine])
            gone = np.zeros(len(key), dtype=bool)
            gone[mine[~first]] = True
            yield out(gone, GONE)
            mine = mine[first]
            edge = np.zeros(len(key), dtype=bool)
            if own == OF_HOT:
                edge[mine] = True
                yield out(edge, HOT_EDGE)
                continue
            hot = np.isin(one[mine], marked)
            edge[mine[hot]] = True
            yield out(edge, HOT_EDGE)
            mine, edge = mine[~hot], np.zeros(len(key), dtype=bool)
            _, inverse, times = np.unique(one[mine], return_inverse=True, return_counts=True)
            edge[mine[times[inverse] > 1]] = True
            yield out(edge, EDGE)

    n = partitions(found.sparkSession)
    return found.repartition(n, "sort").sortWithinPartitions("sort").mapInArrow(resolve, "key long, place long, one long, state byte")


def _listed(rows: DataFrame, *columns: str) -> DataFrame:
    """key and, as one array each, the columns of its rows. They grow with the corpus, so they are shuffled to the texts at any size."""
    lists = rows.groupBy("key").agg(F.collect_list(F.struct(*columns)).alias("rows"))
    return settle(lists.select(F.col("key").alias("k"), *(F.col(f"rows.{c}").alias(f"{c}s") for c in columns)), "repeats-listed").hint("merge")


_SPREAD = ["slot", "key", "place", "bytes", "check", "gone"]


def _spread(docs: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """Edges with the bytes that they cover, dealt by their anchor (slot); those of hot anchors as single suffixes, dealt by a hash of theirs."""

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PIECE):
            slots, keys, places, covered, hot = [], [], [], [], []
            for key, text, place, one, state in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "places", "ones", "states"))):
                b = (text or "").encode("utf-8", "surrogatepass")
                for p, o, x in zip(place, one, state):
                    s, n = divmod(p, 256)
                    if x == EDGE:
                        slots.append(o), keys.append(key), places.append(p), covered.append(b[s : s + n + depth - 1])
                    else:
                        hot.append((key, p, b[s : s + n + depth - 1]))
            if slots:
                yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(keys, pa.int64()), pa.array(places, pa.int64()), pa.array(covered, pa.binary()), pa.nulls(len(slots), pa.int64()), pa.array([False] * len(slots))], _SPREAD)
            for i in range(0, len(hot), 4096):
                key, start, deep, check = _suffixes([k for k, _, _ in hot[i : i + 4096]], [p for _, p, _ in hot[i : i + 4096]], [c for _, _, c in hot[i : i + 4096]], depth)
                gone = ~_firsts(check, deep, key, start)
                slot = np.where(gone, mixed(key.view(U64) + start.view(U64)), deep).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(key), pa.array(start * 256 + 1), pa.nulls(len(key), pa.binary()), pa.array(check.view(np.int64)), pa.array(gone)], _SPREAD)

    both = docs.join(edges, F.col("key") == F.col("k")).select("key", "text", "places", "ones", "states")
    return both.mapInArrow(find, "slot long, key long, place long, bytes binary, check long, gone boolean")


def _suffixes(keys: list[int], places: list[int], covered: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of runs given with the bytes that they cover: key, start and two hashes of all bytes to the depth of each suffix."""
    n = np.array([len(c) for c in covered], dtype=np.int64)
    begins = np.cumsum(n) - n
    b = np.frombuffer(b"".join(covered), dtype=np.uint8)
    deep, check = window_hashes(b, (depth,))[0], window_hashes(b, (depth,), _BASE2)[0]
    many = n - depth + 1
    at = np.repeat(begins - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    offset = at - np.repeat(begins, many)
    return np.repeat(np.array(keys, dtype=np.int64), many), np.repeat(np.array(places, dtype=np.int64) // 256, many) + offset, deep[at], check[at]


def _settled(spread: DataFrame, depth: int) -> DataFrame:
    """Pass three: key and place of the runs of suffixes that have an earlier equal."""

    def resolve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in _lots(batches, "slot"):
            yield from resolved(lot.combine_chunks().to_batches()[0])

    def resolved(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        has = pc.is_valid(batch.column("bytes")).to_numpy(zero_copy_only=False)
        gone = batch.column("gone").to_numpy(zero_copy_only=False)
        key, place, slot = (batch.column(c).to_numpy() for c in ("key", "place", "slot"))
        single = ~has & ~gone
        known = batch.column("check").filter(pa.array(single)).to_numpy(zero_copy_only=False).astype(np.int64)
        parts = [(key[single], place[single] // 256, slot[single].view(U64), known.view(U64))]
        rows = np.flatnonzero(has)
        covered = batch.column("bytes").take(pa.array(rows))
        for i in range(0, len(rows), 4096):
            some = rows[i : i + 4096]
            parts.append(_suffixes(key[some], place[some], covered.slice(i, 4096).to_pylist(), depth))
        keys, starts, deep, check = (np.concatenate(x) for x in zip(*parts))
        later = ~_firsts(check, deep, keys, starts)
        key, start = np.concatenate([keys[later], key[gone]]), np.concatenate([starts[later], place[gone] // 256])
        order = np.lexsort((start, key))
        key, start = key[order], start[order]
        # Neighbouring suffixes as one run, of 128 at most.
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (start[1:] != start[:-1] + 1)]) if len(key) else np.zeros(0, dtype=bool)
        head = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0)) if len(key) else np.zeros(0, dtype=np.int64)
        new |= (np.arange(len(key)) - head) % 128 == 0
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(key)))
        yield pa.RecordBatch.from_arrays([pa.array(key[first]), pa.array(start[first] * 256 + n)], ["key", "place"])

    n = partitions(spread.sparkSession)
    return spread.repartition(n, "slot").sortWithinPartitions("slot").mapInArrow(resolve, "key long, place long")


def _keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows as doc_id, text and key, which orders documents: doc_id itself where it tells them apart; and documents as key, text."""
    d = docs.select(docs["doc_id"], docs["text"])
    ids = d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col("doc_id").isNull() | (F.col("doc_id") == -(2**63)))
    if ids.isEmpty():
        d = d.withColumn("key", F.col("doc_id").cast("long"))
        return d, d.select("key", "text")
    texts = d.select("doc_id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("h")).distinct()
    order = [F.col("doc_id").asc_nulls_first(), F.col("h")]
    numbers = texts.repartitionByRange(partitions(d.sparkSession), *order).sortWithinPartitions(*order).withColumn("key", F.monotonically_increasing_id())
    numbers = settle(numbers, "repeats-keys").withColumnsRenamed({"doc_id": "d", "h": "g"})
    d = settle(d.join(numbers, d["doc_id"].eqNullSafe(F.col("d")) & (F.coalesce(F.xxhash64("text"), F.lit(0)) == F.col("g"))).select("doc_id", "text", "key"), "repeats-docs")
    return d, settle(d.select("key", "text").dropDuplicates(["key"]), "repeats-once")


def deduplicate(docs: DataFrame, depth: int = DEPTH, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; with `texts` also spans (start, end) and kept, the remaining bytes."""
    spark = docs.sparkSession
    keyed, bare = _keyed(docs)
    found = settle(_resolved(_all_runs(bare, depth)), "repeats-runs")
    release(spark)
    edges = _listed(found.where(F.col("state") != GONE), "place", "one", "state")
    later = settle(_settled(_spread(bare, edges, depth), depth), "repeats-suffixes")
    release(spark)
    gone = _listed(found.where(F.col("state") == GONE).select("key", "place").unionByName(later), "place")
    release(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PIECE):
            sizes, removed, spans, shas, kept, places = [], [], [], [], [], []
            for text, list_ in zip(batch.column("text").to_pylist(), batch.column("places")):
                b = (text or "").encode("utf-8", "surrogatepass")
                place = np.sort(np.asarray(list_.values)) if list_.is_valid else np.zeros(0, dtype=np.int64)
                s = place // 256
                e = s + place % 256 + depth - 1
                # Joined where they overlap or touch: a span begins where no earlier one reaches.
                reach = np.maximum.accumulate(e) if len(e) else e
                new = np.concatenate([[True], s[1:] > reach[:-1]]) if len(s) else np.zeros(0, dtype=bool)
                begin, end = s[new].tolist(), reach[np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)].tolist() if len(s) else []
                rest = b"".join(b[x:y] for x, y in zip([0, *end], [*begin, len(b)]))
                sizes.append(len(b)), removed.append(len(b) - len(rest)), spans.append(len(begin)), shas.append(hashlib.sha256(rest).hexdigest())
                if texts:
                    kept.append(rest), places.append([{"start": x, "end": y} for x, y in zip(begin, end)])
            columns = {"doc_id": batch.column("doc_id"), "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(shas, pa.string())}
            if texts:
                columns |= {"spans": pa.array(places, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept": pa.array(kept, pa.binary())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", spans array<struct<start: long, end: long>>, kept binary" * texts
    return keyed.join(gone, F.col("key") == F.col("k"), "left").select("doc_id", "text", "places").mapInArrow(finish, schema)
