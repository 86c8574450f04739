"""N-gram Jaccard join: an exact metric-space self-join under Jaccard distance.

Documents with the same shingle set are one point. The join is by regions, in
three steps, each on the regions that the one before leaves open:

1. The first coordinate is a set's size. Points within the distance differ in
   size by a bounded ratio, so sizes are cut into intervals of that ratio and
   each point is placed in its own interval and, as its boundary copy, in the
   one below; a pair meets in the interval of the smaller set.
2. An interval bounds by K the shingles in which a pair may differ. The shingle
   universe is cut into K + S pivot sets; a pair differs in K of its projections
   onto them at most, so S are equal, where S is more than a set of that size is
   likely to have empty ones. (A set that can only differ in fewer than K from any
   that it meets takes as many fewer, the first ones: S of those are equal still.) A region holds the points with the same projection
   onto one pivot set. Empty projections tell nothing apart: a point drops them,
   and must meet others in as many fewer; one with S of them or more keeps them,
   and must meet others once. A point stays in play only while that many of its
   projections meet another point, and while other points in play have as many of
   its shingles as one that is linked with it must. Regions of one interval that
   share points make a cell.
3. The most central point of a cell (whose regions hold most) is its pivot, and
   all points of the cell are measured against it; those within the distance are
   linked to it, and pairs among them are one component already. The cell is then
   joined again, each point described by its difference from the pivot: x and y
   differ in as much as their differences from p do. So by the triangle
   inequality a point beyond the distance can only be linked with one whose
   difference it shares to a computable part. What it shares with no other point
   of the cell counts against it, and points that can't reach that part are
   dropped, until few are left. The rarest elements of the others, a computable
   prefix, cut the cell into smaller regions; these are joined recursively, with
   further pivots among the points beyond the distance: 16 of a region, then 256,
   and so on, a point being a pivot once. Each pivot is measured against the
   points of its region that lie within its window and aren't in its component
   by then, and the components are brought up to date after each turn.

Regions are tables of identifiers; sets travel only to be measured against pivots.
Distances are exact: set sizes and intersections of 64-bit shingle hashes (two
shingles with one hash count as one; at 10^12 distinct shingles a given document
of 1000 is touched by that with a probability of 10^-4).

Pivots that are documents can't cut the whole space: the distance of unrelated
documents is nearly 1 to any of them, so every window would hold everything (see
the README for figures). Hence the first two steps.

Defined cases: documents without words have size 0 and are linked with nothing;
texts of fewer than n words are one shingle; repeated rows are linked with each
other by having one set; extra columns are ignored; null identifiers are carried,
and are the smallest of their class only if it has no others.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import U64, checked_broadcast, forget, mixed, partitions, release, settle, shingles, slices, trim, word_hashes
from shelfwise.llm.components import components

#: Least number of projections that linked sets share.
SPARE = 3
#: Bytes of text whose regions are compared with each other before the shuffle.
CHUNK = 4 << 20
#: Points of one region in a chunk from which it is hot.
HOT = 8
#: Pivots of a region in the first turn; each further one has so many times more.
PIVOTS = 16


def word_sets(texts: list[str | None], n: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's n-word shingles."""
    for hashes in word_hashes(texts):
        yield np.unique(shingles(hashes, n))


def print_of(s: np.ndarray) -> int:
    """A set's fingerprint, signed 64 bits."""
    import xxhash

    return int(np.array([xxhash.xxh3_64_intdigest(s.tobytes())], dtype=U64).view(np.int64)[0]) if len(s) else 0


def intervals(size: int, num: int, den: int) -> list[tuple[int, int, int]]:
    """The interval of a size and the one below, each as (its first size, K, the most that a set of this very size can differ in from one that it meets there), for similarity num / den."""
    low, before, found = 1, None, []
    while True:
        high = low * den // num
        if low <= size <= high:
            found = [x for x in (before, (low, high)) if x]
            break
        before, low = (low, high), high + 1
    differ = lambda x, y: (x + y) * (den - num) // (den + num)
    # In its own interval it meets larger sets too, in the one below those up to its end.
    return [(a, differ(b, b * den // num), differ(size, size * den // num if a <= size <= b else b)) for a, b in found]


def spare(low: int, k: int) -> int:
    """Projections beyond K, at least SPARE and more than a set of this size is likely to have empty ones."""
    empty = math.exp(-low / (k + SPARE)) * k
    return SPARE + math.ceil(1.5 * empty + 5 * math.sqrt(empty))


def projections(s: np.ndarray, num: int, den: int, cache: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a sorted set of hashes: region numbers, their interval, and how many of the interval's a linked set shares at least."""
    size = len(s)
    if size not in cache:
        if len(cache) > 100_000:
            cache.clear()
        # K = 0: only equal sets are as near. Of the K + S parts a set needs as many more than S as it can differ in, the first ones.
        cache[size] = [(low, k + spare(low, k), own + spare(low, k), spare(low, k)) for low, k, own in intervals(size, num, den) if k]
    total = np.concatenate([np.zeros(1, dtype=U64), np.cumsum(mixed(s), dtype=U64)])
    out, levels, needs = [], [], []
    for low, parts, first, need in cache[size]:
        # Pivot sets are ranges of the hash, so a sorted set falls into runs.
        bounds = np.searchsorted((s >> U64(32)) * U64(parts) >> U64(32), np.arange(first + 1, dtype=U64))
        sums = total[bounds[1:]] - total[bounds[:-1]]
        names = np.arange(first, dtype=U64) + (U64(low) << U64(24))
        keep = bounds[1:] > bounds[:-1]
        none = first - int(np.count_nonzero(keep))
        if none >= need:
            keep[:], none = True, need - 1
        out.append(mixed(sums[keep] ^ mixed(names[keep])))
        levels.append(np.full(len(out[-1]), low, dtype=np.int64))
        needs.append(np.full(len(out[-1]), need - none, dtype=np.int64))
    if not out:
        return np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(out), np.concatenate(levels), np.concatenate(needs)


def _points(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, text_hash, size, print of every document."""

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 19):
            sizes, prints = [], []
            for s in word_sets(batch.column("text").to_pylist(), n):
                sizes.append(len(s)), prints.append(print_of(s))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64())], ["doc_id", "text_hash", "size", "print"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", text_hash(docs).alias("text_hash")).mapInArrow(find, f"doc_id {kind}, text_hash long, size long, print long")


def text_hash(docs: DataFrame) -> Column:
    """With the identifier, what tells rows of different documents apart."""
    return F.xxhash64(docs["text"])


_DEALT = ["region", "print", "tag"]
#: Lowest bits of a tag: the region is known to be shared; the row needn't go where its region is gathered.
KNOWN, AWAY = 1, 2


def _dealt(region: np.ndarray, point: np.ndarray, tag: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of a chunk: of a hot region, as a common passage makes it, one row goes to where the region is gathered; the others, known to be shared, go anywhere."""
    _, first, which, times = np.unique(region, return_index=True, return_inverse=True, return_counts=True)
    hot = times[which] > HOT
    tag = tag + hot * KNOWN
    tag[hot & (first[which] != np.arange(len(region)))] += AWAY
    for i in range(0, len(region), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 16)]) for c in (region.view(np.int64), point, tag)], _DEALT)


def _regions(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """A row for each region of each document: region, print, tag (the interval, how many regions a linked set shares, and how the row is dealt). In a chunk a set is taken once."""

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        seen: set[int] = set()
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in slices(batches, "text", 1 << 19):
            for s in word_sets(batch.column("text").to_pylist(), n):
                p = print_of(s)
                if len(s) and p not in seen:
                    seen.add(p)
                    g, level, need = projections(s, num, den, cache)
                    held.append((g, np.full(len(g), p, dtype=np.int64), level << 18 | need << 2))
            size += batch.column("text").nbytes
            if size >= CHUNK and held:
                yield from _dealt(*(np.concatenate(x) for x in zip(*held)))
                held, size = [], 0
                seen.clear()
        if held:
            yield from _dealt(*(np.concatenate(x) for x in zip(*held)))

    return docs.select("text").mapInArrow(find, ", ".join(f"{c} long" for c in _DEALT))


def _shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of region, print and tag (descending): each point once of regions that hold two at least, or are known to.

    Nothing is held but the last row: a region may have any number of points.
    """
    last: tuple[int, int, int] | None = None
    given = False  # whether the row that is held has been handed out
    for batch in batches:
        if not batch.num_rows:
            continue
        region, point, tag = (batch.column(c).to_numpy() for c in _DEALT)
        if last is not None:
            region, point, tag = (np.concatenate([[x], y]) for x, y in zip(last, (region, point, tag)))
        first = np.concatenate([[True], region[1:] != region[:-1]])
        fresh = first | np.concatenate([[True], point[1:] != point[:-1]])
        region, point, tag, first = region[fresh], point[fresh], tag[fresh], first[fresh]
        group = np.cumsum(first) - 1
        ok = (np.bincount(group) > 1) | (np.bincount(group, weights=tag & KNOWN) > 0)
        out = ok[group]
        last = (int(region[-1]), int(point[-1]), int(tag[-1]) | KNOWN * int(ok[-1]))
        if given:
            out[0] = False
        given = bool(ok[-1])
        yield pa.RecordBatch.from_arrays([pa.array(region[out]), pa.array(point[out]), pa.array(tag[out] >> 18), pa.array(tag[out] >> 2 & 0xFFFF)], ["region", "print", "level", "need"])
    trim()


def _gathered(rows: DataFrame) -> DataFrame:
    """(region, print, level, need) of dealt rows whose region has two points at least."""
    to = F.when(F.col("tag").bitwiseAND(AWAY) > 0, F.xxhash64("region", "print")).otherwise(F.col("region"))
    rows = rows.repartition(partitions(rows.sparkSession), to).sortWithinPartitions("region", "print", F.col("tag").desc())
    return rows.mapInArrow(_shared, "region long, print long, level long, need long")


def _covered(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(print) of points that can be linked at all: as many of their shingles as a linked set shares must be in another point's set."""

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column("set")
            ends = np.cumsum(pc.list_value_length(whole).to_numpy())
            begin = 0
            while begin < batch.num_rows:  # about CHUNK bytes of sets at once
                base = int(ends[begin - 1]) if begin else 0
                end = max(begin + 1, int(np.searchsorted(ends, base + CHUNK // 8, side="right")))
                some = whole.slice(begin, end - begin)
                e = some.flatten().to_numpy()
                point = np.repeat(batch.column("print").to_numpy()[begin:end], pc.list_value_length(some).to_numpy())
                yield from _dealt(e.view(U64), point, np.zeros(len(e), dtype=np.int64))
                begin = end
        trim()

    elements = sets.mapInArrow(find, ", ".join(f"{c} long" for c in _DEALT))
    times = _gathered(elements).groupBy("print").agg(F.count(F.lit(1)).alias("shared"))
    sizes = sets.select("print", F.size("set").alias("size"))
    return times.join(sizes, "print").where(F.col("shared") * den >= F.col("size") * num).select("print")


def _meeting(members: DataFrame) -> DataFrame:
    """`members` without points of which too few projections meet another point, and regions with one point then."""
    here = members.groupBy("print", "level").agg(F.count("region").alias("equal"), F.max("need").alias("need")).where("equal >= need").select("print", "level")
    left = members.join(here, ["print", "level"], "left_semi")
    full = left.groupBy("region").agg(F.min("print").alias("pivot"), F.max("print").alias("other")).where("pivot < other").select("region")
    out = settle(left.join(full, "region", "left_semi"), "jaccard-meeting")
    forget(members)
    return out


def _cells(members: DataFrame) -> DataFrame:
    """(print, pivot): the cells of each point, named by their most central point.

    A cell lies within one interval of sizes, where its pairs meet, so that cells
    don't grow together by points that are in two intervals.
    """
    nodes = members.select("region", "print", F.xxhash64("print", "level").alias("b"))
    regions = nodes.groupBy("region").agg(F.min("b").alias("a"), F.count(F.lit(1)).alias("times"))
    steps = settle(nodes.join(regions, "region").select("a", "b", "print", "times"), "jaccard-steps")
    degrees = steps.groupBy(F.col("b").alias("node"), "print").agg(F.sum("times").alias("degree"))
    cells = settle(components(steps.select("a", "b")).join(degrees, "node"), "jaccard-degrees")
    # Of equally central points the smallest print.
    pivots = cells.groupBy("root").agg(F.max_by("print", F.struct("degree", F.bitwise_not("print"))).alias("pivot"))
    out = settle(cells.join(pivots, "root").select("print", "pivot").distinct(), "jaccard-cells")
    forget(steps, cells)
    return out


def _sets(docs: DataFrame, n: int) -> DataFrame:
    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 19):
            found = [s.view(np.int64) for s in word_sets(batch.column("text").to_pylist(), n)]
            prints = [print_of(s.view(U64)) for s in found]
            yield pa.RecordBatch.from_arrays([pa.array(prints, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["print", "set"])

    return docs.select("text").mapInArrow(find, "print long, set array<long>")


def _measured(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(pivot, print) to pivot, print, n_pivot, n, difference (the shingles that one of them has) and whether they are linked."""
    x = sets.select(F.col("print").alias("pivot"), F.col("set").alias("x"))
    y = sets.select("print", F.col("set").alias("y"))
    both = pairs.join(y, "print").join(x, "pivot").select("pivot", "print", F.size("x").alias("n_pivot"), F.size("y").alias("n"), F.concat(F.array_except("x", "y"), F.array_except("y", "x")).alias("difference"))
    apart = F.size("difference")
    return both.withColumn("linked", (F.col("n_pivot") + F.col("n") - apart) * den >= (F.col("n_pivot") + F.col("n") + apart) * num)


def _rest(measured: DataFrame, roots: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) between points of a pivot's cell that the pivot doesn't show; roots: (node, root) of those that pivots show.

    With n a point's size, d that of its difference from the pivot, and
    u = (num + den) d - (den - num) n, two points whose differences share o
    elements are linked if 2 (num + den) o >= u + u'. The pivot links the others,
    so one of a pair lies beyond the distance, and then u + u' > 0.
    """
    w, g = num + den, den - num
    c = measured.withColumn("d", F.size("difference").cast("long")).where("d > 0")
    u = F.col("d") * w - F.col("n") * g
    # The least u of a point that this one can be linked with: by the triangle inequality and the sizes, and if this one is near, because the other isn't.
    most = F.floor(F.col("n") * den / num)
    least = F.greatest(u - 2 * g * most, w - g * most, F.when(F.col("linked"), F.col("n_pivot") * g + 1))
    c = c.join(roots, F.col("print") == F.col("node"), "left").withColumn("root", F.coalesce("root", "print"))
    c = settle(c.select("pivot", "print", "difference", u.alias("u"), least.alias("least"), (~F.col("linked")).alias("far"), "root"), "jaccard-differences")

    def up(x: Column) -> Column:
        """How many shared elements it takes."""
        return F.greatest(F.lit(1), F.ceil(x / (2 * w)))

    steps = settle(c.select("pivot", "print", "u", "least", "far", "root", F.explode("difference").alias("e")), "jaccard-elements")
    own = Window.partitionBy("pivot", "print")
    times = steps.groupBy("pivot", "e").agg(F.count(F.lit(1)).alias("times"), F.bool_or("far").alias("any_far")).where("times > 1 and any_far").select("pivot", "e", "times")
    often = steps.join(times, ["pivot", "e"]).withColumn("many", F.count(F.lit(1)).over(own)).withColumn("at", F.row_number().over(own.orderBy("times", "e")))
    # Of `many` elements that any other has, the rarest: a point that shares as many as it takes shares one of them.
    kept = often.where(F.col("at") <= F.col("many") - up(F.col("u") + F.col("least")) + 1).withColumn("v", 2 * w * F.col("many") - F.col("u"))
    kept = settle(kept, "jaccard-prefixes")
    forget(steps)
    far_only = lambda x: F.when(F.col("far"), F.col(x))
    sides = kept.groupBy("pivot", "e").agg(F.max("v").alias("v1"), F.min("u").alias("u1"), F.max(far_only("v")).alias("v2"), F.min(far_only("u")).alias("u2"), F.count(F.lit(1)).alias("here")).where("here > 1")
    # Elements shared are `many` at most on either side, so u <= v' and u' <= v.
    able = F.when(F.col("far"), (F.col("v1") >= F.col("u")) & (F.col("u1") <= F.col("v"))).otherwise((F.col("v2") >= F.col("u")) & (F.col("u2") <= F.col("v")))
    regions = settle(kept.join(sides, ["pivot", "e"]).where(able).drop("v1", "u1", "v2", "u2"), "jaccard-regions")
    forget(kept)

    # A point's turn as a pivot of its region: a hash of it picks PIVOTS of the region's points in the first, PIVOTS times as many in each further one.
    place = F.pmod(F.xxhash64("print", "e"), F.lit(1 << 30)) * F.col("here") / F.lit(1 << 30)
    turn = F.greatest(F.lit(0), F.floor(F.log(F.greatest(place, F.lit(1.0))) / math.log(PIVOTS))).cast("int")
    held = settle(regions.withColumn("turn", F.when(F.col("far"), turn)).drop("least", "times", "here"), "jaccard-turns")
    forget(regions)
    last = held.agg(F.max("turn")).first()[0]
    links = [c.select(F.col("pivot").alias("a"), F.col("print").alias("b")).where("false")]
    for t in range(0 if last is None else last + 1):
        of = ("print", "root", "u", "v", "many", "at")
        x = held.where(F.col("turn") == t).select(F.col("pivot").alias("p"), F.col("e").alias("f"), *(F.col(f).alias(f"{f}_a") for f in of))
        y = held.where(F.col("turn").isNull() | (F.col("turn") >= t)).select("pivot", "e", F.col("turn").alias("turn_b"), *(F.col(f).alias(f"{f}_b") for f in of))
        window = (F.col("u_a") <= F.col("v_b")) & (F.col("u_b") <= F.col("v_a"))
        takes = up(F.col("u_a") + F.col("u_b"))
        window &= (F.col("at_a") <= F.col("many_a") - takes + 1) & (F.col("at_b") <= F.col("many_b") - takes + 1)
        once = F.col("turn_b").isNull() | (F.col("turn_b") > t) | (F.col("print_a") < F.col("print_b"))
        both = x.join(y, (F.col("p") == F.col("pivot")) & (F.col("f") == F.col("e")) & (F.col("root_a") != F.col("root_b")) & once & window)
        pairs = both.select("pivot", F.col("print_a").alias("a"), F.col("print_b").alias("b"), "root_a", "root_b", (F.col("u_a") + F.col("u_b")).alias("uu")).distinct()
        one = c.select("pivot", F.col("print").alias("a"), F.col("difference").alias("da"))
        two = c.select("pivot", F.col("print").alias("b"), F.col("difference").alias("db"))
        found = pairs.join(one, ["pivot", "a"]).join(two, ["pivot", "b"]).where(2 * w * F.size(F.array_intersect("da", "db")) >= F.col("uu"))
        found = settle(found.select("a", "b", "root_a", "root_b"), "jaccard-links")
        links.append(found.select("a", "b"))
        if t < last:
            merged = components(found.select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))).select("node", F.col("root").alias("new"))
            before = held
            held = settle(held.join(merged, F.col("root") == F.col("node"), "left").withColumn("root", F.coalesce("new", "root")).drop("node", "new"), "jaccard-turns")
            forget(before)
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


def join(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """All documents' points (doc_id, text_hash, size, print) and the components of their links (node, root) by print.

    Points that have no link to another set aren't in the second.
    """
    points = settle(_points(docs, n), "jaccard-points")
    members = settle(_gathered(_regions(docs, n, num, den)).distinct(), "jaccard-members")
    release(docs.sparkSession)
    members = _meeting(members)
    # Of each point in play one document.
    one = points.where("size > 0").groupBy("print").agg(F.min(F.struct("doc_id", "text_hash")).alias("first")).join(members.select("print").distinct(), "print", "left_semi").select(F.col("first.doc_id").alias("__doc"), F.col("first.text_hash").alias("__hash"))
    one = settle(one, "jaccard-one")
    these = docs.join(checked_broadcast(one), docs["doc_id"].eqNullSafe(F.col("__doc")) & (text_hash(docs) == F.col("__hash")), "left_semi")
    sets = settle(_sets(these, n).dropDuplicates(["print"]), "jaccard-sets")
    forget(one)
    covered = settle(_covered(sets, num, den), "jaccard-covered")
    release(docs.sparkSession)
    before, members = members, settle(members.join(covered, "print", "left_semi"), "jaccard-members")
    forget(before)
    members = _meeting(members)
    cells = _cells(members)
    forget(members, covered)

    first = settle(_measured(cells.where("print <> pivot"), sets, num, den), "jaccard-first")
    forget(sets)
    open_ = settle(first.where("not linked").select("pivot").distinct(), "jaccard-open")
    links = first.where("linked").select(F.col("pivot").alias("a"), F.col("print").alias("b"))
    rest = _rest(first.join(checked_broadcast(open_), "pivot", "left_semi"), components(links), num, den)
    roots = components(links.unionByName(rest))
    release(docs.sparkSession)
    return points, roots


def _named(points: DataFrame, roots: DataFrame, least: Column) -> DataFrame:
    """(print, least): what of its class's documents is the least, for every point with words."""
    sets = points.where("size > 0").groupBy("print").agg(F.min(least).alias("least"))
    named = sets.join(roots.select(F.col("node").alias("print"), "root"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    named = settle(named, "jaccard-named")
    best = named.groupBy("root").agg(F.min("least").alias("least"))
    out = settle(named.drop("least").join(best, "root").select("print", "least"), "jaccard-classes")
    forget(named)
    return out


def classes(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that links lead to."""
    points, roots = join(docs, n, num, den)
    named = _named(points, roots, F.col("doc_id")).withColumnRenamed("least", "component_id")
    out = points.join(checked_broadcast(named), "print", "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """`docs`, every column, without the documents that aren't the first of their class.

    The first is that with the smallest identifier (null before all), of several
    texts under it the one with the smallest hash. Of rows equal in identifier and
    text one stays. Documents without words all stay.
    """
    points, roots = join(docs, n, num, den)
    first = F.struct("doc_id", "text_hash")
    named = _named(points, roots, first)
    kept = points.join(checked_broadcast(named), "print", "left").where((F.col("size") == 0) | (first == F.col("least")))
    kept = settle(kept.select(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash")), "jaccard-kept")
    keep = settle(kept.distinct(), "jaccard-keep")
    out = docs.join(checked_broadcast(keep), docs["doc_id"].eqNullSafe(F.col("__doc")) & (text_hash(docs) == F.col("__hash")), "left_semi")
    # Only where rows repeat, for this shuffles whole rows.
    if kept.count() == keep.count():
        return out
    names = out.columns
    return out.withColumn("__hash", text_hash(out)).dropDuplicates(["doc_id", "__hash"]).select(*(f"`{c}`" for c in names))
