"""Best-fit packing of token sequences by a configuration linear program.

Pieces of documents are counted by length; the histogram (`limit` lengths at
most, whatever the corpus) is all that the solver sees. A configuration is a
multiset of lengths that fits in a sequence. The program - use configurations as
few times as can be so that every length is covered - is solved by
multiplicative weights: lengths that are covered less weigh more, an unbounded
knapsack over all capacities (dynamic programming) prices configurations, and
near-best ones enter by small steps that cover nothing twice. The fractional
solution is rounded down, what is left goes through the same again, and the rest
is packed best-fit decreasing, into open space too. Which piece of a length takes which place
of a configuration is decided by its rank, so pieces are only numbered within
their length and never gathered: those of a length in parts of about PART pieces,
which a hash of the piece tells apart.

The plan is broadcast. It has one configuration at most for each length, round and
pass, and best fit adds few, so its size is bounded by `limit` and not by the
corpus: some 50,000 configurations of 63 different lengths at most (the sum of
which is `limit`).

Defined cases: a null or empty text is its end id alone; repeated rows are
packed each on their own; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import checked_broadcast, settle, slices
from shelfwise.llm.tokens import encoder

LIMIT = 2048
ROUNDS = 12
#: Price, in sequences, by which a configuration that enters may fall short of the best.
SLACK = 0.0003
#: How fast the weight of a length falls with its coverage. The slow rate suits lengths that fill sequences whole; where they can't, prices must part from volume, so the fast one is tried too.
RATES = (0.1, 5.0)
#: For each pass: the share of the scarcest length that a step uses, and the least step. What passes leave has every length in much the same part, which suits best fit.
PASSES = ((0.5, 1e-3), (0.5, 1e-3))
#: Pieces of one length that are numbered in one task.
PART = 20_000


def cut(docs: DataFrame, tokenizer: str, end_id: int, limit: int = LIMIT) -> DataFrame:
    """Pieces of `limit` ids at most: doc_id, piece, start, length, ids_crc32, ids (little-endian)."""

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = encoder(tokenizer), np.array([end_id], dtype="<u4")
        for batch in slices(batches, "text", 2 << 20):
            rows, of, piece, start, length, crc = batch.column("doc_id"), [], [], [], [], []
            for i, ids in enumerate(coder.encode(batch.column("text"))):
                ids = np.concatenate([ids, end], dtype="<u4")
                for k, at in enumerate(range(0, len(ids), limit)):
                    part = ids[at : at + limit]
                    of.append(i), piece.append(k), start.append(at), length.append(len(part)), crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([rows.take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(pieces, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def knapsack(lengths: np.ndarray, prices: np.ndarray, limit: int) -> np.ndarray:
    """For every capacity to `limit`, the best total price; lengths ascend."""
    best = np.zeros(limit + 1)
    upto = np.searchsorted(lengths, np.arange(limit + 1), side="right")
    for c in range(1, limit + 1):
        k = upto[c]
        best[c] = max(best[c - 1], (best[c - lengths[:k]] + prices[:k]).max()) if k else best[c - 1]
    return best


def fractional(need: dict[int, int], limit: int, share: float, least: float, rounds: int = ROUNDS, slack: float = SLACK, rate: float = RATES[0]) -> dict[tuple[int, ...], float]:
    """Configurations and how often to use them, such that no length is used more than it is needed.

    Weights start where the price of a length is its share of a sequence, the
    dual solution of the volume bound, and fall by a factor for every unit of
    coverage. Each round prices all capacities once; then every length, the least
    covered first, enters with a configuration whose price is within `slack` of
    the best, built by taking the least covered of the lengths that keep it so.
    A step uses `share` of what the scarcest length of the configuration still
    needs, `least` at least.
    """
    lengths = np.array(sorted(need), dtype=np.int64)
    n = np.array([need[x] for x in lengths.tolist()], dtype=np.float64)
    left, use = n.copy(), {}
    for _ in range(rounds):
        alive = np.flatnonzero(left >= least)
        if not len(alive):
            break
        x = lengths[alive]
        covered = 1 - left[alive] / n[alive]
        prices = x / limit * np.exp(-rate * (covered - covered.min()))
        best = knapsack(x, prices, limit)
        upto = np.searchsorted(x, np.arange(limit + 1), side="right")
        entered = False
        for i in np.argsort(covered, kind="stable").tolist():
            config, room, lost = [i], limit - int(x[i]), best[limit] * (1 + 1e-12) - prices[i] - best[limit - x[i]]
            while room >= x[0] and lost <= slack:
                k = upto[room]
                loss = best[room] - prices[:k] - best[room - x[:k]]
                fits = np.flatnonzero(loss <= slack - lost)
                if not len(fits):
                    room -= 1  # an empty place costs nothing but what the smaller room is worth less
                    lost += best[room + 1] - best[room]
                    continue
                j = int(fits[covered[fits].argmin()])
                lost += loss[j]
                room -= int(x[j])
                config.append(j)
            times = Counter(config)
            most = min(left[alive[j]] / k for j, k in times.items())
            step = min(most, max(share * most, least))
            if lost > slack or most < least:
                continue
            name = tuple(sorted((int(x[j]) for j in config), reverse=True))
            use[name] = use.get(name, 0.0) + step
            entered = True
            for j, k in times.items():
                left[alive[j]] -= step * k
                covered[j] = 1 - left[alive[j]] / n[alive[j]]
        if not entered:
            break
    return use


def best_fit(need: Counter, limit: int, open_: list[list] | None = None) -> list[tuple[int, tuple[int, ...]]]:
    """Best-fit decreasing over counts: (times, configuration). Equal sequences are held once, with their number."""
    by_room: dict[int, list[list]] = {}
    rooms = np.zeros(limit + 1, dtype=np.int64)  # groups with so much room
    for times, config in open_ or ():
        room = limit - sum(config)
        by_room.setdefault(room, []).append([times, config])
        rooms[room] += 1
    for x in sorted(need, reverse=True):
        left = need[x]
        while left > 0:
            fits = np.flatnonzero(rooms[x:])
            if not len(fits):
                # New sequences, as many of this length in each as fit.
                each = limit // x
                full, rest = divmod(left, each)
                for times, k in ((full, each), (int(rest > 0), rest)):
                    if times:
                        by_room.setdefault(limit - k * x, []).append([times, (x,) * k])
                        rooms[limit - k * x] += 1
                break
            room = x + int(fits[0])
            group = by_room[room].pop()
            rooms[room] -= 1
            each = room // x
            take = min(group[0], left // each)
            k = each if take else left
            take = max(take, 1)
            if group[0] > take:
                by_room[room].append([group[0] - take, group[1]])
                rooms[room] += 1
            by_room.setdefault(room - k * x, []).append([take, group[1] + (x,) * k])
            rooms[room - k * x] += 1
            left -= take * k
    return [(times, config) for groups in by_room.values() for times, config in groups]


def solve(histogram: dict[int, int], limit: int = LIMIT) -> list[tuple[int, tuple[int, ...]]]:
    """(times, configuration) such that every length is used exactly as often as the histogram says.

    Of the solutions at the two rates the one with fewer sequences; the second is
    left out when the first needs no more than the volume does.
    """
    volume = -(-sum(x * n for x, n in histogram.items()) // limit)
    best, fewest = [], math.inf
    for rate in RATES:
        plan = _solved(histogram, limit, rate)
        if (times := sum(t for t, _ in plan)) < fewest:
            best, fewest = plan, times
        if fewest <= volume:
            break
    return best


def _solved(histogram: dict[int, int], limit: int, rate: float) -> list[tuple[int, tuple[int, ...]]]:
    need = Counter({x: n for x, n in histogram.items() if n > 0})
    plan: Counter = Counter()
    if need.get(limit):
        plan[(limit,)] = need.pop(limit)
    for share, least in PASSES:
        if not need:
            break
        for config, x in fractional(need, limit, share, least, rate=rate).items():
            times = int(x + 1e-9)
            if times:
                plan[config] += times
                for length, k in Counter(config).items():
                    need[length] -= times * k
        need = +need
    return [(t, c) for t, c in best_fit(need, limit, [[t, c] for c, t in plan.items()]) if t]


def places(plan: list[tuple[int, tuple[int, ...]]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, pieces of this length in each, offset of the first), by rank."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    used: Counter = Counter()
    sequence = 0
    for times, config in plan:
        at = 0
        for x, k in sorted(Counter(config).items(), reverse=True):
            out.setdefault(x, []).append((used[x], sequence, k, at))
            used[x] += times * k
            at += x * k
        sequence += times
    return {x: np.array(rows, dtype=np.int64) for x, rows in out.items()}


def pack(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """`pieces` (with length) and the place of each: sequence_id, offset."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # `limit` rows at most
    shared = spark.sparkContext.broadcast(places(solve(histogram, limit)))
    # How many parts a length has: of this a literal of `limit` entries at most is made.
    many = {x: -(-n // PART) for x, n in histogram.items() if n > PART}
    parts = F.coalesce(F.create_map(*(F.lit(v) for x in many.items() for v in x))[F.col("length")], F.lit(1)) if many else F.lit(1)
    rows = pieces.withColumn("__salt", F.pmod(F.xxhash64(*(f"`{c}`" for c in pieces.columns)), parts))
    sums = settle(rows.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("n")), "pack-counts")
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sums.select("length", "__salt", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("__first"))
    order = Window.partitionBy("length", "__salt").orderBy(*(f"`{c}`" for c in pieces.columns))
    ranked = rows.withColumn("__rank", F.row_number().over(order)).join(checked_broadcast(firsts), ["length", "__salt"])
    ranked = ranked.withColumn("__rank", F.col("__rank") + F.col("__first") - 1)
    names = pieces.columns

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(), batch.column("__rank").to_numpy()
            sequence, offset = np.empty(len(ranks), dtype=np.int64), np.empty(len(ranks), dtype=np.int64)
            for x in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == x)
                t = shared.value[x]
                row = t[np.searchsorted(t[:, 0], ranks[at], side="right") - 1]
                nth = ranks[at] - row[:, 0]
                sequence[at] = row[:, 1] + nth // row[:, 2]
                offset[at] = row[:, 3] + nth % row[:, 2] * x
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.select(*(f"`{c}`" for c in names), "__rank").mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, limit: int = LIMIT) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(settle(cut(docs, tokenizer, end_id, limit), "pack-pieces"), limit)
