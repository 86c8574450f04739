"""Connected components of a table of links, on the executors."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import settle

#: Links that one task may take: 16 MB of them.
ONE_TASK = 1_000_000


def components(links: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(a, b) links of longs to (node, root): root is the smallest node that can be reached.

    Links that are counted to be `one_task` at most go through one task; more of
    them through alternating star operations. Both give the same.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = settle(edges, "cc")
    if edges.count() <= one_task:
        return settle(edges.coalesce(1).mapInArrow(_together, "node long, root long"), "cc")
    return _by_stars(edges)


def _together(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labels that fall to the smallest neighbour's, and then to their label's label, until none falls."""
    parts = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    u, v = (np.concatenate(x) for x in zip(*parts))
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        np.minimum.at(label, before[a], before[b])
        np.minimum.at(label, before[b], before[a])
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            break
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "root"])


def _by_stars(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours, then its smaller ones, to the smallest it knows, until nothing changes.

    The links of a round are no more than before, whatever a node's degree, the
    sums are by map-side minimum, and the rounds grow with the logarithm of the
    longest path. Each round is a table in the shared folder.
    """
    before = None
    while True:
        # Large star: larger neighbours go to the smallest neighbour, or to the node itself.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = settle(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc")
        # Small star: the smaller neighbours and the node itself go to the smallest.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("u", "v", "m")
        moved = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = settle(small.select("u", F.col("m").alias("v")).unionByName(moved).distinct(), "cc")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
