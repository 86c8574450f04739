"""Trees: nodes reached from the top, closures, and hierarchy predicates.

A tree is expanded level by level from its start nodes, however deep; each step is
one join on the parent, whose result is checkpointed, so the cost is that of the
nodes reached, and a path of the primary keys from the start travels with each
node. Nodes whose parent is missing (or lies on a cycle) are never reached. What
lies above a few nodes is found the other way round, from them to the roots.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.constraints import Constraint, QueryError
from shelfwise.operators.context import Context
from shelfwise.scratch import checkpointed


def nodes(ctx: Context) -> DataFrame:
    """(node, parent) of the first searched scope that has a tree, LIVE first."""
    if not ctx.collection.hierarchical:
        raise QueryError(f"collection {ctx.collection.name} is not hierarchical")
    df = ctx.collection.frame
    if "scope" in df.columns:
        df = df.where(F.col("scope") == sorted(ctx.scopes, key=lambda s: s != "LIVE")[0])
    return df.select(F.col("pk").alias("node"), F.col("parent_pk").alias("parent"))


def expand(tree: DataFrame, start: DataFrame, allowed: DataFrame | None = None, deepest: int | None = None, stop: DataFrame | None = None) -> DataFrame:
    """(root, node, distance, path) of everything below each start node (node), itself included.

    allowed: (node) outside which a branch ends before the node; stop: (node) at
    which it ends after the node; deepest: the largest distance.
    """
    tree = tree.select("node", "parent")
    edges = tree.where(F.col("parent").isNotNull())
    if allowed is not None:
        edges = edges.join(allowed.select("node"), "node", "left_semi")
    now = start.select("node").distinct()
    if allowed is not None:
        now = now.join(allowed.select("node"), "node", "left_semi")
    now = now.select(F.col("node").alias("root"), "node", F.lit(0).alias("distance"), F.array("node").alias("path"))
    found, level = now, 0
    while deepest is None or level < deepest:
        from_ = now if stop is None else now.join(stop.select(F.col("node")), "node", "left_anti")
        up = from_.select("root", F.col("node").alias("parent"), "path")
        now = edges.join(up, "parent").where(~F.array_contains("path", F.col("node"))).select("root", "node", F.lit(level + 1).alias("distance"), F.concat("path", F.array("node")).alias("path"))
        now = checkpointed(now)
        level += 1
        if now.isEmpty():
            break
        found = found.unionByName(now)
    return found


def roots(tree: DataFrame) -> DataFrame:
    return tree.where(F.col("parent").isNull()).select("node")


def closure(tree: DataFrame) -> DataFrame:
    """(ancestor, node, distance, level, path): every reachable node under each node above it and itself; roots have level 1."""
    paths = expand(tree, roots(tree)).select("node", "path")
    return paths.select(F.posexplode("path").alias("i", "ancestor"), "node", "path").select("ancestor", "node", (F.size("path") - 1 - F.col("i")).alias("distance"), F.size("path").alias("level"), "path")


def below(tree: DataFrame, start: DataFrame) -> DataFrame:
    """The closure of the subtrees of some nodes (node) alone: ancestor, node, distance, level."""
    tops = ascend(tree, start).select(F.col("node").alias("root"), F.col("level").alias("top")).unionByName(start.join(roots(tree), "node", "left_semi").select(F.col("node").alias("root"), F.lit(1).alias("top"))).distinct()
    paths = expand(tree, start).join(tops, "root").select("node", "path", (F.col("top") + F.size("path") - 1).alias("level"))
    return paths.select(F.posexplode("path").alias("i", "ancestor"), "node", "path", "level").select("ancestor", "node", (F.size("path") - 1 - F.col("i")).alias("distance"), "level").distinct()


def ascend(tree: DataFrame, start: DataFrame) -> DataFrame:
    """(node, ancestor, distance, level): what lies above each start node (node) that a root can be reached from, the node's own level with it."""
    edges = tree.select(F.col("node").alias("__n"), F.col("parent").alias("__p"))
    first = start.select("node").distinct().join(edges, F.col("node") == F.col("__n"))
    now = checkpointed(first.select("node", F.col("__p").alias("ancestor"), F.array("node").alias("path")))
    found, distance = None, 0
    tops = now.where("ancestor is null").select("node", F.lit(1).alias("level"))
    now = now.where("ancestor is not null")
    while not now.isEmpty():
        distance += 1
        here = now.select("node", "ancestor", F.lit(distance).alias("distance"))
        found = here if found is None else found.unionByName(here)
        up = now.join(edges, F.col("ancestor") == F.col("__n")).select("node", F.col("__p").alias("ancestor"), F.concat("path", F.array(F.col("ancestor"))).alias("path"))
        up = checkpointed(up.where("ancestor is null or not array_contains(path, ancestor)"))
        tops = tops.unionByName(up.where("ancestor is null").select("node", F.lit(distance + 1).alias("level")))
        now = up.where("ancestor is not null")
    if found is None:
        found = start.select("node", F.lit(0).alias("ancestor"), F.lit(0).alias("distance")).where("false")
    return found.join(tops, "node")


def node_set(ctx: Context, spec: list[Constraint], start: DataFrame | None, matching: Callable[[Context, tuple[Constraint, ...]], DataFrame]) -> DataFrame:
    """(node, distance) in the subtrees of `start` (the roots if None) as the specification allows.

    having: a node must match and so must all above it; excluding: none may;
    anyHaving: a node's own subtree must hold a match; excludingRoot: the start
    itself is left out. At most one of each counts. `directRelation` is up to the
    caller, for it means other things in other places.
    """
    tree = nodes(ctx)
    by = {}
    for c in spec:
        by.setdefault(c.name, c)
    allowed = None
    if "having" in by:
        allowed = matching(ctx, by["having"].children).select(F.col("pk").alias("node"))
    if "excluding" in by:
        bad = matching(ctx, by["excluding"].children).select(F.col("pk").alias("node"))
        allowed = (tree.select("node") if allowed is None else allowed).join(bad, "node", "left_anti")
    out = expand(tree, roots(tree) if start is None else start, allowed).groupBy("node").agg(F.min("distance").alias("distance"))
    if "anyHaving" in by:
        hits = matching(ctx, by["anyHaving"].children).select(F.col("pk").alias("node"))
        # Upwards from the matches, so that nothing else of the tree is opened.
        hits = hits.join(tree.select("node"), "node", "left_semi")
        above = ascend(tree, hits)
        reached = above.select("node").unionByName(hits.join(tree.where("parent is null"), "node", "left_semi"))
        keep = above.select(F.col("ancestor").alias("node")).unionByName(reached).distinct()
        out = out.join(keep, "node", "left_semi")
    if "excludingRoot" in by and start is not None:
        out = out.where("distance > 0")
    return out


def sorted_paths(tree: DataFrame, order: Column | None = None, mode: str = "DEPTH_FIRST") -> DataFrame:
    """(node, position): the order in which a traversal meets the nodes; `order` ranks the nodes of the tree, else their key does."""
    tree = tree.withColumn("__key", order if order is not None else F.struct("node"))
    ranked = tree.withColumn("__rank", F.struct(F.col("__key").alias("k"), F.col("node").alias("n")))
    paths = expand(tree, roots(tree)).select("node", F.posexplode("path").alias("i", "step"))
    steps = paths.join(ranked.select(F.col("node").alias("step"), "__rank"), "step")
    path = steps.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "__rank"))), lambda x: x["__rank"]).alias("p"))
    return path.select("node", (F.struct("p") if mode == "DEPTH_FIRST" else F.struct(F.size("p").alias("s"), "p")).alias("position"))
