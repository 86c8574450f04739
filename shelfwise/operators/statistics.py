"""Hierarchy statistics: named parts of a tree with how many nodes and queried entities lie below each node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.constraints import Constraint, QueryError
from shelfwise.operators import filters, hierarchy
from shelfwise.operators.context import Context

#: Bytes of input whose entities one task counts, and the pairs of a tree's closure that are broadcast at most.
TASK_BYTES, BROADCAST_PAIRS = 4 << 20, 2_000_000


def _parts(df: DataFrame) -> int:
    """In how many parts to count, by the size of what is read: they grow in number, not in size, and as a number that is asked for they aren't coalesced."""
    leaves, spark = df._jdf.queryExecution().optimizedPlan().collectLeaves(), df.sparkSession
    leaves = [leaves.apply(i) for i in range(leaves.size())]
    # Rows that are no files have the size that their plan was guessed to have, or none.
    sizes = [0 if leaf.getClass().getSimpleName() == "LogicalRDD" else int(leaf.stats().sizeInBytes()) for leaf in leaves]
    known = [size for size in sizes if 0 < size < 2**50]
    least = int(spark.conf.get("spark.sql.shuffle.partitions")) if len(known) < len(sizes) else spark.sparkContext.defaultParallelism
    return max(least, -(-sum(known) // TASK_BYTES))


def _counts(owned: DataFrame, closure: DataFrame) -> DataFrame:
    """(node, queried_entity_count): how many entities each node and those below it have.

    A row of `owned` becomes one for each node above it. All of an entity's come into
    one part before they are told apart, so no task holds a partial result of many
    entities, and nothing but counts is shuffled after it.
    """
    above = closure.groupBy("node").agg(F.collect_set("ancestor").alias("__above"))
    parts = _parts(owned)
    if closure.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS:
        rows = owned.repartition(parts, "pk").join(F.broadcast(above), "node")
    else:
        rows = owned.join(above, "node").repartition(parts, "pk")
    return rows.select("pk", F.explode("__above").alias("node")).groupBy("node").agg(F.count_distinct("pk").alias("queried_entity_count"))


def _stop(ctx: Context, output: Constraint, below: DataFrame, closure: DataFrame) -> DataFrame:
    """Rows (node, distance, ...) within stopAt; the node that stops is given, its children aren't."""
    stop = output.child("stopAt")
    if not stop:
        return below
    s = stop.children[0]
    if s.name == "distance":
        return below.where(F.col("distance") <= s.values[0])
    if s.name == "level":
        return below.where(F.col("level") <= s.values[0])
    hits = filters.entities(ctx, s.child("filterBy").children).select(F.col("pk").alias("ancestor"))
    cut = closure.where("distance > 0").join(hits, "ancestor", "left_semi").select(F.col("node")).distinct()
    return below.join(cut, "node", "left_anti")


def compute(ctx: Context, output: Constraint, pivot: DataFrame | None, owned: DataFrame, within: DataFrame | None, keep_empty: bool, rules_nodes: DataFrame | None = None) -> DataFrame:
    """output, node, parent, level, children_count, queried_entity_count, for one of fromRoot, fromNode, children, parents, siblings.

    ctx: on the tree's collection; pivot: (node) of the filter's hierarchyWithin;
    owned: (pk, node), the queried entities and the nodes that they belong to, repeated or not;
    within: (node) to which the filter's having and excluding restrict the tree.
    A node's entities are counted once each however many nodes below have them.
    Nodes without any are left out unless keep_empty.
    """
    tree = hierarchy.nodes(ctx)
    if within is not None:
        tree = tree.join(within, "node", "left_semi")
        tree = tree.join(tree.select(F.col("node").alias("__p")), F.col("parent") == F.col("__p"), "left").withColumn("parent", F.col("__p")).drop("__p")
    start = None
    if output.name == "fromNode":
        start = filters.entities(ctx, output.child("node").child("filterBy").children).select(F.col("pk").alias("node"))
    elif output.name == "children":
        start = pivot
    # Of parts of a tree only their nodes are opened; parents and siblings of a node, and the whole tree, count what lies below the roots.
    closure = hierarchy.closure(tree) if start is None else hierarchy.below(tree, start)
    entities = _counts(owned, closure)
    levels = closure.where("distance = 0").select("node", "level").join(tree, "node")
    every = levels.join(entities, "node", "left").fillna(0, ["queried_entity_count"])
    shown = every if keep_empty else every.where("queried_entity_count > 0")
    children = closure.where("distance > 0").join(shown.select("node"), "node", "left_semi").groupBy(F.col("ancestor").alias("node")).agg(F.count("node").alias("children_count"))
    shown = shown.join(children, "node", "left").fillna(0, ["children_count"])

    name = output.values[0]
    if output.name == "fromRoot":
        base = closure.where("distance = 0").select("node", (F.col("level") - 1).alias("distance"), "level")
    elif output.name == "fromNode":
        base = closure.join(start.select(F.col("node").alias("ancestor")), "ancestor", "left_semi").select("node", "distance", "level")
    else:
        if pivot is None:
            raise QueryError(f"{output.name} needs a hierarchyWithin in the filter")
        here = pivot.select(F.col("node").alias("pivot"))
        if output.name == "children":
            base = closure.join(here, F.col("ancestor") == F.col("pivot"), "left_semi").select("node", "distance", "level")
        elif output.name == "siblings":
            parents = tree.join(here, F.col("node") == F.col("pivot"), "left_semi").select(F.coalesce("parent", F.lit(-(2**31))).alias("__p")).distinct()
            beside = tree.withColumn("__p", F.coalesce("parent", F.lit(-(2**31)))).join(parents, "__p", "left_semi").join(here, F.col("node") == F.col("pivot"), "left_anti").select(F.col("node").alias("ancestor"))
            # Siblings stand beside the pivot; what is below them only as far as it is asked for.
            base = closure.join(beside, "ancestor", "left_semi").select("node", "distance", "level")
            if not output.child("stopAt"):
                base = base.where("distance = 0")
        else:
            up = closure.join(here, F.col("node") == F.col("pivot"), "left_semi").select(F.col("ancestor"), "distance")
            base = up.join(levels.select(F.col("node").alias("ancestor"), "level"), "ancestor").select(F.col("ancestor").alias("node"), "distance", "level")
            if output.child("siblings") or "siblings" in output.values:
                same = levels.join(base.select(F.col("node").alias("__n")).join(tree, F.col("__n") == F.col("node")).select(F.coalesce("parent", F.lit(-(2**31))).alias("__p")).distinct(), F.coalesce("parent", F.lit(-(2**31))) == F.col("__p"), "left_semi")
                base = base.unionByName(same.select("node", F.lit(0).alias("distance"), "level").join(base.select("node"), "node", "left_anti"))
    base = _stop(ctx, output, base, closure)
    return base.select("node").distinct().join(shown, "node").select(F.lit(name).alias("output"), "node", "parent", "level", "children_count", "queried_entity_count")
