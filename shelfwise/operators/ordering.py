"""Ordering: a chain of fallbacks, then the primary key.

The second clause orders only entities that have no value for the first, and so
on; a tie within a clause goes to the primary key at once. Entities without a
value come last whatever the direction.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.constraints import Constraint, QueryError
from shelfwise.operators import filters, hierarchy, prices
from shelfwise.operators.context import Context, localized

#: (keys of one clause as (column, descending, nulls first), and whether an entity has a value for the clause)
Clause = tuple[list[tuple[Column, bool, bool]], Column]


def _set_position(column: Column, values: Iterable) -> Column:
    values = list(values)
    return F.nullif(F.coalesce(F.array_position(F.array(*(F.lit(v) for v in values)), column), F.lit(0)), F.lit(0)) if values else F.lit(None).cast("bigint")


def _collated(ctx: Context, name: str, column: Column) -> Column:
    """Localized strings sort by the rules of the query's locale."""
    a = ctx.collection.attribute(name)
    return F.collate(column, ctx.locale.split("-")[0]) if a.localized and a.type == "string" and ctx.locale else column


def _directed(c: Constraint, at: int) -> bool:
    direction = c.values[at] if len(c.values) > at else "ASC"
    if direction not in ("ASC", "DESC"):
        raise QueryError(f"{c.name} knows ASC and DESC, not {direction}")
    return direction == "DESC"


class Orderer:
    """Adds sort keys to a frame of entities, one clause after the other."""

    def __init__(self, ctx: Context, df: DataFrame, filter_by: Constraint | None = None, prefix: str = "__o"):
        self.ctx, self.df, self.filter_by, self.prefix, self.n = ctx, df, filter_by, prefix, 0

    def _named(self, column: Column) -> Column:
        self.n += 1
        self.df = self.df.withColumn(f"{self.prefix}{self.n}", column)
        return F.col(f"{self.prefix}{self.n}")

    def _joined(self, keyed: DataFrame, column: str) -> Column:
        """A value that another frame has by pk."""
        self.n += 1
        name = f"{self.prefix}{self.n}"
        self.df = self.df.join(keyed.select(F.col("pk").alias("__pk"), F.col(column).alias(name)), F.col("pk") == F.col("__pk"), "left").drop("__pk")
        return F.col(name)

    def _filter_values(self, name: str, attribute: str | None = None) -> tuple:
        found = [c for c in (self.filter_by.walk() if self.filter_by else ()) if c.name == name and (attribute is None or c.values[0] == attribute)]
        if len(found) != 1:
            raise QueryError(f"the order needs one {name} in the filter, and has {len(found)}")
        return found[0].values if attribute is None else found[0].values[1:]

    def clause(self, c: Constraint) -> Clause:
        ctx, v = self.ctx, c.values
        if c.name == "attributeNatural":
            if v[0] in ctx.collection.compounds:
                keys = []
                present = F.lit(False)
                turned = _directed(c, 1)
                for name, direction, nulls in ctx.collection.compounds[v[0]]:
                    column = ctx.column(name)
                    keys.append((_collated(ctx, name, column), (direction == "DESC") != turned, (nulls == "FIRST") != turned))
                    present = present | column.isNotNull()
                return keys, present
            a = ctx.collection.attribute(v[0])
            if not a.sortable:
                raise QueryError(f"attribute {v[0]} is not sortable")
            column = ctx.column(v[0])
            if a.range:  # from, then to; open bounds are the least and the greatest
                down = _directed(c, 1)
                return [(F.when(column.isNotNull(), F.struct(column["from"].isNotNull(), column["from"], column["to"].isNull(), column["to"])), down, False)], column.isNotNull()
            return [(_collated(ctx, v[0], column), _directed(c, 1), False)], column.isNotNull()
        if c.name in ("attributeSetExact", "attributeSetInFilter"):
            values = v[1:] if c.name == "attributeSetExact" else self._filter_values("attributeInSet", v[0])
            position = _set_position(ctx.column(v[0]), values)
            return [(position, False, False)], position.isNotNull()
        if c.name == "entityPrimaryKeyNatural":
            return [(F.col("pk"), _directed(c, 0), False)], F.lit(True)
        if c.name in ("entityPrimaryKeyExact", "entityPrimaryKeyInFilter"):
            position = _set_position(F.col("pk"), v if c.name == "entityPrimaryKeyExact" else self._filter_values("entityPrimaryKeyInSet"))
            return [(position, False, False)], position.isNotNull()
        if c.name == "priceNatural":
            # The price that the query's own amount filter leaves; the filter may have brought it along.
            if "__amount" in self.df.columns:
                return [(F.col("__amount"), _directed(c, 0), False)], F.col("__amount").isNotNull()
            bounds = next((x.values[:2] for x in (self.filter_by.walk() if self.filter_by else ()) if x.name == "priceBetween"), (None, None))
            amount = self._joined(prices.for_sale(ctx, *bounds), "amount")
            return [(amount, _directed(c, 0), False)], amount.isNotNull()
        if c.name == "priceDiscount":
            directions = [x for x in v[:1] if x in ("ASC", "DESC")]
            lists = v[len(directions) :]
            value = self._joined(prices.discount(ctx, lists), "discount")
            return [(value, directions != ["ASC"], False)], value.isNotNull()
        if c.name == "random":
            # One permutation for a seed, so that pages are disjoint; without a seed, one for each query.
            seed = v[0] if v else int(ctx.now.timestamp() * 1e6)
            return [(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("pk"))), False, False)], F.lit(True)
        if c.name == "referenceProperty":
            key = self._joined(reference_keys(ctx, c), "key")
            down = any(_directed(x, 1) for x in c.children if x.name == "attributeNatural" and not c.child("traverseByEntityProperty"))
            return [(key, down, False)], key.isNotNull()
        if c.name == "inScope":
            inner, present = self.clause(c.children[0])
            here = F.col("scope") == v[0]
            return [(F.when(here, k), d, n) for k, d, n in inner], here & present
        if c.name == "segments":
            position = self._joined(segments(ctx, self.df, c, self.filter_by), "position")
            return [(position, False, False)], position.isNotNull()
        raise QueryError(f"{c.name} can't be used in orderBy")

    def keys(self, clauses: Iterable[Constraint]) -> list[Column]:
        """Sort keys of the whole chain, ending in the primary key."""
        out, open_ = [], None  # open_: no clause so far has a value
        for c in clauses:
            keys, present = self.clause(c)
            present = self._named(present)
            for column, down, first in keys:
                column = self._named(column if open_ is None else F.when(open_, column))
                out.append({(False, False): column.asc_nulls_last, (False, True): column.asc_nulls_first, (True, False): column.desc_nulls_last, (True, True): column.desc_nulls_first}[down, first]())
            open_ = ~present if open_ is None else open_ & ~present
            # What has a value for an earlier clause comes before what hasn't.
            out.append(self._named(open_).asc())
        return [*out, F.col("pk").asc()]


def by_entity(ctx: Context, clauses: Iterable[Constraint], refs: DataFrame, on: str, prefix: str = "__o") -> tuple[DataFrame, list[Column]]:
    """Reference rows with the sort keys of the entities that they lead to, then of the key itself."""
    o = Orderer(ctx, ctx.rows(), prefix=prefix)
    keys = o.keys(clauses)
    flags = [k for k in o.df.columns if k.startswith(prefix)]
    target = o.df.select(F.col("pk").alias("__t"), *flags)
    joined = refs.join(target, F.col(on) == F.col("__t"), "left").drop("__t")
    return joined, [*keys[:-1], F.col(on).asc()]


def reference_keys(ctx: Context, c: Constraint) -> DataFrame:
    """(pk, key): the sort value that an entity's references give it.

    Of several references, pickFirstByEntityProperty takes the one whose entity
    sorts first, by key if nothing is said. traverseByEntityProperty (the default
    where the target is a tree) orders by the place of the referenced node in a
    traversal first, and the reference met first counts.
    """
    name = c.values[0]
    reference = ctx.collection.reference(name)
    attributes = [x for x in c.children if x.name == "attributeNatural"]
    values = [localized(reference.attributes[x.values[0]], x.values[0], ctx.locale) for x in attributes]
    target = ctx.on(reference.target)
    traverse = c.child("traverseByEntityProperty")
    pick = c.child("pickFirstByEntityProperty")
    if traverse or pick is None and target.collection.hierarchical:
        mode = next(iter(traverse.values), "DEPTH_FIRST") if traverse else "DEPTH_FIRST"
        tree = hierarchy.nodes(target)
        order = None
        if traverse and traverse.children:
            o = Orderer(target, target.rows())
            keys = o.keys(traverse.children)
            ranked = o.df.select(F.col("pk").alias("node"), F.row_number().over(Window.partitionBy("parent_pk").orderBy(*keys)).alias("place"))
            tree, order = tree.join(ranked, "node"), F.struct("place")
        places = hierarchy.sorted_paths(tree, order, mode)
        refs = reference.frame.join(places, F.col("ref_pk") == F.col("node"))
        key = F.struct(F.col("position"), *(F.struct(v.isNull(), v) for v in values))
        return refs.groupBy("pk").agg(F.min(key).alias("key"))
    refs, keys = by_entity(target, pick.children if pick else (), reference.frame, "ref_pk")
    first = refs.withColumn("__n", F.row_number().over(Window.partitionBy("pk").orderBy(*keys))).where("__n = 1")
    return first.select("pk", (values[0] if len(values) == 1 else F.struct(*values)).alias("key"))


def segments(ctx: Context, df: DataFrame, c: Constraint, filter_by: Constraint | None) -> DataFrame:
    """(pk, position): entities of the segments in turn; what one took, later ones can't.

    A segment has only entities that satisfy its entityHaving and have a value to
    be sorted by. Windows without a partition run over a segment's entities,
    after a limit if it has one.
    """
    left, taken = df.select(ctx.collection.frame.columns), None
    for number, s in enumerate(c.all("segment")):
        here = left
        if s.child("entityHaving"):
            here = filters.EntityRow(ctx).apply(here, s.child("entityHaving").children)
        o = Orderer(ctx, here, filter_by)
        clauses = s.child("orderBy").children
        keys = o.keys(clauses)
        # The columns that say whether a clause has a value are the last of the chain: open means none had.
        flags = [x for x in o.df.columns if x.startswith("__o")]
        present = ~F.col(flags[-1])
        chosen = o.df.where(present).orderBy(*keys)
        limit = s.child("limit")
        if limit:
            chosen = chosen.limit(limit.values[0])
        ranked = chosen.select("pk", F.struct(F.lit(number).alias("segment"), F.row_number().over(Window.orderBy(*keys)).alias("place")).alias("position"))
        taken = ranked if taken is None else taken.unionByName(ranked)
        left = left.join(ranked.select(F.col("pk").alias("__taken")), F.col("pk") == F.col("__taken"), "left_anti")
    return taken


def ordered(ctx: Context, df: DataFrame, order_by: Constraint | None, filter_by: Constraint | None = None) -> tuple[DataFrame, list[Column]]:
    """The frame with what its order needs, and the sort keys."""
    o = Orderer(ctx, df, filter_by)
    keys = o.keys(order_by.children if order_by else ())
    return o.df, keys
