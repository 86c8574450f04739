"""Filters: one conjunction of columns, with semi- and anti-joins for what looks beyond the row.

A constraint about the row itself is a two-valued column. One that looks into
references, trees or prices is a table of the keys that satisfy it; at the top
of the conjunction it becomes a left semi-join, under `not` a left anti-join, and
elsewhere (in `or`) a marker column from a left join on distinct keys.

The price constraints of a conjunction are one: that there is a price for sale
within the bounds. Without bounds any price that the terms allow will do, and
nothing is aggregated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.catalog import Reference
from shelfwise.constraints import Constraint, QueryError, build
from shelfwise.operators import attributes, hierarchy, prices
from shelfwise.operators.context import Context, localized

_ATTRIBUTES = frozenset(n for n in ("attributeEquals attributeGreaterThan attributeGreaterThanEquals attributeLessThan attributeLessThanEquals attributeBetween attributeInSet attributeContains attributeStartsWith attributeEndsWith attributeIs attributeInRange").split())
_KEYS = frozenset("entityPrimaryKeyInSet entityPrimaryKeyGreaterThan entityPrimaryKeyGreaterThanEquals entityPrimaryKeyLessThan entityPrimaryKeyLessThanEquals entityPrimaryKeyBetween".split())
PRICE_TERMS = frozenset("priceInCurrency priceInPriceLists priceValidIn".split())
_PRICES = PRICE_TERMS | {"priceBetween"}
_TREES = frozenset("hierarchyWithin hierarchyWithinSelf hierarchyWithinRoot hierarchyWithinRootSelf".split())
_SPECS = frozenset("directRelation having anyHaving excluding excludingRoot".split())
_ALL_OF = frozenset("filterBy filterGroupBy and userFilter entityHaving groupHaving".split())


def flat(cs) -> list[Constraint]:
    """The members of a conjunction, its inner conjunctions opened."""
    out = []
    for c in cs:
        out += flat(c.children) if c.name in ("filterBy", "filterGroupBy", "and", "userFilter") else [c]
    return out


class _Row:
    """How constraints are resolved on the rows of one frame."""

    pk = "pk"

    def column(self, c: Constraint, sure: bool = False) -> Column | None:
        """The constraint as a column of the row (two-valued if it must be `sure`), or None if it looks beyond it."""
        raise NotImplementedError

    def keys(self, c: Constraint) -> tuple[DataFrame, str]:
        """Distinct keys (key) that satisfy the constraint, and the column that they are compared with."""
        raise NotImplementedError

    def apply(self, df: DataFrame, cs) -> DataFrame:
        """`df` with only the rows that satisfy all of the constraints; columns stay as they are."""
        columns = df.columns
        later = []
        for c in flat(cs):
            p = self.plain(c)
            if p is not None:
                df = df.where(p)
            else:
                later.append(c)
        for c in later:
            inner, how = (c.children[0], "left_anti") if c.name == "not" else (c, "left_semi")
            if inner.name not in ("and", "or", "not", "inScope", "userFilter"):
                keys, on = self.keys(inner)
                df = df.join(keys.select(F.col("key").alias("__key")), F.col(on) == F.col("__key"), how)
            else:
                df, p = self.marked(df, c)
                df = df.where(p)
        return df.select(*columns)

    def plain(self, c: Constraint, sure: bool = False) -> Column | None:
        """A whole boolean tree as one column, if all of it is about the row."""
        if c.name in ("and", "or", "not", "userFilter", "inScope"):
            parts = [self.plain(x, sure or c.name == "not") for x in c.children]
            return None if any(p is None for p in parts) else self.combined(c, parts)
        return self.column(c, sure)

    def combined(self, c: Constraint, parts: list[Column]) -> Column:
        if c.name == "not":
            return ~parts[0]
        if c.name == "or":
            return reduce(lambda a, b: a | b, parts) if parts else F.lit(True)
        every = reduce(lambda a, b: a & b, parts) if parts else F.lit(True)
        return (F.col("scope") != F.lit(c.values[0])) | every if c.name == "inScope" else every

    def marked(self, df: DataFrame, c: Constraint, sure: bool = False) -> tuple[DataFrame, Column]:
        """`df` with marker columns, and the constraint as a column over them."""
        p = self.plain(c, sure)
        if p is not None:
            return df, p
        if c.name in ("and", "or", "not", "userFilter", "inScope"):
            parts = []
            for x in c.children:
                df, p = self.marked(df, x, sure or c.name == "not")
                parts.append(p)
            return df, self.combined(c, parts)
        keys, on = self.keys(c)
        name = f"__m{len(df.columns)}"
        df = df.join(keys.select(F.col("key").alias(f"{name}k"), F.lit(True).alias(name)), F.col(on) == F.col(f"{name}k"), "left").drop(f"{name}k")
        return df, F.coalesce(F.col(name), F.lit(False))


class EntityRow(_Row):
    def __init__(self, ctx: Context):
        self.ctx = ctx

    def apply(self, df: DataFrame, cs, amount: bool = False) -> DataFrame:
        """As of any row; with `amount` also `__amount`, the price for sale, if the constraints are about prices."""
        cs = flat(cs)
        about = [c for c in cs if c.name in _PRICES]
        own = [c for c in cs if c.name not in _PRICES and self.plain(c) is not None]
        beyond = [c for c in cs if c.name not in _PRICES and c not in own]
        df = super().apply(df, own)
        if about:
            # Only the prices of entities that the row's own constraints leave are aggregated.
            between = next((c for c in about if c.name == "priceBetween"), None)
            if amount:
                sale = prices.sold(self.ctx, between, df).select(F.col("pk").alias("__key"), F.col("amount").alias("__amount"))
                df = df.join(sale, F.col("pk") == F.col("__key")).drop("__key")
            else:
                keys = prices.test(self.ctx, between or about[0], df).withColumnRenamed("pk", "__key")
                df = df.join(keys, F.col("pk") == F.col("__key"), "left_semi")
        return super().apply(df, beyond)

    def column(self, c: Constraint, sure: bool = False) -> Column | None:
        ctx = self.ctx
        if c.name in _ATTRIBUTES:
            name = c.values[0]
            return attributes.attribute_test(c, ctx.collection.attribute(name), ctx.column(name), ctx.moment, sure)
        if c.name in _KEYS:
            return attributes.key_test(c, F.col("pk"))
        if c.name == "entityLocaleEquals":
            return F.coalesce(F.array_contains("locales", c.values[0]), F.lit(False))
        if c.name == "scope":
            return F.col("scope").isin(*c.values) if "scope" in ctx.collection.frame.columns else F.lit(True)
        return None

    def keys(self, c: Constraint) -> tuple[DataFrame, str]:
        ctx = self.ctx
        if c.name in _PRICES:
            return prices.test(ctx, c).select(F.col("pk").alias("key")), "pk"
        if c.name == "referenceHaving":
            return referencing(ctx, c.values[0], c.children), "pk"
        if c.name == "facetHaving":
            from shelfwise.operators import facets

            return facets.selected(ctx, c, ctx.rules or facets.Rules()), "pk"
        if c.name == "histogramHaving":
            return self.keys(rewritten_histogram(ctx, c))
        if c.name in _TREES:
            return within(ctx, c), "pk"
        raise QueryError(f"{c.name} can't be used in a filter of {ctx.collection.name}")


class ReferenceRow(_Row):
    """Rows of a reference: its attributes, and the entities and groups that it leads to."""

    def __init__(self, ctx: Context, reference: Reference):
        self.ctx, self.reference = ctx, reference

    def column(self, c: Constraint, sure: bool = False) -> Column | None:
        if c.name in _ATTRIBUTES:
            name = c.values[0]
            if name not in self.reference.attributes:
                raise QueryError(f"the reference has no attribute {name}")
            attribute = self.reference.attributes[name]
            return attributes.attribute_test(c, attribute, localized(attribute, name, self.ctx.locale), self.ctx.moment, sure)
        if c.name in _KEYS:
            return attributes.key_test(c, F.col("ref_pk"))
        return None

    def keys(self, c: Constraint) -> tuple[DataFrame, str]:
        if c.name == "entityHaving":
            return entities(self.ctx.on(self.reference.target), c.children).select(F.col("pk").alias("key")), "ref_pk"
        if c.name == "groupHaving":
            if self.reference.group is None:
                raise QueryError("the reference has no groups")
            return entities(self.ctx.on(self.reference.group), c.children).select(F.col("pk").alias("key")), "group_pk"
        raise QueryError(f"{c.name} can't be used inside referenceHaving")


def entities(ctx: Context, cs, amount: bool = False) -> DataFrame:
    """The entities of the context's collection that satisfy all of the constraints, every column."""
    return EntityRow(ctx).apply(ctx.rows(), cs, amount)


def entities_by_marks(ctx: Context, cs) -> DataFrame:
    """The same by another plan: a marker column for whatever looks beyond the row, and one predicate over them."""
    df, row = ctx.rows(), EntityRow(ctx)
    columns = df.columns
    for c in flat(cs):
        df, p = row.marked(df, c, True)
        df = df.where(p).select(*columns)
    return df


def references(ctx: Context, name: str, cs) -> DataFrame:
    """Rows of a reference that satisfy all of the constraints together."""
    reference = ctx.collection.reference(name)
    return ReferenceRow(ctx, reference).apply(reference.frame, cs)


def referencing(ctx: Context, name: str, cs) -> DataFrame:
    """(key) of entities with one such reference at least."""
    return references(ctx, name, cs).select(F.col("pk").alias("key")).distinct()


def rewritten_histogram(ctx: Context, c: Constraint) -> Constraint:
    """histogramHaving(reference, attribute?, from, to, groupHaving?) as the references that it stands for; the attribute may be left out where the reference has one number only."""
    name, *bounds = c.values
    if bounds and isinstance(bounds[0], str):
        attribute = bounds.pop(0)
    else:
        numbers = [k for k, a in ctx.collection.reference(name).attributes.items() if a.type in ("int", "decimal") and not a.range]
        if len(numbers) != 1:
            raise QueryError(f"reference {name} has {len(numbers)} numbers; histogramHaving must name one")
        attribute = numbers[0]
    low, high = [*bounds, None, None][:2]
    inner = [] if low is None and high is None else [build("attributeBetween", attribute, low, high)]
    reference = ctx.collection.reference(name)
    own = attribute in reference.attributes
    return build("referenceHaving", name, *(inner if own else [build("entityHaving", *inner)] if inner else []), *c.all("groupHaving"))


def tree_nodes(ctx: Context, c: Constraint) -> DataFrame:
    """(node) that a hierarchy constraint selects, in the tree that it looks at."""
    self_mode = c.name.endswith("Self")
    on = ctx if self_mode else ctx.on(ctx.collection.reference(c.values[0]).target)
    spec = [x for x in c.children if x.name in _SPECS]
    matching = lambda k, cs: entities(k, cs).select("pk")
    start = None
    if "Root" not in c.name:
        start = entities(on, [x for x in c.children if x.name not in _SPECS]).select(F.col("pk").alias("node"))
    out = hierarchy.node_set(on, spec, start, matching)
    if any(x.name == "directRelation" for x in spec):
        # Of the start itself; in its own tree, the children; of the root, the roots.
        out = out.where(F.col("distance") == (1 if self_mode and start is not None else 0))
    return out.select("node")


def within(ctx: Context, c: Constraint) -> DataFrame:
    """(key) of entities in, or referring to, the nodes that a hierarchy constraint selects."""
    found = tree_nodes(ctx, c)
    if c.name.endswith("Self"):
        return found.select(F.col("node").alias("key"))
    refs = ctx.collection.reference(c.values[0]).frame
    return refs.join(found, F.col("ref_pk") == F.col("node"), "left_semi").select(F.col("pk").alias("key")).distinct()


def flat_top(filter_by: Constraint | None) -> tuple[list[Constraint], list[Constraint]]:
    """A filter's mandatory constraints, and those that its userFilter holds."""
    mandatory, user = [], []
    for c in filter_by.children if filter_by else ():
        if c.name == "userFilter":
            user += flat(c.children)
        elif c.name == "and":
            m, u = flat_top(c)
            mandatory += m
            user += u
        else:
            mandatory.append(c)
    return mandatory, user
