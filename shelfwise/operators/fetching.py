"""Entity bodies, put together after the slice is taken (late materialization).

Of a page only its keys go into what is gathered from prices, references and
trees: each is cut down to them by a semi-join before anything is aggregated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.constraints import Constraint, QueryError
from shelfwise.operators import filters, hierarchy, ordering, paging, prices
from shelfwise.operators.context import Context


def _locales(ctx: Context, contents: list[Constraint]) -> tuple[str, ...] | None:
    """Locales to give of localized values; empty means all, None the query's one."""
    c = next((x for x in contents if x.name == "dataInLocales"), None)
    return None if c is None else tuple(c.values)


def _localized(ctx: Context, column: Column, is_localized: bool, locales: tuple[str, ...] | None) -> Column:
    if not is_localized or locales == ():
        return column
    if locales is not None:
        return F.map_filter(column, lambda k, _: k.isin(*locales))
    return column.getItem(ctx.locale) if ctx.locale else F.lit(None).cast("string")


def fetched(ctx: Context, df: DataFrame, contents: list[Constraint], defaults: tuple[str, ...] = (), page: bool = False) -> DataFrame:
    """`df` (pk and maybe sort keys beginning with __) with a column for everything that is asked for; a `page` is a few rows."""
    keys = df.select(F.col("pk").alias("__page")) if page else None
    kept = [c for c in df.columns if c == "pk" or c.startswith("__")]
    locales = _locales(ctx, contents)
    columns: list[Column] = []
    joins: list[DataFrame] = []
    for c in contents:
        if c.name == "attributeContent":
            for name in c.values or ctx.collection.attributes:
                if name not in df.columns:
                    raise QueryError(f"collection {ctx.collection.name} holds no data of attribute {name}")
                columns.append(_localized(ctx, F.col(name), ctx.collection.attribute(name).localized, locales).alias(name))
        elif c.name == "associatedDataContent":
            for name in c.values or ctx.collection.associated:
                if name not in ctx.collection.associated:
                    raise QueryError(f"collection {ctx.collection.name} has no associated data {name}")
                columns.append(F.col(name))
        elif c.name == "priceContent":
            joins.append(price_lists(ctx, c, keys))
        elif c.name == "accompanyingPriceContent":
            joins.append(accompanying(ctx, c, defaults, df if page else None))
        elif c.name in ("referenceContent", "referenceContentWithAttributes"):
            joins += [reference_lists(ctx, name, c, keys) for name in ([v for v in c.values if v not in ("ANY", "EXISTING")] or ctx.collection.references)]
        elif c.name == "hierarchyContent":
            joins.append(parent_chain(ctx, c, df))
        elif c.name != "dataInLocales":
            raise QueryError(f"{c.name} can't be part of entityFetch")
    seen, unique = set(), []
    for column in columns:  # asked for twice, given once
        name = str(column)
        if name not in seen:
            seen.add(name)
            unique.append(column)
    out = df.select(*kept, *unique)
    for j in joins:
        out = out.join(j, "pk", "left")
    return out


def _of(rows: DataFrame, keys: DataFrame | None, on: str = "pk") -> DataFrame:
    """Rows of the page's entities, or all."""
    return rows if keys is None else rows.join(F.broadcast(keys), F.col(on) == F.col("__page"), "left_semi")


def price_lists(ctx: Context, c: Constraint, keys: DataFrame | None = None) -> DataFrame:
    """(pk, prices): all prices, or those of the query's terms and the lists that are named besides."""
    mode, *more = [*c.values] or ["RESPECTING_FILTER"]
    p = _of(ctx.collection.prices, keys)
    if mode == "NONE":
        p = p.where("false")
    elif mode == "RESPECTING_FILTER":
        t = ctx.prices
        if t.currency is not None:
            p = p.where(F.col("currency") == t.currency)
        if t.lists is not None:
            p = p.where(F.col("price_list").isin(*t.lists, *more))
        if t.valid_in is not None:
            at = F.lit(t.valid_in)
            p = p.where((F.col("valid_from").isNull() | (F.col("valid_from") <= at)) & (F.col("valid_to").isNull() | (F.col("valid_to") >= at)))
    elif mode != "ALL":
        raise QueryError(f"priceContent knows NONE, RESPECTING_FILTER and ALL, not {mode}")
    fields = [x for x in p.columns if x != "pk"]
    return p.groupBy("pk").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("prices"))


def accompanying(ctx: Context, c: Constraint, defaults: tuple[str, ...], page: DataFrame | None = None) -> DataFrame:
    """(pk, <name>): the price for sale under another order of price lists."""
    name, *lists = [*c.values] or ["default"]
    lists = tuple(lists) or defaults
    if not lists:
        raise QueryError("accompanyingPriceContent has no price lists, and there are no default ones")
    return prices.for_sale(ctx, lists=lists, entities=page if page is None else F.broadcast(page.select("pk", "inner_record_handling"))).select("pk", F.col("amount").alias(f"price_{name}"))


def reference_lists(ctx: Context, name: str, c: Constraint, keys: DataFrame | None = None) -> DataFrame:
    """(pk, <reference>): an array of the references, filtered, ordered and cut to a page for each entity."""
    reference = ctx.collection.reference(name)
    refs = _of(reference.frame, keys)
    if c.child("filterBy"):
        refs = filters.ReferenceRow(ctx, reference).apply(refs, c.child("filterBy").children)
    if "EXISTING" in c.values:  # only references to entities that there are
        refs = refs.join(ctx.on(reference.target).rows().select(F.col("pk").alias("__there")), F.col("ref_pk") == F.col("__there"), "left_semi")
    order: list[Column] = []
    for o in c.child("orderBy").children if c.child("orderBy") else ():
        if o.name in ("entityProperty", "entityGroupProperty"):
            of, on = (reference.target, "ref_pk") if o.name == "entityProperty" else (reference.group, "group_pk")
            refs, keys = ordering.by_entity(ctx.on(of), o.children, refs, on, f"__s{len(order)}_")
            order += keys[:-1]
        elif o.name == "attributeNatural":
            column = F.col(o.values[0])
            order.append(column.desc_nulls_last() if ordering._directed(o, 1) else column.asc_nulls_last())
        else:
            raise QueryError(f"{o.name} can't order references")
    refs = refs.withColumn("__n", F.row_number().over(Window.partitionBy("pk").orderBy(*order, F.col("ref_pk").asc())))
    slice_ = c.child("page", "strip")
    if slice_:
        # A page beyond an entity's last one is its first.
        size = F.count(F.lit(1)).over(Window.partitionBy("pk"))
        s = paging.window(slice_, 1 << 62)
        refs = refs.withColumn("__off", F.when(size > s.offset, s.offset).otherwise(0)).where((F.col("__n") > F.col("__off")) & (F.col("__n") <= F.col("__off") + s.limit))
    fields = ["__n", "ref_pk", "group_pk"]
    if c.name == "referenceContentWithAttributes" or c.child("attributeContent"):
        wanted = c.child("attributeContent")
        fields += list((wanted.values if wanted else ()) or reference.attributes)
    for fetch, target, on, label in ((c.child("entityFetch"), reference.target, "ref_pk", "entity"), (c.child("entityGroupFetch"), reference.group, "group_pk", "group")):
        if fetch:
            inner = ctx.on(target)
            bodies = inner.collection.frame
            if keys is not None:  # only of what the page refers to
                bodies = bodies.join(F.broadcast(refs.select(F.col(on).alias("__page")).distinct()), F.col("pk") == F.col("__page"), "left_semi")
            body = fetched(inner, bodies, list(fetch.children), page=keys is not None)
            refs = refs.join(body.select(F.col("pk").alias("__b"), F.struct("*").alias(label)), F.col(on) == F.col("__b"), "left").drop("__b")
            fields.append(label)
    return refs.groupBy("pk").agg(F.transform(F.array_sort(F.collect_list(F.struct(*fields))), lambda x: x.dropFields("__n")).alias(name))


def parent_chain(ctx: Context, c: Constraint, df: DataFrame) -> DataFrame:
    """(pk, parents): primary keys from each entity's parent up to the root, as far as stopAt allows, with bodies if asked for."""
    up = hierarchy.ascend(hierarchy.nodes(ctx), df.select(F.col("pk").alias("node")))
    stop = c.child("stopAt")
    if stop:
        s = stop.children[0]
        if s.name == "distance":
            up = up.where(F.col("distance") <= s.values[0])
        elif s.name == "level":
            up = up.where(F.col("level") - F.col("distance") >= s.values[0])
        else:
            hits = filters.entities(ctx, s.child("filterBy").children).select(F.col("pk").alias("ancestor"), F.lit(True).alias("hit"))
            nearest = up.join(hits, "ancestor").groupBy("node").agg(F.min("distance").alias("upto"))
            up = up.join(nearest, "node", "left").where("upto is null or distance <= upto")
    fields = ["distance", "ancestor"]
    if c.child("entityFetch"):
        bodies = ctx.collection.frame.join(up.select(F.col("ancestor").alias("__page")).distinct(), F.col("pk") == F.col("__page"), "left_semi")
        body = fetched(ctx, bodies, list(c.child("entityFetch").children))
        up = up.join(body.select(F.col("pk").alias("ancestor"), F.struct("*").alias("entity")), "ancestor", "left")
        fields.append("entity")
    parents = F.array_sort(F.collect_list(F.struct(*fields)))
    picked = F.transform(parents, lambda x: x["ancestor"]) if len(fields) == 2 else F.transform(parents, lambda x: x["entity"])
    return up.groupBy(F.col("node").alias("pk")).agg(picked.alias("parents"))
