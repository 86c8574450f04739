"""A query tree to DataFrames: the page of entities, and one table for each extra result.

The filter is split once into its mandatory part and its user part; each consumer
recombines what it needs: the page takes all, facet counts leave the user part
out, a histogram leaves out the sliders that it draws, hierarchy statistics leave
out the tree constraint itself. Everything is lazy but the count that a page
number is checked against.
"""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise import language
from shelfwise.catalog import Catalog
from shelfwise.constraints import Constraint, QueryError
from shelfwise.operators import facets, fetching, filters, histograms, ordering, paging, prices, statistics
from shelfwise.operators.context import Context, terms_of

_SLIDERS = ("attributeBetween", "histogramHaving")
# The names of debug modes.
DEBUG = ("VERIFY_ALTERNATIVE_INDEX_RESULTS", "VERIFY_POSSIBLE_CACHING_TREES", "PREFER_PREFETCHING", "PREFER_TREE_SORT", "PREFER_PRESORT_ARRAYS", "PREFER_INDEX_SCAN")
_TREES = ("hierarchyWithin", "hierarchyWithinRoot", "hierarchyWithinSelf", "hierarchyWithinRootSelf")


@dataclass(frozen=True)
class Response:
    """page: the entities, `__position` giving their order; total: how many there are in all; extras: by name.

    All but the total is lazy, so the query's labels go with the response: jobs that
    are run by `collect`, or inside `labelled()`, bear them as Spark tags.
    """

    page: DataFrame
    total: int | None
    extras: dict[str, DataFrame] = field(default_factory=dict)
    telemetry: dict[str, str] = field(default_factory=dict)
    labels: dict[str, str] = field(default_factory=dict)

    @contextmanager
    def labelled(self) -> Iterator[Response]:
        with tagged(self.page.sparkSession, self.labels):
            yield self

    def collect(self, name: str = "page") -> list:
        """The rows of the page, or of an extra result."""
        with self.labelled():
            return (self.page if name == "page" else self.extras[name]).collect()


@contextmanager
def tagged(spark: SparkSession, labels: dict) -> Iterator[None]:
    """Jobs that are started inside bear the labels."""
    tags = [f"{name}={value}".replace(",", ";") for name, value in labels.items()]
    for t in tags:
        spark.addTag(t)
    try:
        yield
    finally:
        for t in tags:
            spark.removeTag(t)


class Query:
    """A checked query on a catalog."""

    def __init__(self, catalog: Catalog, tree: Constraint | str, *positional, now: datetime | None = None, **named):
        tree = language.parse(tree, *positional, **named) if isinstance(tree, str) else tree
        if tree.name != "query":
            raise QueryError("a query begins with query(...)")
        tree = language.purify(tree)
        self.tree, self.catalog = tree, catalog
        head = tree.child("head")
        collection = tree.child("collection") or (head.child("collection") if head else None)
        self.labels = {c.values[0]: c.values[1] for c in (head.all("label") if head else ())}
        self.filter_by, self.order_by, self.require = tree.child("filterBy"), tree.child("orderBy"), tree.child("require")
        self.now = now or datetime.now(timezone.utc)
        self.terms = terms_of(self.filter_by, self.require, self.now)
        name = collection.values[0] if collection else self._unique_owner()
        self.rules = facets.Rules.of(self.require)
        self.ctx = Context(catalog, catalog[name], now=self.now, rules=self.rules, **self.terms)
        parts = filters.flat_top(self.filter_by)
        self.mandatory, self.user = parts

    def _unique_owner(self) -> str:
        """Without a collection: the one whose globally unique attribute the filter names, among all of them the one with a match."""
        for c in self.filter_by.walk() if self.filter_by else ():
            if c.name in ("attributeEquals", "attributeInSet"):
                for owner in self.catalog.with_attribute(c.values[0]):
                    ctx = Context(self.catalog, owner, now=self.now, **self.terms)
                    if not filters.entities(ctx, (c,)).isEmpty():
                        return owner.name
        raise QueryError("a query without a collection needs a globally unique attribute in its filter")

    # Parts of the filter

    def _entities(self, cs: Iterable[Constraint], amount: bool = False) -> DataFrame:
        cs = list(cs)
        # Selections of facets look only at the entities that the rest leaves.
        df = filters.entities(self.ctx, [c for c in cs if c.name != "facetHaving"], amount)
        for c in (c for c in cs if c.name == "facetHaving"):
            keys = facets.selected(self.ctx, c, self.rules, df.select("pk")).withColumnRenamed("key", "__f")
            df = df.join(keys, F.col("pk") == F.col("__f"), "left_semi")
        return df

    @cached_property
    def matching(self) -> DataFrame:
        """The entities that the filter leaves; with `__amount`, the price for sale, if they are ordered by it."""
        by_price = any(c.name == "priceNatural" for c in (self.order_by.walk() if self.order_by else ()))
        df = self._entities([*self.mandatory, *self.user], by_price)
        return self._preferred(df)

    def _preferred(self, df: DataFrame) -> DataFrame:
        """With several scopes and an equality on a unique attribute, the scope that is named first wins."""
        scopes = self.ctx.scopes
        unique = [c.values[0] for c in self.mandatory if c.name == "attributeEquals" and self.ctx.collection.attribute(c.values[0]).unique]
        if len(scopes) < 2 or not unique or "scope" not in df.columns:
            return df
        from pyspark.sql import Window

        rank = F.array_position(F.array(*(F.lit(s) for s in scopes)), F.col("scope"))
        return df.withColumn("__r", F.row_number().over(Window.partitionBy(unique[0]).orderBy(rank, "pk"))).where("__r = 1").drop("__r")

    # The page

    def _find(self, *names: str) -> list[Constraint]:
        """Requirements of these names; those inside inScope if its scope is searched."""
        out = []
        for c in self.require.children if self.require else ():
            if c.name in names:
                out.append(c)
            elif c.name == "inScope" and c.values[0] in self.ctx.scopes:
                out += c.all(*names)
        return out

    @cached_property
    def _slice(self) -> tuple[paging.Slice, int]:
        total = self.matching.count()
        return paging.window(next(iter(self._find("page", "strip")), None), total), total

    def page(self) -> DataFrame:
        df, keys = ordering.ordered(self.ctx, self.matching, self.order_by, self.filter_by)
        s, _ = self._slice
        flags = [c for c in df.columns if c.startswith("__o")]
        top = df.select("pk", *flags).orderBy(*keys).offset(s.offset).limit(s.limit)
        # A page is a few rows; only they are numbered and joined with their bodies.
        from pyspark.sql import Window

        numbered = top.withColumn("__position", F.row_number().over(Window.orderBy(*keys)) + s.offset).select("pk", "__position")
        fetches = self._find("entityFetch")
        if not fetches:
            return numbered
        defaults = tuple(v for c in self._find("defaultAccompanyingPriceLists") for v in c.values)
        bodies = self.matching.join(F.broadcast(numbered.withColumnRenamed("pk", "__pk")), F.col("pk") == F.col("__pk")).drop("__pk")
        scoped = {c.values[0]: [x for f in c.all("entityFetch") for x in f.children] for c in (self.require.children if self.require else ()) if c.name == "inScope" and c.child("entityFetch")}
        common = [c for f in self.require.all("entityFetch") for c in f.children]
        if not set(scoped) & set(self.ctx.scopes):
            return fetching.fetched(self.ctx, bodies, common, defaults, page=True)
        # Entities of a scope get what is asked for it besides.
        parts = [fetching.fetched(self.ctx, bodies.where(F.col("scope") == scope), [*common, *scoped.get(scope, [])], defaults, page=True) for scope in self.ctx.scopes]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    # Extra results

    def _relaxed(self, drop: tuple[str, ...], attribute: str | None = None) -> DataFrame:
        """All of the filter but the user's constraints of these names (on this attribute)."""
        kept = [c for c in self.user if not (c.name in drop and (attribute is None or attribute in c.values))]
        return self._entities([*self.mandatory, *kept])

    def attribute_histogram(self, name: str, n: int, behaviour: str = "STANDARD") -> DataFrame:
        a = self.ctx.collection.attribute(name)
        if a.type not in ("int", "decimal") or not a.filterable:
            raise QueryError(f"a histogram needs a numeric filterable attribute; {name} is none")
        df = self._relaxed(_SLIDERS, name)
        column = self.ctx.column(name)
        return histograms.histogram(df.select("pk", (F.explode(column) if a.array else column).alias("value")), n, behaviour)

    def price_histogram(self, n: int, behaviour: str = "STANDARD") -> DataFrame:
        # The sale's price says as well that there is one.
        df = self._entities([c for c in (*self.mandatory, *self.user) if c.name not in ("priceBetween", *filters.PRICE_TERMS)])
        sale = prices.for_sale(self.ctx, entities=df).select("pk", F.col("amount").alias("value"))
        return histograms.histogram(sale, n, behaviour)

    def reference_histogram(self, reference: str, attribute: str, n: int, behaviour: str = "STANDARD") -> DataFrame:
        """Per group of a reference, the histogram of an attribute of the edge or of the entity that it leads to, with the entities at its ends."""
        ref = self.ctx.collection.reference(reference)
        df = self._relaxed(("histogramHaving",), reference).select("pk")
        rows = ref.frame.join(df, "pk", "left_semi")
        if attribute in ref.attributes:
            values = rows.select("pk", F.coalesce("group_pk", F.lit(-1)).alias("group_pk"), "ref_pk", F.col(attribute).alias("value"))
        else:
            target = self.ctx.on(ref.target)
            body = target.collection.frame.select(F.col("pk").alias("__t"), target.column(attribute).alias("value"))
            values = rows.join(body, F.col("ref_pk") == F.col("__t")).select("pk", F.coalesce("group_pk", F.lit(-1)).alias("group_pk"), "ref_pk", "value")
        out = histograms.histogram(values, n, behaviour, ("group_pk",))
        ends = values.where("value is not null").groupBy("group_pk").agg(F.min_by("ref_pk", F.struct("value", "ref_pk")).alias("least_pk"), F.max_by("ref_pk", F.struct("value", "ref_pk")).alias("greatest_pk"))
        return out.join(ends, "group_pk")

    def facet_summary(self, reference: str, depth: str = "COUNTS", c: Constraint | None = None) -> DataFrame:
        if depth not in ("NONE", "COUNTS", "IMPACT"):
            raise QueryError(f"a summary has depth NONE, COUNTS or IMPACT, not {depth}")
        selections = [x for x in (*self.mandatory, *self.user) if x.name == "facetHaving" and x.values[0] == reference]
        mandatory = self._entities([x for x in self.mandatory if x not in selections])
        others = self._entities([x for x in (*self.mandatory, *self.user) if x not in selections])
        out = facets.summary(self.ctx, reference, mandatory, others, selections[0] if selections else None, self.rules, depth == "IMPACT")
        ref = self.ctx.collection.reference(reference)
        if c is not None and c.child("filterBy"):
            out = out.join(filters.entities(self.ctx.on(ref.target), c.child("filterBy").children).select(F.col("pk").alias("__k")), F.col("facet_pk") == F.col("__k"), "left_semi")
        if c is not None and c.child("filterGroupBy"):
            out = out.join(filters.entities(self.ctx.on(ref.group), c.child("filterGroupBy").children).select(F.col("pk").alias("__k")), F.col("group_pk") == F.col("__k"), "left_semi")
        for fetch, target, on, label in ((c and c.child("entityFetch"), ref.target, "facet_pk", "facet"), (c and c.child("entityGroupFetch"), ref.group, "group_pk", "group")):
            if fetch:
                inner = self.ctx.on(target)
                body = fetching.fetched(inner, inner.collection.frame, list(fetch.children))
                out = out.join(body.select(F.col("pk").alias("__k"), F.struct("*").alias(label)), F.col(on) == F.col("__k"), "left").drop("__k")
        for clause, target, on in ((c and c.child("orderGroupBy"), ref.group, "group_pk"), (c and c.child("orderBy"), ref.target, "facet_pk")):
            if clause:
                inner = self.ctx.on(target)
                from pyspark.sql import Window

                df, keys = ordering.ordered(inner, inner.collection.frame, clause)
                keyed = df.select(F.col("pk").alias("__k"), *(F.col(k) for k in df.columns if k.startswith("__o")))
                # Facets are placed within their group, groups among those that come out.
                every = [*keys[:-1], F.col("__k").asc()]
                if on == "facet_pk":
                    out = out.join(keyed, F.col(on) == F.col("__k"), "left").withColumn(f"{on}_position", F.when(F.col("__k").isNotNull(), F.row_number().over(Window.partitionBy("group_pk").orderBy(F.col("__k").isNull(), *every))))
                    out = out.drop(*keyed.columns)
                else:
                    groups = out.select(F.col(on).alias("__g")).distinct().join(keyed, F.col("__g") == F.col("__k"))
                    place = groups.select("__g", F.row_number().over(Window.orderBy(*every)).alias(f"{on}_position"))
                    out = out.join(place, F.col(on) == F.col("__g"), "left").drop("__g")
        return out.drop("count", "group_count") if depth == "NONE" else out

    def _about(self, c: Constraint, reference: str | None) -> bool:
        """Whether a constraint limits the tree that a reference (None: the collection itself) leads to."""
        if reference is None:
            return c.name in ("hierarchyWithinSelf", "hierarchyWithinRootSelf")
        target = self.ctx.collection.reference(reference).target
        return c.name in (*_TREES, "referenceHaving", "facetHaving") and not c.name.endswith("Self") and self.ctx.collection.reference(c.values[0]).target == target

    def hierarchy(self, reference: str | None, output: Constraint, keep_empty: bool = False, order_by: Constraint | None = None) -> DataFrame:
        """Statistics of the collection's own tree (reference None) or of a referenced one; with an order also `place`, a node's rank among its siblings."""
        ctx = self.ctx if reference is None else self.ctx.on(self.ctx.collection.reference(reference).target)
        trees = [c for c in (*self.mandatory, *self.user) if c.name in _TREES and (c.name.endswith("Self") if reference is None else not c.name.endswith("Self") and c.values[0] == reference)]
        stats = output.child("statistics")
        base = next((v for v in (stats.values if stats else ()) if v in ("COMPLETE_FILTER", "WITHOUT_USER_FILTER", "COMPLETE_FILTER_EXCLUDING_SELF_IN_USER_FILTER")), "WITHOUT_USER_FILTER")
        # The tree's own constraints name the pivot; only a complete filter counts by them too, and but for the user's if it excludes itself.
        if base == "WITHOUT_USER_FILTER":
            cs = [c for c in self.mandatory if c not in trees]
        else:
            cs = [*self.mandatory, *(c for c in self.user if base == "COMPLETE_FILTER" or not self._about(c, reference))]
        df = self._entities(cs)
        if reference is None:
            owned = df.select("pk", F.col("pk").alias("node"))
        else:
            refs = self.ctx.collection.reference(reference).frame.select("pk", F.col("ref_pk").alias("node"))
            owned = refs.join(df.select("pk"), "pk", "left_semi")
        within = pivot = None
        if trees:
            t = trees[0]
            if "Root" not in t.name:
                pivot = filters.entities(ctx, [x for x in t.children if x.name not in filters._SPECS]).select(F.col("pk").alias("node"))
            if any(x.name in ("having", "anyHaving", "excluding") for x in t.children):
                spec = [x for x in t.children if x.name in ("having", "anyHaving", "excluding")]
                within = filters.hierarchy.node_set(ctx, spec, None, lambda k, q: filters.entities(k, q).select("pk")).select("node")
        out = statistics.compute(ctx, output, pivot, owned, within, keep_empty)
        if order_by:
            from pyspark.sql import Window

            nodes, keys = ordering.ordered(ctx, ctx.rows(), order_by)
            place = nodes.select(F.col("pk").alias("__k"), F.row_number().over(Window.partitionBy("parent_pk").orderBy(*keys)).alias("place"))
            out = out.join(place, F.col("node") == F.col("__k"), "left").drop("__k")
        wanted = {v for v in (stats.values if stats else ())}
        if stats and wanted & {"CHILDREN_COUNT", "QUERIED_ENTITY_COUNT"}:
            out = out.drop(*(c for c, v in (("children_count", "CHILDREN_COUNT"), ("queried_entity_count", "QUERIED_ENTITY_COUNT")) if v not in wanted))
        fetch = output.child("entityFetch")
        if fetch:
            body = fetching.fetched(ctx, ctx.collection.frame, list(fetch.children))
            out = out.join(body.select(F.col("pk").alias("__k"), F.struct("*").alias("entity")), F.col("node") == F.col("__k"), "left").drop("__k")
        return out

    def extras(self) -> dict[str, DataFrame]:
        out: dict[str, DataFrame] = {}
        for c in self.require.children if self.require else ():
            if c.name == "inScope":
                # The requirement on the entities of one scope only.
                scoped = replace(self.ctx, scopes=tuple(s for s in self.ctx.scopes if s == c.values[0]))
                inner = Query.__new__(Query)
                inner.__dict__.update({k: v for k, v in self.__dict__.items() if k not in ("matching", "_slice")})
                inner.ctx, inner.require = scoped, Constraint("require", c.children)
                if scoped.scopes:  # else the scope isn't searched
                    out.update(inner.extras())
            elif c.name == "attributeHistogram":
                n, *more = c.values
                behaviour = more.pop(0) if more and more[0] in histograms.BEHAVIOURS else "STANDARD"
                for name in more:
                    out[f"attributeHistogram:{name}"] = self.attribute_histogram(name, n, behaviour)
            elif c.name == "priceHistogram":
                out["priceHistogram"] = self.price_histogram(*c.values)
            elif c.name == "referenceSummary":
                # A summary of one reference overrides what is asked for all.
                own = {x.values[0]: x for x in self.require.all("referenceSummaryOfReference")}
                depth = next(iter(c.values), "COUNTS")
                names = [name for name, r in self.ctx.collection.references.items() if r.faceted]
                each = [self.facet_summary(name, next(iter(own[name].values[1:]), "COUNTS"), own[name]) if name in own else self.facet_summary(name, depth, c) for name in names]
                if each:
                    out["referenceSummary"] = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), each)
                for name in names:
                    if name not in own:
                        out.update(self._reference_histograms(name, c, False))
                missing = [a for h in c.all("histogramStatistics") for a in self._drawn(h)[2] if not any(self._has(name, a) for name in names)]
                if missing:
                    raise QueryError(f"no faceted reference has {missing[0]}")
            elif c.name == "referenceSummaryOfReference":
                name, *more = c.values
                out[f"referenceSummary:{name}"] = self.facet_summary(name, next(iter(more), "COUNTS"), c)
                out.update(self._reference_histograms(name, c, True))
            elif c.name in ("hierarchyOfSelf", "hierarchyOfReference"):
                keep = "LEAVE_EMPTY" in c.values or c.name == "hierarchyOfSelf" and "REMOVE_EMPTY" not in c.values
                for reference in [None] if c.name == "hierarchyOfSelf" else [v for v in c.values if v not in ("LEAVE_EMPTY", "REMOVE_EMPTY")]:
                    for output in c.children:
                        if output.name != "orderBy":
                            out[f"hierarchy:{reference or 'self'}:{output.values[0]}"] = self.hierarchy(reference, output, keep, c.child("orderBy"))
        return out

    @staticmethod
    def _drawn(h: Constraint) -> tuple[int, str, list[str]]:
        """Buckets, behaviour and attributes of a histogramStatistics."""
        n, *more = h.values
        return n, more.pop(0) if more and more[0] in histograms.BEHAVIOURS else "STANDARD", more

    def _has(self, reference: str, attribute: str) -> bool:
        """Whether a reference, or what it leads to, has such a number."""
        ref = self.ctx.collection.reference(reference)
        a = ref.attributes.get(attribute) or self.ctx.catalog[ref.target].attributes.get(attribute)
        return a is not None and a.type in ("int", "decimal") and not a.range

    def _reference_histograms(self, reference: str, c: Constraint, strict: bool) -> dict[str, DataFrame]:
        """The histograms that a summary asks for; of many references those that have the attribute."""
        drawn = [(n, behaviour, a) for h in c.all("histogramStatistics") for n, behaviour, more in [self._drawn(h)] for a in more]
        return {f"referenceHistogram:{reference}:{a}": self.reference_histogram(reference, a, n, behaviour) for n, behaviour, a in drawn if strict or self._has(reference, a)}

    def run(self, spark: SparkSession | None = None) -> Response:
        spark = spark or self.ctx.collection.frame.sparkSession
        began = time.perf_counter()
        with tagged(spark, self.labels):
            self._debug()
            page = self.page()
            planned = time.perf_counter()
            extras = self.extras()
            telemetry = {}
            for c in self._find("queryTelemetry"):
                wanted = set(c.values) or {"PLAN", "TIMINGS"}
                if not wanted <= {"PLAN", "TIMINGS"}:
                    raise QueryError("queryTelemetry knows PLAN and TIMINGS")
                if "PLAN" in wanted:
                    telemetry |= {"page": page._jdf.queryExecution().toString(), **{k: v._jdf.queryExecution().toString() for k, v in extras.items()}}
                if "TIMINGS" in wanted:
                    telemetry["timings"] = f"count and plan of the page {planned - began:.6f} s, plans of extra results {time.perf_counter() - planned:.6f} s"
            return Response(page, self._slice[1], extras, telemetry, self.labels)


    def _debug(self) -> None:
        """debug: VERIFY modes hold the matching entities against those found by another plan; modes that prefer a path leave it to Catalyst."""
        modes = {v for c in self._find("debug") for v in c.values}
        if unknown := modes - set(DEBUG):
            raise QueryError(f"debug doesn't know {sorted(unknown)[0]}")
        if any(m.startswith("VERIFY") for m in modes):
            found = self.matching.select("pk")
            other = self._preferred(filters.entities_by_marks(self.ctx, [*self.mandatory, *self.user])).select("pk")
            if not found.exceptAll(other).isEmpty() or not other.exceptAll(found).isEmpty():
                raise AssertionError("two plans of the filter differ")


def run(catalog: Catalog, tree: Constraint | str, *positional, **named) -> Response:
    return Query(catalog, tree, *positional, **named).run()
