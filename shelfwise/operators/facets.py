"""Facets: what a selection of them selects, how many entities each has, and what adding one would do.

Facets of a group are combined by one relation, groups by another; by default a
group is satisfied by any of its selected facets, and all groups must be. Both
can be set for a query, and for single groups.

Impact is worked out for all facets at once: an entity's state under the current
selection is how many units of it (a group, or all groups joined by "or") it fails;
adding a facet can only help entities that fail nothing else than its own unit.
The facets of the entities that count, and those that are selected, are
checkpointed once, as each is needed several times; what is said of the selection as
a whole - its units, how many entities satisfy it - is a scalar subquery.

A selection that no facet answers to is satisfied by no entity.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.constraints import Constraint, QueryError
from shelfwise.operators import filters, hierarchy
from shelfwise.operators.context import Context
from shelfwise.scratch import checkpointed

DISJUNCTION, CONJUNCTION, NEGATION, EXCLUSIVITY = "DISJUNCTION", "CONJUNCTION", "NEGATION", "EXCLUSIVITY"
IN_GROUP, BETWEEN = "WITH_DIFFERENT_FACETS_IN_GROUP", "WITH_DIFFERENT_GROUPS"
_BY_NAME = {"facetGroupsConjunction": CONJUNCTION, "facetGroupsDisjunction": DISJUNCTION, "facetGroupsNegation": NEGATION, "facetGroupsExclusivity": EXCLUSIVITY}
#: The unit of all groups that are joined by "or".
_ANY = -(2**62)


@dataclass(frozen=True)
class Rules:
    in_group: str = DISJUNCTION
    between: str = CONJUNCTION
    special: tuple[Constraint, ...] = field(default=())

    @staticmethod
    def of(require: Constraint | None) -> Rules:
        found = {c.name: c for c in require.children} if require else {}
        defaults = found["facetCalculationRules"].values if "facetCalculationRules" in found else (DISJUNCTION, CONJUNCTION)
        return Rules(*defaults, tuple(c for c in (require.children if require else ()) if c.name in _BY_NAME))

    def relation(self, ctx: Context, reference: str, level: str, groups: DataFrame) -> DataFrame:
        """`groups` (group_pk) with the relation that holds in, or between, them."""
        out = groups.withColumn("relation", F.lit(self.in_group if level == IN_GROUP else self.between))
        for c in self.special:
            name, *more = c.values
            if name != reference or (more[0] if more else IN_GROUP) != level:
                continue
            this = F.lit(_BY_NAME[c.name])
            if not c.child("filterBy"):
                out = out.withColumn("relation", this)
                continue
            target = ctx.collection.reference(reference).group
            if target is None:
                raise QueryError(f"reference {reference} has no groups to filter")
            hit = filters.entities(ctx.on(target), c.child("filterBy").children).select(F.col("pk").alias("__g"), F.lit(True).alias("__hit"))
            out = out.join(hit, F.col("group_pk") == F.col("__g"), "left").withColumn("relation", F.when(F.col("__hit"), this).otherwise(F.col("relation"))).drop("__g", "__hit")
        return out


def facet_rows(ctx: Context, name: str) -> DataFrame:
    """(pk, group_pk, ref_pk) of a reference's edges that are facets; edges without a group form group -1."""
    reference = ctx.collection.reference(name)
    if not reference.faceted:
        raise QueryError(f"reference {name} is not faceted")
    rows = reference.frame.where(reference.faceted_when) if reference.faceted_when else reference.frame
    return rows.select("pk", F.coalesce("group_pk", F.lit(-1)).cast("long").alias("group_pk"), "ref_pk").distinct()


def chosen(ctx: Context, c: Constraint) -> DataFrame:
    """(group_pk, ref_pk) of the facets that a facetHaving selects, its children rules included."""
    name = c.values[0]
    below = [x for x in c.children if x.name.startswith("includingChildren")]
    rest = [x for x in c.children if x not in below]
    picked = filters.references(ctx, name, rest).select("ref_pk").distinct()
    if below:
        target = ctx.on(ctx.collection.reference(name).target)
        if all(x.name == "entityHaving" or x.name.startswith("entityPrimaryKey") for x in rest):
            # A node can be chosen for its children though nothing refers to itself.
            opened = [y for x in rest for y in (x.children if x.name == "entityHaving" else (x,))]
            picked = filters.entities(target, opened).select(F.col("pk").alias("ref_pk"))
        start = picked.select(F.col("ref_pk").alias("__start"))
        tree = hierarchy.closure(hierarchy.nodes(target))
        down = tree.join(start, F.col("ancestor") == F.col("__start"), "left_semi").select(F.col("node").alias("ref_pk"), F.col("distance"))
        if below[0].name != "includingChildren":
            hits = filters.entities(target, below[0].children).select(F.col("pk").alias("__h"))
            how = "left_semi" if below[0].name == "includingChildrenHaving" else "left_anti"
            down = down.where("distance > 0").join(hits, F.col("ref_pk") == F.col("__h"), how)
        picked = picked.unionByName(down.select("ref_pk")).distinct()
    return facet_rows(ctx, name).join(picked, "ref_pk", "left_semi").select("group_pk", "ref_pk").distinct()


def _states(ctx: Context, c: Constraint, rules: Rules, picked: DataFrame | None = None, facets: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Groups of a selection (group_pk, relation, n, unit, negated), and entities that satisfy one (pk, group_pk, unit); picked and facets, if they are at hand."""
    name = c.values[0]
    picked = chosen(ctx, c) if picked is None else picked
    groups = picked.groupBy("group_pk").agg(F.count_distinct("ref_pk").alias("n"))
    groups = rules.relation(ctx, name, IN_GROUP, groups)
    between = rules.relation(ctx, name, BETWEEN, groups.select("group_pk")).withColumnRenamed("relation", "between")
    groups = groups.join(between, "group_pk")
    negated = (F.col("relation") == NEGATION) | (F.col("between") == NEGATION)
    groups = groups.withColumn("negated", negated).withColumn("unit", F.when(F.col("between") == DISJUNCTION, F.lit(_ANY)).otherwise(F.col("group_pk")))
    hits = (facet_rows(ctx, name) if facets is None else facets).join(picked, ["group_pk", "ref_pk"], "left_semi").groupBy("pk", "group_pk").agg(F.count_distinct("ref_pk").alias("k"))
    hits = hits.join(groups, "group_pk")
    good = F.when(F.col("negated"), F.lit(True)).when(F.col("relation") == CONJUNCTION, F.col("k") == F.col("n")).otherwise(F.lit(True))
    return groups, hits.where(good).select("pk", "group_pk", "unit", "negated")


def selected(ctx: Context, c: Constraint, rules: Rules, entities: DataFrame | None = None) -> DataFrame:
    """(key) of entities that satisfy a facetHaving, of these (pk) or of all in scope."""
    entities = ctx.rows().select("pk") if entities is None else entities
    return unmet(ctx, c, rules, entities).where("unmet = 0").select(F.col("pk").alias("key"))


def _units(groups: DataFrame) -> Column:
    """The units that must be satisfied; null if the selection has no facet at all."""
    # As many as the groups that a user has selected.
    units = groups.select("unit", "negated").distinct()
    wanted = F.sort_array(F.collect_set(F.when(~F.col("negated"), F.col("unit"))))
    return units.agg(F.when(F.count(F.lit(1)) > 0, wanted).alias("wanted")).scalar()


def unmet(ctx: Context, c: Constraint, rules: Rules, entities: DataFrame, picked: DataFrame | None = None, facets: DataFrame | None = None) -> DataFrame:
    """`entities` (pk) with how many units of the selection each fails (null if there is no facet to satisfy), and one that it fails."""
    groups, hits = _states(ctx, c, rules, picked, facets)
    held = hits.groupBy("pk").agg(F.collect_set(F.when(~F.col("negated"), F.col("unit"))).alias("has"), F.collect_set(F.when(F.col("negated"), F.col("unit"))).alias("bad"))
    none = F.array().cast("array<bigint>")
    out = entities.join(held, "pk", "left").withColumn("wanted", _units(groups))
    missing = F.concat(F.array_except("wanted", F.coalesce("has", none)), F.coalesce("bad", none))
    out = out.withColumn("missing", missing)
    return out.select(*entities.columns, F.when(F.col("wanted").isNotNull(), F.size("missing")).alias("unmet"), F.get("missing", 0).alias("failed"))


def summary(ctx: Context, name: str, mandatory: DataFrame, others: DataFrame, selection: Constraint | None, rules: Rules, impact: bool) -> DataFrame:
    """reference, group_pk, facet_pk, count, group_count, requested; with impact also match_count, difference, has_sense.

    mandatory: (pk) by the filter without its user part, the base of the counts;
    others: (pk) by the whole filter but for the selection on this reference.
    """
    facets = checkpointed(facet_rows(ctx, name).join(mandatory.select("pk"), "pk", "left_semi"))
    picked = None if selection is None else checkpointed(chosen(ctx, selection))
    # One pass over the facets of the entities that count, with their state under the selection.
    state = mandatory.select("pk")
    if impact:
        now = unmet(ctx, selection, rules, others.select("pk"), picked, facets) if selection is not None else others.select("pk", F.lit(0).alias("unmet"), F.lit(None).cast("bigint").alias("failed"))
        state = state.join(now, "pk", "left")
    groups = facets.select("group_pk").distinct()
    rows = facets.join(state, "pk") if impact else facets.withColumn("unmet", F.lit(None).cast("int")).withColumn("failed", F.lit(None).cast("bigint"))
    if impact:
        related = rules.relation(ctx, name, IN_GROUP, groups).join(rules.relation(ctx, name, BETWEEN, groups).withColumnRenamed("relation", "between"), "group_pk")
        related = related.withColumn("unit", F.when(F.col("between") == DISJUNCTION, F.lit(_ANY)).otherwise(F.col("group_pk")))
        rows = rows.join(related, "group_pk")
    else:
        rows = rows.withColumn("unit", F.lit(None).cast("bigint"))
    kept = ["group_pk", "ref_pk", *(["relation", "between", "unit"] if impact else [])]
    sums = rows.groupBy(*kept).agg(F.count(F.lit(1)).alias("count"), F.count_if(F.col("unmet") == 0).alias("met"), F.count_if((F.col("unmet") == 1) & (F.col("failed") == F.col("unit"))).alias("gained"))
    by_group = facets.groupBy("group_pk").agg(F.count_distinct("pk").alias("group_count"))
    out = sums.join(by_group, "group_pk")
    if selection is not None:
        mark = picked.select("group_pk", "ref_pk", F.lit(True).alias("requested"))
        out = out.join(mark, ["group_pk", "ref_pk"], "left").withColumn("requested", F.coalesce("requested", F.lit(False)))
    else:
        out = out.withColumn("requested", F.lit(False))
    if impact:
        out = out.withColumn("base", state.agg(F.count_if(F.col("unmet") == 0)).scalar())
        base = F.col("base")
        active = _units(_states(ctx, selection, rules, picked, facets)[0]) if selection is not None else F.array().cast("array<bigint>")
        out = out.withColumn("is_active", F.coalesce(F.array_contains(active, F.col("unit")), F.lit(False)))
        negated = (F.col("relation") == NEGATION) | (F.col("between") == NEGATION)
        exclusive = (F.col("relation") == EXCLUSIVITY) | (F.col("between") == EXCLUSIVITY)
        match = (
            F.when(negated, base - F.col("met"))
            .when(exclusive, F.col("met") + F.col("gained"))
            .when(F.col("is_active") & ((F.col("relation") == DISJUNCTION) | (F.col("between") == DISJUNCTION)), base + F.col("gained"))
            .otherwise(F.col("met"))
        )
        out = out.withColumn("match_count", match.cast("long")).withColumn("difference", (F.col("match_count") - base).cast("long"))
        out = out.withColumn("has_sense", (F.col("match_count") > 0) & ((F.col("difference") != 0) | ~F.col("requested")))
    fields = ["group_pk", "ref_pk", "count", "group_count", "requested"] + ["match_count", "difference", "has_sense"] * impact
    return out.select(F.lit(name).alias("reference"), *fields).withColumnRenamed("ref_pk", "facet_pk")
