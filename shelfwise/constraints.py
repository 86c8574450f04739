"""The query language as immutable trees, with one constructor for each constraint.

`filterBy(attributeEquals("code", "x"))` in Python and the same text parsed by
`shelfwise.language` give equal trees. Constructors whose names are Python
keywords end in an underscore (`and_`, `or_`, `not_`).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

# The names of the language, by the clause that they belong to.
HEAD = ("query", "head", "collection", "label")
FILTER = (
    "filterBy", "filterGroupBy", "and", "or", "not", "userFilter", "scope",
    "attributeEquals", "attributeGreaterThan", "attributeGreaterThanEquals", "attributeLessThan", "attributeLessThanEquals",
    "attributeBetween", "attributeInSet", "attributeContains", "attributeStartsWith", "attributeEndsWith", "attributeIs", "attributeInRange",
    "entityPrimaryKeyInSet", "entityPrimaryKeyGreaterThan", "entityPrimaryKeyGreaterThanEquals", "entityPrimaryKeyLessThan",
    "entityPrimaryKeyLessThanEquals", "entityPrimaryKeyBetween", "entityLocaleEquals",
    "priceInCurrency", "priceInPriceLists", "priceValidIn", "priceBetween",
    "referenceHaving", "entityHaving", "groupHaving", "facetHaving", "includingChildren", "includingChildrenHaving", "includingChildrenExcept", "histogramHaving",
    "hierarchyWithin", "hierarchyWithinSelf", "hierarchyWithinRoot", "hierarchyWithinRootSelf", "directRelation", "having", "anyHaving", "excluding", "excludingRoot",
)
ORDER = (
    "orderBy", "orderGroupBy", "attributeNatural", "attributeSetExact", "attributeSetInFilter", "entityPrimaryKeyNatural", "entityPrimaryKeyExact",
    "entityPrimaryKeyInFilter", "priceNatural", "priceDiscount", "random", "referenceProperty", "pickFirstByEntityProperty", "traverseByEntityProperty",
    "entityProperty", "entityGroupProperty", "segments", "segment", "limit",
)
REQUIRE = (
    "require", "page", "strip", "spacing", "gap", "entityFetch", "entityGroupFetch", "attributeContent", "associatedDataContent", "priceContent",
    "accompanyingPriceContent", "defaultAccompanyingPriceLists", "referenceContent", "referenceContentWithAttributes", "hierarchyContent", "dataInLocales", "priceType",
    "attributeHistogram", "priceHistogram", "referenceSummary", "referenceSummaryOfReference", "histogramStatistics",
    "facetGroupsConjunction", "facetGroupsDisjunction", "facetGroupsNegation", "facetGroupsExclusivity", "facetCalculationRules",
    "hierarchyOfSelf", "hierarchyOfReference", "fromRoot", "fromNode", "children", "parents", "siblings", "stopAt", "distance", "level", "node", "statistics",
    "queryTelemetry", "debug",
)
BOTH = ("inScope",)


class QueryError(ValueError):
    """A query that the language or the schema doesn't allow."""


@dataclass(frozen=True)
class Constraint:
    name: str
    args: tuple

    @property
    def children(self) -> tuple[Constraint, ...]:
        return tuple(a for a in self.args if isinstance(a, Constraint))

    @property
    def values(self) -> tuple:
        return tuple(a for a in self.args if not isinstance(a, Constraint))

    def child(self, *names: str) -> Constraint | None:
        """The first child of one of these names."""
        return next((c for c in self.children if c.name in names), None)

    def all(self, *names: str) -> list[Constraint]:
        return [c for c in self.children if c.name in names]

    def walk(self):
        yield self
        for c in self.children:
            yield from c.walk()

    def __str__(self) -> str:
        return f"{self.name}({', '.join(_text(a) for a in self.args)})"


def _text(a: Any) -> str:
    if isinstance(a, str):
        return "'" + a.replace("'", "\\'") + "'"
    return str(a).lower() if isinstance(a, bool) else str(a)


@dataclass(frozen=True)
class Range:
    """A closed range; a bound of None is open, but not both."""

    low: Any
    high: Any

    def __post_init__(self):
        if self.low is None and self.high is None:
            raise QueryError("a range needs one bound at least")

    def __str__(self) -> str:
        return f"[{'' if self.low is None else self.low},{'' if self.high is None else self.high}]"


NOW = "\0now"


def _short(name: str, base: str, before: tuple = (), after: tuple = ()) -> Callable[..., Constraint]:
    return lambda *args: build(base, *before, *args, *after)


#: Shorthand spellings and the constraints that they stand for.
SHORT: dict[str, Callable[..., Constraint]] = {
    "attributeEqualsTrue": _short("attributeEqualsTrue", "attributeEquals", after=(True,)),
    "attributeEqualsFalse": _short("attributeEqualsFalse", "attributeEquals", after=(False,)),
    "attributeIsNull": _short("attributeIsNull", "attributeIs", after=("NULL",)),
    "attributeIsNotNull": _short("attributeIsNotNull", "attributeIs", after=("NOT_NULL",)),
    "attributeInRangeNow": _short("attributeInRangeNow", "attributeInRange", after=(NOW,)),
    "priceValidInNow": _short("priceValidInNow", "priceValidIn", after=(NOW,)),
    "randomWithSeed": _short("randomWithSeed", "random"),
    "attributeContentAll": _short("attributeContentAll", "attributeContent"),
    "associatedDataContentAll": _short("associatedDataContentAll", "associatedDataContent"),
    "priceContentAll": _short("priceContentAll", "priceContent", before=("ALL",)),
    "priceContentRespectingFilter": _short("priceContentRespectingFilter", "priceContent", before=("RESPECTING_FILTER",)),
    "accompanyingPriceContentDefault": _short("accompanyingPriceContentDefault", "accompanyingPriceContent"),
    "dataInLocalesAll": _short("dataInLocalesAll", "dataInLocales"),
    "referenceContentAll": _short("referenceContentAll", "referenceContent"),
    "referenceContentAllWithAttributes": _short("referenceContentAllWithAttributes", "referenceContentWithAttributes"),
    "referenceSummaryWithHistograms": _short("referenceSummaryWithHistograms", "referenceSummary"),
    "referenceSummaryOfReferenceWithHistograms": _short("referenceSummaryOfReferenceWithHistograms", "referenceSummaryOfReference"),
    "facetSummary": _short("facetSummary", "referenceSummary"),
    "facetSummaryOfReference": _short("facetSummaryOfReference", "referenceSummaryOfReference"),
}

KNOWN = frozenset(HEAD + FILTER + ORDER + REQUIRE + BOTH)

#: Least number of arguments, where there is one.
_LEAST = {
    "collection": 1, "label": 2, "not": 1, "scope": 1, "attributeEquals": 2, "attributeGreaterThan": 2, "attributeGreaterThanEquals": 2, "attributeLessThan": 2,
    "attributeLessThanEquals": 2, "attributeBetween": 2, "attributeInSet": 1, "attributeContains": 2, "attributeStartsWith": 2, "attributeEndsWith": 2,
    "attributeIs": 2, "attributeInRange": 2, "entityPrimaryKeyGreaterThan": 1, "entityPrimaryKeyGreaterThanEquals": 1, "entityPrimaryKeyLessThan": 1,
    "entityPrimaryKeyLessThanEquals": 1, "entityPrimaryKeyBetween": 2, "entityLocaleEquals": 1, "priceInCurrency": 1, "priceValidIn": 1, "priceBetween": 2,
    "referenceHaving": 1, "facetHaving": 1, "histogramHaving": 1, "hierarchyWithin": 2, "hierarchyWithinSelf": 1, "hierarchyWithinRoot": 1, "inScope": 2,
    "attributeNatural": 1, "attributeSetExact": 2, "attributeSetInFilter": 1, "referenceProperty": 2, "segment": 1, "limit": 1, "gap": 2,
    "attributeHistogram": 2, "priceHistogram": 1, "distance": 1, "level": 1, "node": 1, "stopAt": 1, "fromNode": 2, "fromRoot": 1, "children": 1, "parents": 1,
}


def build(name: str, *args: Any) -> Constraint:
    """The constraint of this name; shorthands give what they stand for, None children are left out."""
    if name in SHORT:
        return SHORT[name](*args)
    if name not in KNOWN:
        raise QueryError(f"unknown constraint {name}")
    if len(args) < _LEAST.get(name, 0):
        raise QueryError(f"{name} needs {_LEAST[name]} arguments at least")
    if name in ("attributeBetween", "entityPrimaryKeyBetween", "priceBetween") and args[-1] is None and args[-2] is None:
        raise QueryError(f"{name} needs one bound at least")
    flat = tuple(tuple(a) if isinstance(a, list) else a for a in args)
    return Constraint(name, flat)


def __getattr__(name: str) -> Callable[..., Constraint]:
    plain = name.rstrip("_")
    if plain in KNOWN or plain in SHORT:
        return lambda *args: build(plain, *args)
    raise AttributeError(name)
