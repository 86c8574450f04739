"""Collections of entities as DataFrames, with the flags that queries are checked against."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from shelfwise.constraints import QueryError


@dataclass(frozen=True)
class Attribute:
    """type: string, int, decimal, boolean, timestamp or date; range: a struct of such a from and to; array: an array of them."""

    type: str = "string"
    filterable: bool = True
    sortable: bool = True
    unique: bool = False
    localized: bool = False
    array: bool = False
    range: bool = False


@dataclass(frozen=True)
class Reference:
    """frame: (pk, ref_pk, group_pk, attributes...), one row for each edge."""

    frame: DataFrame
    target: str
    group: str | None = None
    faceted: bool = False
    attributes: dict[str, Attribute] = field(default_factory=dict)
    #: SQL condition under which an edge is a facet, else all are.
    faceted_when: str | None = None


@dataclass(frozen=True)
class Collection:
    """frame: (pk, scope, attributes...), with parent_pk if hierarchical, locales if localized, inner_record_handling if priced.

    prices: (pk, price_id, price_list, currency, inner_record_id, price_without_tax, price_with_tax, valid_from, valid_to, indexed).
    compounds: name to (attribute, ASC or DESC, FIRST or LAST for nulls).
    """

    name: str
    frame: DataFrame
    attributes: dict[str, Attribute]
    references: dict[str, Reference] = field(default_factory=dict)
    prices: DataFrame | None = None
    hierarchical: bool = False
    compounds: dict[str, tuple[tuple[str, str, str], ...]] = field(default_factory=dict)
    associated: tuple[str, ...] = ()

    def attribute(self, name: str) -> Attribute:
        if name not in self.attributes:
            raise QueryError(f"collection {self.name} has no attribute {name}")
        return self.attributes[name]

    def reference(self, name: str) -> Reference:
        if name not in self.references:
            raise QueryError(f"collection {self.name} has no reference {name}")
        return self.references[name]


@dataclass(frozen=True)
class Catalog:
    collections: dict[str, Collection]

    def __getitem__(self, name: str) -> Collection:
        if name not in self.collections:
            raise QueryError(f"unknown collection {name}")
        return self.collections[name]

    def with_attribute(self, attribute: str) -> list[Collection]:
        """Collections that have this globally unique attribute, for queries without a collection."""
        return [c for c in self.collections.values() if attribute in c.attributes and c.attributes[attribute].unique]


def reflected(reference: Reference, target: str) -> Reference:
    """The inverse of a reference: the same edges, seen from the other end."""
    turned = {"pk": "ref_pk", "ref_pk": "pk"}
    frame = reference.frame.toDF(*(turned.get(c, c) for c in reference.frame.columns))
    return Reference(frame, target, None, reference.faceted, reference.attributes)
