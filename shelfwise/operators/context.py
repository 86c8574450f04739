"""What the operators of one query share: its collection, locale, scopes, moment and price terms."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.catalog import Attribute, Catalog, Collection
from shelfwise.constraints import NOW, Constraint, QueryError

LIVE, ARCHIVED = "LIVE", "ARCHIVED"


@dataclass(frozen=True)
class PriceTerms:
    currency: str | None = None
    lists: tuple[str, ...] | None = None
    valid_in: Any = None
    amount: str = "price_with_tax"


@dataclass(frozen=True)
class Context:
    catalog: Catalog
    collection: Collection
    locale: str | None = None
    scopes: tuple[str, ...] = (LIVE,)
    now: datetime = field(default_factory=lambda: datetime.now(timezone.utc))
    prices: PriceTerms = PriceTerms()
    #: How facets are combined (facets.Rules); of the query's own collection, so none on others.
    rules: Any = None

    def on(self, collection: str) -> Context:
        """The same terms on another collection."""
        other = self.catalog[collection]
        return replace(self, collection=other, rules=self.rules if other is self.collection else None)

    def moment(self, value: Any) -> Any:
        """`now` is one moment for the whole query."""
        return self.now if value == NOW else value

    def rows(self) -> DataFrame:
        """The collection's entities in the searched scopes."""
        df = self.collection.frame
        return df.where(F.col("scope").isin(*self.scopes)) if "scope" in df.columns else df

    def column(self, name: str) -> Column:
        """An entity attribute, in the query's locale if it is localized."""
        return localized(self.collection.attribute(name), name, self.locale)


def localized(attribute: Attribute, name: str, locale: str | None) -> Column:
    if not attribute.localized:
        return F.col(name)
    if locale is None:
        raise QueryError(f"attribute {name} is localized; the query needs entityLocaleEquals")
    return F.col(name).getItem(locale)


def terms_of(filter_by: Constraint | None, require: Constraint | None, now: datetime) -> dict:
    """Locale, scopes and price terms that a query's clauses fix, wherever they stand in them."""
    out: dict = {"scopes": (LIVE,)}
    currency, lists, valid, amount = None, None, None, "price_with_tax"
    separate = {"entityHaving", "groupHaving", "referenceHaving"}

    def look(c: Constraint, inside_user: bool) -> None:
        nonlocal currency, lists, valid
        if inside_user and c.name in ("priceInCurrency", "priceInPriceLists", "priceValidIn", "entityLocaleEquals", "scope"):
            raise QueryError(f"{c.name} can't be part of userFilter")
        if c.name == "entityLocaleEquals":
            out["locale"] = c.values[0]
        elif c.name == "scope":
            out["scopes"] = tuple(c.values)
        elif c.name == "priceInCurrency":
            if currency not in (None, c.values[0]):
                raise QueryError("a query has one currency at most")
            currency = c.values[0]
        elif c.name == "priceInPriceLists":
            lists = tuple(c.values)
        elif c.name == "priceValidIn":
            valid = now if c.values[0] == NOW else c.values[0]
        for child in c.children:
            if child.name not in separate:
                look(child, inside_user or c.name == "userFilter")

    if filter_by:
        look(filter_by, False)
    for c in require.walk() if require else ():
        if c.name == "priceType":
            amount = {"WITH_TAX": "price_with_tax", "WITHOUT_TAX": "price_without_tax"}[c.values[0]]
    return out | {"prices": PriceTerms(currency, lists, valid, amount)}
