"""The price for sale, and what is computed from it.

Candidates are indexed prices in the currency, in the price lists and valid at
the moment. In each inner record (or entity, where these aren't handled) the
price of the list named first wins. An amount filter acts on each inner record
for LOWEST_PRICE, and on the sum or the single price otherwise; then LOWEST_PRICE
takes the cheapest inner record left and SUM adds them up.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.constraints import Constraint, QueryError
from shelfwise.operators.context import Context

NONE, LOWEST, SUM = "NONE", "LOWEST_PRICE", "SUM"


def _prices(ctx: Context) -> DataFrame:
    if ctx.collection.prices is None:
        raise QueryError(f"collection {ctx.collection.name} has no prices")
    return ctx.collection.prices


def candidates(ctx: Context, lists: tuple[str, ...] | None) -> DataFrame:
    """Indexed prices that the terms allow, of these lists (None: of any)."""
    t = ctx.prices
    p = _prices(ctx).where("indexed")
    if t.currency is not None:
        p = p.where(F.col("currency") == t.currency)
    if t.valid_in is not None:
        at = F.lit(t.valid_in)
        p = p.where((F.col("valid_from").isNull() | (F.col("valid_from") <= at)) & (F.col("valid_to").isNull() | (F.col("valid_to") >= at)))
    if lists is not None:
        p = p.where(F.col("price_list").isin(*lists)) if lists else p.where("false")
    return p


def _rank(lists: tuple[str, ...] | None) -> Column:
    return F.array_position(F.array(*(F.lit(x) for x in lists)), F.col("price_list")) if lists else F.lit(0)


def _handled(ctx: Context, p: DataFrame, entities: DataFrame | None) -> DataFrame:
    """Prices of these entities (None: of all in scope) with how their inner records are handled, and the inner record."""
    handling = (ctx.rows() if entities is None else entities).select("pk", "inner_record_handling")
    return p.join(handling, "pk").withColumn("inner", F.when(F.col("inner_record_handling") == NONE, F.lit(None)).otherwise(F.coalesce("inner_record_id", F.lit(0))))


def _picked(ctx: Context, lists: tuple[str, ...] | None, entities: DataFrame | None = None) -> DataFrame:
    """(pk, inner, handling, amount, price): per inner record the price of the first list that has one."""
    p = _handled(ctx, candidates(ctx, lists), entities)
    price = F.struct("price_id", "price_list", "currency", "price_without_tax", "price_with_tax")
    # Of several prices of one list the one with the lowest identifier.
    first = p.groupBy("pk", "inner_record_handling", "inner").agg(F.min_by(price, F.struct(_rank(lists), "price_id")).alias("price"))
    return first.withColumn("amount", F.col(f"price.{ctx.prices.amount}"))


def _between(amount: Column, low: Any, high: Any) -> Column:
    return (amount >= F.lit(low) if low is not None else F.lit(True)) & (amount <= F.lit(high) if high is not None else F.lit(True))


def for_sale(ctx: Context, low: Any = None, high: Any = None, lists: tuple[str, ...] | None = None, entities: DataFrame | None = None) -> DataFrame:
    """(pk, amount, price, inner): the price for sale of every entity that has one within the bounds.

    lists: other price lists than the query's; entities: those to look at, if not
    all in scope. `price` is the price itself, for SUM that of the first inner
    record; `inner` the inner record that a LOWEST_PRICE comes from.
    """
    p = _picked(ctx, ctx.prices.lists if lists is None else lists, entities)
    if low is not None or high is not None:
        p = p.where((F.col("inner_record_handling") != LOWEST) | _between(F.col("amount"), low, high))
    cheapest = F.min_by(F.struct("amount", "price", "inner"), F.struct("amount", "inner"))
    out = p.groupBy("pk", "inner_record_handling").agg(cheapest.alias("least"), F.sum("amount").alias("total"), F.min_by("price", F.struct("inner")).alias("first"), F.min("inner").alias("first_inner"))
    is_sum = F.col("inner_record_handling") == SUM
    out = out.select("pk", F.when(is_sum, F.col("total")).otherwise(F.col("least.amount")).alias("amount"), F.when(is_sum, F.col("first")).otherwise(F.col("least.price")).alias("price"), F.when(is_sum, F.col("first_inner")).otherwise(F.col("least.inner")).alias("inner"), "inner_record_handling")
    if low is not None or high is not None:
        out = out.where((F.col("inner_record_handling") == LOWEST) | _between(F.col("amount"), low, high))
    return out.select("pk", "amount", "price", "inner", "inner_record_handling")


def sold(ctx: Context, between: Constraint | None, entities: DataFrame | None = None) -> DataFrame:
    """The price for sale, within the bounds of a priceBetween if there is one."""
    if between is None:
        return for_sale(ctx, entities=entities)
    if ctx.prices.lists is None or ctx.prices.currency is None:
        raise QueryError("priceBetween needs priceInCurrency and priceInPriceLists")
    return for_sale(ctx, *between.values[:2], entities=entities)


def test(ctx: Context, c: Constraint, entities: DataFrame | None = None) -> DataFrame:
    """(pk) of entities that satisfy a price constraint; all but the amount filter mean that there is a price for sale, so any candidate."""
    if c.name == "priceBetween":
        return sold(ctx, c, entities).select("pk")
    return candidates(ctx, ctx.prices.lists).select("pk").distinct()


def discount(ctx: Context, lists: tuple[str, ...]) -> DataFrame:
    """(pk, discount): the price under the other lists less the selling price, 0 at least.

    The inner records are those that the selling price was made of; entities
    without a price under the other lists have no row. Both prices are picked in
    one pass over the prices of all lists.
    """
    own = ctx.prices.lists
    p = _handled(ctx, candidates(ctx, None if own is None else tuple(dict.fromkeys((*own, *lists)))), None)
    amount = F.col(ctx.prices.amount)

    def first(of: tuple[str, ...] | None) -> Column:
        place = F.struct(_rank(of), "price_id")
        return F.min_by(amount, place if of is None else F.when(F.col("price_list").isin(*of), place))

    p = p.groupBy("pk", "inner_record_handling", "inner").agg(first(own).alias("amount"), first(lists).alias("reference")).where("amount is not null")
    least = F.min_by(F.struct("amount", "reference"), F.struct("amount", "inner"))
    out = p.groupBy("pk", "inner_record_handling").agg(least.alias("least"), F.sum("amount").alias("total"), F.sum("reference").alias("references"))
    is_sum = F.col("inner_record_handling") == SUM
    less = F.when(is_sum, F.col("references") - F.col("total")).otherwise(F.col("least.reference") - F.col("least.amount"))
    return out.select("pk", F.greatest(less, F.lit(0)).alias("discount"), less.isNotNull().alias("__has")).where("__has").drop("__has")
