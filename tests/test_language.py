from datetime import date, datetime, timezone
from decimal import Decimal

import pytest

from shelfwise import constraints as c
from shelfwise.constraints import QueryError, Range, build
from shelfwise.language import parse, purify


def test_text_and_python_give_one_tree():
    text = "query(collection('product'), filterBy(and(attributeEquals('code', 'x'), not(attributeIsNull(\"y\")))), require(page(1, 20)))"
    tree = c.query(c.collection("product"), c.filterBy(c.and_(c.attributeEquals("code", "x"), c.not_(c.attributeIs("y", "NULL")))), c.require(c.page(1, 20)))
    assert parse(text) == tree and parse(str(tree)) == tree


@pytest.mark.parametrize(
    "text, value",
    [("'it\\'s'", "it's"), ("-3", -3), ("2.50", Decimal("2.50")), ("true", True), ("2021-01-31", date(2021, 1, 31)), ("2021-01-31T10:00:00Z", datetime(2021, 1, 31, 10, tzinfo=timezone.utc)), ("[1,5]", Range(1, 5)), ("[,5]", Range(None, 5)), ("ASC", "ASC"), ("{1,2}", (1, 2))],
)
def test_values(text, value):
    assert parse(f"attributeEquals('a', {text})").values[1] == value


def test_parameters():
    assert parse("attributeBetween(?, @low, ?)", "size", 9, low=3) == build("attributeBetween", "size", 3, 9)
    with pytest.raises(QueryError):
        parse("attributeEquals(?, ?)", "a")
    with pytest.raises(QueryError):
        parse("attributeEquals('a', 1)", safe=True)
    assert parse("attributeEquals(?, ?)", "a", 1, safe=True).values == ("a", 1)


@pytest.mark.parametrize("text", ["unknownThing('a')", "attributeEquals('a')", "attributeBetween('a', null, null)", "attributeEquals('a', 1", "attributeEquals('a', 1))", "[,]", "attributeEquals('a', [,])", "page(1 2)", "@"])
def test_errors(text):
    with pytest.raises(QueryError):
        parse(text)


@pytest.mark.parametrize("name", sorted(c.KNOWN | set(c.SHORT)))
def test_every_name_has_a_constructor(name):
    assert callable(getattr(c, name)) and callable(getattr(c, name + "_"))


def test_shorthands():
    assert c.attributeEqualsTrue("a") == c.attributeEquals("a", True) and c.facetSummary() == c.referenceSummary() and c.randomWithSeed(4) == c.random(4)
    assert c.priceContentAll() == c.priceContent("ALL") and c.attributeInRangeNow("v").values[1] == c.NOW


def test_purify():
    assert purify(parse("filterBy(and(or(attributeIsNull('a')), and()))")) == parse("filterBy(attributeIsNull('a'))")
    assert purify(parse("query(collection('a'), filterBy(and()))")) == parse("query(collection('a'))")
