"""Semantics on hand-made collections, where the right answer is plain to see."""

from datetime import datetime, timezone
from decimal import Decimal

import pytest

from shelfwise.catalog import Attribute, Catalog, Collection, Reference, reflected
from shelfwise.constraints import QueryError
from shelfwise.operators import chains, hierarchy, statistics
from shelfwise.operators.histograms import histogram
from shelfwise.plans.compiler import Query, run

NOW = datetime(2024, 1, 1, tzinfo=timezone.utc)


@pytest.fixture(scope="module")
def shop(spark):
    node = spark.createDataFrame([(1, "LIVE", None, "root", 3), (2, "LIVE", 1, "a", 2), (3, "LIVE", 1, "b", 1), (4, "LIVE", 2, "aa", 5), (5, "LIVE", 99, "orphan", 0), (6, "ARCHIVED", 1, "old", 1)], "pk int, scope string, parent_pk int, name string, rank int")
    item = spark.createDataFrame(
        [(1, "LIVE", "NONE", "x", ["en"], {"en": "chata"}, 5), (2, "LIVE", "LOWEST_PRICE", "y", ["en", "cs"], {"en": "b", "cs": "hora"}, None), (3, "LIVE", "SUM", "z", ["cs"], {"cs": "chata"}, 7), (4, "ARCHIVED", "NONE", "x", ["cs"], {"cs": "cena"}, 1), (5, "LIVE", "NONE", None, None, None, None)],
        "pk int, scope string, inner_record_handling string, code string, locales array<string>, name map<string,string>, size int",
    )
    t = lambda day: datetime(2024, 1, day)
    d = Decimal
    price = spark.createDataFrame(
        [
            (1, 1, "basic", "CZK", None, d(100), d(121), None, None, True), (1, 2, "vip", "CZK", None, d(80), d(97), t(5), t(9), True),
            (2, 3, "basic", "CZK", 10, d(50), d(60), None, None, True), (2, 4, "basic", "CZK", 11, d(70), d(85), None, None, True), (2, 5, "vip", "CZK", 11, d(40), d(48), None, None, True),
            (3, 6, "basic", "CZK", 20, d(10), d(12), None, None, True), (3, 7, "basic", "CZK", 21, d(20), d(24), None, None, True), (3, 8, "vip", "CZK", 21, d(15), d(18), None, None, False),
        ],
        "pk int, price_id long, price_list string, currency string, inner_record_id int, price_without_tax decimal(12,2), price_with_tax decimal(12,2), valid_from timestamp, valid_to timestamp, indexed boolean",
    )
    link = spark.createDataFrame([(1, 2, 7, 1), (1, 4, 7, 2), (2, 4, 8, 3), (3, 3, 8, 1), (3, 5, 8, 9)], "pk int, ref_pk int, group_pk int, priority int")
    reference = Reference(link, "node", "group", True, {"priority": Attribute("int")}, "priority < 9")
    group = spark.createDataFrame([(7, "LIVE", "g7"), (8, "LIVE", "g8")], "pk int, scope string, name string")
    return Catalog(
        {
            "item": Collection("item", item, {"code": Attribute(unique=True), "name": Attribute(localized=True), "size": Attribute("int"), "hidden": Attribute(filterable=False, sortable=False)}, {"node": reference}, price),
            "node": Collection("node", node, {"name": Attribute(), "rank": Attribute("int")}, {"items": reflected(reference, "item")}, hierarchical=True),
            "group": Collection("group", group, {"name": Attribute()}),
        }
    )


def keys(shop, text, *args):
    return sorted(r.pk for r in Query(shop, text, *args, now=NOW).matching.collect())


def page(shop, text):
    return [r.pk for r in sorted(Query(shop, text, now=NOW).run().page.collect(), key=lambda r: r["__position"])]


SALE = "priceInCurrency('CZK'), priceInPriceLists('vip', 'basic')"


@pytest.mark.parametrize(
    "filter_, want",
    [
        ("not(attributeEquals('code', 'x'))", [2, 3, 5]), ("scope(LIVE, ARCHIVED), attributeEquals('size', 1)", [4]), ("scope(ARCHIVED, LIVE), attributeEquals('code', 'x')", [4]), ("scope(LIVE, ARCHIVED), attributeEquals('code', 'x')", [1]),
        ("entityLocaleEquals('cs'), attributeEquals('name', 'chata')", [3]), ("attributeIsNull('size')", [2, 5]), ("attributeBetween('size', 5, 6)", [1]), ("attributeInSet('code')", []),
        (f"{SALE}, priceBetween(0, 50)", [2, 3]), (f"{SALE}, priceBetween(48, 48)", [2]), (f"{SALE}, priceBetween(60, 60)", [2]), (f"{SALE}, priceBetween(36, 36)", [3]), (f"{SALE}, priceBetween(97, 97)", [1]),
        (f"{SALE}, priceValidIn(2024-01-20T00:00:00Z), priceBetween(121, 121)", [1]), (f"{SALE}, priceValidInNow(), priceBetween(90, 100)", []), ("priceInCurrency('CZK'), priceInPriceLists()", []),
        ("hierarchyWithin('node', attributeEquals('name', 'a'))", [1, 2]), ("hierarchyWithinRoot('node')", [1, 2, 3]), ("hierarchyWithinRoot('node', having(attributeGreaterThan('rank', 1)))", [1, 2]), ("hierarchyWithinRoot('node', directRelation())", []),
        ("referenceHaving('node', attributeEquals('priority', 1), entityHaving(attributeEquals('name', 'a')))", [1]), ("referenceHaving('node', attributeEquals('priority', 2), entityHaving(attributeEquals('name', 'a')))", []), ("referenceHaving('node', groupHaving(attributeEquals('name', 'g8')))", [2, 3]),
        ("not(referenceHaving('node'))", [5]), ("or(referenceHaving('node', attributeEquals('priority', 3)), attributeEquals('size', 7))", [2, 3]), ("facetHaving('node', entityPrimaryKeyInSet(2), includingChildren())", []), ("facetHaving('node', entityPrimaryKeyInSet(5))", []),
        ("facetHaving('node', entityPrimaryKeyInSet(1), includingChildrenHaving(attributeEquals('name', 'b')))", [3]), ("facetHaving('node', entityPrimaryKeyInSet(2, 3))", []),
    ],
)
def test_filters(shop, filter_, want):
    """Node 4 is a facet of two groups, so a selection with it needs both; an edge that is no facet selects nothing, which nothing satisfies."""
    assert keys(shop, f"query(collection('item'), filterBy({filter_}))") == want


def test_trees(shop):
    q = lambda f: keys(shop, f"query(collection('node'), filterBy({f}))")
    assert q("hierarchyWithinRootSelf()") == [1, 2, 3, 4] and q("hierarchyWithinRootSelf(directRelation())") == [1]
    assert q("hierarchyWithinSelf(entityPrimaryKeyInSet(2))") == [2, 4] and q("hierarchyWithinSelf(entityPrimaryKeyInSet(2), excludingRoot())") == [4]
    assert q("hierarchyWithinRootSelf(anyHaving(attributeEquals('name', 'aa')))") == [1, 2, 4] and q("hierarchyWithinRootSelf(excluding(attributeEquals('name', 'a')))") == [1, 3]
    assert q("referenceHaving('items', entityHaving(attributeEquals('code', 'z')))") == [3, 5]


@pytest.mark.parametrize(
    "order, want",
    [
        ("attributeNatural('size', DESC)", [3, 1, 2, 5]), ("attributeNatural('size'), attributeNatural('code', DESC)", [1, 3, 2, 5]), ("entityPrimaryKeyExact(3, 5)", [3, 5, 1, 2]), ("attributeSetExact('code', 'z', 'x')", [3, 1, 2, 5]),
        ("referenceProperty('node', attributeNatural('priority'))", [1, 2, 3, 5]), ("referenceProperty('node', traverseByEntityProperty(BREADTH_FIRST, attributeNatural('rank')), attributeNatural('priority'))", [3, 1, 2, 5]),
        ("referenceProperty('node', traverseByEntityProperty(BREADTH_FIRST, attributeSetExact('name', 'b'), attributeNatural('name', DESC)), attributeNatural('priority'))", [3, 1, 2, 5]),
        ("referenceProperty('node', pickFirstByEntityProperty(attributeNatural('rank', DESC)), attributeNatural('priority', DESC))", [2, 1, 3, 5]),
        ("segments(segment(entityHaving(attributeIsNull('size')), orderBy(entityPrimaryKeyNatural(DESC)), limit(1)), segment(orderBy(attributeNatural('size', DESC))))", [5, 3, 1, 2]),
    ],
)
def test_orders(shop, order, want):
    assert page(shop, f"query(collection('item'), orderBy({order}))") == want


def test_price_orders(shop):
    assert page(shop, f"query(collection('item'), filterBy({SALE}), orderBy(priceNatural(DESC)))") == [1, 2, 3]
    assert page(shop, f"query(collection('item'), filterBy({SALE}), orderBy(priceDiscount('basic')))") == [2, 1, 3]
    assert page(shop, f"query(collection('item'), filterBy({SALE}, priceBetween(50, 200)), orderBy(priceNatural()))") == [2, 1]


def test_locale_order_is_collated(shop):
    text = "query(collection('item'), filterBy(scope(LIVE, ARCHIVED), entityLocaleEquals('cs')), orderBy(attributeNatural('name')))"
    assert page(shop, text) == [4, 2, 3]  # cena, hora, chata


def test_random_pages_are_a_permutation(shop):
    one = [page(shop, f"query(collection('item'), orderBy(randomWithSeed(7)), require(page({n}, 2)))") for n in (1, 2)]
    assert sorted(one[0] + one[1]) == [1, 2, 3, 5] and one[0] == page(shop, "query(collection('item'), orderBy(randomWithSeed(7)), require(page(1, 2)))")


def test_fetching(shop):
    text = f"query(collection('item'), filterBy({SALE}, entityLocaleEquals('cs')), require(entityFetch(attributeContentAll(), priceContentAll(), dataInLocales('en'), accompanyingPriceContentDefault(), referenceContent('node', entityFetch(attributeContent('name')), entityGroupFetch(attributeContent('name')), orderBy(entityProperty(attributeNatural('rank', DESC)))), priceContentRespectingFilter()), defaultAccompanyingPriceLists('basic')))"
    with pytest.raises(QueryError):
        run(shop, text)  # `hidden` has no column: only what a collection has can be fetched
    text = text.replace("attributeContentAll()", "attributeContent('code', 'name')").replace("priceContentAll(), ", "")
    rows = {r.pk: r for r in Query(shop, text, now=NOW).run().page.collect()}
    assert set(rows) == {2, 3} and rows[2].name == {"en": "b"} and rows[3].price_default == 36 and [x.price_id for x in rows[2].prices] == [3, 4, 5]
    assert [x.ref_pk for x in rows[3].node] == [3, 5] and rows[3].node[0].entity.name == "b" and rows[3].node[0].group.name == "g8"
    refs = "query(collection('node'), require(page(1, 9), entityFetch(referenceContent('items'))))"
    there = lambda text: sum(len(r["items"] or ()) for r in Query(shop, text, now=NOW).run().page.collect())
    assert there(refs) == 5 and there(refs.replace("'items'", "EXISTING, 'items'")) == 5
    up = Query(shop, "query(collection('node'), require(entityFetch(hierarchyContent(stopAt(distance(1))))))", now=NOW).run().page.collect()
    assert {r.pk: r.parents for r in up} == {1: None, 2: [1], 3: [1], 4: [2], 5: None}


def test_summaries(shop):
    q = lambda depth, user="", require="": {(r.group_pk, r.facet_pk): r for r in Query(shop, f"query(collection('item'), filterBy(attributeIsNotNull('code'){user}), require(referenceSummaryOfReference('node', {depth}){require}))", now=NOW).run().extras["referenceSummary:node"].collect()}
    assert {k: (r["count"], r.group_count) for k, r in q("COUNTS").items()} == {(7, 2): (1, 1), (7, 4): (1, 1), (8, 4): (1, 2), (8, 3): (1, 2)}
    got = q("IMPACT", ", userFilter(facetHaving('node', entityPrimaryKeyInSet(3)))")
    assert {k: (r.match_count, r.difference, r.requested) for k, r in got.items()} == {(7, 2): (0, -1, False), (7, 4): (0, -1, False), (8, 4): (2, 1, False), (8, 3): (1, 0, True)}
    got = q("IMPACT", ", userFilter(facetHaving('node', entityPrimaryKeyInSet(3)))", ", facetGroupsDisjunction('node', WITH_DIFFERENT_GROUPS)")
    assert got[7, 2].match_count == 2 and got[8, 3].difference == 0
    got = q("IMPACT", "", ", facetGroupsNegation('node')")
    assert {k: r.match_count for k, r in got.items()} == {(7, 2): 2, (7, 4): 2, (8, 4): 2, (8, 3): 2}


def test_hierarchy_statistics(shop):
    q = lambda text: {r.node: (r.children_count, r.queried_entity_count) for r in next(iter(Query(shop, text, now=NOW).run().extras.values())).collect()}
    assert q("query(collection('item'), require(hierarchyOfReference('node', fromRoot('m'))))") == {1: (3, 3), 2: (1, 2), 3: (0, 1), 4: (0, 2)}
    assert q("query(collection('item'), filterBy(attributeEquals('code', 'z')), require(hierarchyOfReference('node', fromRoot('m'))))") == {1: (1, 1), 3: (0, 1)}
    assert q("query(collection('item'), filterBy(attributeEquals('code', 'z')), require(hierarchyOfReference('node', LEAVE_EMPTY, fromRoot('m', stopAt(level(2))))))") == {1: (3, 1), 2: (1, 0), 3: (0, 1)}
    assert q("query(collection('node'), require(hierarchyOfSelf(fromRoot('m', stopAt(node(filterBy(attributeEquals('name', 'a'))))))))") == {1: (3, 4), 2: (1, 2), 3: (0, 1)}


@pytest.mark.parametrize("pairs", [0, 100])
def test_an_entity_counts_once_at_a_node(spark, monkeypatch, pairs):
    """However often it has the node, or has nodes below it, by a broadcast tree and by a shuffled one."""
    monkeypatch.setattr(statistics, "BROADCAST_PAIRS", pairs)
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, 2)], "node int, parent int")
    owned = spark.createDataFrame([("x", 4), ("x", 4), ("x", 2), ("x", 3), ("y", 1), ("y", 1), ("z", 4), ("z", 99), (None, 3)], "pk string, node int")
    assert {r.node: r.queried_entity_count for r in statistics._counts(owned, hierarchy.closure(tree)).collect()} == {1: 3, 2: 2, 3: 1, 4: 2}


@pytest.mark.parametrize("behaviour", ["STANDARD", "OPTIMIZED", "EQUALIZED"])
def test_histogram_edges(spark, behaviour):
    schema = "pk int, value decimal(10,2)"
    assert histogram(spark.createDataFrame([(1, None)], schema), 5, behaviour).count() == 0
    one = histogram(spark.createDataFrame([(1, Decimal(7)), (2, Decimal(7)), (2, Decimal(7))], schema), 5, behaviour).collect()
    assert [(r.bucket, r.occurrences, r.overall) for r in one] == [(0, 2, 2)]
    many = histogram(spark.createDataFrame([(i, Decimal(i * i)) for i in range(30)], schema), 10, behaviour).orderBy("bucket").collect()
    assert sum(r.occurrences for r in many) == 30 and many[0].threshold == 0 and all(a.threshold < b.threshold for a, b in zip(many, many[1:])) and len(many) <= 10
    if behaviour == "EQUALIZED":
        assert {r.occurrences for r in many} == {3}
    if behaviour == "OPTIMIZED":
        assert sum(r.occurrences == 0 for r in many) <= 2


def test_histogram_ranges_count_an_entity_once(spark):
    got = histogram(spark.createDataFrame([(1, Decimal(0)), (1, Decimal(1)), (1, Decimal(10)), (2, Decimal(10))], "pk int, value decimal(10,2)"), 2).orderBy("bucket").collect()
    assert [(r.occurrences, r.overall) for r in got] == [(1, 2), (2, 2)]


@pytest.mark.parametrize("rows, want", [([(5, -1), (3, 5), (1, 3), (4, 1)], {5: (5, 0), 3: (5, 1), 1: (5, 2), 4: (5, 3)}), ([(1, -1), (2, -1), (3, 2), (4, 99)], {1: (1, 0), 2: (2, 0), 3: (2, 1), 4: (4, 0)}), ([(1, 3), (2, 1), (3, 2), (9, -1)], {1: (1, 0), 2: (1, 1), 3: (1, 2), 9: (9, 0)}), ([], {})])
def test_chains(spark, rows, want):
    got = chains.positions(spark.createDataFrame(rows, "pk int, predecessor int")).collect()
    assert {r.pk: (r.chain, r.position) for r in got} == want


def test_chains_of_all_brands(spark, small):
    from shelfwise.plans import registry

    parts = spark.read.parquet(f"{small}/part.parquet")
    want, lists = {}, {}
    for r in sorted(parts.collect(), key=lambda r: r.p_partkey):
        own = lists.setdefault(r.p_brand, [])
        own.append(r.p_partkey)
        want[r.p_partkey] = (own[0], len(own) - 1)
    got = registry.queries()["predecessor_chains"](spark, small).collect()
    assert len(lists) > 1 and len(got) == len(want) and {r.pk: (r.chain, r.position) for r in got} == want
    assert "Join" not in registry._predecessors(parts)._jdf.queryExecution().executedPlan().toString()  # no pairs of parts


@pytest.mark.parametrize(
    "text",
    ["query(collection('none'))", "query(collection('item'), filterBy(attributeEquals('nope', 1)))", "query(collection('item'), filterBy(attributeEquals('hidden', 1)))", "query(collection('item'), filterBy(attributeEquals('name', 'a')))", "query(collection('item'), filterBy(userFilter(priceInCurrency('CZK'))))", "query(collection('item'), filterBy(or(priceInCurrency('CZK'), priceInCurrency('EUR'))))", "query(collection('item'), filterBy(priceBetween(1, 2)))", "query(collection('group'), filterBy(hierarchyWithinRootSelf()))", "query(collection('item'), require(attributeHistogram(5, 'code')))", "query(filterBy(attributeEquals('size', 1)))"],
)
def test_errors(shop, text):
    with pytest.raises(QueryError):
        run(shop, text).page.collect()


def test_collection_by_unique_attribute_and_labels(shop, spark):
    q = Query(shop, "query(head(label('a', 'b')), filterBy(attributeEquals('code', 'z')), require(queryTelemetry(PLAN)))", now=NOW)
    out = q.run()
    assert q.ctx.collection.name == "item" and [r.pk for r in out.page.collect()] == [3] and "Physical Plan" in out.telemetry["page"] and out.total == 1 and "timings" not in out.telemetry
    status = spark.sparkContext._jsc.sc().statusStore()

    def tagged():
        jobs = status.jobsList(None)
        return sum("a=b" in jobs.apply(i).jobTags().toString() for i in range(jobs.size()))

    before = tagged()
    assert before > 0  # the count
    out.page.collect()
    assert tagged() == before
    assert [r.pk for r in out.collect()] == [3] and tagged() > before
    timings = Query(shop, "query(collection('item'), require(queryTelemetry(TIMINGS)))", now=NOW).run().telemetry
    assert list(timings) == ["timings"]


def test_debug(shop):
    q = "query(collection('item'), filterBy(%s), require(debug(%s)))"
    some = "or(referenceHaving('node', attributeEquals('priority', 3)), not(attributeEquals('size', 7)), attributeIsNull('code'))"
    assert Query(shop, q % (some, "VERIFY_ALTERNATIVE_INDEX_RESULTS, PREFER_PREFETCHING"), now=NOW).run().total == 3
    with pytest.raises(QueryError):
        run(shop, q % (some, "FASTER"))


def test_histogram_having_without_a_name(shop):
    assert keys(shop, "query(collection('item'), filterBy(histogramHaving('node', 2, 3)))") == [1, 2] == keys(shop, "query(collection('item'), filterBy(histogramHaving('node', 'priority', 2, 3)))")


def test_a_summary_of_one_reference_overrides_that_of_all(shop):
    text = "query(collection('item'), filterBy(attributeIsNotNull('code')), require(referenceSummary(COUNTS%s)%s))"
    plain = Query(shop, text % ("", ""), now=NOW).run().extras
    assert set(plain) == {"referenceSummary"} and "match_count" not in plain["referenceSummary"].columns
    own = Query(shop, text % ("", ", referenceSummaryOfReference('node', IMPACT, filterBy(attributeEquals('name', 'b')))"), now=NOW).run().extras
    assert [(r.facet_pk, r.match_count) for r in own["referenceSummary"].collect()] == [(3, 1)]
    drawn = Query(shop, text.replace("referenceSummary(", "referenceSummaryWithHistograms(") % (", histogramStatistics(3, 'priority')", ""), now=NOW).run().extras
    assert set(drawn) == {"referenceSummary", "referenceHistogram:node:priority"}
    with pytest.raises(QueryError):
        Query(shop, text.replace("referenceSummary(", "referenceSummaryWithHistograms(") % (", histogramStatistics(3, 'nothing')", ""), now=NOW).run()


def test_deep_trees_have_no_limit(spark):
    """Each level is checkpointed, so the plan of one doesn't hold those above it."""
    from shelfwise.operators import hierarchy

    tree = spark.createDataFrame([(i, i - 1 if i else None) for i in range(30)] + [(100, 101), (101, 100)], "node int, parent int")
    found = hierarchy.expand(tree, hierarchy.roots(tree)).collect()
    assert sorted((r.node, r.distance) for r in found) == [(i, i) for i in range(30)]
    up = hierarchy.ascend(tree, spark.createDataFrame([(29,), (3,), (0,), (100,)], "node int")).collect()
    assert sorted((r.node, r.ancestor, r.distance, r.level) for r in up) == sorted([(29, 29 - d, d, 30) for d in range(1, 30)] + [(3, 3 - d, d, 4) for d in range(1, 4)])
