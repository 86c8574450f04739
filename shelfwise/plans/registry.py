"""Registered queries over the driver's tables, with their SQL twins.

A case is a query text, what of its response is returned, and SQL for DuckDB on
top of the common tables in `PRELUDE`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.operators import chains, filters, hierarchy
from shelfwise.plans.compiler import Query
from shelfwise.sources import changes, mutations
from shelfwise.sources.tables import catalog

FLAGSHIP = "product_page"
#: The moment of every query, so that "now" has one result.
NOW = datetime(2000, 6, 1, tzinfo=timezone.utc)

PRELUDE = """
WITH RECURSIVE product AS (
  SELECT p_partkey::BIGINT AS pk, CASE WHEN p_size % 10 = 0 THEN 'ARCHIVED' ELSE 'LIVE' END AS scope,
    p_partkey % 2 = 0 AS has_cs, CASE p_size % 3 WHEN 0 THEN 'NONE' WHEN 1 THEN 'LOWEST_PRICE' ELSE 'SUM' END AS handling,
    'P-' || p_partkey AS code, p_name, p_brand AS brand, p_type AS type, p_size::INTEGER AS size, p_retailprice::DECIMAL(12,2) AS list_price,
    string_split(p_name, ' ') AS tags, CASE WHEN p_size % 7 <> 0 THEN p_size % 2 = 0 END AS available,
    CASE WHEN p_size % 5 <> 0 THEN p_size END AS lo, CASE WHEN p_size % 4 <> 0 THEN p_size + 10 END AS hi
  FROM part
), live AS (SELECT * FROM product WHERE scope = 'LIVE'),
price AS (
  SELECT l_partkey::BIGINT AS pk, l_orderkey * 8 + l_linenumber AS price_id, l_returnflag AS price_list, l_linestatus AS currency, l_suppkey::BIGINT AS inner_id,
    l_extendedprice::DECIMAL(12,2) AS net, round(l_extendedprice::DECIMAL(12,2) * (1 + l_tax::DECIMAL(4,2)), 2)::DECIMAL(12,2) AS gross,
    l_shipdate AS valid_from, l_shipdate + INTERVAL 365 DAY AS valid_to, l_quantity >= 5 AS indexed
  FROM lineitem
), supply AS (
  SELECT l_partkey::BIGINT AS pk, (l_suppkey + 1001)::INTEGER AS ref_pk, (s_nationkey + 101)::INTEGER AS group_pk,
    sum(l_quantity::DECIMAL(12,2))::DECIMAL(14,2) AS quantity, count(*)::INTEGER AS lines
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3
), geo AS (
  SELECT (r_regionkey + 1)::INTEGER AS pk, NULL::INTEGER AS parent_pk, r_name AS name, 'region' AS kind, NULL::DECIMAL(12,2) AS balance FROM region
  UNION ALL SELECT (n_nationkey + 101)::INTEGER, (n_regionkey + 1)::INTEGER, n_name, 'nation', NULL FROM nation
  UNION ALL SELECT (s_suppkey + 1001)::INTEGER, (s_nationkey + 101)::INTEGER, s_name, 'supplier', s_acctbal::DECIMAL(12,2) FROM supplier
), paths AS (
  SELECT pk AS node, [pk] AS path FROM geo WHERE parent_pk IS NULL
  UNION ALL SELECT g.pk, list_append(path, g.pk) FROM paths JOIN geo g ON g.parent_pk = node
), closure AS (
  SELECT node, unnest(path) AS ancestor, len(path) - generate_subscripts(path, 1) AS distance, len(path) AS level FROM paths
), brand AS (SELECT DISTINCT regexp_extract(p_brand, '(\\d+)$', 1)::INTEGER AS pk, p_brand AS name FROM part),
brand_ref AS (SELECT p_partkey::BIGINT AS pk, regexp_extract(p_brand, '(\\d+)$', 1)::INTEGER AS ref_pk FROM part)
"""


def _sale(lists: str = "['R','A']", currency: str = "O", between: tuple[str, str] | None = None, valid: str = "TRUE", amount: str = "gross", name: str = "sale") -> str:
    """CTEs of the price for sale of live products."""
    bound = f"amount BETWEEN {between[0]} AND {between[1]}" if between else "TRUE"
    return f""", {name}_first AS (
  SELECT p.pk, handling, CASE WHEN handling = 'NONE' THEN NULL ELSE inner_id END AS inner_id, {amount} AS amount, price_id,
    row_number() OVER (PARTITION BY p.pk, CASE WHEN handling = 'NONE' THEN NULL ELSE inner_id END ORDER BY list_position({lists}, price_list), price_id) AS n
  FROM price p JOIN live USING (pk) WHERE indexed AND currency = '{currency}' AND list_contains({lists}, price_list) AND {valid}
), {name} AS (
  SELECT pk, handling, (CASE WHEN handling = 'SUM' THEN sum(amount) ELSE min(amount) END)::DECIMAL(22,2) AS amount
  FROM {name}_first WHERE n = 1 AND (handling <> 'LOWEST_PRICE' OR {bound}) GROUP BY pk, handling
  HAVING handling = 'LOWEST_PRICE' OR {bound.replace("amount", "CASE WHEN handling = 'SUM' THEN sum(amount) ELSE min(amount) END")}
)"""


@dataclass(frozen=True)
class Case:
    text: str
    sql: str | None
    #: From the checked query to the result; by default the keys of all matching entities.
    result: Callable[[Query], DataFrame] = lambda q: q.matching.select("pk")


def _page(*columns: str) -> Callable[[Query], DataFrame]:
    return lambda q: q.run().page.select(F.col("__position").cast("long").alias("position"), "pk", *columns)


def _extra(name: str, *columns: str) -> Callable[[Query], DataFrame]:
    return lambda q: q.run().extras[name].selectExpr(*columns)


_BUCKETS = ("bucket", "cast(threshold AS decimal(20,4)) AS threshold", "cast(occurrences AS long) AS occurrences", "relative_frequency")


def _standard(values: str, n: int) -> str:
    """A standard histogram over a CTE (pk, value)."""
    return f""", ends AS (SELECT min(value)::DOUBLE AS lo, max(value)::DOUBLE AS hi, count(DISTINCT pk) AS total FROM {values}),
grid AS (SELECT i::INTEGER AS bucket, (lo + (hi - lo) * i / {n})::DECIMAL(20,6) AS threshold, total FROM ends, range({n}) t(i) WHERE lo IS NOT NULL),
placed AS (SELECT pk, (SELECT max(bucket) FROM grid WHERE threshold <= value) AS bucket FROM {values} WHERE value IS NOT NULL)
SELECT bucket, threshold::DECIMAL(20,4) AS threshold, count(DISTINCT pk) AS occurrences, round(100.0 * count(DISTINCT pk) / any_value(total), 2)::DOUBLE AS relative_frequency
FROM grid LEFT JOIN placed USING (bucket) GROUP BY bucket, threshold"""


_PRICES = "priceInCurrency('O'), priceInPriceLists('R', 'A')"
_TREE_BELOW_ASIA = "SELECT node FROM closure JOIN geo ON geo.pk = ancestor WHERE geo.name = 'ASIA'"


def _match(filter_: str, where: str, source: str = "live") -> Case:
    return Case(f"query(collection('product'), filterBy({filter_}))", f"SELECT pk FROM {source} WHERE {where}")


def _ordered(order: str, by: str, filter_: str = "attributeLessThanEquals('size', 12)", where: str = "size <= 12", page: str = "page(2, 15)", window: str = "n > 15 AND n <= 30", extra: str = "", joins: str = "") -> Case:
    return Case(
        f"query(collection('product'), filterBy({filter_}), orderBy({order}), require({page}))",
        f"{extra} SELECT n AS position, pk FROM (SELECT pk, row_number() OVER (ORDER BY {by}) AS n FROM live {joins} WHERE {where}) WHERE {window}",
        _page(),
    )


CASES: dict[str, Case] = {
    "product_page": Case(
        "query(collection('product'), filterBy(attributeBetween('size', 5, 25), attributeStartsWith('brand', 'Brand#1')), orderBy(attributeNatural('list_price', DESC)), require(page(1, 20), entityFetch(attributeContent('code', 'brand', 'size', 'list_price'))))",
        "SELECT row_number() OVER (ORDER BY list_price DESC, pk) AS position, pk, code, brand, size, list_price FROM live WHERE size BETWEEN 5 AND 25 AND brand LIKE 'Brand#1%' ORDER BY 1 LIMIT 20",
        _page("code", "brand", "size", "list_price"),
    ),
    # Logic, user filter, scope
    "logic_and_or_not": _match("or(and(attributeEquals('type', 'PROMO'), attributeGreaterThan('size', 30)), not(attributeLessThan('size', 45)))", "(type = 'PROMO' AND size > 30) OR NOT size < 45"),
    "logic_not_keeps_missing": _match("not(attributeEquals('available', true))", "coalesce(available, FALSE) = FALSE"),
    "logic_user_filter": _match("attributeEquals('type', 'SMALL'), userFilter(attributeBetween('size', 3, 17))", "type = 'SMALL' AND size BETWEEN 3 AND 17"),
    "scope_both_with_in_scope": _match("scope(LIVE, ARCHIVED), inScope(LIVE, attributeLessThan('size', 10)), inScope(ARCHIVED, attributeEquals('size', 50))", "(scope <> 'LIVE' OR size < 10) AND (scope <> 'ARCHIVED' OR size = 50)", "product"),
    "scope_archived_orders": Case("query(collection('order'), filterBy(scope(ARCHIVED), attributeGreaterThan('total', 400000)))", "SELECT o_orderkey::BIGINT AS pk FROM orders WHERE o_orderstatus = 'F' AND o_totalprice::DECIMAL(14,2) > 400000"),
    # Attribute predicates
    "attribute_equals_converts": _match("attributeEquals('size', '7')", "size = 7"),
    "attribute_equals_not_convertible": _match("or(attributeEquals('size', 'x'), attributeEquals('size', 8))", "size = 8"),
    "attribute_equals_true_false": _match("or(attributeEqualsTrue('available'), and(attributeEqualsFalse('available'), attributeLessThan('size', 5)))", "available OR (NOT available AND size < 5)"),
    "attribute_compare": _match("attributeGreaterThanEquals('list_price', 950.5), attributeLessThanEquals('list_price', 1000.25), attributeGreaterThan('brand', 'Brand#10'), attributeLessThan('brand', 'Brand#22')", "list_price >= 950.5 AND list_price <= 1000.25 AND brand > 'Brand#10' AND brand < 'Brand#22'"),
    "attribute_between_open": _match("or(attributeBetween('size', null, 3), attributeBetween('size', 48, null))", "size <= 3 OR size >= 48"),
    "attribute_between_range": _match("attributeBetween('validity', 20, 25)", "(lo IS NOT NULL OR hi IS NOT NULL) AND (lo IS NULL OR lo <= 25) AND (hi IS NULL OR hi >= 20)"),
    "attribute_in_set": _match("attributeInSet('type', 'PROMO', 'LARGE'), attributeInSet('size', 1, '2', 'z', 3)", "type IN ('PROMO', 'LARGE') AND size IN (1, 2, 3)"),
    "attribute_array_any": _match("attributeEquals('tags', 'red'), attributeInSet('tags', 'ring', 'bolt'), attributeStartsWith('tags', 'b')", "list_contains(tags, 'red') AND (list_contains(tags, 'ring') OR list_contains(tags, 'bolt')) AND len(list_filter(tags, lambda t: starts_with(t, 'b'))) > 0"),
    "attribute_string": _match("attributeContains('brand', '#1'), attributeEndsWith('brand', '3'), not(attributeStartsWith('brand', 'brand'))", "contains(brand, '#1') AND ends_with(brand, '3')"),
    "attribute_is": _match("or(and(attributeIsNull('available'), attributeIsNotNull('validity')), attributeIs('validity', NULL))", "(available IS NULL AND (lo IS NOT NULL OR hi IS NOT NULL)) OR (lo IS NULL AND hi IS NULL)"),
    "attribute_in_range": _match("attributeInRange('validity', 30)", "(lo IS NOT NULL OR hi IS NOT NULL) AND (lo IS NULL OR lo <= 30) AND (hi IS NULL OR hi >= 30)"),
    # Keys and locale
    "key_in_set": _match("entityPrimaryKeyInSet(3, 77, 5, 100000, 12)", "pk IN (3, 77, 5, 100000, 12)"),
    "key_compare": _match("entityPrimaryKeyGreaterThan(10), entityPrimaryKeyLessThanEquals(90), or(entityPrimaryKeyLessThan(30), entityPrimaryKeyGreaterThanEquals(60)), entityPrimaryKeyBetween(12, 80)", "pk > 10 AND pk <= 90 AND (pk < 30 OR pk >= 60) AND pk BETWEEN 12 AND 80"),
    "locale_equals": _match("entityLocaleEquals('cs'), attributeContains('name', 'RING')", "has_cs AND contains(upper(p_name), 'RING')"),
    # Prices
    "price_in_currency": _match("priceInCurrency('F')", "pk IN (SELECT pk FROM price WHERE indexed AND currency = 'F')"),
    "price_in_lists": _match("priceInCurrency('F'), priceInPriceLists('N')", "pk IN (SELECT pk FROM price WHERE indexed AND currency = 'F' AND price_list = 'N')"),
    "price_valid_in": _match("priceInCurrency('O'), priceInPriceLists('A', 'N'), priceValidIn(1998-03-01T00:00:00Z)", "pk IN (SELECT pk FROM price WHERE indexed AND currency = 'O' AND price_list IN ('A', 'N') AND TIMESTAMP '1998-03-01' BETWEEN valid_from AND valid_to)"),
    "price_valid_now": _match("priceInCurrency('O'), priceInPriceLists('A'), priceValidInNow()", "pk IN (SELECT pk FROM price WHERE indexed AND currency = 'O' AND price_list = 'A' AND TIMESTAMP '2000-06-01' BETWEEN valid_from AND valid_to)"),
    "price_for_sale": Case(f"query(collection('product'), filterBy({_PRICES}))", _sale() + " SELECT pk, amount FROM sale", lambda q: _for_sale(q)),
    "price_for_sale_without_tax": Case(f"query(collection('product'), filterBy({_PRICES}), require(priceType(WITHOUT_TAX)))", _sale(amount="net") + " SELECT pk, amount FROM sale", lambda q: _for_sale(q)),
    "price_between": Case(f"query(collection('product'), filterBy({_PRICES}, priceBetween(30000, 60000)))", _sale(between=("30000", "60000")) + " SELECT pk FROM sale"),
    # References
    "reference_having": _match("referenceHaving('suppliers', attributeGreaterThan('quantity', 60), attributeBetween('lines', 2, 3))", "pk IN (SELECT pk FROM supply WHERE quantity > 60 AND lines BETWEEN 2 AND 3)"),
    "reference_any": Case("query(collection('geo'), filterBy(not(referenceHaving('products')), attributeEquals('kind', 'nation')))", "SELECT pk FROM geo WHERE kind = 'nation' AND pk NOT IN (SELECT ref_pk FROM supply)"),
    "reference_reflected": Case("query(collection('geo'), filterBy(referenceHaving('products', attributeGreaterThan('quantity', 140), entityHaving(attributeLessThan('size', 30)))))", "SELECT pk FROM geo WHERE pk IN (SELECT ref_pk FROM supply JOIN live USING (pk) WHERE quantity > 140 AND size < 30)"),
    "reference_none_of_an_attribute": _match("not(referenceHaving('suppliers', attributeGreaterThan('quantity', 100)))", "pk NOT IN (SELECT pk FROM supply WHERE quantity > 100)"),
    "reference_entity_having": _match("referenceHaving('suppliers', entityHaving(attributeLessThan('balance', 0)), attributeGreaterThan('quantity', 30))", "pk IN (SELECT s.pk FROM supply s JOIN geo g ON s.ref_pk = g.pk WHERE g.balance < 0 AND quantity > 30)"),
    "reference_group_having": _match("or(referenceHaving('suppliers', groupHaving(attributeEquals('name', 'NATION_3'))), attributeEquals('size', 1))", "size = 1 OR pk IN (SELECT s.pk FROM supply s JOIN geo g ON s.group_pk = g.pk WHERE g.name = 'NATION_3')"),
    "reference_nested_or": _match("referenceHaving('suppliers', or(entityHaving(attributeGreaterThan('balance', 9000)), attributeGreaterThan('lines', 3)))", "pk IN (SELECT s.pk FROM supply s JOIN geo g ON s.ref_pk = g.pk WHERE g.balance > 9000 OR lines > 3)"),
    "facet_having": _match("facetHaving('brand', entityPrimaryKeyInSet(3, 7))", "brand IN ('Brand#3', 'Brand#7')"),
    "facet_having_between_groups": _match(
        "facetHaving('suppliers', groupHaving(attributeInSet('name', 'NATION_8', 'NATION_12')), attributeLessThan('quantity', 30))",
        """pk IN (SELECT s.pk FROM supply s JOIN (SELECT DISTINCT ref_pk FROM supply WHERE group_pk IN (109, 113) AND quantity < 30) p USING (ref_pk) GROUP BY s.pk
          HAVING count(DISTINCT group_pk) = (SELECT count(DISTINCT group_pk) FROM supply WHERE group_pk IN (109, 113) AND quantity < 30))""",
    ),
    "facet_having_nothing": _match("or(facetHaving('suppliers', entityPrimaryKeyInSet(1)), attributeEquals('size', 5))", "size = 5"),
    "histogram_having": _match("userFilter(histogramHaving('suppliers', 'quantity', 40, 45))", "pk IN (SELECT pk FROM supply WHERE quantity BETWEEN 40 AND 45)"),
    # Hierarchies
    "hierarchy_within": _match("hierarchyWithin('suppliers', attributeEquals('name', 'ASIA'))", f"pk IN (SELECT pk FROM supply WHERE ref_pk IN ({_TREE_BELOW_ASIA}))"),
    "hierarchy_within_direct": _match("hierarchyWithin('suppliers', attributeInSet('name', 'ASIA', 'Supplier#000000003'), directRelation())", "pk IN (SELECT pk FROM supply WHERE ref_pk IN (SELECT pk FROM geo WHERE name IN ('ASIA', 'Supplier#000000003')))"),
    "hierarchy_within_root": _match("hierarchyWithinRoot('suppliers', excluding(attributeEquals('name', 'EUROPE')))", "pk IN (SELECT pk FROM supply WHERE ref_pk NOT IN (SELECT node FROM closure JOIN geo ON geo.pk = ancestor WHERE geo.name = 'EUROPE'))"),
    "hierarchy_self": Case("query(collection('geo'), filterBy(hierarchyWithinSelf(attributeEquals('name', 'ASIA'), excludingRoot())))", f"SELECT node AS pk FROM closure JOIN geo ON geo.pk = ancestor WHERE geo.name = 'ASIA' AND distance > 0"),
    "hierarchy_self_direct": Case("query(collection('geo'), filterBy(hierarchyWithinSelf(attributeEquals('name', 'ASIA'), directRelation())))", "SELECT pk FROM geo WHERE parent_pk = (SELECT pk FROM geo WHERE name = 'ASIA')"),
    "hierarchy_root_self": Case("query(collection('geo'), filterBy(hierarchyWithinRootSelf(directRelation())))", "SELECT pk FROM geo WHERE parent_pk IS NULL"),
    "hierarchy_having": Case(
        "query(collection('geo'), filterBy(hierarchyWithinRootSelf(having(not(attributeInSet('name', 'AFRICA', 'NATION_2'))))))",
        "SELECT node AS pk FROM paths WHERE NOT list_has_any(path, (SELECT list(pk) FROM geo WHERE name IN ('AFRICA', 'NATION_2')))",
    ),
    "hierarchy_any_having": Case(
        "query(collection('geo'), filterBy(hierarchyWithinRootSelf(anyHaving(attributeGreaterThan('balance', 9500)))))",
        "SELECT DISTINCT ancestor AS pk FROM closure JOIN geo ON geo.pk = node WHERE balance > 9500",
    ),
    "hierarchy_excluding": Case(
        "query(collection('geo'), filterBy(hierarchyWithinSelf(attributeEquals('name', 'AMERICA'), excluding(attributeLessThan('balance', 5000)))))",
        "SELECT node AS pk FROM closure c JOIN geo a ON a.pk = ancestor JOIN geo n ON n.pk = node WHERE a.name = 'AMERICA' AND coalesce(n.balance >= 5000, TRUE)",
    ),
    # Order and paging
    "order_natural_missing_last": _ordered("attributeNatural('available', DESC), attributeNatural('brand')", "available DESC NULLS LAST, CASE WHEN available IS NULL THEN brand END, pk"),
    "order_compound": _ordered("attributeNatural('brand_size')", "brand, size DESC, pk"),
    "order_set_exact": _ordered("attributeSetExact('type', 'PROMO', 'SMALL')", "list_position(['PROMO', 'SMALL'], type) NULLS LAST, pk"),
    "order_set_in_filter": _ordered("attributeSetInFilter('type')", "list_position(['LARGE', 'ECONOMY', 'PROMO'], type), pk", "attributeInSet('type', 'LARGE', 'ECONOMY', 'PROMO'), attributeLessThan('size', 20)", "type IN ('LARGE', 'ECONOMY', 'PROMO') AND size < 20"),
    "order_key": _ordered("entityPrimaryKeyNatural(DESC)", "pk DESC"),
    "order_key_exact": _ordered("entityPrimaryKeyExact(60, 4, 30)", "list_position([60, 4, 30], pk) NULLS LAST, pk", page="page(1, 15)", window="n <= 15"),
    "order_key_in_filter": _ordered("entityPrimaryKeyInFilter()", "list_position([90, 2, 33, 14, 5], pk)", "entityPrimaryKeyInSet(90, 2, 33, 14, 5)", "pk IN (90, 2, 33, 14, 5)", "page(1, 4)", "n <= 4"),
    "order_price": _ordered("priceNatural(DESC)", "amount DESC NULLS LAST, pk", f"{_PRICES}, attributeLessThan('size', 20)", "size < 20", extra=_sale(), joins="JOIN sale USING (pk)"),
    "order_price_discount": _ordered(
        "priceDiscount('N')", "discount DESC NULLS LAST, pk", f"{_PRICES}, attributeLessThan('size', 20)", "size < 20",
        extra=_sale() + _sale("['N']", name="ref") + """, used AS (
          SELECT pk, handling, CASE WHEN handling = 'LOWEST_PRICE' THEN arg_min(inner_id, (amount, inner_id)) END AS one FROM sale_first WHERE n = 1 GROUP BY pk, handling
        ), other AS (
          SELECT r.pk, sum(r.amount) AS amount FROM ref_first r JOIN used u USING (pk)
          WHERE r.n = 1 AND (u.handling = 'NONE' OR (u.handling = 'LOWEST_PRICE' AND r.inner_id = u.one) OR (u.handling = 'SUM' AND (r.pk, r.inner_id) IN (SELECT pk, inner_id FROM sale_first WHERE n = 1)))
          GROUP BY r.pk
        ), disc AS (SELECT s.pk, greatest(o.amount - s.amount, 0) AS discount FROM sale s JOIN other o USING (pk))""",
        joins="JOIN sale USING (pk) LEFT JOIN disc USING (pk)",
    ),
    "order_reference_property": _ordered(
        "referenceProperty('suppliers', pickFirstByEntityProperty(attributeNatural('balance', DESC)), attributeNatural('quantity', DESC))", "quantity DESC NULLS LAST, pk",
        extra=", picked AS (SELECT s.pk, s.quantity, row_number() OVER (PARTITION BY s.pk ORDER BY g.balance DESC, s.ref_pk) AS k FROM supply s JOIN geo g ON g.pk = s.ref_pk)", joins="LEFT JOIN (SELECT pk, quantity FROM picked WHERE k = 1) USING (pk)",
    ),
    "order_traverse": _ordered(
        "referenceProperty('suppliers', traverseByEntityProperty(DEPTH_FIRST, entityPrimaryKeyNatural()), attributeNatural('quantity'))", "path NULLS LAST, quantity, pk",
        extra=", met AS (SELECT s.pk, path, quantity, row_number() OVER (PARTITION BY s.pk ORDER BY path, quantity) AS k FROM supply s JOIN paths ON node = s.ref_pk)", joins="LEFT JOIN (SELECT pk, path, quantity FROM met WHERE k = 1) USING (pk)",
    ),
    "order_breadth_first": _ordered(
        "referenceProperty('suppliers', traverseByEntityProperty(BREADTH_FIRST, attributeNatural('name', DESC)), attributeNatural('quantity'))", "met NULLS LAST, quantity, pk",
        extra=""", sib AS (SELECT pk, parent_pk, row_number() OVER (PARTITION BY parent_pk ORDER BY name DESC, pk) AS place FROM geo),
        ranks AS (SELECT node, list(place ORDER BY c.level - c.distance) AS met FROM closure c JOIN sib ON sib.pk = ancestor GROUP BY node),
        first AS (SELECT s.pk, met, quantity, row_number() OVER (PARTITION BY s.pk ORDER BY len(met), met, quantity) AS k FROM supply s JOIN ranks ON node = s.ref_pk)""",
        joins="LEFT JOIN (SELECT pk, met, quantity FROM first WHERE k = 1) USING (pk)",
    ),
    "order_segments": Case(
        "query(collection('product'), orderBy(segments(segment(entityHaving(attributeEquals('type', 'PROMO')), orderBy(attributeNatural('list_price', DESC)), limit(3)), segment(orderBy(attributeNatural('size')), limit(4)))), require(strip(0, 12)))",
        """, one AS (SELECT pk, 1 AS s, row_number() OVER (ORDER BY list_price DESC, pk) AS k FROM live WHERE type = 'PROMO' QUALIFY k <= 3),
        two AS (SELECT pk, 2 AS s, row_number() OVER (ORDER BY size, pk) AS k FROM live WHERE pk NOT IN (SELECT pk FROM one) QUALIFY k <= 4),
        rest AS (SELECT pk, 3 AS s, pk AS k FROM live WHERE pk NOT IN (SELECT pk FROM one UNION ALL SELECT pk FROM two))
        SELECT row_number() OVER (ORDER BY s, k) AS position, pk FROM (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM rest) ORDER BY 1 LIMIT 12""",
        _page(),
    ),
    "order_in_scope": Case(
        "query(collection('product'), filterBy(scope(LIVE, ARCHIVED)), orderBy(inScope(ARCHIVED, attributeNatural('list_price', DESC))), require(strip(5, 20)))",
        "SELECT n AS position, pk FROM (SELECT pk, row_number() OVER (ORDER BY CASE WHEN scope = 'ARCHIVED' THEN list_price END DESC NULLS LAST, pk) AS n FROM product) WHERE n > 5 AND n <= 25",
        _page(),
    ),
    "order_random_seeded": Case(
        "query(collection('product'), orderBy(randomWithSeed(42)), require(page(2, 20)))",
        "SELECT n AS position, pk FROM (SELECT pk, row_number() OVER (ORDER BY md5('42:' || pk), pk) AS n FROM live) WHERE n > 20 AND n <= 40", _page(),
    ),
    "page_beyond_the_end": _ordered("attributeNatural('brand')", "brand, pk", page="page(100000, 15)", window="n <= 15"),
    "page_spacing": _ordered("attributeNatural('brand')", "brand, pk", page="page(3, 10, spacing(gap(2, '$pageNumber % 2 == 1'), gap(1, '$pageNumber == 2')))", window="n > 17 AND n <= 25"),
    "strip": _ordered("attributeNatural('brand', DESC)", "brand DESC, pk", page="strip(7, 9)", window="n > 7 AND n <= 16"),
    # Fetching
    "fetch_localized": Case(
        "query(collection('product'), filterBy(entityLocaleEquals('cs'), attributeLessThan('size', 9)), require(page(1, 10), entityFetch(attributeContent('name', 'size'), associatedDataContent('note'))))",
        """SELECT row_number() OVER (ORDER BY pk) AS position, pk, upper(p_name) AS name, size, '{"brand":"' || brand || '"}' AS note FROM live WHERE has_cs AND size < 9 ORDER BY 1 LIMIT 10""",
        _page("name", "size", "note"),
    ),
    "fetch_references": Case(
        "query(collection('product'), filterBy(attributeEquals('size', 4)), require(page(1, 20), entityFetch(referenceContentWithAttributes('suppliers', filterBy(attributeGreaterThan('quantity', 10)), orderBy(attributeNatural('quantity', DESC)), page(1, 3)))))",
        """, top AS (SELECT pk, row_number() OVER (ORDER BY pk) AS position FROM live WHERE size = 4 QUALIFY position <= 20),
        r AS (SELECT pk, ref_pk, quantity, row_number() OVER (PARTITION BY pk ORDER BY quantity DESC, ref_pk) AS n FROM supply WHERE quantity > 10)
        SELECT position, pk, n::INTEGER AS n, ref_pk, quantity FROM top JOIN r USING (pk) WHERE n <= 3""",
        lambda q: q.run().page.select(F.col("__position").cast("long").alias("position"), "pk", F.posexplode("suppliers").alias("n", "r")).select("position", "pk", (F.col("n") + 1).alias("n"), "r.ref_pk", "r.quantity"),
    ),
    "fetch_prices": Case(
        f"query(collection('product'), filterBy({_PRICES}, attributeEquals('size', 6)), require(page(1, 10), entityFetch(priceContentRespectingFilter(), accompanyingPriceContent('list', 'N')), defaultAccompanyingPriceLists('N')))",
        _sale() + _sale("['N']", name="ref") + """, top AS (SELECT pk, row_number() OVER (ORDER BY pk) AS position FROM sale JOIN live USING (pk) WHERE size = 6 QUALIFY position <= 10)
        SELECT position, pk, (SELECT count(*) FROM price p WHERE p.pk = top.pk AND currency = 'O' AND price_list IN ('R', 'A')) AS n_prices, ref.amount AS price_list FROM top LEFT JOIN ref USING (pk)""",
        lambda q: q.run().page.select(F.col("__position").cast("long").alias("position"), "pk", F.size("prices").cast("long").alias("n_prices"), "price_list"),
    ),
    "fetch_parents": Case(
        "query(collection('geo'), filterBy(attributeEquals('kind', 'supplier')), require(page(1, 50), entityFetch(attributeContent('name'), hierarchyContent())))",
        """SELECT row_number() OVER (ORDER BY pk) AS position, pk, name, p.path[2]::INTEGER AS parent, p.path[1]::INTEGER AS top FROM geo JOIN paths p ON p.node = pk WHERE kind = 'supplier' ORDER BY 1 LIMIT 50""",
        lambda q: q.run().page.select(F.col("__position").cast("long").alias("position"), "pk", "name", F.col("parents")[0].alias("parent"), F.col("parents")[1].alias("top")),
    ),
    "fetch_parents_as_far": Case(
        "query(collection('geo'), filterBy(attributeEquals('kind', 'supplier')), require(page(1, 50), entityFetch(hierarchyContent(stopAt(distance(1)), entityFetch(attributeContent('name'))))))",
        "SELECT row_number() OVER (ORDER BY g.pk) AS position, g.pk, p.name AS parent, 1 AS n FROM geo g JOIN geo p ON p.pk = g.parent_pk WHERE g.kind = 'supplier' ORDER BY 1 LIMIT 50",
        lambda q: q.run().page.select(F.col("__position").cast("long").alias("position"), "pk", F.col("parents")[0]["name"].alias("parent"), F.size("parents").cast("int").alias("n")),
    ),
    "fetch_parents_to_a_level": Case(
        "query(collection('geo'), filterBy(attributeInSet('kind', 'supplier', 'nation')), orderBy(entityPrimaryKeyNatural(DESC)), require(page(1, 40), entityFetch(hierarchyContent(stopAt(level(2))))))",
        "SELECT row_number() OVER (ORDER BY pk DESC) AS position, pk, CASE WHEN kind = 'supplier' THEN parent_pk END AS parent FROM geo WHERE kind IN ('supplier', 'nation') ORDER BY 1 LIMIT 40",
        lambda q: q.run().page.select(F.col("__position").cast("long").alias("position"), "pk", F.get("parents", 0).alias("parent")),
    ),
    "fetch_references_by_entity": Case(
        "query(collection('product'), filterBy(attributeEquals('size', 4)), require(page(1, 20), entityFetch(referenceContent('suppliers', orderBy(entityProperty(attributeNatural('balance', DESC))), strip(0, 2), entityFetch(attributeContent('name')), entityGroupFetch(attributeContent('name'))))))",
        """, top AS (SELECT pk, row_number() OVER (ORDER BY pk) AS position FROM live WHERE size = 4 QUALIFY position <= 20),
        r AS (SELECT s.pk, ref_pk, g.name, n.name AS group_name, row_number() OVER (PARTITION BY s.pk ORDER BY g.balance DESC, ref_pk) AS n FROM supply s JOIN geo g ON g.pk = ref_pk JOIN geo n ON n.pk = group_pk)
        SELECT position, pk, ref_pk, name, group_name FROM top JOIN r USING (pk) WHERE r.n <= 2""",
        lambda q: q.run().page.select(F.col("__position").cast("long").alias("position"), "pk", F.explode("suppliers").alias("r")).select("position", "pk", "r.ref_pk", "r.entity.name", F.col("r.group.name").alias("group_name")),
    ),
    "fetch_references_by_group": Case(
        "query(collection('product'), filterBy(attributeEquals('size', 4)), require(page(1, 20), entityFetch(referenceContent('suppliers', orderBy(entityGroupProperty(attributeNatural('name', DESC))), page(1, 3)))))",
        """, top AS (SELECT pk, row_number() OVER (ORDER BY pk) AS position FROM live WHERE size = 4 QUALIFY position <= 20),
        r AS (SELECT s.pk, ref_pk, row_number() OVER (PARTITION BY s.pk ORDER BY n.name DESC, n.pk IS NULL, ref_pk) AS n FROM supply s JOIN geo n ON n.pk = group_pk)
        SELECT position, pk, ref_pk FROM top JOIN r USING (pk) WHERE r.n <= 3""",
        lambda q: q.run().page.select(F.col("__position").cast("long").alias("position"), "pk", F.explode("suppliers.ref_pk").alias("ref_pk")),
    ),
    "fetch_all": Case(
        "query(collection('product'), filterBy(attributeEquals('size', 6)), require(page(1, 10), entityFetch(attributeContent('code', 'name'), associatedDataContentAll(), priceContentAll(), referenceContentAllWithAttributes(), dataInLocalesAll())))",
        """SELECT row_number() OVER (ORDER BY pk) AS position, pk, code, p_name AS name, '{"brand":"' || brand || '"}' AS note, (SELECT count(*) FROM price p WHERE p.pk = live.pk) AS n_prices,
        (SELECT count(*) FROM supply s WHERE s.pk = live.pk) AS n_suppliers, (SELECT sum(quantity) FROM supply s WHERE s.pk = live.pk)::DOUBLE AS quantity FROM live WHERE size = 6 ORDER BY 1 LIMIT 10""",
        lambda q: q.run().page.select(F.col("__position").cast("long").alias("position"), "pk", "code", F.col("name")["en"].alias("name"), "note", F.size("prices").cast("long").alias("n_prices"), F.size("suppliers").cast("long").alias("n_suppliers"), F.aggregate("suppliers", F.lit(0.0), lambda a, x: a + x["quantity"].cast("double")).alias("quantity")),
    ),
    "fetch_locale": Case(
        "query(collection('product'), filterBy(entityLocaleEquals('cs'), attributeEquals('size', 3)), require(page(1, 10), entityFetch(attributeContent('name'), dataInLocales('en'))))",
        "SELECT row_number() OVER (ORDER BY pk) AS position, pk, p_name AS name, 1 AS locales FROM live WHERE has_cs AND size = 3 ORDER BY 1 LIMIT 10",
        lambda q: q.run().page.select(F.col("__position").cast("long").alias("position"), "pk", F.col("name")["en"].alias("name"), F.size("name").alias("locales")),
    ),
    "fetch_default_price": Case(
        f"query(collection('product'), filterBy({_PRICES}, attributeEquals('size', 6)), require(page(1, 10), entityFetch(accompanyingPriceContentDefault()), defaultAccompanyingPriceLists('N')))",
        _sale() + _sale("['N']", name="ref") + """, top AS (SELECT pk, row_number() OVER (ORDER BY pk) AS position FROM sale JOIN live USING (pk) WHERE size = 6 QUALIFY position <= 10)
        SELECT position, pk, ref.amount AS price_default FROM top LEFT JOIN ref USING (pk)""",
        _page("price_default"),
    ),
    "fetch_of_a_scope": Case(
        "query(collection('product'), filterBy(scope(LIVE, ARCHIVED), attributeBetween('size', 29, 31)), require(page(1, 30), entityFetch(attributeContent('code')), inScope(ARCHIVED, entityFetch(attributeContent('brand')))))",
        "SELECT row_number() OVER (ORDER BY pk) AS position, pk, code, CASE WHEN scope = 'ARCHIVED' THEN brand END AS brand FROM product WHERE size BETWEEN 29 AND 31 ORDER BY 1 LIMIT 30",
        _page("code", "brand"),
    ),
    "collection_in_the_head": Case("query(head(collection('product'), label('from', 'test')), filterBy(attributeEquals('size', 5)))", "SELECT pk FROM live WHERE size = 5"),
    "collection_by_unique_attribute": Case("query(filterBy(attributeInSet('code', 'P-7', 'P-12', 'none')))", "SELECT pk FROM live WHERE code IN ('P-7', 'P-12')"),
    "debug_verified": Case(
        f"query(collection('product'), filterBy({_PRICES}, or(referenceHaving('suppliers', attributeGreaterThan('quantity', 90)), attributeLessThan('size', 9)), not(attributeEquals('available', true))), require(page(1, 25), debug(VERIFY_ALTERNATIVE_INDEX_RESULTS)))",
        _sale() + " SELECT n AS position, pk FROM (SELECT pk, row_number() OVER (ORDER BY pk) AS n FROM live WHERE pk IN (SELECT pk FROM sale) AND (size < 9 OR pk IN (SELECT pk FROM supply WHERE quantity > 90)) AND coalesce(available, FALSE) = FALSE) WHERE n <= 25",
        _page(),
    ),
    # Extra results
    "histogram_attribute": Case(
        "query(collection('product'), filterBy(attributeEquals('type', 'PROMO'), userFilter(attributeBetween('size', 5, 9))), require(attributeHistogram(20, 'size')))",
        ", v AS (SELECT pk, size::DECIMAL(20,4) AS value FROM live WHERE type = 'PROMO')" + _standard("v", 20), _extra("attributeHistogram:size", *_BUCKETS),
    ),
    "histogram_price": Case(
        f"query(collection('product'), filterBy({_PRICES}, userFilter(priceBetween(10000, 20000))), require(priceHistogram(20)))",
        _sale() + ", v AS (SELECT pk, amount AS value FROM sale)" + _standard("v", 20), _extra("priceHistogram", *_BUCKETS),
    ),
    "histogram_reference": Case(
        "query(collection('product'), filterBy(attributeLessThan('size', 20)), require(referenceSummaryOfReferenceWithHistograms('suppliers', COUNTS, histogramStatistics(5, 'quantity'))))",
        """, v AS (SELECT DISTINCT group_pk, pk, quantity AS value FROM supply WHERE pk IN (SELECT pk FROM live WHERE size < 20)),
        ends AS (SELECT group_pk, min(value)::DOUBLE AS lo, max(value)::DOUBLE AS hi FROM v GROUP BY 1),
        grid AS (SELECT group_pk, i::INTEGER AS bucket, (lo + (hi - lo) * i / 5)::DECIMAL(20,6) AS threshold, lead(threshold) OVER (PARTITION BY group_pk ORDER BY i) AS upto FROM ends, range(5) t(i) WHERE lo < hi OR i = 0)
        SELECT g.group_pk, bucket, threshold::DECIMAL(20,4) AS threshold, count(DISTINCT pk) AS occurrences FROM grid g LEFT JOIN v ON v.group_pk = g.group_pk AND value >= threshold AND (upto IS NULL OR value < upto) GROUP BY 1, 2, 3""",
        _extra("referenceHistogram:suppliers:quantity", "group_pk", "bucket", *_BUCKETS[1:3]),
    ),
    "histogram_optimized": Case(
        "query(collection('product'), filterBy(attributeLessThan('list_price', 915)), require(attributeHistogram(20, OPTIMIZED, 'list_price')))",
        """, v AS (SELECT pk, list_price::DECIMAL(20,4) AS value FROM live WHERE list_price < 915),
        ends AS (SELECT min(value) AS lo, max(value) AS hi, count(DISTINCT pk) AS total FROM v WHERE value IS NOT NULL),
        tries AS (SELECT n, count(DISTINCT least(floor((value - lo)::DOUBLE * n / (hi - lo)::DOUBLE + 1e-9), n - 1)) AS filled FROM (SELECT DISTINCT value FROM v), ends, range(1, 21) t(n) WHERE lo < hi GROUP BY n),
        best AS (SELECT coalesce(max(n), 1) AS n FROM tries WHERE n - filled <= greatest(1, n // 5) AND (n < 3 OR filled > 1)),
        grid AS (SELECT i::INTEGER AS bucket, (lo::DOUBLE + (hi - lo)::DOUBLE * i / n)::DECIMAL(20,6) AS threshold, total FROM ends, best, range(20) t(i) WHERE i < n),
        placed AS (SELECT pk, (SELECT max(bucket) FROM grid WHERE threshold <= value) AS bucket FROM v)
        SELECT bucket, threshold::DECIMAL(20,4) AS threshold, count(DISTINCT pk) AS occurrences, round(100.0 * count(DISTINCT pk) / any_value(total), 2)::DOUBLE AS relative_frequency FROM grid LEFT JOIN placed USING (bucket) GROUP BY bucket, threshold""",
        _extra("attributeHistogram:list_price", *_BUCKETS),
    ),
    "histogram_equalized": Case(
        "query(collection('product'), require(attributeHistogram(10, EQUALIZED, 'list_price')))",
        """, v AS (SELECT list_price AS value, count(*) AS k FROM live GROUP BY 1),
        runs AS (SELECT value, k, sum(k) OVER (ORDER BY value) AS after, lead(value) OVER (ORDER BY value) AS next, sum(k) OVER () AS total FROM v),
        cuts AS (SELECT i, CASE WHEN i = 0 THEN value ELSE round(value + (coalesce(next - value, 0))::DOUBLE * (total * i / 10.0 - (after - k)) / k, 2) END::DECIMAL(20,6) AS threshold
          FROM runs, range(10) t(i) WHERE total * i / 10.0 >= after - k AND total * i / 10.0 < after),
        grid AS (SELECT row_number() OVER (ORDER BY threshold)::INTEGER - 1 AS bucket, threshold FROM (SELECT DISTINCT threshold FROM cuts))
        SELECT bucket::INTEGER AS bucket, threshold::DECIMAL(20,4) AS threshold, (SELECT count(*) FROM live WHERE list_price >= g.threshold AND list_price < coalesce((SELECT min(threshold) FROM grid h WHERE h.bucket > g.bucket), 1e9)) AS occurrences FROM grid g""",
        _extra("attributeHistogram:list_price", *_BUCKETS[:3]),
    ),
    "histograms_of_all_references": Case(
        "query(collection('product'), filterBy(attributeLessThan('size', 20)), require(referenceSummaryWithHistograms(COUNTS, histogramStatistics(4, 'lines'))))",
        """, v AS (SELECT DISTINCT group_pk, pk, lines AS value FROM supply WHERE pk IN (SELECT pk FROM live WHERE size < 20)),
        ends AS (SELECT group_pk, min(value)::DOUBLE AS lo, max(value)::DOUBLE AS hi FROM v GROUP BY 1),
        grid AS (SELECT group_pk, i::INTEGER AS bucket, (lo + (hi - lo) * i / 4)::DECIMAL(20,6) AS threshold, lead(threshold) OVER (PARTITION BY group_pk ORDER BY i) AS upto FROM ends, range(4) t(i) WHERE lo < hi OR i = 0)
        SELECT g.group_pk, bucket, threshold::DECIMAL(20,4) AS threshold, count(DISTINCT pk) AS occurrences FROM grid g LEFT JOIN v ON v.group_pk = g.group_pk AND value >= threshold AND (upto IS NULL OR value < upto) GROUP BY 1, 2, 3""",
        _extra("referenceHistogram:suppliers:lines", "group_pk", "bucket", *_BUCKETS[1:3]),
    ),
    "histogram_of_a_scope": Case(
        "query(collection('product'), filterBy(scope(LIVE, ARCHIVED)), require(inScope(ARCHIVED, attributeHistogram(5, 'list_price'))))",
        ", v AS (SELECT pk, list_price::DECIMAL(20,4) AS value FROM product WHERE scope = 'ARCHIVED')" + _standard("v", 5), _extra("attributeHistogram:list_price", *_BUCKETS),
    ),
    "facet_summary_in_order": Case(
        "query(collection('product'), filterBy(attributeLessThan('size', 30)), require(facetSummaryOfReference('suppliers', COUNTS, filterBy(attributeLessThan('balance', 8000)), filterGroupBy(attributeInSet('name', 'NATION_3', 'NATION_8', 'NATION_12')), orderBy(attributeNatural('balance', DESC)), orderGroupBy(attributeNatural('name', DESC)), entityGroupFetch(attributeContent('name')))))",
        """, f AS (SELECT s.group_pk, s.ref_pk, count(DISTINCT s.pk) AS count FROM supply s JOIN live USING (pk) WHERE size < 30 GROUP BY 1, 2)
        SELECT f.group_pk::BIGINT AS group_pk, ref_pk AS facet_pk, count, n.name AS group_name, row_number() OVER (PARTITION BY f.group_pk ORDER BY g.balance DESC, ref_pk) AS place, dense_rank() OVER (ORDER BY n.name DESC) AS group_place
        FROM f JOIN geo g ON g.pk = ref_pk JOIN geo n ON n.pk = f.group_pk WHERE g.balance < 8000 AND n.name IN ('NATION_3', 'NATION_8', 'NATION_12')""",
        _extra("referenceSummary:suppliers", "group_pk", "facet_pk", "`count`", "`group`.name AS group_name", "facet_pk_position AS place", "group_pk_position AS group_place"),
    ),
    "facet_exclusive": Case(
        "query(collection('product'), filterBy(attributeLessThan('size', 30), userFilter(facetHaving('brand', entityPrimaryKeyInSet(3)))), require(referenceSummaryOfReference('brand', IMPACT), facetGroupsExclusivity('brand')))",
        """SELECT ref_pk AS facet_pk, count(*) AS match_count, count(*) - (SELECT count(*) FROM live WHERE size < 30 AND brand = 'Brand#3') AS difference FROM brand_ref JOIN live USING (pk) WHERE size < 30 GROUP BY 1""",
        _extra("referenceSummary:brand", "facet_pk", "match_count", "difference"),
    ),
    "facet_calculation_rules": Case(
        "query(collection('product'), filterBy(userFilter(facetHaving('suppliers', groupHaving(attributeInSet('name', 'NATION_8', 'NATION_12'))))), require(facetCalculationRules(CONJUNCTION, DISJUNCTION)))",
        """, sel AS (SELECT DISTINCT group_pk, ref_pk FROM supply WHERE group_pk IN (109, 113)), sizes AS (SELECT group_pk, count(*) AS n FROM sel GROUP BY 1),
        met AS (SELECT pk, group_pk, count(DISTINCT ref_pk) AS k FROM supply WHERE group_pk IN (109, 113) GROUP BY 1, 2)
        SELECT DISTINCT live.pk FROM live JOIN met ON met.pk = live.pk JOIN sizes USING (group_pk) WHERE k = n""",
    ),
    "facet_rules_inside_or": Case(
        "query(collection('product'), filterBy(or(facetHaving('brand', entityPrimaryKeyInSet(3, 4)), attributeEquals('size', 1))), require(facetGroupsNegation('brand')))",
        "SELECT pk FROM live WHERE brand NOT IN ('Brand#3', 'Brand#4') OR size = 1",
    ),
    "facet_rules_inside_not": Case(
        "query(collection('product'), filterBy(not(facetHaving('brand', entityPrimaryKeyInSet(3, 4)))), require(facetGroupsNegation('brand')))",
        "SELECT pk FROM live WHERE brand IN ('Brand#3', 'Brand#4')",
    ),
    "facet_counts": Case(
        "query(collection('product'), filterBy(attributeLessThan('size', 30), userFilter(facetHaving('brand', entityPrimaryKeyInSet(3)))), require(referenceSummary(COUNTS)))",
        """, base AS (SELECT pk FROM live WHERE size < 30), f AS (
          SELECT 'suppliers' AS reference, group_pk::BIGINT AS group_pk, ref_pk, pk FROM supply UNION ALL SELECT 'brand', -1, ref_pk, pk FROM brand_ref)
        SELECT reference, group_pk, ref_pk AS facet_pk, count(DISTINCT pk) AS count, any_value(n) AS group_count, reference = 'brand' AND ref_pk = 3 AS requested
        FROM f JOIN base USING (pk) JOIN (SELECT reference, group_pk, count(DISTINCT pk) AS n FROM f JOIN base USING (pk) GROUP BY 1, 2) USING (reference, group_pk) GROUP BY 1, 2, 3""",
        _extra("referenceSummary", "reference", "group_pk", "facet_pk", "`count`", "group_count", "requested"),
    ),
    "facet_impact": Case(
        "query(collection('product'), filterBy(attributeLessThan('size', 30), userFilter(facetHaving('suppliers', entityPrimaryKeyInSet(1001, 1002)))), require(referenceSummaryOfReference('suppliers', IMPACT)))",
        """, base AS (SELECT pk FROM live WHERE size < 30), sel AS (SELECT DISTINCT group_pk, ref_pk FROM supply WHERE ref_pk IN (1001, 1002)),
        met AS (SELECT DISTINCT s.pk, s.group_pk FROM supply s JOIN sel USING (group_pk, ref_pk)),
        facets AS (SELECT DISTINCT group_pk, ref_pk FROM supply JOIN base USING (pk)),
        now AS (SELECT count(*) AS n FROM base WHERE (SELECT count(*) FROM met m WHERE m.pk = base.pk) = (SELECT count(DISTINCT group_pk) FROM sel)),
        hypo AS (
          SELECT f.group_pk, f.ref_pk, b.pk FROM facets f CROSS JOIN base b
          WHERE (SELECT count(*) FROM (SELECT DISTINCT group_pk FROM sel WHERE group_pk <> f.group_pk)) = (SELECT count(*) FROM met m WHERE m.pk = b.pk AND m.group_pk <> f.group_pk)
            AND (EXISTS (SELECT 1 FROM supply s WHERE s.pk = b.pk AND s.ref_pk = f.ref_pk) OR EXISTS (SELECT 1 FROM met m WHERE m.pk = b.pk AND m.group_pk = f.group_pk)))
        SELECT f.group_pk::BIGINT AS group_pk, f.ref_pk AS facet_pk, count(h.pk) AS match_count, count(h.pk) - (SELECT n FROM now) AS difference FROM facets f LEFT JOIN hypo h USING (group_pk, ref_pk) GROUP BY 1, 2""",
        _extra("referenceSummary:suppliers", "group_pk", "facet_pk", "match_count", "difference"),
    ),
    "facet_negation": Case(
        "query(collection('product'), filterBy(userFilter(facetHaving('brand', entityPrimaryKeyInSet(3, 4)))), require(facetGroupsNegation('brand')))",
        "SELECT pk FROM live WHERE brand NOT IN ('Brand#3', 'Brand#4')",
    ),
    "facet_conjunction": Case(
        "query(collection('product'), filterBy(userFilter(facetHaving('suppliers', groupHaving(attributeEquals('name', 'NATION_15')), entityPrimaryKeyInSet(1001, 1016, 1031, 1046)))), require(facetGroupsConjunction('suppliers', filterBy(attributeEquals('name', 'NATION_15')))))",
        ", sel AS (SELECT DISTINCT ref_pk FROM supply JOIN geo g ON g.pk = group_pk WHERE g.name = 'NATION_15' AND ref_pk IN (1001, 1016, 1031, 1046)) SELECT pk FROM live WHERE (SELECT count(DISTINCT ref_pk) FROM supply s WHERE s.pk = live.pk AND s.ref_pk IN (SELECT ref_pk FROM sel)) = (SELECT count(*) FROM sel)",
    ),
    "facet_disjunction_between": Case(
        "query(collection('product'), filterBy(userFilter(facetHaving('suppliers', entityPrimaryKeyInSet(1001, 1002, 1003)))), require(facetGroupsDisjunction('suppliers', WITH_DIFFERENT_GROUPS)))",
        "SELECT pk FROM live WHERE pk IN (SELECT pk FROM supply WHERE ref_pk IN (1001, 1002, 1003))",
    ),
    "facet_children": _match("facetHaving('suppliers', entityPrimaryKeyInSet(109), includingChildren())", "pk IN (SELECT pk FROM supply WHERE ref_pk IN (SELECT node FROM closure WHERE ancestor = 109))"),
    "facet_children_having": Case(
        "query(collection('product'), filterBy(facetHaving('suppliers', entityPrimaryKeyInSet(4), includingChildrenHaving(attributeLessThan('balance', 4000)))), require(facetGroupsDisjunction('suppliers', WITH_DIFFERENT_GROUPS)))",
        "SELECT pk FROM live WHERE pk IN (SELECT pk FROM supply WHERE ref_pk IN (SELECT node FROM closure JOIN geo ON geo.pk = node WHERE ancestor = 4 AND distance > 0 AND balance < 4000))",
    ),
    "facet_children_except": Case(
        "query(collection('product'), filterBy(facetHaving('suppliers', entityPrimaryKeyInSet(4), includingChildrenExcept(attributeLessThan('balance', 4000)))), require(facetGroupsConjunction('suppliers')))",
        """, sel AS (SELECT DISTINCT group_pk, ref_pk FROM supply JOIN closure ON node = ref_pk JOIN geo ON geo.pk = node WHERE ancestor = 4 AND balance >= 4000)
        SELECT live.pk FROM live WHERE (SELECT count(DISTINCT (s.group_pk, s.ref_pk)) FROM supply s JOIN sel USING (group_pk, ref_pk) WHERE s.pk = live.pk) = (SELECT count(*) FROM sel) AND EXISTS (SELECT 1 FROM sel)""",
    ),
    "hierarchy_stats_from_root": Case(
        "query(collection('product'), filterBy(attributeLessThan('size', 10), hierarchyWithin('suppliers', attributeEquals('name', 'ASIA'))), require(hierarchyOfReference('suppliers', fromRoot('menu', stopAt(level(2)), statistics(CHILDREN_COUNT, QUERIED_ENTITY_COUNT)))))",
        """, own AS (SELECT DISTINCT pk, ref_pk AS node FROM supply JOIN live USING (pk) WHERE size < 10),
        q AS (SELECT ancestor AS node, count(DISTINCT pk) AS queried_entity_count FROM closure JOIN own USING (node) GROUP BY 1),
        ch AS (SELECT ancestor AS node, count(*) AS children_count FROM closure WHERE distance > 0 AND node IN (SELECT node FROM q) GROUP BY 1)
        SELECT node, level::INTEGER AS level, coalesce(children_count, 0) AS children_count, queried_entity_count FROM (SELECT DISTINCT node, level FROM closure) JOIN q USING (node) LEFT JOIN ch USING (node) WHERE level <= 2""",
        _extra("hierarchy:suppliers:menu", "node", "level", "children_count", "queried_entity_count"),
    ),
    "hierarchy_stats_complete": Case(
        "query(collection('product'), filterBy(attributeLessThan('size', 10), hierarchyWithin('suppliers', attributeEquals('name', 'NATION_8')), userFilter(attributeInSet('type', 'PROMO', 'SMALL'))), require(hierarchyOfReference('suppliers', fromRoot('menu', stopAt(level(2)), statistics(COMPLETE_FILTER, QUERIED_ENTITY_COUNT)))))",
        """, own AS (SELECT DISTINCT pk, ref_pk AS node FROM supply JOIN live USING (pk) WHERE size < 10 AND type IN ('PROMO', 'SMALL') AND pk IN (SELECT pk FROM supply WHERE ref_pk IN (SELECT node FROM closure WHERE ancestor = 109))),
        q AS (SELECT ancestor AS node, count(DISTINCT pk) AS queried_entity_count FROM closure JOIN own USING (node) GROUP BY 1)
        SELECT DISTINCT node, queried_entity_count FROM q JOIN closure USING (node) WHERE level <= 2""",
        _extra("hierarchy:suppliers:menu", "node", "queried_entity_count"),
    ),
    "hierarchy_stats_without_itself": Case(
        "query(collection('product'), filterBy(attributeLessThan('size', 10), userFilter(hierarchyWithin('suppliers', attributeEquals('name', 'NATION_8')), attributeInSet('type', 'PROMO', 'SMALL'))), require(hierarchyOfReference('suppliers', fromRoot('menu', stopAt(level(2)), statistics(COMPLETE_FILTER_EXCLUDING_SELF_IN_USER_FILTER, QUERIED_ENTITY_COUNT)))))",
        """, own AS (SELECT DISTINCT pk, ref_pk AS node FROM supply JOIN live USING (pk) WHERE size < 10 AND type IN ('PROMO', 'SMALL')),
        q AS (SELECT ancestor AS node, count(DISTINCT pk) AS queried_entity_count FROM closure JOIN own USING (node) GROUP BY 1)
        SELECT DISTINCT node, queried_entity_count FROM q JOIN closure USING (node) WHERE level <= 2""",
        _extra("hierarchy:suppliers:menu", "node", "queried_entity_count"),
    ),
    "hierarchy_stats_in_order": Case(
        "query(collection('product'), require(hierarchyOfReference('suppliers', orderBy(attributeNatural('name', DESC)), fromRoot('menu', stopAt(level(2))))))",
        """, q AS (SELECT DISTINCT ancestor AS node FROM closure JOIN supply ON ref_pk = node JOIN live USING (pk)),
        places AS (SELECT pk AS node, row_number() OVER (PARTITION BY parent_pk ORDER BY name DESC, pk) AS place FROM geo)
        SELECT DISTINCT node, place FROM q JOIN places USING (node) JOIN closure USING (node) WHERE level <= 2""",
        _extra("hierarchy:suppliers:menu", "node", "place"),
    ),
    "hierarchy_stats_children": Case(
        "query(collection('product'), filterBy(hierarchyWithin('suppliers', attributeEquals('name', 'ASIA'))), require(hierarchyOfReference('suppliers', children('below', stopAt(distance(1))))))",
        f""", own AS (SELECT DISTINCT pk, ref_pk AS node FROM supply JOIN live USING (pk)), q AS (SELECT ancestor AS node, count(DISTINCT pk) AS queried_entity_count FROM closure JOIN own USING (node) GROUP BY 1)
        SELECT node, queried_entity_count FROM q JOIN closure USING (node) JOIN geo ON geo.pk = ancestor WHERE geo.name = 'ASIA' AND distance <= 1""",
        _extra("hierarchy:suppliers:below", "node", "queried_entity_count"),
    ),
    "hierarchy_stats_parents": Case(
        "query(collection('product'), filterBy(hierarchyWithin('suppliers', attributeEquals('name', 'NATION_7'))), require(hierarchyOfReference('suppliers', parents('up', siblings()))))",
        """, p AS (SELECT ancestor AS node FROM closure JOIN geo ON geo.pk = node WHERE geo.name = 'NATION_7'),
        s AS (SELECT g.pk AS node FROM geo g WHERE coalesce(g.parent_pk, 0) IN (SELECT coalesce(parent_pk, 0) FROM geo JOIN p ON geo.pk = p.node)),
        q AS (SELECT ancestor AS node, count(DISTINCT supply.pk) AS queried_entity_count FROM closure JOIN supply ON ref_pk = node JOIN live USING (pk) GROUP BY 1)
        SELECT node, queried_entity_count FROM q WHERE node IN (SELECT node FROM p UNION SELECT node FROM s)""",
        _extra("hierarchy:suppliers:up", "node", "queried_entity_count"),
    ),
    "hierarchy_stats_siblings": Case(
        "query(collection('product'), filterBy(hierarchyWithin('suppliers', attributeEquals('name', 'NATION_7'))), require(hierarchyOfReference('suppliers', siblings('beside'))))",
        """, q AS (SELECT ancestor AS node, count(DISTINCT supply.pk) AS queried_entity_count FROM closure JOIN supply ON ref_pk = node JOIN live USING (pk) GROUP BY 1)
        SELECT node, queried_entity_count FROM q JOIN geo g ON g.pk = node WHERE g.parent_pk = (SELECT parent_pk FROM geo WHERE name = 'NATION_7') AND g.name <> 'NATION_7'""",
        _extra("hierarchy:suppliers:beside", "node", "queried_entity_count"),
    ),
    "hierarchy_stats_from_node": Case(
        "query(collection('geo'), require(hierarchyOfSelf(fromNode('part', node(filterBy(attributeEquals('name', 'AFRICA'))), statistics(CHILDREN_COUNT, QUERIED_ENTITY_COUNT)))))",
        """, ch AS (SELECT ancestor AS node, count(*) FILTER (distance > 0) AS children_count, count(*) AS queried_entity_count FROM closure GROUP BY 1)
        SELECT c.node, children_count, queried_entity_count FROM closure c JOIN geo ON geo.pk = c.ancestor JOIN ch ON ch.node = c.node WHERE geo.name = 'AFRICA'""",
        _extra("hierarchy:self:part", "node", "children_count", "queried_entity_count"),
    ),
}


def _for_sale(q: Query) -> DataFrame:
    from shelfwise.operators import prices

    return prices.for_sale(q.ctx).select("pk", F.col("amount").cast("decimal(22,2)").alias("amount"))


def _runner(case: Case) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: case.result(Query(catalog(spark, sf_dir), case.text, now=NOW))


# What isn't a query of the language


def _closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    q = Query(c, "query(collection('geo'))", now=NOW)
    return hierarchy.closure(hierarchy.nodes(q.ctx)).select("ancestor", "node", "distance", "level")


def _predecessors(parts: DataFrame) -> DataFrame:
    """Parts of each brand as a linked list by key, the first of each brand named by the head."""
    before = F.lag("p_partkey").over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    return parts.select(F.col("p_partkey").cast("int").alias("pk"), F.coalesce(before.cast("int"), F.lit(chains.HEAD)).alias("predecessor"))


def _chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists of all brands: where each part stands, and the first part of its list."""
    return chains.positions(_predecessors(spark.read.parquet(f"{sf_dir}/part.parquet"))).select("pk", F.col("chain").cast("int").alias("chain"), F.col("position").cast("long").alias("position"))


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all lists, the one that the SQL twin names."""
    own = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_brand = 'Brand#3'").select(F.col("p_partkey").cast("int").alias("pk"))
    return _chains(spark, sf_dir).join(own, "pk", "left_semi").select("pk", "position")


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def _mutated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers after the events: errors remove one, signups make one, purchases and views set and clear the segment, clicks set the balance."""
    e = _changes(spark, sf_dir)
    kind = F.col("container_name")
    as_ = lambda **x: F.coalesce(*(F.when(kind == k, v) for k, v in x.items()))
    rows = e.select(
        "version", "index", "ts", "area", F.lit("customer").alias("entity_type"), "pk", F.when(kind.isin("error", "view"), "REMOVE").otherwise("UPSERT").alias("operation"),
        F.when(kind.isin("error", "signup"), "ENTITY").otherwise("ATTRIBUTE").alias("container_type"), as_(purchase="segment", view="segment", click="balance").alias("container_name"), "body",
    )
    return mutations.applied(catalog(spark, sf_dir)["customer"], rows).frame.select("pk", "segment", "balance")


def _expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfwise.functions.expressions import column

    c = catalog(spark, sf_dir)
    df = c["product"].frame
    row = {"entity": {"attributes": {k: F.col(k) for k in ("size", "list_price", "available", "tags")}}}
    parts = {
        "a": "$entity.attributes['size'] % 7 + 2 * 3", "b": "abs(-$entity.attributes['size']) >= 10 && !($entity.attributes['size'] == 12)", "c": "$entity.attributes['available'] ?? false",
        "d": "max($entity.attributes['size'], 25) - min($entity.attributes['size'], 25)", "e": "$entity.attributes['tags'].size()", "f": "$entity.attributes['size'] > 40 ^ $entity.attributes['size'] < 45", "g": "round($entity.attributes['size'])",
    }
    return df.select("pk", *(column(text, row).alias(k) for k, text in parts.items()))


def _expressions_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfwise.functions.expressions import column

    df = catalog(spark, sf_dir)["product"].frame
    row = {"entity": {"attributes": {k: F.col(k) for k in ("size", "list_price", "tags", "validity", "name")}}, "on": F.col("available")}
    size, price, tags, valid = (f"$entity.attributes['{k}']" for k in ("size", "list_price", "tags", "validity"))
    parts = {
        "a": f"{size} != 7 || {size} <= 3", "b": f"ceil({price} / 7) - floor({price} / 7)", "c": f"{size} / 7", "d": f"{price} / {size}", "e": f"{tags}.any(item == 'red') && {tags}.none(item == 'ring')", "f": f"{tags}.all(item != 'blue')",
        "g": f"{valid}.from ?? -1", "h": f"{valid}?.to ?? -1", "i": f"sqrt({size}) + log({size}) + pow({size}, 3)", "j": "$entity.attributes['name'].entries.size()", "k": f"{tags}.*[item == 'red'].size()", "l": f"({tags} *? 'none')[0]", "m": f"+{size} - -2",
    }
    return df.select("pk", *(column(text, row).alias(k) for k, text in parts.items())).withColumn("i", F.round("i", 6))


OTHERS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "hierarchy_closure": (_closure, PRELUDE + "SELECT ancestor, node, distance::INTEGER AS distance, level::INTEGER AS level FROM closure"),
    "predecessor_chain": (_chain, "SELECT p_partkey::INTEGER AS pk, row_number() OVER (ORDER BY p_partkey) - 1 AS position FROM part WHERE p_brand = 'Brand#3'"),
    "predecessor_chains": (_chains, "SELECT p_partkey::INTEGER AS pk, (min(p_partkey) OVER (PARTITION BY p_brand))::INTEGER AS chain, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS position FROM part"),
    "changes_captured": (
        lambda s, d: changes.captured(_changes(s, d), [changes.Criterion(operations=("REMOVE",)), changes.Criterion(container_names=("purchase",), pk=7)], 1704070000, 0, "HEADER").select("version", "index", "pk", "operation", "container_name"),
        "SELECT epoch(date_trunc('minute', ts))::BIGINT AS version, event_id::INTEGER AS index, user_id::INTEGER AS pk, CASE WHEN event_type = 'error' THEN 'REMOVE' ELSE 'UPSERT' END AS operation, event_type AS container_name FROM events WHERE (event_type = 'error' OR (event_type = 'purchase' AND user_id = 7)) AND epoch(date_trunc('minute', ts)) >= 1704070000",
    ),
    "changes_replayed": (
        lambda s, d: changes.replayed(_changes(s, d).withColumn("container_name", F.lit("last"))).select("pk", "body"),
        "SELECT pk, body FROM (SELECT user_id::INTEGER AS pk, event_type, value::DECIMAL(12,2)::VARCHAR AS body, row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('minute', ts) DESC, event_id DESC) AS n FROM events) WHERE n = 1 AND event_type <> 'error'",
    ),
    "changes_by_transaction": (lambda s, d: changes.transactions(_changes(s, d)).select("version", "changes", "entities"), "SELECT epoch(date_trunc('minute', ts))::BIGINT AS version, count(*) AS changes, count(DISTINCT user_id) AS entities FROM events GROUP BY 1"),
    "mutations_applied": (
        _mutated,
        """WITH e AS (SELECT user_id::BIGINT AS pk, epoch(date_trunc('minute', ts))::BIGINT AS v, event_id::BIGINT AS i, event_type AS t, value::DECIMAL(12,2) AS value FROM events),
        gone AS (SELECT pk, v AS gv, i AS gi FROM e WHERE t = 'error' QUALIFY row_number() OVER (PARTITION BY pk ORDER BY v DESC, i DESC) = 1),
        since AS (SELECT e.* FROM e LEFT JOIN gone USING (pk) WHERE gv IS NULL OR v > gv OR (v = gv AND i > gi)),
        seg AS (SELECT pk, CASE WHEN t = 'purchase' THEN value::VARCHAR END AS segment FROM since WHERE t IN ('purchase', 'view') QUALIFY row_number() OVER (PARTITION BY pk ORDER BY v DESC, i DESC) = 1),
        bal AS (SELECT pk, value AS balance FROM since WHERE t = 'click' QUALIFY row_number() OVER (PARTITION BY pk ORDER BY v DESC, i DESC) = 1),
        base AS (SELECT c_custkey AS pk, c_mktsegment AS segment, c_acctbal::DECIMAL(12,2) AS balance FROM customer)
        SELECT pk, CASE WHEN seg.pk IS NOT NULL THEN seg.segment WHEN gone.pk IS NULL THEN base.segment END AS segment, CASE WHEN bal.pk IS NOT NULL THEN bal.balance WHEN gone.pk IS NULL THEN base.balance END AS balance
        FROM (SELECT pk FROM base UNION SELECT pk FROM since) LEFT JOIN base USING (pk) LEFT JOIN seg USING (pk) LEFT JOIN bal USING (pk) LEFT JOIN gone USING (pk)
        WHERE gone.pk IS NULL OR pk IN (SELECT pk FROM since)""",
    ),
    "expressions": (
        _expressions,
        PRELUDE + """SELECT pk, size % 7 + 6 AS a, size >= 10 AND size <> 12 AS b, coalesce(available, FALSE) AS c, greatest(size, 25) - least(size, 25) AS d, len(tags)::INTEGER AS e, (size > 40) <> (size < 45) AS f,
        CASE WHEN size < 10 THEN size::DOUBLE ELSE round(size / 10.0) * 10 END::DOUBLE AS g FROM product""",
    ),
    "expressions_more": (
        _expressions_more,
        PRELUDE + """SELECT pk, size <> 7 OR size <= 3 AS a, (ceil(list_price / 7) - floor(list_price / 7))::BIGINT AS b, size / 7 AS c, list_price::DOUBLE / size AS d, list_contains(tags, 'red') AND NOT list_contains(tags, 'ring') AS e, NOT list_contains(tags, 'blue') AS f,
        coalesce(lo, -1) AS g, coalesce(hi, -1) AS h, round(sqrt(size) + ln(size) + pow(size, 3), 6) AS i, (CASE WHEN has_cs THEN 2 ELSE 1 END)::INTEGER AS j, len(tags)::INTEGER AS k, tags[1] AS l, size + 2 AS m FROM product""",
    ),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**{k: _runner(c) for k, c in CASES.items()}, **{k: f for k, (f, _) in OTHERS.items()}}


def oracle_sql() -> dict[str, str]:
    return {**{k: PRELUDE + c.sql for k, c in CASES.items() if c.sql}, **{k: sql for k, (_, sql) in OTHERS.items() if sql}}
