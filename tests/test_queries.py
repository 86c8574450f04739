"""Every registered query against its SQL twin, as the driver does, on the two smaller sets of tables."""

import re

import duckdb
import pytest

from shelfwise.operators import statistics
from shelfwise.plans import registry
from shelfwise.plans.compiler import Query
from shelfwise.sources.tables import catalog
from tests.compare import rows, views


@pytest.fixture(scope="module", params=["sf0.001", "sf0.01"])
def tables(request, small):
    sf_dir = small.replace("sf0.001", request.param)
    con = duckdb.connect()
    views(con, sf_dir)
    return sf_dir, con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, tables, name):
    sf_dir, con = tables
    df = registry.queries()[name](spark, sf_dir)
    cursor = con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    want = rows(columns, cursor.fetchall())
    assert want and rows(df.columns, map(tuple, df.collect())) == want


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def pushed(df, table):
    """What the scan of a table gets to filter by."""
    return [line.split("PushedFilters: [", 1)[1].split("], ReadSchema")[0] for line in plan(df).split("\n") if f"{table}.parquet" in line and "PushedFilters" in line]


@pytest.mark.parametrize(
    "name, table, wanted",
    [
        ("product_page", "part", ["GreaterThanOrEqual(p_size,5)", "LessThanOrEqual(p_size,25)", "StringStartsWith(p_brand,Brand#1)"]),
        ("attribute_in_set", "part", ["In(p_type, [LARGE,PROMO])", "In(p_size, [1,2,3])"]),
        ("key_compare", "part", ["GreaterThan(p_partkey,10)", "LessThanOrEqual(p_partkey,90)", "Or(LessThan(p_partkey,30),GreaterThanOrEqual(p_partkey,60))"]),
        ("attribute_string", "part", ["StringContains(p_brand,#1)", "StringEndsWith(p_brand,3)"]),
        ("price_in_lists", "lineitem", ["EqualTo(l_linestatus,F)", "EqualTo(l_returnflag,N)"]),
    ],
)
def test_comparisons_reach_the_scan(spark, small, name, table, wanted):
    spark.conf.set("spark.sql.maxMetadataStringLength", 4000)
    found = pushed(registry.queries()[name](spark, small), table)
    assert any(all(w.replace(" ", "") in f.replace(" ", "") for w in wanted) for f in found), found


def test_a_price_query_reads_prices_once(spark, small):
    text = "query(collection('product'), filterBy(priceInCurrency('O'), priceInPriceLists('R', 'A'), priceValidInNow(), priceBetween(100, 90000)), orderBy(priceNatural(DESC)))"
    q = Query(catalog(spark, small), text, now=registry.NOW)
    assert plan(q.page()).count("lineitem.parquet") == 1 and plan(q.matching).count("lineitem.parquet") == 1
    # Existence alone aggregates no prices.
    q = Query(catalog(spark, small), text.replace(", priceBetween(100, 90000)", "").replace(", orderBy(priceNatural(DESC))", ""), now=registry.NOW)
    assert "min_by" not in plan(q.matching) and plan(q.matching).count("lineitem.parquet") == 1


def test_a_page_is_fetched_by_its_keys(spark, small):
    """Under every aggregation of prices or references there is a semi-join with the page."""
    for name in ("fetch_prices", "fetch_references", "fetch_all"):
        text = registry.queries()[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
        depth, under = {}, 0
        for line in text.split("\n"):
            at = len(line) - len(line.lstrip(" :+-|"))
            if "collect_list" in line and "Aggregate" in line:
                depth[at] = False
            for d in [d for d in depth if at <= d and "collect_list" not in line]:
                assert depth.pop(d), text
            if "LeftSemi" in line:
                for d in depth:
                    depth[d], under = True, under + 1
        assert all(depth.values()) and under, text


def test_flagship(spark, small):
    assert registry.queries()[registry.FLAGSHIP](spark, small).count() > 0


@pytest.mark.parametrize("name", ["hierarchy_stats_in_order", "hierarchy_stats_parents", "hierarchy_stats_siblings"])
def test_statistics_are_counted_in_parts_that_do_not_grow(spark, small, monkeypatch, name):
    """More input makes more parts by entity; no partial result of node and entity is held, nor shuffled."""
    build = lambda: registry.queries()[name](spark, small)
    parts = lambda df: [int(n) for n in re.findall(r"hashpartitioning\(\w+#\d+L?, (\d+)\), REPARTITION_BY_NUM", plan(df))]
    few = build()
    want = sorted(few.collect())
    assert not re.search(r"hashpartitioning\((ancestor|node)#\d+, pk#", plan(few))
    monkeypatch.setattr(statistics, "TASK_BYTES", statistics.TASK_BYTES >> 10)
    many = build()
    assert parts(few) and min(parts(many)) > 2 * max(parts(few)) and sorted(many.collect()) == want
    monkeypatch.setattr(statistics, "BROADCAST_PAIRS", 0)
    assert sorted(build().collect()) == want
