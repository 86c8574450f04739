from datetime import datetime, timedelta

from shelfwise.sources import changes
from shelfwise.streaming import changes as streams


def rows(n):
    t = datetime(2024, 1, 1)
    return [(i // 3, i % 3, t + timedelta(minutes=i), "DATA", "item", i % 4, "REMOVE" if i % 5 == 4 else "UPSERT", "ATTRIBUTE", "size", str(i)) for i in range(n)]


def test_stream_equals_batch_and_misses_nothing(spark, tmp_path):
    path, seen = str(tmp_path / "changes"), []
    wanted = [changes.Criterion(operations=("REMOVE",)), changes.Criterion(pk=2)]
    for part in (rows(20)[:11], rows(20)[11:]):
        changes.append(spark.createDataFrame(part, changes.SCHEMA).coalesce(1), path)
        q = streams.by_transaction(streams.capture(spark, path, wanted, 1, 1), lambda batch, _: seen.extend((r.version, r["index"]) for r in batch.collect()), str(tmp_path / "checkpoint"))
        q.awaitTermination(60)
    batch = changes.captured(changes.read(spark, path), wanted, 1, 1)
    assert sorted(seen) == sorted((r.version, r["index"]) for r in batch.collect()) and len(seen) == len(set(seen)) > 5
    assert "body" not in changes.captured(changes.read(spark, path), content="HEADER").columns


def test_replay_and_current_state(spark, tmp_path):
    path = str(tmp_path / "changes")
    changes.append(spark.createDataFrame(rows(19), changes.SCHEMA), path)
    want = {r[5]: r for r in rows(19)}
    want = {(k, r[9]) for k, r in want.items() if r[6] != "REMOVE"}
    assert {(r.pk, r.body) for r in changes.replayed(changes.read(spark, path)).collect()} == want
    q = streams.current_state(streams.capture(spark, path)).writeStream.outputMode("complete").format("memory").queryName("state").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.pk, r.body) for r in spark.table("state").collect()} == want


def test_activity_windows(spark, tmp_path):
    path = str(tmp_path / "changes")
    changes.append(spark.createDataFrame(rows(60), changes.SCHEMA), path)
    q = streams.activity(streams.capture(spark, path)).writeStream.outputMode("append").format("memory").queryName("activity").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("activity").where("operation = 'UPSERT'").count() >= 1


def test_export(spark, tmp_path):
    df = spark.createDataFrame(rows(6), changes.SCHEMA)
    changes.export(df, str(tmp_path / "out"), partition_by=("operation",))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_whole_versions_are_handed_over(spark, tmp_path):
    """A version that two batches share comes in one piece."""
    path, seen = str(tmp_path / "changes"), []
    for part in (rows(20)[:4], rows(20)[4:8], rows(20)[8:]):
        changes.append(spark.createDataFrame(part, changes.SCHEMA).coalesce(1), path)
        q = streams.by_transaction(streams.capture(spark, path), lambda batch, _: seen.append([(r.version, r["index"]) for r in batch.collect()]), str(tmp_path / "checkpoint"), flush=False)
        q.awaitTermination(60)
    assert [x for part in seen for x in part] == [(i // 3, i % 3) for i in range(18)]  # version 6 may go on
    assert all(a[-1][0] < b[0][0] for a, b in zip(seen, seen[1:]) if a and b)


def test_system_changes(spark, tmp_path):
    path = str(tmp_path / "changes")
    made = [(1, 0, datetime(2024, 1, 1), "ENGINE", None, None, "UPSERT", "CATALOG", "shop", None), *rows(3)]
    changes.append(spark.createDataFrame(made, changes.SCHEMA), path)
    q = streams.system(spark, path).writeStream.outputMode("append").format("memory").queryName("system").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r.container_name, r.operation) for r in spark.table("system").collect()] == [("shop", "UPSERT")]


def test_mutations_of_references_and_prices(spark):
    from decimal import Decimal

    from shelfwise.catalog import Attribute, Collection, Reference
    from shelfwise.sources import mutations

    frame = spark.createDataFrame([(1, "LIVE", 5, "a", ["x"]), (2, "LIVE", None, "b", None), (3, "LIVE", 1, "c", None)], "pk int, scope string, parent_pk int, name string, tags array<string>")
    link = spark.createDataFrame([(1, 7, None, 1), (1, 8, None, 2), (2, 7, None, 3)], "pk int, ref_pk int, group_pk int, rank int")
    price = spark.createDataFrame([(1, 100, Decimal(5)), (2, 200, Decimal(6))], "pk int, price_id long, price_with_tax decimal(12,2)")
    c = Collection("item", frame, {"name": Attribute(), "tags": Attribute(array=True)}, {"link": Reference(link, "item", attributes={"rank": Attribute("int")})}, price, hierarchical=True)
    t = datetime(2024, 1, 1)
    log = [
        (1, 1, "UPSERT", 1, "ATTRIBUTE", "name", "A"), (1, 2, "UPSERT", 1, "ATTRIBUTE", "tags", '["y","z"]'), (1, 3, "REMOVE", 1, "PARENT", None, None), (1, 4, "UPSERT", 1, "SCOPE", None, "ARCHIVED"),
        (2, 1, "REMOVE", 1, "REFERENCE", "link:8", None), (2, 2, "UPSERT", 1, "REFERENCE", "link:9", '{"group_pk": 4, "rank": 6}'), (2, 3, "UPSERT", 1, "PRICE", "100", '{"price_with_tax": 9.5}'),
        (3, 1, "REMOVE", 2, "ENTITY", None, None), (4, 1, "UPSERT", 4, "ENTITY", None, None), (4, 2, "UPSERT", 4, "PARENT", None, "1"), (5, 1, "REMOVE", 3, "ENTITY", None, None), (6, 1, "UPSERT", 3, "ATTRIBUTE", "name", "again"),
    ]
    df = spark.createDataFrame([(v, i, t, "DATA", "item", pk, op, kind, name, body) for v, i, op, pk, kind, name, body in log], changes.SCHEMA)
    out = mutations.applied(c, df)
    assert sorted(map(tuple, out.frame.collect())) == [(1, "ARCHIVED", None, "A", ["y", "z"]), (3, "LIVE", None, "again", None), (4, "LIVE", 1, None, None)]
    assert sorted(map(tuple, out.references["link"].frame.collect())) == [(1, 7, None, 1), (1, 9, 4, 6)]
    assert sorted(map(tuple, out.prices.collect())) == [(1, 100, Decimal("9.50"))]
    assert sorted(r.pk for r in mutations.applied(c, df, 2).frame.collect()) == [1, 2, 3]


def test_schema_changes(spark):
    import pytest

    from shelfwise.catalog import Attribute, Catalog, Collection, Reference
    from shelfwise.constraints import QueryError
    from shelfwise.plans.compiler import Query
    from shelfwise.sources import mutations as m

    item = Collection("item", spark.createDataFrame([(1, "LIVE", "a")], "pk int, scope string, name string"), {"name": Attribute()})
    kind = Collection("kind", spark.createDataFrame([(5, "LIVE")], "pk int, scope string"), {})
    c = m.with_collection(Catalog({"item": item}), kind)
    c = m.with_reference(c, "item", "kind", Reference(spark.createDataFrame([(1, 5, None)], "pk int, ref_pk int, group_pk int"), "kind"))
    c = m.with_attribute(c, "item", "size", Attribute("int"))
    c = m.with_compound(c, "item", "both", (("name", "ASC", "LAST"), ("size", "DESC", "LAST")))
    c = m.renamed_collection(c, "kind", "sort")
    keys = lambda text: [r.pk for r in Query(c, text).matching.collect()]
    assert keys("query(collection('item'), filterBy(attributeIsNull('size'), referenceHaving('kind', entityHaving(entityPrimaryKeyInSet(5)))))") == [1]
    with pytest.raises(QueryError):
        m.without_collection(c, "sort")
    with pytest.raises(QueryError):
        m.without_attribute(c, "item", "size")
    with pytest.raises(QueryError):
        m.with_collection(c, item)
    c = m.without_collection(m.without_reference(c, "item", "kind"), "sort")
    assert set(c.collections) == {"item"}
    with pytest.raises(QueryError):
        Query(c, "query(collection('item'), filterBy(referenceHaving('kind')))").matching  # noqa: B018


def test_traffic_is_recorded(spark, tmp_path):
    from shelfwise.catalog import Attribute, Catalog, Collection
    from shelfwise.plans import traffic
    from shelfwise.plans.compiler import Query

    c = Catalog({"item": Collection("item", spark.createDataFrame([(1, "LIVE", "a"), (2, "LIVE", "b")], "pk int, scope string, name string"), {"name": Attribute()})})
    path = str(tmp_path / "log")
    for name in ("a", "b"):
        traffic.recorded(Query(c, f"query(head(label('page', '{name}')), collection('item'), filterBy(attributeEquals('name', '{name}')))"), path)
    traffic.recorded(Query(c, "query(collection('item'))"), path, percent=0)
    assert traffic.read(spark, path).count() == 2
    (r,) = traffic.read(spark, path, datetime(2024, 1, 1), {"page": "b"}).collect()
    assert r.total == 1 and "attributeEquals('name', 'b')" in r["query"] and r.seconds > 0
