"""Registered queries against their SQL twins, and the pipeline stage by stage against brute force."""

import duckdb
import pytest

import corpus_pipeline
from shelfwise.llm import jaccard, language, queries, sql
from tests.compare import rows, views
from tests.llm.helpers import awkward, empty, texts
from tests.llm.test_text import base_by_hand, classes_by_hand, contained, sets_of


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_query_equals_sql(spark, small, name):
    con = duckdb.connect()
    views(con, small)
    cursor = con.execute(sql.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    df = queries.queries()[name](spark, small)
    assert rows(df.columns, map(tuple, df.collect())) == rows(columns, cursor.fetchall())


def test_shards_fit_and_hold_every_row(spark, small):
    from pyspark.sql import functions as F

    from shelfwise.llm import sharding

    docs = spark.read.parquet(f"{small}/documents.parquet")
    for limit in (500, 20_000, 10**9):
        out = sharding.assign(docs, F.col("doc_id"), F.octet_length("text"), limit).collect()
        by = {}
        for r in out:
            by.setdefault(r.shard, []).append(r)
        assert len(out) == docs.count() and len({r.doc_id for r in out}) == len(out)
        names = sorted(by)
        assert not any(b.startswith(a) for a, b in zip(names, names[1:]))  # no shard's prefix is another's
        for name, members in by.items():
            total = sum(r.row_bytes for r in members)
            assert total == members[0].shard_bytes and len(name) == members[0].shard_depth and (total <= limit or len(members) == 1)


def test_hot_keys_are_split_by_row_then_by_place(spark):
    from pyspark.sql import functions as F

    from shelfwise.llm import sharding

    hot = spark.range(400).select(F.lit(None).cast("string").alias("k"), (F.col("id") % 40).alias("v"), F.lit("x" * 10).alias("text"))
    df = hot.unionByName(spark.createDataFrame([("a", 1, None), ("b", 2, "")], "k string, v long, text string"))
    out = sharding.assign(df, F.col("k"), F.octet_length("text"), 60)
    sums = {r.shard: (r.n, r.b) for r in out.groupBy("shard").agg(F.count("*").alias("n"), F.sum("row_bytes").alias("b")).collect()}
    assert sum(n for n, _ in sums.values()) == 402 and all(b <= 60 for _, b in sums.values())
    assert sharding.assign(empty(spark), F.col("doc_id"), F.octet_length("text"), 10).count() == 0
    assert sharding.assign(awkward(spark).drop("key"), F.col("doc_id"), F.octet_length("text"), 100).count() == 18
    # Columns with the names of results are replaced, though the key or the payload be one of them.
    clash = df.withColumn("shard", F.col("k")).withColumn("row_bytes", F.octet_length("text")).withColumn("shard_depth", F.lit("x"))
    again = sharding.assign(clash, F.col("shard"), F.col("row_bytes"), 60)
    assert again.columns == ["k", "v", "text", "shard", "shard_depth", "shard_bytes", "row_bytes"] and all(x <= 60 for x in (r.shard_bytes for r in again.collect()))


def test_pipeline_stages(spark, small, tmp_path):
    bench = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, small).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if name == "packing":
            break
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == columns and set(after) <= set(before)
        if name == "language":
            assert set(before) - set(after) == {i for i, r in before.items() if not language.has_letter(r.text)}
        if name == "near_duplicates":
            classes = classes_by_hand(sets_of(((i, r.text) for i, r in before.items()), 5), 80, 100)
            assert set(after) == {i for i, (n, c) in classes.items() if c == i}
        if name == "decontaminate":
            assert set(before) - set(after) == {x[0] for x in contained([(i, r.text) for i, r in before.items()], bench.items())}
        if name == "secrets":
            changed = {i for i, r in before.items() if after[i].text != r.text}
            assert set(after) == set(before) and {i for i, r in before.items() if base_by_hand(r.text)} <= changed
            assert all(r.n_chars == len(r.text) for r in after.values())
            assert all(after[i].text == r.text for i, r in before.items() if not any(c.isdigit() for c in r.text) and "=" not in r.text and ":" not in r.text)
        before = after
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == set(before)


def test_pipeline_carries_columns_of_any_name(spark, small):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{small}/documents.parquet").limit(30)
    for name in ("score", "lang_pred", "fit", "held_out", "size", "print", "text_hash", "item_id", "spans", "key"):
        docs = docs.withColumn(name, F.lit(name))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns and out.where("score = 'score' and size = 'size' and lang_pred = 'lang_pred'").count() == out.count() > 0


def test_pipeline_rejects_text_of_no_learned_language(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    junk = [(10**6 + i, t, None, "x", len(t)) for i, t in enumerate(["xkcd qwrtp zzkj vbnm fghj klmnp qqwx " * 4, "Съешь же ещё этих мягких французских булок", "我能吞下玻璃而不伤身体", "12 34", None or ""])]
    out = corpus_pipeline.language(spark, docs.unionByName(spark.createDataFrame(junk, docs.schema)), small)
    ids = {r.doc_id for r in out.collect()}
    assert not any(i >= 10**6 for i in ids) and ids == {r.doc_id for r in docs.collect() if language.has_letter(r.text)}


def test_pipeline_of_nothing(spark, small):
    docs = empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
    assert docs.count() == 0


def test_first_of_each_class_in_any_order(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(60)
    kept = {r.doc_id for r in jaccard.one_of_each(docs.repartition(5)).collect()}
    assert kept == {i for i, (n, c) in classes_by_hand(sets_of(((r.doc_id, r.text) for r in docs.collect()), 5), 80, 100).items() if c == i}
    assert len(texts(f"{small}/documents.parquet")) == 200
