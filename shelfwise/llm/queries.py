"""The registered queries of this package, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import chat, decontaminate, jaccard, language, packing, quality, rans, repeats, secrets, sharding
from shelfwise.llm.common import table

#: Bytes of text in a shard: a unit that streaming loaders fetch and shuffle.
SHARD_BYTES = 1 << 20


def tokenizer() -> str:
    """The vocabulary file that the token queries take; operators have its path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, its shard (the hash prefix), the prefix's bits, the shard's bytes and the document's."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.assign(docs, F.col("doc_id"), F.octet_length("text"), SHARD_BYTES).drop("text")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.deduplicate(table(spark, sf_dir, "documents"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, part, role, rendered."""
    return chat.format_conversations(table(spark, sf_dir, "conversations"))


def op4_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.round_trip(table(spark, sf_dir, "documents"), tokenizer(), 1)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_labelled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.learn(docs))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sharding, op2_suffix_dedup, op3_chat, op4_rans, op5_quality, op6_secrets, op7_language, op8_decontaminate, op9_jaccard, op10_packing)}
