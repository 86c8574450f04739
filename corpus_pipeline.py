"""The corpus pipeline: five stages over `documents`, each a DataFrame that is written before the next reads it.

Every stage works on all that its predecessor kept and, but for the last,
returns the columns of documents.

1. language: documents whose language can't be told go, and those that no learned
   language explains.
2. near_duplicates: one document of each class of near-duplicates stays (5-word
   shingles, Jaccard similarity of 0.8 or more).
3. decontaminate: documents that contain a benchmark item go.
4. secrets: what is found is replaced in the text.
5. packing: token sequences for training.

Defined cases: null texts have no language and so end at stage 1; an empty table
stays empty; extra columns of any name are carried to stage 4; texts are worked on
whole, however long; of documents that are equally good to stay that with the
smallest identifier does (null before all), of rows equal in identifier and text
one; rows of one identifier with other texts, or of none, are documents of their
own at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import decontaminate as benchmark
from shelfwise.llm import jaccard, packing, secrets
from shelfwise.llm import language as languages
from shelfwise.llm.common import scratch, table
from shelfwise.llm.queries import tokenizer

#: Posterior of its language below which a document is rejected.
LEAST_SCORE = 0.5
#: Fit (see shelfwise.llm.language) below which no learned language explains a document.
LEAST_FIT = 0.0

#: The stages learn models; SQL can't express them.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, those whose best language has no majority of the posterior, and those that it doesn't fit."""
    model = languages.train(docs.where(~languages.held_out(docs["doc_id"]) & docs["lang"].isNotNull()))
    lang, score, fit = out = tuple(fresh(docs, name) for name in languages.OUT)
    judged = languages.predict(docs, model, out, text=True)
    return judged.where((F.col(lang) != "und") & (F.col(score) >= LEAST_SCORE) & (F.col(fit) >= LEAST_FIT)).select(*(f"`{c}`" for c in docs.columns))


def fresh(docs: DataFrame, name: str) -> str:
    """A name like this one that no column has, in any case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs, 5, 80, 100)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return benchmark.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secrets.mask_documents(docs, secrets.learn(docs))
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer())


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("secrets", mask_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
