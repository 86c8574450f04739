"""Quality rules: surface rules, then a hashed n-gram log-likelihood ratio.

Two multinomials over hashed word 1- and 2-grams, one of trusted documents and
one of the raw corpus, give every bucket a weight log(p_trusted / p_raw). A
document's score is the mean weight of its n-grams, and it is kept when no
surface rule fails and its score is at least `threshold`. Both multinomials
count all their documents.

`judge_labelled` takes the bucket count from the corpus, so that buckets don't
fill up as it grows, and the threshold from labels that were held out.

All on DataFrame functions: a document's words, windows and lookups stay in
arrays within its row, so only the bucket counts (bounded by `buckets`) are
shuffled.

Defined cases: a null or empty text has no words, fails the base rule and has
score 0; without trusted documents all weights are 0; a text equal to an earlier
one is judged the same; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import checked_broadcast, settle

BUCKETS = 1 << 14
#: Buckets by which counts are made; `judge_labelled` folds them to about one for GRAMS n-grams, BUCKETS at least.
MOST_BUCKETS = 1 << 18
GRAMS = 128
#: Mean log-likelihood ratio, in nats per n-gram, from which a document is kept; with labels, the least such ratio.
THRESHOLD = -0.1
#: Steps, in nats, in which held-out scores are counted.
STEP = 1e-3
#: Weights are whole multiples of this, so that sums don't depend on their order.
UNIT = 1e-4
SMOOTHING = 1.0
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
WINDOW = 8
SPACES = " \t\n\x0b\f\r"


def _but_first(a: Column, n: int = 1) -> Column:
    return F.slice(a, n + 1, F.greatest(F.size(a) - n, F.lit(0)))


def _but_last(a: Column, n: int = 1) -> Column:
    return F.slice(a, 1, F.greatest(F.size(a) - n, F.lit(0)))


def _paired(a: Column, gap: int) -> Column:
    """Hash of each element with the one `gap` places on."""
    return F.zip_with(_but_last(a, gap), _but_first(a, gap), lambda x, y: F.xxhash64(x, y))


def words(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text, by built-in functions that are compiled."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+"))


def features(docs: DataFrame, *also: str) -> DataFrame:
    """(doc_id, text) to doc_id, `also`, the base columns, and arrays h1, h2 of word and word-pair hashes.

    Each step is a column of its own: what a lambda or a larger expression refers
    to twice would be computed twice, and what a lambda captures anew for every
    element. Windows of 8 words are hashed by doubling (2, 4, 8); sorted with
    their places, equal ones are neighbours. All is n log n in the words of a
    document.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    d = docs.select(
        docs["doc_id"],
        *also,
        F.transform(words(docs["text"]), lambda w: F.xxhash64(w)).alias("h1"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.filter(F.transform(F.split(text, "\n"), lambda x: F.when(F.trim(x, F.lit(SPACES)) != "", F.xxhash64(x))), lambda x: x.isNotNull()).alias("lines"),
    )
    d = d.select("*", F.size("h1").cast("long").alias("n_words"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), _paired(d["h1"], 1).alias("h2")).drop("lines")
    d = d.select("*", _paired(d["h2"], 2).alias("h4"))
    d = d.select("*", _paired(d["h4"], 4).alias("h8")).drop("h4")
    d = d.select("*", (F.size("h8") != F.size(F.array_distinct("h8"))).alias("some"))  # else no window is repeated
    none = F.array().cast("array<struct<w:bigint,i:int>>")
    numbered = F.transform("h8", lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    d = d.select("*", F.when(F.col("some"), F.array_sort(numbered)).otherwise(none).alias("sorted")).drop("h8", "some")
    twice = F.zip_with(_but_last(d["sorted"]), _but_first(d["sorted"]), lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
    d = d.select("*", F.array_sort(F.array_distinct(F.flatten(twice))).alias("starts")).drop("sorted")
    gaps = F.zip_with(_but_last(d["starts"]), _but_first(d["starts"]), lambda a, b: F.least(b - a, F.lit(WINDOW)))
    covered = F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x) + F.when(F.size("starts") > 0, WINDOW).otherwise(0)
    return d.select("doc_id", *also, "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"), "h1", "h2")


def _grams(docs: DataFrame, buckets: int) -> DataFrame:
    """(text, trusted) to a row for each 1- and 2-gram: its bucket, and trusted. Compiled throughout."""
    d = docs.select("trusted", words(docs["text"]).alias("w"))
    d = d.select("trusted", F.explode(F.arrays_zip(F.col("w").alias("a"), _but_first(F.col("w")).alias("b"))).alias("x"))
    a, b = F.xxhash64("x.a"), F.xxhash64("x.b")
    mask = F.lit(buckets - 1).cast("long")
    d = d.select("trusted", F.array(a.bitwiseAND(mask).cast("int"), F.when(F.col("x.b").isNotNull(), F.xxhash64(a, b).bitwiseAND(mask).cast("int"))).alias("g"))
    return d.select("trusted", F.explode("g").alias("bucket")).where("bucket is not null")


def weights(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> list[int]:
    """Log-likelihood ratio of every bucket, in UNITs.

    docs: (doc_id, text), the raw corpus; trusted: (doc_id) of the target. Only
    the two counts of each bucket reach the driver.
    """
    mark = trusted.select("doc_id").distinct().withColumn("trusted", F.lit(1).cast("long"))
    counts = _counts(docs, mark, buckets, F.sum("trusted"))
    return _ratios(counts[0], counts[1], smoothing)


def _counts(docs: DataFrame, mark: DataFrame, buckets: int, *targets: Column) -> list[list[int]]:
    """N-grams of each bucket: of all documents, then by each of `targets`, sums over `trusted` (0 where `mark` lacks the document)."""
    mark = checked_broadcast(mark.where("doc_id is not null").withColumnRenamed("doc_id", "t_id"))
    d = docs.select("doc_id", "text").join(mark, F.col("doc_id") == F.col("t_id"), "left").select("text", F.coalesce("trusted", F.lit(0).cast("long")).alias("trusted"))
    sums = [F.count(F.lit(1)), *targets]
    rows = _grams(d, buckets).groupBy("bucket").agg(*(x.alias(f"n{i}") for i, x in enumerate(sums))).collect()  # `buckets` rows at most
    out = [[0] * buckets for _ in sums]
    for r in rows:
        for i, counts in enumerate(out):
            counts[r["bucket"]] = r[f"n{i}"]
    return out


def _ratios(raw: list[int], target: list[int], smoothing: float = SMOOTHING) -> list[int]:
    if not any(target):
        return [0] * len(raw)
    raw, target = [x + smoothing for x in raw], [x + smoothing for x in target]
    all_raw, all_target = sum(raw), sum(target)
    return [round((math.log(t / all_target) - math.log(r / all_raw)) / UNIT) for t, r in zip(target, raw)]


def judge(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """Every document with its base columns, score (nats per n-gram) and verdict."""
    return _verdicts(docs, weights(docs, trusted, buckets), threshold)


def judge_labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`judge` by labels (doc_id, quality, toxic): quality 1 and not toxic is trusted, and the threshold is set by them.

    Weights from one half of the trusted documents score the other half and the
    documents of quality 0. The threshold is the highest at which the share of
    the first that is kept exceeds that of the second by most, but never below
    THRESHOLD. The verdicts are by weights from all trusted documents.
    """
    labels = labels.select("doc_id", "quality", "toxic")
    half = F.when(F.xxhash64("doc_id").bitwiseAND(F.lit(1).cast("long")) == 0, 1).otherwise(2).cast("long")
    trusted = labels.where("quality = 1 and toxic = 0").select("doc_id").distinct().withColumn("trusted", half)
    raw, target, first = _counts(docs, trusted, MOST_BUCKETS, F.sum((F.col("trusted") > 0).cast("long")), F.sum((F.col("trusted") == 1).cast("long")))
    buckets = BUCKETS
    while buckets < MOST_BUCKETS and buckets * GRAMS < sum(raw):
        buckets *= 2
    raw, target, first = ([sum(x[i::buckets]) for i in range(buckets)] for x in (raw, target, first))
    judged = trusted.where("trusted = 2").select("doc_id", F.lit(True).alias("good")).unionByName(labels.where("quality = 0").select("doc_id", F.lit(False).alias("good")).distinct())
    return _verdicts(docs, _ratios(raw, target), max(THRESHOLD, _parting(docs, judged, _ratios(raw, first))))


def _parting(docs: DataFrame, judged: DataFrame, w: list[int]) -> float:
    """The highest score that parts good documents from others best, among those that pass the base rules; THRESHOLD if either kind is missing."""
    judged = checked_broadcast(judged.where("doc_id is not null").withColumnRenamed("doc_id", "j_id"))
    d = docs.select("doc_id", "text").join(judged, F.col("doc_id") == F.col("j_id"))
    d = settle(_scored(d, w, "good").select("good", "base_failed", "units", "n_grams"), "quality-held-out").where(~F.col("base_failed"))  # written as the verdicts are
    step = F.floor(F.col("units") / F.col("n_grams") * (UNIT / STEP))
    rows = d.groupBy(step.alias("step"), "good").agg(F.count(F.lit(1)).alias("n")).collect()  # two a step at most
    counts = {True: {}, False: {}}
    for r in rows:
        counts[r["good"]][r["step"]] = r["n"]
    n_good, n_bad = (sum(counts[k].values()) for k in (True, False))
    if not n_good or not n_bad:
        return THRESHOLD
    best, at, good, bad = -1.0, THRESHOLD, 0, 0
    for x in sorted({*counts[True], *counts[False]}, reverse=True):
        good, bad = good + counts[True].get(x, 0), bad + counts[False].get(x, 0)
        if good / n_good - bad / n_bad > best:
            best, at = good / n_good - bad / n_bad, x * STEP
    return at


def _scored(docs: DataFrame, w: list[int], *also: str) -> DataFrame:
    """`features` of documents with base_failed, the sum of their weights (units) and n_grams."""
    # One foldable literal; it becomes a constant array when the plan is optimised.
    table = F.split(F.lit(",".join(map(str, w))), ",").cast("array<int>")
    d = features(docs.select("doc_id", "text", *also), *also)
    n = F.greatest(F.size("h1") + F.size("h2"), F.lit(1))
    mask = F.lit(len(w) - 1).cast("long")
    total = F.aggregate(F.concat("h1", "h2"), F.lit(0).cast("long"), lambda s, h: s + F.get(table, h.bitwiseAND(mask).cast("int")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return d.withColumn("units", total).withColumn("n_grams", n.cast("long")).withColumn("base_failed", failed)


def _verdicts(docs: DataFrame, w: list[int], threshold: float) -> DataFrame:
    d = _scored(docs, w)
    limit = F.lit(round(threshold / UNIT)).cast("long") * F.col("n_grams")
    out = d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("units") >= limit)).alias("kept"),
        (F.col("units") * UNIT / F.col("n_grams")).alias("score"),
    )
    # Written, so that a filter on the result isn't pushed down into the array steps, where each would be computed over and over.
    return settle(out, "quality")
