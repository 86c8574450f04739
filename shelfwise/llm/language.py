"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of hashed 2- and 3-grams of code points are taken over every labelled
training document; the log-probability matrix (languages x buckets, bounded by
`buckets` and the number of languages) is broadcast and whole texts are scored
in numpy, a batch of documents at a time.

A posterior is near 1 for any long text, so it can't tell text of no learned
language. `fit` does: the mean log-probability in the language found of the
text's n-grams of letters and spaces, less that in a model that knows nothing and
takes all buckets for equally likely. Below 0 no learned language explains the
text; numbers, keys and signs in it don't count.

Defined cases: a text that is null or has no letter is ``und`` with score 0;
with nothing to learn from every document is ``und``; equal likelihoods go to
the language that sorts first; extra columns are ignored; repeated rows each
count in training and each get their result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from shelfwise.llm.common import slices

BUCKETS = 1 << 15
SMOOTHING = 0.5


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def grams(texts: list[str], buckets: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For 2-grams and for 3-grams: the bucket of each in all texts, where each text's begin, and whether it is of letters and spaces (of ASCII no others).

    Texts have a letter each; they are lower-cased and bordered by a space.
    """
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    joined = [f" {t.lower()} " for t in texts]
    sizes = np.fromiter(map(len, joined), dtype=np.int64, count=len(joined))
    c = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint32)
    two = (c[:-1] * np.uint32(0x9E3779B1) ^ c[1:] * np.uint32(0x85EBCA77)) * np.uint32(0xC2B2AE3D)
    three = (two[:-1] ^ c[2:] * np.uint32(0x27D4EB2F)) * np.uint32(0x165667B1)
    last = np.cumsum(sizes) - 1
    across2 = np.ones(len(two), dtype=bool)
    across2[last[:-1]] = False
    across3 = np.ones(len(three), dtype=bool)
    across3[last[:-1]] = across3[last[:-1] - 1] = False
    plain = (c > 127) | (c == 32) | (c - 97 < 26)  # unsigned, so below the letters it is large
    plain2 = plain[:-1] & plain[1:]
    plain3 = plain2[:-1] & plain[2:]
    out = []
    for h, inside, fewer, letters in ((two, across2, 1, plain2), (three, across3, 2, plain3)):
        n = sizes - fewer
        out.append(((h[inside] >> shift).astype(np.int32), np.cumsum(n) - n, letters[inside]))
    return out


def train(docs: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> dict:
    """Learn from every row of (text, lang) with a language and a letter.

    Returns languages in order, the matrix of log-probabilities (buckets x
    languages, float32) and the log-priors.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, n in sums.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at - 1, pa.int32()), pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])
            sums.clear()

        for batch in slices(batches, "text", 4 << 20):
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            keep = [i for i, t in enumerate(texts) if langs[i] is not None and has_letter(t)]
            if not keep:
                continue
            of: dict[str, list[np.ndarray]] = {}
            for idx, begins, _ in grams([texts[i] for i in keep], buckets):
                ends = np.append(begins[1:], len(idx))
                for j, i in enumerate(keep):
                    of.setdefault(langs[i], []).append(idx[begins[j] : ends[j]])
            for lang, parts in of.items():
                total = sums.setdefault(lang, np.zeros(buckets + 1, dtype=np.int64))  # at 0: documents, as bucket -1
                total[0] += len(parts) // 2
                total[1:] += np.bincount(np.concatenate(parts), minlength=buckets)
            if len(sums) > 256:  # bounds the memory of a task; the sums go on below
                yield from rows()
        yield from rows()

    found = docs.select(docs["text"], docs["lang"]).mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    pdf = found.toPandas()  # languages x buckets
    langs = sorted(pdf["lang"].unique())
    place = {x: i for i, x in enumerate(langs)}
    counts = np.zeros((buckets + 1, len(langs)))
    counts[pdf["bucket"].to_numpy() + 1, pdf["lang"].map(place).to_numpy().astype(int) if len(pdf) else []] = pdf["n"]
    prior, counts = counts[0], counts[1:]
    logp = np.log(counts + smoothing) - np.log(counts.sum(axis=0) + smoothing * buckets)
    return {"langs": langs, "logp": np.ascontiguousarray(logp, dtype=np.float32), "prior": np.log(np.maximum(prior, 1)) - np.log(max(prior.sum(), 1)), "buckets": buckets}


def predict_batch(model: dict, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, posterior and fit of each text; without a language both are 0."""
    langs, scores, fits = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    keep = [i for i, t in enumerate(texts) if has_letter(t)] if model["langs"] else []
    if keep:
        # Sums run in float64 and text by text, so that a text's score doesn't depend on its batch.
        ll = np.tile(model["prior"], (len(keep), 1))
        found = grams([texts[i] for i in keep], model["buckets"])
        for idx, begins, _ in found:
            if len(keep) > 1:
                ll += np.add.reduceat(model["logp"][idx], begins, axis=0, dtype=np.float64)
            else:  # a text may be very long
                for i in range(0, len(idx), 1 << 20):
                    ll += model["logp"][idx[i : i + (1 << 20)]].sum(axis=0, dtype=np.float64)
        best = ll.argmax(axis=1)
        posterior = 1 / np.exp(ll - ll[np.arange(len(best)), best][:, None]).sum(axis=1)
        for j, i in enumerate(keep):
            langs[i] = model["langs"][best[j]]
        scores[keep] = posterior
        shown, n = np.zeros(len(keep)), np.zeros(len(keep))
        for idx, begins, plain in found:
            # As one gather of the plain ones; sums are differences of a running one.
            at = np.flatnonzero(plain)
            ends = np.searchsorted(at, np.append(begins, len(idx)))
            of = np.repeat(best.astype(np.int32), np.diff(ends))
            total = np.concatenate([[0.0], np.cumsum(model["logp"][idx[at], of], dtype=np.float64)])
            shown += total[ends[1:]] - total[ends[:-1]]
            n += np.diff(ends)
        fits[keep] = np.where(n > 0, shown / np.maximum(n, 1) + np.log(model["buckets"]), 0)
    return langs, scores, fits


OUT = ("lang_pred", "score", "fit")


def predict(docs: DataFrame, model: dict, out: tuple[str, str, str] = OUT, text: bool = False) -> DataFrame:
    """`docs`, every column but text (with `text` that too), with the language found, its score and its fit under the names of `out`.

    Columns of `docs` that have one of these names are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    carried = [(i, f) for i, f in enumerate(docs.schema.fields) if (text or f.name != "text") and f.name not in out]
    at = docs.columns.index("text")

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            langs, scores, fits = predict_batch(shared.value, batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i, _ in carried), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(fits, pa.float64())], [*(f.name for _, f in carried), *out])

    schema = StructType([*(f for _, f in carried), *(StructField(name, kind) for name, kind in zip(out, (StringType(), DoubleType(), DoubleType())))])
    return docs.mapInArrow(score, schema)


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from: crc32 of the identifier's text mod 4 is 2."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def identify(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Learn on the folds that aren't held out, predict all: doc_id, held_out, lang_pred, score, fit."""
    model = train(docs.where(~held_out(docs["doc_id"]) & docs["lang"].isNotNull()), buckets)
    return predict(docs.select(docs["doc_id"], held_out(docs["doc_id"]).alias("held_out"), docs["text"]), model)
