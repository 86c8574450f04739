"""Small documents that hold the awkward cases, and readers of the driver's tables."""

import pyarrow.parquet as pq

LONG = ("alpha beta gamma delta " * 30 + "omega. ") * 40

#: Null, empty and blank texts, ties, repeated rows, one very long text, non-ASCII and an astral character.
AWKWARD = [
    (0, "The quick brown fox jumps over the lazy dog and runs away from the hound again and again today"),
    (1, None),
    (2, ""),
    (3, " \n\t\r "),
    (4, "one"),
    (5, "one"),
    (6, "ONE two"),
    (7, LONG),
    (8, LONG + "x"),
    (9, "Ünïcödé wörds \U0001f600 ça été là, naïve"),
    (10, "The quick brown fox jumps over the lazy dog and runs away from the hound again and again today"),
    (11, "no\nno\nno\n\nno yes"),
    (12, "a\x0bb\x0cc\x1cd\x85e"),
    (13, "<|endoftext|> inside <|startoftext|>text"),
    (14, "12345 67890 !!!"),
    (15, "ALİ. İ, ve ALİ."),
    (7, LONG),
]


def awkward(spark):
    """With extra columns whose names the operators use themselves, and a null identifier."""
    rows = [(i, t, "x", 1, 2, 3) for i, t in AWKWARD] + [(None, "text without an identifier", None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, hash string, size long, length long, `key` long")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def texts(path):
    t = pq.read_table(path, columns=["doc_id", "text"]).to_pylist()
    return {r["doc_id"]: r["text"] for r in t}
