import json
import random
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from shelfwise.llm import packing, rans
from shelfwise.llm.tokens import WordCache
from tests.llm.helpers import AWKWARD, awkward, empty, texts

PATH = public_tokenizers.path("word_bpe_49k.json")


def library(items, end):
    t = Tokenizer.from_file(PATH)
    return [t.encode(x or "", add_special_tokens=False).ids + [end] for x in items]


def test_cached_words_equal_whole_texts(small):
    items = [t for _, t in AWKWARD] + list(texts(f"{small}/documents.parquet").values())
    items += ["don't 'twas l'eau 's x.,y end.' ..a ,b c.. A.B.C i'll 'Re İstanbul ΣΑΣ ﬁn é é ́x ÀB.", "tab\tnbsp end x　y", "it's.,", "a. b, c., d,. e.. .f ,g . , É. É, ñ, 5. 5, x́. ǅ, ⅷ. ", "ABC abc aBc. ABC,", "µm Å Å ª º ß."]
    cache = WordCache(PATH)
    for _ in range(2):  # with an empty cache, then with a full one
        assert [x.tolist() + [1] for x in cache.encode(pa.array(items, pa.string()))] == library(items, 1)
    assert cache.encode(pa.array([], pa.string())) == []
    assert [x.tolist() + [1] for x in cache.encode(pa.array(items, pa.string())[3:9])] == library(items[3:9], 1)


def test_cached_words_equal_whole_texts_of_any_characters():
    """Short strings of characters of every category, often next to the marks that are taken off."""
    rng, by = random.Random(5), {}
    for c in (c for c in range(0x110000) if not 0xD800 <= c < 0xE000):
        by.setdefault(unicodedata.category(chr(c)), []).append(chr(c))
    kinds = [k for k in by if k not in ("Cn", "Co")]
    near = "ABZabzİıſßςΣσΩÅªºŉǰµ\u0958\ufb2cﬁﷺ가\u1100\u1161각123 \t\n\r\x0b\x0c\xa0\u0085\u0307\u0301.,;:'!?-_"
    letter = lambda r: rng.choice(near) if r < 0.5 else rng.choice(by[rng.choice(kinds)]) if r < 0.85 else rng.choice(".,")
    items = ["".join(letter(rng.random()) for _ in range(rng.randint(1, 7))) for _ in range(100_000)]
    cache, plain = WordCache(PATH), Tokenizer.from_file(PATH)
    assert cache.by_word
    for i in range(0, len(items), 5000):
        some = items[i : i + 5000]
        assert [x.tolist() for x in cache.encode(pa.array(some))] == [e.ids for e in plain.encode_batch(some, add_special_tokens=False)]


def test_a_tokenizer_that_keeps_case_is_called_on_whole_texts():
    from shelfwise.llm import tokens

    config = json.loads(Tokenizer.from_file(PATH).to_str())
    assert tokens._space_separates(config)
    config["normalizer"]["normalizers"] = [s for s in config["normalizer"]["normalizers"] if s["type"] != "Lowercase"]
    assert not tokens._space_separates(config)


def test_a_full_cache_is_dropped():
    cache = WordCache(PATH, limit=3)
    for t in ("some words to hold here", "and other ones", "some words"):
        assert cache.encode(pa.array([t]))[0].tolist() == library([t], 0)[0][:-1]


@pytest.mark.parametrize("n", [0, 1, 5, 1024, 1025, 70_000, 140_000])
def test_rans_round_trip_and_checkpoints(n):
    ids = (np.random.default_rng(n).pareto(1, n) * 20).astype(np.int64).clip(0, 49_407)
    table = rans.Table(rans.quantise(np.bincount(ids, minlength=49_408)), rans.BITS)
    payload, marks = rans.encode(ids, table)
    assert (rans.decode(payload, marks, n, table) == ids).all()
    part = rans.LANES * rans.EVERY
    for k in range(len(marks)):
        assert (rans.decode(payload, marks, n, table, k, k + 1) == ids[k * part : (k + 1) * part]).all()
    if n > 2000:
        assert len(payload) < 2 * n
        damaged = bytearray(payload)
        damaged[len(damaged) // 2] ^= 1
        with pytest.raises(ValueError):
            rans.decode(bytes(damaged), marks, n, table)


def test_quantise_keeps_what_occurs():
    counts = np.array([0, 1, 10**9, 3, 0, 10**9])
    freqs = rans.quantise(counts, 8)
    assert freqs.sum() == 256 and ((freqs > 0) == (counts > 0)).all()
    assert rans.quantise(np.array([0, 7]), 8).tolist() == [0, 256]


def by_hand(rows, end):
    """doc_id order; rows of one identifier in any order, here they are equal."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out, start = [], 0
    for (i, _), ids in zip(rows, library([t for _, t in rows], end)):
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_give_back_every_document(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = sorted(tuple(r) for r in rans.round_trip(docs, PATH, 1).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == by_hand(texts(f"{small}/documents.parquet").items(), 1)


def test_files_of_awkward_documents(spark):
    got = rans.round_trip(awkward(spark), PATH, 1).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=key) == by_hand([*AWKWARD, (None, "text without an identifier")], 1)
    assert rans.round_trip(empty(spark), PATH, 1).count() == 0


def packed(rows, limit):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length >= 1
            at += length
        assert at <= limit
    return len(by)


def test_packing_of_documents(spark, small):
    rows = packing.pack_documents(spark.read.parquet(f"{small}/documents.parquet"), PATH).collect()
    want = []
    for i, t in texts(f"{small}/documents.parquet").items():
        ids = library([t], 0)[0]
        want += [(i, k, at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    assert packed(rows, 2048) <= 1.01 * sum(w[3] for w in want) / 2048 + 2


def test_packing_of_one_length_in_many_parts(spark, monkeypatch):
    """Pieces of one length are numbered in as many parts as their number takes."""
    monkeypatch.setattr(packing, "PART", 7)
    rows = packing.pack(spark.range(500).selectExpr("id", "cast(if(id % 5 = 0, 40, 9) as long) as length"), 64).collect()
    assert len({r.id for r in rows}) == 500 and packed(rows, 64) == 129  # two nines beside each forty, seven in each of the rest


def test_packing_of_awkward_documents(spark):
    rows = packing.pack_documents(awkward(spark), PATH, limit=64).collect()
    assert len([r for r in rows if r.doc_id in (1, 2, 3)]) == 3 and all(r.length == 1 for r in rows if r.doc_id in (1, 2, 3))
    packed(rows, 64)
    assert packing.pack_documents(empty(spark), PATH).count() == 0


@pytest.mark.parametrize("n", [1, 40, 3000, 60_000])
def test_solver_uses_each_length_as_often_as_it_occurs(n):
    from collections import Counter

    rng = np.random.default_rng(n)
    lengths = Counter(np.clip(rng.lognormal(6.3, 1, n).astype(int), 1, 2048).tolist())
    plan = packing.solve(lengths)
    used = Counter()
    for times, config in plan:
        assert sum(config) <= 2048
        for x in config:
            used[x] += times
    assert used == lengths
    bound = -(-sum(x * k for x, k in lengths.items()) // 2048)
    sequences = sum(t for t, _ in plan)
    assert sequences <= max(bound * 1.005 + 3, sum(t for t, _ in packing.best_fit(lengths, 2048)) * 1.002 + 1)


def test_the_program_packs_most_of_a_large_histogram(monkeypatch):
    from collections import Counter

    rng = np.random.default_rng(1)
    lengths = Counter(np.clip(rng.lognormal(6.3, 1, 60_000).astype(int), 1, 2047).tolist())
    left = []
    plain = packing.best_fit
    monkeypatch.setattr(packing, "best_fit", lambda need, limit, open_: left.append(sum(need.values())) or plain(need, limit, open_))
    packing.solve(lengths)
    assert left[0] < 0.5 * 60_000
