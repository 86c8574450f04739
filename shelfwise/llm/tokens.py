"""Token ids of whole texts, by the tokenizers library.

Most of the time of a plain call goes into words that were seen before. Where
the tokenizer's own configuration shows that white space only separates (it is
replaced by one space and dropped by the pre-tokenizer), texts are cut at ASCII
white space, Arrow finds the distinct pieces of a batch, and the library encodes
each piece once. A full stop or comma after letters ends a word to the tokenizer,
so pieces that differ in it are encoded once; a piece of Latin letters is one
word, so it goes straight to the library's model. Any other tokenizer, and any text in which a special token
or a separator control character occurs, goes through the library whole. Tests
hold both ways against each other.

A full stop or comma is taken off only where the letters before it still end in
a letter once they are normalised: some letters become a letter and a combining
mark, which the pre-tokenizer joins with what follows.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts with these go to the library whole: special tokens, and control characters that some take for white space.
_WHOLE = "<\\||[\x1c-\x1f]"


#: Latin letters, all of which end in a letter in composed lower case; of those up to here only the dotted capital I doesn't.
_LATIN = re.compile("[A-Za-zªµºÀ-įıĲ-ɏ]+")


def ends_in_letter(stem: str) -> bool:
    """Whether a word of letters still ends in one in composed lower case."""
    return bool(_LATIN.fullmatch(stem)) or unicodedata.category(unicodedata.normalize("NFC", unicodedata.normalize("NFC", stem).lower())[-1])[0] == "L"


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level tokenizers write for each byte: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _space_separates(config: dict) -> bool:
    """Whether letters are lower-cased and white space is collapsed by the normalizer, and dropped by the pre-tokenizer."""
    steps = (config.get("normalizer") or {}).get("normalizers", [])
    collapses = any(s.get("type") == "Replace" and s.get("pattern") == {"Regex": "\\s+"} and s.get("content") == " " for s in steps)
    known = all(s.get("type") in ("NFC", "Replace", "Lowercase") for s in steps) and any(s.get("type") == "Lowercase" for s in steps)
    cuts = (config.get("pre_tokenizer") or {}).get("pretokenizers", [])
    drops = bool(cuts) and cuts[0].get("type") == "Split" and cuts[0].get("behavior") == "Removed" and cuts[0].get("invert") is True and str(cuts[0].get("pattern")).count("\\s") == 1
    return collapses and known and drops and config["model"].get("end_of_word_suffix") == "</w>"


class WordCache:
    """Encodes texts to ids of the smallest little-endian type that holds the vocabulary."""

    def __init__(self, path: str, limit: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.by_word = _space_separates(json.loads(self.tokenizer.to_str()))
        self.limit, self.cache = limit, {}
        self.letters = _byte_letters()
        #: Ids of the marks that may follow a word; only marks of one id are taken off.
        self.marks = {m: i[0] for m in ".," if len(i := self.tokenizer.encode(m, add_special_tokens=False).ids) == 1}

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _learn(self, pieces: list[str]) -> None:
        """Encode new pieces."""
        cache, tokenize, letters, kind = self.cache, self.tokenizer.model.tokenize, self.letters, self.dtype.char
        for piece in pieces:
            if piece.isascii() and piece.isalpha():
                cache[piece] = array(kind, [t.id for t in tokenize(piece)]).tobytes()
            elif piece.isalpha() and max(piece) < "Ā":
                cache[piece] = array(kind, [t.id for t in tokenize(piece.lower().encode().decode("latin-1").translate(letters))]).tobytes()
            else:
                cache[piece] = self._ids(piece) if piece else b""

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a string array; none for a null text."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        if not self.by_word:
            return [np.frombuffer(self._ids(t), dtype=self.dtype) if t else np.zeros(0, dtype=self.dtype) for t in texts.to_pylist()]
        whole = np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, _WHOLE), False).to_numpy(zero_copy_only=False))
        apart = {int(i): np.frombuffer(self._ids(texts[int(i)].as_py()), dtype=self.dtype) for i in whole}
        plain = pc.fill_null(texts, "")
        if apart:
            mask = np.zeros(len(texts), dtype=bool)
            mask[whole] = True
            plain = pc.if_else(pa.array(mask), "", plain)
        cut = pc.ascii_split_whitespace(pc.ascii_lower(plain))
        words = cut.flatten().dictionary_encode()
        # Words without a mark after their letters, and which mark it was.
        bare = pc.utf8_rtrim(words.dictionary, characters="".join(self.marks))
        marked = pc.and_(pc.equal(pc.subtract(pc.binary_length(words.dictionary), pc.binary_length(bare)), 1), pc.utf8_is_alpha(bare))
        # Words with other than plain Latin letters are looked at one by one.
        odd = np.flatnonzero(pc.and_not(marked, pc.string_is_ascii(bare)).to_numpy(zero_copy_only=False))
        odd = odd[pc.match_substring_regex(bare.take(pa.array(odd)), "[^A-Za-zªµºÀ-įıĲ-ɏ]").to_numpy(zero_copy_only=False)]
        if len(odd):
            keep = np.ones(len(bare), dtype=bool)
            keep[[i for i, stem in zip(odd.tolist(), bare.take(pa.array(odd)).to_pylist()) if not ends_in_letter(stem)]] = False
            marked = pc.and_(marked, pa.array(keep))
        mark = np.zeros(len(bare), dtype=np.int64)
        for m, i in self.marks.items():
            mark[pc.and_(marked, pc.ends_with(words.dictionary, m)).to_numpy(zero_copy_only=False)] = i + 1
        stems = pc.if_else(marked, bare, words.dictionary).dictionary_encode()
        distinct = stems.dictionary.to_pylist()
        if len(self.cache) > self.limit:
            self.cache.clear()
        known = list(map(self.cache.get, distinct))
        new = [i for i, k in enumerate(known) if k is None]
        self._learn([distinct[i] for i in new])
        for i in new:
            known[i] = self.cache[distinct[i]]
        pool = np.frombuffer(b"".join(known), dtype=self.dtype)
        sizes = np.fromiter(map(len, known), dtype=np.int32, count=len(known)) // self.dtype.itemsize
        starts = np.cumsum(sizes, dtype=np.int32) - sizes
        stem = stems.indices.to_numpy()
        codes = words.indices.to_numpy()
        n = (sizes[stem] + (mark > 0)).astype(np.int32)[codes]
        ends = np.cumsum(n)
        at = np.repeat((starts[stem][codes] - (ends - n)).astype(np.int32), n)
        at += np.arange(len(at), dtype=np.int32)
        ids = pool[np.minimum(at, len(pool) - 1)] if len(pool) else np.zeros(len(at), dtype=self.dtype)
        last = mark[codes]
        ids[ends[last > 0] - 1] = last[last > 0] - 1
        bounds = np.concatenate([[0], ends])[cut.offsets.to_numpy() - cut.offsets[0].as_py()].tolist()
        out = [ids[x:y] for x, y in zip(bounds, bounds[1:])]
        for i, x in apart.items():
            out[i] = x
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> WordCache:
    """One per worker process, so that tasks after the first find a full cache."""
    return WordCache(path)
