"""Secret scans: fixed patterns, and probabilistic automata inferred from what they find.

Base spans come from three fixed patterns. Their values, labelled by kind, are
the positive examples of a grammar inference: the examples of a kind form a
prefix tree over character classes, and states of it whose outgoing
distributions are statistically compatible (Hoeffding bound, recursively) are
merged into a deterministic probabilistic automaton. Every candidate - each run
of MIN_RUN credential characters or more, and what base spans leave of one - is
scored with each automaton against a background of the corpus's own runs, a
character bigram model (of plain numbers at least even digits). A candidate whose log-likelihood ratio is `threshold`
nats or more becomes a span of kind ``model``: an ordinary run is taken for a
secret with a probability of exp(-threshold) at most, as far as the background
describes it, and short or word-like runs can't reach it.

The examples are a bounded sample: the `examples` distinct values of a kind that
come first by hash, over all documents. The background counts all documents.

Defined cases: null and empty texts have no spans; without examples of a kind
there is no automaton of it; full stops at a candidate's ends aren't part of it;
of a candidate that touches base spans the parts outside them are scored, each on
its own; extra columns are ignored; repeated rows each get their result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import forget, settle, slices

#: Fixed patterns. Letters of a key in either case; only ASCII counts.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "model")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
#: Matches of the last two lie in runs of so many characters; candidates may be as short as the shortest value that is learned from.
LONG_RUN, MIN_RUN = 20, 6
LONG = re.compile(r"[A-Za-z0-9]{20,}", re.ASCII)

EXAMPLES = 400
#: Nats by which a format must beat the background.
THRESHOLD = 10.0
ALPHA = 0.05
#: Digits and the signs between them; in a candidate without letters each is as likely as any other, should the corpus have few numbers.
NUMERALS = 16
#: Longer candidates are scored one by one, so that a batch takes no more steps.
STEPS = 256

#: Character classes: letters that are hex digits, other letters, digits; the rest stand for themselves.
CLASSES = {**{c: "h" for c in "abcdef"}, **{c: "l" for c in "ghijklmnopqrstuvwxyz"}, **{c: "d" for c in "0123456789"}, **{c: "A" for c in "ABCDEF"}, **{c: "G" for c in "GHIJKLMNOPQRSTUVWXYZ"}, **{c: c for c in "+/_=-."}}
SIZES = Counter(CLASSES.values())
_TO_CLASS = str.maketrans(CLASSES)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's place, end, value) of the fixed patterns, leftmost and not overlapping within a kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    # A match of the other two lies within a run of their characters that has no white space in it.
    if max(map(len, text.split()), default=0) >= LONG_RUN:
        for run in LONG.finditer(text):
            at, word = run.start(), run[0]
            out += [(at + m.start(), 1, at + m.end(), m[0]) for m in ACCESS.finditer(word) if m.end() - m.start() >= MIN_ACCESS]
            out += [(at + m.start(), 2, at + m.end(), m[0]) for m in HEX.finditer(word) if m.end() - m.start() >= MIN_HEX]
    return sorted(out)


class _State:
    __slots__ = ("arcs", "end")

    def __init__(self):
        self.end, self.arcs = 0, {}  # class -> [target, times taken]

    @property
    def n(self) -> int:
        return self.end + sum(k for _, k in self.arcs.values())


def infer(examples: list[str], alpha: float = ALPHA) -> list[dict]:
    """A deterministic probabilistic automaton from positive examples.

    States are dicts of class to (next state, log-probability), with the
    log-probability of ending under "". Red states are final; blue ones, their
    children, are merged with the first compatible red state or turn red.
    """
    tree = [_State()]
    for word in examples:
        at = tree[0]
        for c in word.translate(_TO_CLASS):
            if c not in at.arcs:
                tree.append(_State())
                at.arcs[c] = [tree[-1], 0]
            at.arcs[c][1] += 1
            at = at.arcs[c][0]
        at.end += 1
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(f1: int, n1: int, f2: int, n2: int) -> bool:
        return n1 > 0 and n2 > 0 and abs(f1 / n1 - f2 / n2) > bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(a: _State, b: _State) -> bool:
        todo, seen = [(a, b)], set()
        while todo:
            a, b = todo.pop()
            if a is b or (id(a), id(b)) in seen:
                continue
            seen.add((id(a), id(b)))
            n, m = a.n, b.n
            if differ(a.end, n, b.end, m):
                return False
            for c in a.arcs.keys() | b.arcs.keys():
                x, y = a.arcs.get(c), b.arcs.get(c)
                if differ(x[1] if x else 0, n, y[1] if y else 0, m):
                    return False
                if x and y:
                    todo.append((x[0], y[0]))
        return True

    def fold(a: _State, b: _State) -> None:
        """Add the subtree under b to a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if a is b:
                continue
            a.end += b.end
            for c, (y, k) in b.arcs.items():
                if c in a.arcs:
                    a.arcs[c][1] += k
                    todo.append((a.arcs[c][0], y))
                else:
                    a.arcs[c] = [y, k]

    red = [tree[0]]
    while True:
        # A merge moves arcs, so the children of red states are found anew, the most frequent first.
        inside = {id(r) for r in red}
        blue = min(((-y.n, i, c) for i, r in enumerate(red) for c, (y, _) in r.arcs.items() if id(y) not in inside), default=None)
        if blue is None:
            break
        parent, c = red[blue[1]], blue[2]
        y = parent.arcs[c][0]
        for r in red:
            if compatible(r, y):
                parent.arcs[c][0] = r
                fold(r, y)
                break
        else:
            red.append(y)
    place = {id(r): i for i, r in enumerate(red)}
    return [{"": math.log((r.end + 0.5) / (r.n + 1)), **{c: (place[id(y)], math.log(k / (r.n + 1))) for c, (y, k) in r.arcs.items()}} for r in red]


#: Log-probability of a class that a state has never seen; the automaton then starts anew.
UNSEEN = math.log(1e-3)


def likelihood(automaton: list[dict], word: str) -> float:
    """Log-probability of a string: its classes by the automaton, each character evenly within its class."""
    at, total = 0, 0.0
    for c in word.translate(_TO_CLASS):
        at, p = automaton[at].get(c, (0, UNSEEN))
        total += p - math.log(SIZES[c])
    return total + automaton[at][""]


#: Characters of candidates by number from 1, and 0 for where a run begins or ends; their classes by number.
_CHARS = {c: i for i, c in enumerate(CLASSES, 1)}
_KINDS = {k: i for i, k in enumerate(SIZES)}
_CHAR, _CLASS = np.zeros(129, dtype=np.uint8), np.zeros(129, dtype=np.uint8)
for _c, _i in _CHARS.items():
    _CHAR[ord(_c)], _CLASS[ord(_c)] = _i, _KINDS[CLASSES[_c]]
_N = len(_CHARS) + 1


class Runs:
    """The candidates of a batch of texts: all characters as numbers, and where each candidate begins and ends in them."""

    def __init__(self, texts: list[str | None], least: int = MIN_RUN):
        sizes = np.fromiter((len(t or "") + 1 for t in texts), dtype=np.int64, count=len(texts))
        points = np.frombuffer("\n".join([*((t or "") for t in texts), ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        self.first = np.cumsum(sizes) - sizes  # of each text
        self.points = np.minimum(points, 128).astype(np.uint8)
        self.chars = _CHAR[self.points]
        inside = np.concatenate([[False], self.chars > 0, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        begin, end = edges[0::2].copy(), edges[1::2].copy()
        stop = self.points == ord(".")
        while (cut := (begin < end) & stop[np.minimum(begin, len(stop) - 1)]).any() if len(begin) else False:
            begin[cut] += 1
        while (cut := (begin < end) & stop[end - 1]).any() if len(begin) else False:
            end[cut] -= 1
        keep = end - begin >= least
        self.begin, self.end = begin[keep], end[keep]

    def without(self, spans: list[tuple[int, int]], least: int = MIN_RUN) -> None:
        """Leave out what the spans (begin, end) cover, cutting candidates where they do."""
        if not spans:
            return
        begin, end = (np.array(x, dtype=np.int64) for x in zip(*sorted(spans)))
        reach = np.maximum.accumulate(end)
        # The last span that begins before a candidate's end reaches beyond its begin.
        k = np.searchsorted(begin, self.end) - 1
        hit = (k >= 0) & (reach[np.maximum(k, 0)] > self.begin)
        parts = []
        for b, e in zip(self.begin[hit].tolist(), self.end[hit].tolist()):
            at = b
            for x, y in ((x, y) for x, y in zip(begin[begin < e].tolist(), end[begin < e].tolist()) if y > b):
                parts.append((at, x))
                at = max(at, y)
            parts.append((at, e))
        more = np.array([p for p in parts if p[1] - p[0] >= least], dtype=np.int64).reshape(-1, 2)
        self.begin, self.end = np.concatenate([self.begin[~hit], more[:, 0]]), np.concatenate([self.end[~hit], more[:, 1]])

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the character pairs of all candidates, from the mark before the first to that after the last, and where each candidate's begin."""
        n = self.end - self.begin
        first = np.cumsum(n + 1) - (n + 1)
        at = np.repeat(self.begin - first, n + 1) + np.arange(int((n + 1).sum()))
        before, after = self.chars[at - 1], self.chars[np.minimum(at, len(self.chars) - 1)]
        before[first], after[first + n] = 0, 0
        return before.astype(np.int32) * _N + after, first


def learn(docs: DataFrame, examples: int = EXAMPLES) -> dict:
    """Automata by kind, and the background's log-probability of each character after another."""

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(_N * _N, dtype=np.int64)
        for batch in slices(batches, "text", 1 << 20):
            seen = set()
            texts = batch.column("text").to_pylist()
            for text in texts:
                if text:
                    seen.update((KINDS[k], value) for _, k, _, value in base_spans(text))
            runs = Runs(texts, 1)
            if len(runs.begin):
                counts += np.bincount(runs.pairs()[0], minlength=_N * _N)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.string()), pa.array([v for _, v in seen], pa.string()), pa.array([1] * len(seen), pa.int64())], ["kind", "value", "n"])
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(["pair"] * len(at), pa.string()), pa.array(at).cast(pa.string()), pa.array(counts[at])], ["kind", "value", "n"])

    found = docs.select("text").mapInArrow(look, "kind string, value string, n long").groupBy("kind", "value").agg(F.sum("n").alias("n"))
    found = settle(found, "secret-values")
    automata = {}
    for kind in KINDS[:3]:
        rows = found.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(examples).collect()
        if rows:
            automata[kind] = infer(sorted(r["value"] for r in rows))
    counts = np.ones((_N, _N))
    for r in found.where("kind = 'pair'").collect():  # _N * _N rows at most
        counts[divmod(int(r["value"]), _N)] += r["n"]
    forget(found)
    return {"automata": automata, "pairs": np.log(counts / counts.sum(axis=1, keepdims=True))}


class Scorer:
    """A model as tables, for whole batches."""

    def __init__(self, model: dict):
        self.pairs = model["pairs"].ravel()
        self.automata = []
        for states in model["automata"].values():
            to = np.zeros((len(states), len(_KINDS)), dtype=np.int64)
            p = np.full((len(states), len(_KINDS)), UNSEEN)
            for i, state in enumerate(states):
                for c, x in state.items():
                    if c:
                        to[i, _KINDS[c]], p[i, _KINDS[c]] = x
            p -= np.log([SIZES[c] for c in _KINDS])
            self.automata.append((states, to, p, np.array([state[""] for state in states])))

    def ratios(self, runs: Runs) -> np.ndarray:
        """For each candidate the nats by which its best automaton beats the background."""
        if not self.automata or not len(runs.begin):
            return np.full(len(runs.begin), -math.inf)
        index, first = runs.pairs()
        background = np.add.reduceat(self.pairs[index], first)
        n = runs.end - runs.begin
        letters = np.concatenate([[0], np.cumsum(runs.points >= ord("A"))])  # and the underscore
        number = letters[runs.end] == letters[runs.begin]
        background[number] = np.maximum(background[number], -n[number] * math.log(NUMERALS))
        classes = _CLASS[runs.points]
        order = np.argsort(-n, kind="stable")
        order = order[np.searchsorted(-n[order], -STEPS) :]
        upto = np.searchsorted(-n[order], -np.arange(int(n[order].max(initial=0))), side="left")  # how many are longer than so many characters
        best = np.full(len(n), -math.inf)
        for states, to, p, end in self.automata:
            at, total = np.zeros(len(order), dtype=np.int64), np.zeros(len(order))
            for j, k in enumerate(upto.tolist()):
                c = classes[runs.begin[order[:k]] + j]
                total[:k] += p[at[:k], c]
                at[:k] = to[at[:k], c]
            best[order] = np.maximum(best[order], total + end[at])
            for i in np.flatnonzero(n > STEPS).tolist():
                word = "".join(map(chr, runs.points[runs.begin[i] : runs.end[i]].tolist()))
                best[i] = max(best[i], likelihood(states, word))
        return best - background

    def spans(self, texts: list[str | None], threshold: float = THRESHOLD) -> list[tuple[list, list]]:
        """Base spans and all spans of each text as (start, kind's place, end), in order."""
        base = [[(s, k, e) for s, k, e, _ in base_spans(t)] if t else [] for t in texts]
        runs = Runs(texts)
        runs.without([(int(f) + s, int(f) + e) for f, spans in zip(runs.first, base) for s, _, e in spans])
        hit = np.flatnonzero(self.ratios(runs) >= threshold)
        every = [list(x) for x in base]
        of = np.searchsorted(runs.first, runs.begin[hit], side="right") - 1
        for i, b, e in zip(of.tolist(), runs.begin[hit].tolist(), runs.end[hit].tolist()):
            every[i].append((b - int(runs.first[i]), 3, e - int(runs.first[i])))
        return [(b, sorted(x)) for b, x in zip(base, every)]


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in slices(batches, "text", 1 << 20):
            counts, shas, spans = np.zeros((batch.num_rows, 3), dtype=np.int64), [], []
            for i, (base, every) in enumerate(scorer.spans(batch.column("text").to_pylist(), threshold)):
                for _, k, _ in base:
                    counts[i, k] += 1
                shas.append(hashlib.sha256(_listed(base).encode()).hexdigest())
                spans.append(_listed(every))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(counts[:, k]) for k in range(3)), pa.array(shas, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(find, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def masked(text: str, spans: list[tuple[int, int, int]], mask: str = "[secret]") -> str:
    """A text with its spans, joined where they touch or overlap, replaced."""
    out, at = [], 0
    end = -1
    for s, _, e in spans:
        if s > end:
            out += [text[at:s], mask] if end < 0 else [text[end:s], mask]
        end = max(end, e)
    return "".join(out) + text[end:] if end >= 0 else text


def mask_documents(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """`docs`, every column, with the secrets of column text replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def replace(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in slices(batches, "text", 1 << 20):
            texts = batch.column("text").to_pylist()
            texts = [masked(t, every) if every else t for t, (_, every) in zip(texts, scorer.spans(texts, threshold))]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(i) for i, c in enumerate(names)], names)

    return docs.mapInArrow(replace, docs.schema)
