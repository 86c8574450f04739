"""Chat formatting: roles recovered by a hidden Markov model, then canonical turns.

Rows of a conversation are cut into blocks at lines that begin with what may be a
speaker marker ("User:", "[assistant]", "### Human:", "Q:"). Such a line may be
text as well - a key of a configuration, a quoted question - so a cut is only a
candidate: the states of the model are a turn by each role and the continuation
of each role's turn, and a block that is found to be a continuation stays in the
turn before it, marker and all. A block shows a marker (the row's role or the one
in its line: a role, another name, or none), how it begins (a row, a plain marker,
a doubtful one) and line features: its length, its number of lines, whether it
ends in a question mark. Doubtful are lower-case names and short or common words
("a", "q", "you", "answer"), but in a row without a role that begins with one and
goes on from one role to another by them, as a transcript does. Transitions,
starts and feature distributions are counted over all blocks whose marker names a
role and isn't doubtful; a marker itself is right with probability RELIABLE.
Viterbi then gives the most likely states of the whole conversation, so a wrong,
foreign or missing marker is outvoted by what stands around it, and each turn is
rendered in its role.

A conversation is worked on in segments: rows are sorted by range, and a segment
is a run of SEGMENT blocks or a little more of one partition, cut between rows. So
no conversation is gathered whole, whatever its turn numbers: each segment is
summed up by a 6 x 6 max-plus matrix, a scan of a conversation's matrices fixes
the states at the segments' ends, and each segment is then decoded between its
ends. The result is that of one Viterbi pass.

Defined cases: rows are ordered by turn (null first), then by a hash of role and
text, then in any order, for then they are equal; a null conv_id is a
conversation; a null or empty text is an empty turn; a marker without text after
it is an empty turn; a row's own role without text before the first marker is an
empty turn if the role is known and the marker is another's; markers of one name
only, or of none, fall back on equal distributions; ties go to the role that comes
first in ROLES, and to a turn before a continuation; what isn't found to be a
marker stays in the text, of which only white space at its ends is lost; extra
columns are ignored; repeated rows are turns of their own; a very long text is one
row and its blocks one segment.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import partitions, settle, slices

ROLES = ("system", "user", "assistant")
OTHER, NONE = 3, 4
#: Names that speakers go by, and those that are doubtful even with a capital.
NAMES = {
    "system": 0, "sys": 0, "instruction": 0, "developer": 0,
    "user": 1, "human": 1, "customer": 1, "person": 1, "question": 1, "q": 1, "you": 1,
    "assistant": 2, "ai": 2, "bot": 2, "model": 2, "gpt": 2, "chatgpt": 2, "agent": 2, "answer": 2, "a": 2,
}
DOUBTFUL = frozenset(("sys", "instruction", "developer", "customer", "person", "question", "q", "you", "ai", "bot", "model", "agent", "answer", "a"))
_NAME = "|".join(sorted(NAMES, key=len, reverse=True))
MARKER = re.compile(rf"^[ \t]*(?:(?P<sign>#{{1,4}}[ \t]*|\*\*)?(?P<name>{_NAME})(?:\*\*)?[ \t]*:(?:\*\*)?|[\[<]\|?(?P<boxed>{_NAME})\|?[\]>]:?)[ \t]*", re.IGNORECASE | re.MULTILINE | re.ASCII)
RELIABLE = 0.95
#: How a block begins: as a row does, with a plain marker, with a doubtful one; and the probabilities of the last two in a new turn and in a continuation.
ROW, PLAIN, DOUBT = range(3)
IN_TURN, IN_TEXT = (0.85, 0.15), (0.03, 0.97)
#: Blocks of a segment; it ends with a row.
SEGMENT = 256
_SIZES, _LINES = 18, 4


def _candidates(role: str | None, text: str) -> list[tuple[int, int, int, int]]:
    """(begin, end, role, ROW, PLAIN or DOUBT) of each line of a row that may begin a turn."""
    out = []
    for m in MARKER.finditer(text):
        name = m["name"] or m["boxed"]
        sure = bool(m["boxed"] or m["sign"]) or name[0].isupper() and name.lower() not in DOUBTFUL
        out.append((m.start(), m.end(), NAMES[name.lower()], PLAIN if sure else DOUBT))
    # A row without a role that is a transcript: it begins with a marker, and they change from role to role.
    if role is None and len(out) > 1 and not text[: out[0][0]].strip() and all(x[2] != y[2] for x, y in zip(out, out[1:])):
        out = [(b, e, r, PLAIN) for b, e, r, _ in out]
    return out


def blocks_of(role: str | None, text: str | None) -> list[tuple[int, int, str, str]]:
    """(marker, how it begins, the marker's own text, the text after it) of each block of a row."""
    text = text or ""
    role = None if role is None or not role.strip() else role.strip().lower()
    own = NONE if role is None else NAMES.get(role, OTHER)
    found = _candidates(role, text)
    ends = [b for b, _, _, _ in found][1:] + [len(text)]
    first = found[0] if found and not text[: found[0][0]].strip() else None
    if first and first[3] == PLAIN and (own >= OTHER or own == first[2]):
        # The row begins with its marker.
        out = [(first[2], ROW, text[: first[1]], text[first[1] : ends[0]])]
        found, ends = found[1:], ends[1:]
    else:
        out = [(own, ROW, "", text[: found[0][0]] if found else text)]
    return out + [(r, kind, text[b:e], text[e:end]) for (b, e, r, kind), end in zip(found, ends)]


def features(text: str) -> tuple[int, int, int]:
    """Length, lines and question mark of a block, as small numbers."""
    bare = text.strip()
    return min(len(bare).bit_length(), _SIZES - 1), min(bare.count("\n"), _LINES - 1), int(bare.endswith("?"))


_SEEN = ("marker", "size", "lines", "ask", "kind")


def _blocks(rows: DataFrame) -> DataFrame:
    """The blocks of all rows, in order within each file: `row` and `part` tell them apart, `seg` numbers segments in order."""

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seg, size, conv = TaskContext.get().partitionId() << 32, 0, ()
        for batch in slices(batches, "text", 4 << 20):
            of, part, segs, seen, lead, out = [], [], [], [], [], []
            for i, (c, role, text) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "text")))):
                if size >= SEGMENT or c != conv:
                    seg, size, conv = seg + 1, 0, c
                for k, (marker, kind, raw, block) in enumerate(blocks_of(role, text)):
                    of.append(i), part.append(k), segs.append(seg), seen.append((marker, *features(block), kind)), lead.append(raw), out.append(block)
                    size += 1
            at = pa.array(of, pa.int64())
            cols = np.array(seen, dtype=np.int32).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("conv_id", "turn", "h", "row")), pa.array(segs, pa.int64()), pa.array(part, pa.int32()), *(pa.array(cols[:, k]) for k in range(5)), pa.array(lead, pa.string()), pa.array(out, pa.string())], ["conv_id", "turn", "h", "row", "seg", "part", *_SEEN, "lead", "text"])

    d = rows.select(rows["conv_id"].cast("long").alias("conv_id"), rows["turn"].cast("long").alias("turn"), rows["role"], rows["text"])
    d = settle(d.withColumn("h", F.xxhash64("role", "text")).withColumn("row", F.monotonically_increasing_id()), "chat-rows")
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "h", "row")]
    d = d.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    return d.mapInArrow(find, "conv_id long, turn long, h long, row long, seg long, part int, marker int, size int, lines int, ask int, kind int, lead string, text string")


_KEY = ["conv_id", "seg"]
_PLACE = ("turn", "h", "row", "part")


def _order(n: int = 6) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in (*_KEY, *_PLACE)[:n]]


def _in_order(blocks: DataFrame) -> DataFrame:
    return blocks.repartition(partitions(blocks.sparkSession), *_KEY).sortWithinPartitions(*_order())


def _groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches in order of `keys` to one batch for each key."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        begin = 0
        for i, key in enumerate(zip(*columns)):
            if key != last:
                if i > begin:
                    held.append(batch.slice(begin, i - begin))
                if held:
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, last, begin = [], key, i
        held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def train(blocks: DataFrame, smoothing: float = 0.5) -> dict:
    """Log-probabilities of starts, transitions, markers and features."""

    def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, 3), dtype=np.int64)
        for group in _groups(batches, _KEY):
            m = group.column("marker").to_numpy()
            ok = (m[:-1] < OTHER) & (m[1:] < OTHER)
            np.add.at(total, (m[:-1][ok], m[1:][ok]), 1)
        a, b = np.divmod(np.arange(9), 3)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(total.ravel())], ["a", "b", "n"])

    bare = blocks.where(f"kind <> {DOUBT}").drop("lead", "text")
    move, start = np.full((3, 3), smoothing), np.full(3, smoothing)
    for r in _in_order(bare).mapInArrow(pairs, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect():
        move[r["a"], r["b"]] += r["n"]
    place = F.struct(F.col("turn").isNotNull().alias("x"), *_PLACE, "marker")
    # Pairs across segments: a row a segment, its first and last marker.
    ends = bare.groupBy(*_KEY).agg(F.min(place)["marker"].alias("b"), F.max(place)["marker"].alias("last"))
    ends = ends.select("b", F.lag("last").over(Window.partitionBy("conv_id").orderBy("seg")).alias("a"))
    for r in ends.where(f"a < {OTHER} and b < {OTHER}").groupBy("a", "b").count().collect():
        move[r["a"], r["b"]] += r["count"]
    first = F.min(place)["marker"]
    for r in bare.groupBy("conv_id").agg(first.alias("m")).where(f"m < {OTHER}").groupBy("m").count().collect():
        start[r["m"]] += r["count"]
    shown = [np.full((3, n), smoothing) for n in (_SIZES, _LINES, 2)]
    for r in bare.where(f"marker < {OTHER} and size > 0").groupBy("marker", "size", "lines", "ask").count().collect():
        for table, k in zip(shown, (r["size"], r["lines"], r["ask"])):
            table[r["marker"], k] += r["count"]
    marks = np.full((3, 5), 1.0)
    marks[:, :3] = (1 - RELIABLE) / 2
    marks[np.arange(3), np.arange(3)] = RELIABLE
    share = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
    return {"start": share(start), "move": share(move), "shown": [np.log(marks), *map(share, shown)]}


def wide(model: dict) -> dict:
    """Starts and transitions of the six states: a turn by each role, a continuation of each role's turn. Either is as likely before a candidate."""
    start, move = np.full(6, -np.inf), np.full((6, 6), -np.inf)
    start[:3] = model["start"]
    move[:, :3] = np.tile(model["move"], (2, 1)) + np.log(0.5)
    move[np.arange(6), 3 + np.arange(6) % 3] = np.log(0.5)
    return {**model, "start": start, "move": move}


def emissions(model: dict, seen: np.ndarray) -> np.ndarray:
    """Log-probability of what each block shows (its marker, features and how it begins) in each state."""
    marks, *shown = model["shown"]
    text = np.where(seen[:, 1:2] > 0, sum(table[:, seen[:, k]].T for k, table in enumerate(shown, 1)), 0.0)  # no text, no features
    kind = seen[:, 4]
    with np.errstate(divide="ignore"):
        turn, on = np.log([1.0, *IN_TURN])[kind], np.log([0.0, *IN_TEXT])[kind]
    # Part of a turn says little of its role by its length: a continuation shows features as any block does.
    any_ = np.log(np.exp(text).mean(axis=1)) + on - np.log(3)
    return np.concatenate([text + marks[:, seen[:, 0]].T + turn[:, None], np.repeat(any_[:, None], 3, axis=1)], axis=1)


def span(model: dict, e: np.ndarray) -> np.ndarray:
    """Max-plus matrix from the role before a run of blocks to the role of its last."""
    out = model["move"] + e[0]
    for row in e[1:]:
        out = (out[:, :, None] + model["move"][None] + row).max(axis=1)
    return out


def viterbi(model: dict, e: np.ndarray, enter: int | None, leave: int | None) -> np.ndarray:
    """The best roles, after role `enter` (none: at the start) and ending in `leave` (none: any)."""
    score = (model["start"] if enter is None else model["move"][enter]) + e[0]
    back = []
    for row in e[1:]:
        every = score[:, None] + model["move"]
        back.append(every.argmax(axis=0))
        score = every.max(axis=0) + row
    at = int(score.argmax()) if leave is None else leave
    path = [at]
    for b in reversed(back):
        at = int(b[at])
        path.append(at)
    return np.array(path[::-1])


def _ends(blocks: DataFrame, model: dict) -> DataFrame:
    """conv_id, seg, enter, leave: states before and at the end of each segment (-1: none, the first)."""

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, _KEY):
            e = emissions(model, np.stack([g.column(c).to_numpy() for c in _SEEN], axis=1))
            first = model["start"] + e[0]
            matrix = span(model, e)
            if len(e) > 1:  # what the segment sums up to at the start of a conversation
                first = (first[:, None] + span(model, e[1:])).max(axis=0)
            yield pa.RecordBatch.from_arrays([g.column("conv_id").slice(0, 1), g.column("seg").slice(0, 1), pa.array([[*matrix.ravel().tolist(), *first.tolist()]], pa.list_(pa.float64()))], ["conv_id", "seg", "m"])

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, ["conv_id"]):
            m = np.array(g.column("m").to_pylist())
            score = [m[0, 36:]]
            for row in m[1:, :36]:
                score.append((score[-1][:, None] + row.reshape(6, 6)).max(axis=0))
            leave = [int(score[-1].argmax())]
            for k in range(len(m) - 1, 0, -1):
                leave.append(int((score[k - 1] + m[k, :36].reshape(6, 6)[:, leave[-1]]).argmax()))
            leave.reverse()
            yield pa.RecordBatch.from_arrays([g.column("conv_id"), g.column("seg"), pa.array([-1, *leave[:-1]], pa.int32()), pa.array(leave, pa.int32())], ["conv_id", "seg", "enter", "leave"])

    found = _in_order(blocks.drop("lead", "text")).mapInArrow(sums, "conv_id long, seg long, m array<double>")
    found = found.repartition(partitions(blocks.sparkSession), "conv_id").sortWithinPartitions(*_order(2))
    return found.mapInArrow(scan, "conv_id long, seg long, enter int, leave int")


def render(role: str, text: str) -> str:
    return f"<|{role}|>\n{text.strip()}\n<|end|>\n"


def turns(marker: list[int], kind: list[int], lead: list[str], text: list[str], states: list[int]) -> list[tuple[int, int, str]]:
    """(first block, role, text) of each turn of a run of blocks."""
    out: list[list] = []
    for i, state in enumerate(states):
        if state >= 3:  # never the first of a row
            out[-1][2] += lead[i] + text[i]
            continue
        if kind[i] != ROW and out[-1][0] == i - 1 and kind[i - 1] == ROW and not lead[i - 1] and not text[i - 1].strip() and (marker[i - 1] >= OTHER or state == out[-1][1]):
            out.pop()  # nothing stands before the row's first marker, and the row's own name says nothing else
        out.append([i, state, text[i]])
    return [tuple(x) for x in out]


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) to conv_id, turn, part, role, rendered: a canonical turn for each that is found, `part` being the place of its first block in the row."""
    blocks = settle(_blocks(rows), "chat-blocks")
    model = wide(train(blocks))
    ends = settle(_ends(blocks, model), "chat-ends").withColumnsRenamed({"conv_id": "c", "seg": "s"})

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, _KEY):
            e = emissions(model, np.stack([g.column(c).to_numpy() for c in _SEEN], axis=1))
            enter, leave = g.column("enter")[0].as_py(), g.column("leave")[0].as_py()
            states = viterbi(model, e, None if enter < 0 else enter, leave).tolist()
            found = turns(*(g.column(c).to_pylist() for c in ("marker", "kind", "lead", "text")), states)
            at = pa.array([i for i, _, _ in found], pa.int64())
            names = [ROLES[k] for _, k, _ in found]
            yield pa.RecordBatch.from_arrays([*(g.column(c).take(at) for c in ("conv_id", "turn", "part")), pa.array(names, pa.string()), pa.array([render(r, t) for r, (_, _, t) in zip(names, found)], pa.string())], ["conv_id", "turn", "part", "role", "rendered"])

    both = blocks.join(ends, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("seg") == F.col("s"))).drop("c", "s")
    return _in_order(both).mapInArrow(decode, "conv_id long, turn long, part int, role string, rendered string")


def format_transcripts(transcripts: DataFrame) -> DataFrame:
    """(conv_id, text) of whole transcripts: each is a conversation of one row without a role."""
    return format_conversations(transcripts.select("conv_id", F.lit(0).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), "text"))
