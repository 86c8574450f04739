import itertools

import numpy as np

from shelfwise.llm import chat


ROW, PLAIN, DOUBT = chat.ROW, chat.PLAIN, chat.DOUBT


def test_blocks():
    assert chat.blocks_of("user", "hello\nthere") == [(1, ROW, "", "hello\nthere")]
    assert chat.blocks_of(None, "User: hi\nAssistant: yes\nand more\n### Human: ok") == [(1, ROW, "User: ", "hi\n"), (2, PLAIN, "Assistant: ", "yes\nand more\n"), (1, PLAIN, "### Human: ", "ok")]
    assert chat.blocks_of("narrator", "once") == [(chat.OTHER, ROW, "", "once")] and chat.blocks_of(" ", None) == [(chat.NONE, ROW, "", "")]
    assert chat.blocks_of(None, "[system] be kind\n<|user|>: why?") == [(0, ROW, "[system] ", "be kind\n"), (1, PLAIN, "<|user|>: ", "why?")]
    assert chat.blocks_of("user", "userland: no marker\naim: none") == [(1, ROW, "", "userland: no marker\naim: none")]
    assert chat.blocks_of("user", "Assistant: hi") == [(1, ROW, "", ""), (2, PLAIN, "Assistant: ", "hi")] and chat.blocks_of("assistant", "Assistant: hi") == [(2, ROW, "Assistant: ", "hi")]
    # Doubtful names, but for a transcript in a row of no role.
    assert chat.blocks_of("user", "model: x\na: 5") == [(1, ROW, "", ""), (2, DOUBT, "model: ", "x\n"), (2, DOUBT, "a: ", "5")]
    assert chat.blocks_of(None, "Q: why?\nA: so.\nq: and?\na: no.") == [(1, ROW, "Q: ", "why?\n"), (2, PLAIN, "A: ", "so.\n"), (1, PLAIN, "q: ", "and?\n"), (2, PLAIN, "a: ", "no.")]
    assert [k for _, k, _, _ in chat.blocks_of(None, "a: 1\nmodel: 2")] == [ROW, DOUBT, DOUBT]
    for role, text in [("user", "a\nUser: b\n\nQ: c"), (None, "\n  Human: x\n"), ("bot", "model:\n  a: 1\n"), (None, "x\r\nYou: y")]:
        assert "".join(raw + block for _, _, raw, block in chat.blocks_of(role, text)) == text


def rendered(spark, rows):
    """Beside plain conversations to learn from."""
    plain = [(10_000 + c, t, "user" if t % 2 == 0 else "assistant", f"what is {t} and {c}?" if t % 2 == 0 else f"It is {t}, and so on for a while, as one says.") for c in range(30) for t in range(6)]
    out = chat.format_conversations(spark.createDataFrame(rows + plain, "conv_id long, turn long, role string, text string")).where("conv_id < 10000").collect()
    by = {}
    for r in sorted(out, key=lambda r: (r.conv_id, r.turn, r.part)):
        by.setdefault(r.conv_id, []).append((r.role, r.rendered.split("\n", 1)[1].removesuffix("\n<|end|>\n")))
    return by


YAML = "model: resnet50\na: 5\nplease fix"
CODE = "def f():\n    agent: str = 'x'\n    user: int = 3\n    return agent"
PROSE = "Here is my page.\nQ: Is it open?\nA: Yes, from nine.\nPlease make it shorter."


def test_text_that_looks_like_markers_is_kept(spark):
    got = rendered(spark, [(1, 0, "user", YAML), (1, 1, "assistant", "Done, it works."), (2, 0, "user", CODE), (2, 1, "assistant", CODE), (3, 0, "user", PROSE), (3, 1, "assistant", "Open from nine."), (4, 0, "system", "rules:\nuser: read\nsystem: write")])
    assert got[1] == [("user", YAML), ("assistant", "Done, it works.")] and got[2] == [("user", CODE), ("assistant", CODE)] and got[3][0] == ("user", PROSE)
    assert got[4] == [("system", "rules:\nuser: read\nsystem: write")]


def test_transcripts_are_cut_at_their_markers(spark):
    got = rendered(spark, [(1, 0, None, "Q: What is it?\nA: A thing, as one says.\nQ: And that?\nA: Another one, for a while."), (2, 0, None, "User: hello, what is this?\nAssistant: It is 4, and so on.\nuser: x\n### Human: and what is that?"), (3, 0, "user", "what is it?\nAssistant: It is 3, and so on for a while.")])
    assert [r for r, _ in got[1]] == ["user", "assistant"] * 2 and got[1][0] == ("user", "What is it?")
    assert [r for r, _ in got[2]] == ["user", "assistant", "user"] and got[2][1] == ("assistant", "It is 4, and so on.\nuser: x")
    assert got[3] == [("user", "what is it?"), ("assistant", "It is 3, and so on for a while.")]


def test_turns_lose_only_the_markers_that_are_found(spark):
    """Every row's text is that of its turns, but for markers that begin one and white space at turns' ends."""
    rng = np.random.default_rng(6)
    pieces = ["User: ", "assistant: ", "Q: ", "a: ", "model:", "### Human: ", "[system] ", "plain words here", "why?", "", "  indented", "Answer: 42"]
    rows = [(c, t, [None, "user", "assistant", "x"][int(rng.integers(4))], "\n".join("".join(rng.choice(pieces, 2)) for _ in range(int(rng.integers(1, 6))))) for c in range(40) for t in range(3)]
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    by = {}
    for r in sorted(out, key=lambda r: (r.conv_id, r.turn, r.part)):
        by.setdefault((r.conv_id, r.turn), []).append(r.rendered.split("\n", 1)[1].removesuffix("\n<|end|>\n"))
    for c, t, role, text in rows:
        rest, lost = text, 0
        for body in by[c, t]:
            at = rest.find(body)
            left, markers = chat.MARKER.subn("", rest[:at])
            assert at >= 0 and not left.strip(), (text, by[c, t])
            rest, lost = rest[at + len(body) :], lost + markers
        left, markers = chat.MARKER.subn("", rest)
        assert not left.strip() and lost + markers <= len(by[c, t])


def test_whole_conversations_equal_brute_force(spark):
    """Of every path of states the best one, its turns rendered by hand."""
    rng = np.random.default_rng(9)
    lines = ["User: hi there", "Assistant: yes, it is", "a: 5", "words and more words", "Human: and why?", "user: x"]
    rows = [(c, t, [None, "user", "assistant"][int(rng.integers(3))], "\n".join(rng.choice(lines, int(rng.integers(1, 3))))) for c in range(25) for t in range(int(rng.integers(1, 3)))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    model = chat.wide(chat.train(chat._blocks(df)))
    want = set()
    for c in range(25):
        blocks = [(t, k, *b) for _, t, role, text in sorted(r for r in rows if r[0] == c) for k, b in enumerate(chat.blocks_of(role, text))]
        e = chat.emissions(model, np.array([(m, *chat.features(text), kind) for _, _, m, kind, _, text in blocks]))
        score = lambda p: model["start"][p[0]] + sum(e[i][k] for i, k in enumerate(p)) + sum(model["move"][a, b] for a, b in zip(p, p[1:]))
        path = max(itertools.product(range(6), repeat=len(blocks)), key=score)
        out = []
        for i, ((t, k, _, kind, raw, text), state) in enumerate(zip(blocks, path)):
            if state >= 3:
                out[-1][3] += raw + text
            else:
                out.append([t, k, chat.ROLES[state], text, i])
        drop = {a[4] for a, b in zip(out, out[1:]) if a[0] == b[0] and a[1] == 0 and b[4] == a[4] + 1 and not blocks[a[4]][4] and not a[3].strip() and (blocks[a[4]][2] >= chat.OTHER or a[2] == b[2])}
        want |= {(c, t, k, role, f"<|{role}|>\n{text.strip()}\n<|end|>\n") for t, k, role, text, i in out if i not in drop}
    assert {tuple(r) for r in chat.format_conversations(df).collect()} == want


def test_a_conversation_of_equal_turns_is_cut(spark):
    """Segments are cut by their number of blocks, so equal or null turns don't gather a conversation."""
    rows = spark.range(3000).selectExpr("7 as conv_id", "cast(null as long) as turn", "'user' as role", "'the same text' as text")
    blocks = chat._blocks(rows)
    assert blocks.groupBy("seg").count().agg({"count": "max"}).first()[0] <= chat.SEGMENT
    assert chat.format_conversations(rows).count() == 3000


def test_pairs_across_segments_count(spark, monkeypatch):
    rows = spark.createDataFrame([(c, t, "user" if t % 2 else "assistant", f"text {t}") for c in (1, None) for t in (*range(7), 600, 601)], "conv_id long, turn long, role string, text string")
    whole = chat.train(chat._blocks(rows.where("turn < 256")))["move"]
    monkeypatch.setattr(chat, "SEGMENT", 2)
    assert np.allclose(chat.train(chat._blocks(rows.where("turn < 256")))["move"], whole)
    more = np.exp(chat.train(chat._blocks(rows), 0.0)["move"])  # 6, 600 and 601 are neighbours too
    assert abs(more[2, 1] - 8 / 10) < 1e-9 and abs(more[2, 2] - 2 / 10) < 1e-9


def brute(model, e):
    best = max(itertools.product(range(3), repeat=len(e)), key=lambda p: model["start"][p[0]] + sum(e[i][k] for i, k in enumerate(p)) + sum(model["move"][a, b] for a, b in zip(p, p[1:])))
    return list(best)


def random_model(rng):
    share = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
    return {"start": share(rng.random(3)), "move": share(rng.random((3, 3)))}


def test_viterbi_equals_all_paths_whole_and_in_segments():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 8):
        model, e = random_model(rng), np.log(rng.random((n, 3)))
        want = brute(model, e)
        assert chat.viterbi(model, e, None, None).tolist() == want
        for cut in range(1, n):
            first = chat.viterbi(model, e[:cut], None, want[cut - 1]).tolist()
            assert first + chat.viterbi(model, e[cut:], want[cut - 1], want[-1]).tolist() == want


def test_roles_come_back_without_their_markers(spark, small):
    """Accuracy on conversations whose markers are hidden, the rest being there to learn from."""
    from pyspark.sql import functions as F

    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    hidden = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4 == 2
    got = chat.format_conversations(rows.withColumn("role", F.when(~hidden, F.col("role"))))
    both = got.withColumnRenamed("role", "found").join(rows, ["conv_id", "turn"]).where(hidden).select("role", "found").collect()
    assert len(both) > 50 and np.mean([r.role == r.found for r in both]) > 0.85


def test_segments_change_nothing(spark, small, monkeypatch):
    rows = spark.read.parquet(f"{small}/conversations.parquet")
    read = lambda: sorted(map(tuple, chat.format_conversations(rows).collect()))
    whole = read()
    monkeypatch.setattr(chat, "SEGMENT", 2)
    assert read() == whole
    names = {(r.conv_id, r.turn): r.role for r in rows.collect()}
    assert np.mean([names[c, t] == role for c, t, _, role, _ in whole]) > 0.95


def test_awkward_rows(spark):
    rows = [(1, 0, None, None, 1), (1, None, "user", "", 2), (None, 3, "bot", "x?", 3), (1, 0, None, None, 1), (2, 0, None, "User: a\nAssistant: b", 4)]
    got = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int")).collect()
    assert len(got) == 6 and all(r.rendered.startswith(f"<|{r.role}|>\n") for r in got)
    assert [(r.role, r.rendered) for r in sorted((r for r in got if r.conv_id == 2), key=lambda r: r.part)] == [("user", "<|user|>\na\n<|end|>\n"), ("assistant", "<|assistant|>\nb\n<|end|>\n")]
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert {r.role for r in chat.format_transcripts(spark.createDataFrame([(1, "Human: q\nAI: a")], "conv_id long, text string")).collect()} == {"user", "assistant"}
