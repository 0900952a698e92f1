import itertools
import random

import numpy as np

from palimpsest.llm import chat, chat_query


def conversation(rng, conv, turns):
    role, out = "system" if rng.random() < 0.3 else "user", []
    for t in range(turns):
        long = role == "assistant"
        text = "\n".join(" ".join(["word"] * rng.randint(30, 90) if long else ["ask"] * rng.randint(3, 12)) + ("." if long else "?") for _ in range(rng.randint(1, 3)))
        out.append((conv, t, role, text))
        role = "user" if role != "user" else "assistant"
    return out


def test_path_is_the_best_of_all():
    rng = random.Random(1)
    model = chat.fit([r for c in range(30) for r in conversation(rng, c, 5)])
    lines = chat.lines_of("User: hi?\nmore\n\nan answer here.\nQ: again?")
    seen = model.scores(lines)
    best = max(
        itertools.product(range(chat.STATES), repeat=len(lines)),
        key=lambda p: model.step[chat.START, p[0]] + sum(seen[k, s] for k, s in enumerate(p)) + sum(model.step[a, b] for a, b in itertools.pairwise(p)),
    )
    last = int(model.matrix(seen)[chat.START].argmax())
    assert model.path(seen, chat.START, last) == list(best)


def test_held_out_roles(spark):
    raw = chat_query.transcripts(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")).cache()
    model = chat.fit(chat.sample(raw))
    got = chat.parse(raw, model).join(raw.filter(chat.held_out(raw["conv_id"])).select("conv_id", "turn", "role"), ["conv_id", "turn"]).collect()
    assert len(got) > 50
    assert np.mean([r.role == r.role_pred for r in got]) > 0.93


def test_fragments_equal_uncut(spark, monkeypatch):
    rng = random.Random(2)
    rows = [r for c, n in ((1, 40), (2, 7), (3, 1), (4, 23)) for r in conversation(rng, c, n)]
    rows = [(c, t, role, {"user": "User: ", "assistant": "AI: "}.get(role, "System: ") * (rng.random() < 0.6) + text) for c, t, role, text in rows]
    model = chat.fit(rows)
    marked = [(c, t, text) for c, t, _, text in rows]
    marked += [(1, 5, marked[5][2])] * 3 + [(2, 3, "a tie"), (None, 1, "Q: lone?"), (None, 1, "Q: lone?"), (4, None, "A: no turn"), (5, 0, None), (5, 1, " \n "), (6, 0, "")]
    df = spark.createDataFrame(marked, "conv_id long, turn long, text string").selectExpr("*", "1 frag", "2 role_pred")
    want = None
    for size, crowded in ((1000, 256), (4, 256), (1, 256), (64, 2), (64, 1)):
        monkeypatch.setattr(chat, "FRAGMENT", size)
        monkeypatch.setattr(chat, "CROWDED", crowded)
        got = sorted((r.conv_id or -1, r.turn if r.turn is not None else -1, r.text or "", r.copies, r.role_pred, r.rendered) for r in chat.parse(df, model).collect())
        want = want or got
        assert got == want
    assert sum(r[3] for r in want) == len(marked)
    whole = "".join(r[5] for r in want if r[0] == 1)
    assert whole.startswith("<|") and whole.endswith("\n<|end|>\n") and whole.count("<|end|>") == whole.count("<|user|>") + whole.count("<|assistant|>") + whole.count("<|system|>")
    assert [r[5] for r in want if r[:3] == (-1, 1, "Q: lone?")] == ["<|user|>\nlone?\n<|end|>\n"]
    assert [(r[4], r[5]) for r in want if r[0] in (5, 6)] == [(None, "")] * 3


def plain_rendering(model, texts):
    """The canonical form of one conversation: best path over all lines, line by line, no offsets."""
    lines = [(k, raw) for k, t in enumerate(texts) for raw in t.split("\n")]
    seen = [x for t in texts for x in chat.lines_of(t)]
    path = iter(model.path(model.scores(seen), chat.START, int(model.matrix(model.scores(seen))[chat.START].argmax())))
    turns = []
    for _, raw in lines:
        if not raw.strip():
            if turns:
                turns[-1][1].append("")
            continue
        s = next(path)
        if s % 2 == 0 or not turns:
            m = chat._MARKER.match(raw) if s % 2 == 0 else None
            rest = raw[m.end() :] if m else raw
            turns.append((s // 2, [rest] if rest.strip() else []))
        else:
            turns[-1][1].append(raw)
    out = ""
    for role, body in turns:
        while body and not body[-1].strip():
            body.pop()
        while body and not body[0].strip():
            body.pop(0)
        out += f"<|{chat.ROLES[role]}|>\n" + "\n".join(body).rstrip() + "\n<|end|>\n"
    return out


def test_rendering_is_verbatim(spark):
    rng = random.Random(5)
    said = {"user": "User: ", "assistant": "Assistant: ", "system": "System: "}
    body = lambda: "\n".join(rng.choice(["ask?", "short one.", "x = 1", "long line " * rng.randint(4, 60)]) for _ in range(rng.randint(1, 7)))
    model = chat.fit([(c, t, role, said[role] + body()) for c in range(60) for _, t, role, _ in conversation(rng, c, 6)])
    code = "def f(x):\n    if x:\n        return 1\n\n    return  2\n\tend"
    talks = {1: ["User: show me", "Assistant: " + code, "User: thanks?"], 2: ["### Human:\n" + code + "\n\n### Assistant:\n  indented answer\n\n\nmore\n"], 3: ["  \n\nUser:   spaced   words  "]}
    rows = [(c, t, text) for c, texts in talks.items() for t, text in enumerate(texts)]
    got = chat.parse(spark.createDataFrame(rows, "conv_id long, turn long, text string"), model).orderBy("conv_id", "turn").collect()
    for c, texts in talks.items():
        assert "".join(r.rendered for r in got if r.conv_id == c) == plain_rendering(model, texts)
    assert f"<|assistant|>\n{code}\n<|end|>\n" in "".join(r.rendered for r in got if r.conv_id == 1)


def test_many_rows_of_one_turn(spark):
    """Fragments hold a bounded number of rows whatever the turn numbers are."""
    rows = spark.range(5000).selectExpr("1L conv_id", "7L turn", "concat('User: question ', id, '?') text")
    got = chat.parse(rows, chat.fit([])).collect()
    assert len(got) == 5000 and sum(r.rendered.count("<|end|>") for r in got) == sum(r.rendered.count("<|user|>") + r.rendered.count("<|assistant|>") + r.rendered.count("<|system|>") for r in got)


def test_unmarked_held_out_roles(spark):
    """Accuracy for turns whose speaker marker is missing, which alone need the model."""
    raw = chat_query.transcripts(spark.read.parquet("/root/testdata/sf0.1/conversations.parquet")).cache()
    said = spark.read.parquet("/root/testdata/sf0.1/conversations.parquet").selectExpr("conv_id", "turn", "text plain")
    bare = raw.join(said, ["conv_id", "turn"]).filter("text = plain").filter(chat.held_out(raw["conv_id"])).select("conv_id", "turn", "role")
    got = chat.parse(raw, chat.fit(chat.sample(raw))).join(bare, ["conv_id", "turn"]).collect()
    right = np.mean([r.role == r.role_pred for r in got])
    print("unmarked held-out turns", len(got), right)
    assert len(got) > 100 and right > 0.9


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.parse(df, chat.fit(chat.sample(df))).collect() == []
