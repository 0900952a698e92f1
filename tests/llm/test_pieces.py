import random

import pytest
import sentencepiece

from palimpsest.llm import pieces
from palimpsest.llm.pieces_query import MODEL


@pytest.fixture(scope="module")
def own():
    return pieces.encoder(MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def texts():
    rng = random.Random(1)
    out = ["", "a", " a", "  a  b ", "\n\n", "日本語テキスト😀 x", "a" * 700, "ab" * 600 + "é ñ", "   ", "\t x", "def f(x):\n        return x", "\u0000 ​", "<s> </s> <unk> <0x41>"]
    out += ["".join(rng.choice("abcdefghij xyz,.éüß\n1") for _ in range(rng.randint(1, 200))) for _ in range(150)]
    out += ["".join(rng.choice(["the", "ing", "er", " ", "and", "tion", "un", "re", "1", "é"]) for _ in range(rng.randint(1, 90))) for _ in range(150)]
    return out


def test_ids_equal_the_library_and_decode_back(own, library):
    t = texts()
    got = own.encode(t)
    assert [x.tolist() for x in got] == library.encode(t)
    assert [own.decode(x) for x in got] == t
    assert own.decode(own.encode(["a▁b"])[0]) == "a b"


def test_stream_commits_early_and_equals_lanes(own, monkeypatch):
    rng = random.Random(2)
    for _ in range(40):
        text = pieces.MARK + "".join(rng.choice(["the", "ing", "er", "and", "tion", "re", "s", "é", "日", "\n"]) for _ in range(rng.randint(1, 200)))
        stream, early = pieces.Stream(own.v), []
        for k in range(0, len(text), 7):
            early += stream.feed(text[k : k + 7])
            assert len(stream.last) <= own.v.longest + 2 * pieces.COMMIT_EVERY and len(stream.chars) <= own.v.longest
        ids = early + list(stream.finish())
        assert own.v.lanes([text])[0].tolist() == own.v.spell(__import__("numpy").array(ids), text).tolist()
        assert len(text) < 2 * pieces.COMMIT_EVERY or early


def test_bounded_memory_changes_nothing(own, library, monkeypatch):
    monkeypatch.setattr(pieces, "MEMO", 50)
    monkeypatch.setattr(pieces, "LONG", 5)
    small, t = pieces.Encoder(own.v), texts()
    assert [x.tolist() for k in range(0, len(t), 20) for x in small.encode(t[k : k + 20])] == library.encode(t)


def test_frames(spark, library):
    rows = [(1, "a text"), (1, "a text"), (None, "x"), (2, None), (3, ""), (4, "long é " * 30000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' ids", "0 round_trip")
    out = pieces.encode(df, MODEL, check=True)
    got = {r.doc_id: r for r in out.collect()}
    assert got[2].ids is None and got[2].n_tokens is None and got[2].round_trip is None
    assert got[3].ids == [] and got[3].n_tokens == 0
    assert got[4].ids == library.encode("long é " * 30000) and all(r.round_trip for d, r in got.items() if d != 2)
    back = pieces.decode(out.select("doc_id", "ids"), MODEL).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in back) == sorted((d or -1, t or "") for d, t in rows)
    assert pieces.encode(df.limit(0), MODEL).collect() == []
