import random

import numpy as np
import pytest

from palimpsest.llm import separators
from palimpsest.llm.separators_query import END_ID, RANKS

END = 9


def brute(ids):
    out, start = [], 0
    for k, x in enumerate(ids):
        if x == END:
            out.append((len(out), start, k - start, True))
            start = k + 1
    if start < len(ids):
        out.append((len(out), start, len(ids) - start, False))
    return out


@pytest.mark.parametrize("width", [2, 4])
def test_scan_equals_brute_force(spark, tmp_path, width):
    rng = random.Random(width)
    streams = [[], [1], [END], [END] * 9, [1] * 40, [1] * 33 + [END], [END] + [2] * 50 + [END, 3]]
    streams += [[END if rng.random() < p else rng.randrange(9) for _ in range(rng.randint(1, 200))] for p in (0.02, 0.3, 0.9) for _ in range(4)]
    rows, want = [], {}
    for k, ids in enumerate(streams):
        path = tmp_path / f"{k}.tok"
        path.write_bytes(np.array(ids, dtype=separators.DTYPES[width]).tobytes())
        rows.append((f"file://{path}", len(ids) * width))
        want[rows[-1][0]] = brute(ids)
    files = spark.createDataFrame(rows, "path string, n_bytes long")
    got = {path: [] for path in want}
    for r in separators.scan(files, END, width, block_bytes=17).collect():
        got[r.path].append((r.nth, r.start, r.n_tokens, r.closed))
    assert {p: sorted(v) for p, v in got.items()} == want


def test_counts_equal_direct_encoding(spark):
    rng = random.Random(1)
    rows = [(1, "a text"), (2, None), (3, ""), (None, "no id"), (4, "<|endoftext|> is plain text"), (5, "lang é ü " * 3000), (5, "again"), (5, "again")]
    rows += [(k, " ".join(rng.choice(["The", "tion", "x1", "\n", "ß"]) for _ in range(rng.randint(1, 80)))) for k in range(10, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 path", "2 nth").repartition(3)
    files, documents = separators.write_token_files(df, RANKS, END_ID)
    got = documents.join(separators.scan(files, END_ID, block_bytes=64), ["path", "nth"])
    encode = separators._encoding(RANKS).encode_ordinary
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got.collect()) == sorted((d or -1, len(encode(t or ""))) for d, t in rows)


def test_broken_and_empty(spark, tmp_path):
    (tmp_path / "x.tok").write_bytes(b"abc")
    files = spark.createDataFrame([(f"file://{tmp_path}/x.tok", 3)], "path string, n_bytes long")
    with pytest.raises(Exception, match="no whole number"):
        separators.scan(files, END).collect()
    assert separators.scan(files.limit(0), END).collect() == []
    none = spark.createDataFrame([], "doc_id long, text string")
    files, documents = separators.write_token_files(none, RANKS, END_ID)
    assert documents.collect() == [] and separators.scan(files, END_ID).collect() == []
