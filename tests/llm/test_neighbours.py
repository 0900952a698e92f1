import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import neighbours


def cosine(a, b):
    """Exact cosine of two lists in plain Python."""
    return math.fsum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(math.fsum(x * x for x in a) * math.fsum(y * y for y in b))


def brute(rows, asked, k):
    """{query: [(vec_id, score)]} over distinct (vec_id, vector)."""
    out = {}
    vector = dict(rows)
    for q in asked:
        every = sorted((-round(cosine(vector[q], v), 13), i, v) for i, v in rows if i != q)[:k]
        out[q] = [(i, cosine(vector[q], v)) for _, i, v in every]
    return out


def near(x, queries, k=5):
    """{query: set of rows within the k-th best cosine}, by one product of all unit vectors."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in queries:
        s = unit @ unit[q]
        s[q] = -2
        out[q] = set(np.flatnonzero(s >= np.partition(s, -k)[-k] - 1e-12).tolist())
    return out


def run(spark, rows, every, k=5, exact=False):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 score", "2 h1")
    got = {}
    for r in neighbours.search(df, F.col("vec_id") % every == 0, k, exact=exact).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: [(i, s) for _, i, s in sorted(v)] for q, v in got.items()}


def test_odd_vectors_and_ties_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(60)]
    rows += [(i, rows[7][1]) for i in range(60, 90)] + [rows[7]] * 3
    bad = [(200, None), (210, []), (220, [0.0] * 6), (230, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (240, [float("nan")] * 6), (250, [float("inf")] + [1.0] * 5), (260, [1.0, 2.0]), (None, [1.0] * 6)]
    good = list(dict((i, v) for i, v in rows).items())
    got, want = run(spark, rows + bad, 10, exact=True), brute(good, range(0, 90, 10), 5)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=0, atol=1e-14)


def test_few_and_none(spark):
    assert run(spark, [(0, [1.0, 0.0]), (1, [1.0, 1.0])], 1, 5) == {0: [(1, pytest.approx(2**-0.5))], 1: [(0, pytest.approx(2**-0.5))]}
    assert run(spark, [(0, [1.0, 0.0])], 1) == {} and run(spark, [(0, None)], 1) == {}


def test_recall_with_small_shards_and_a_hot_cell(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD_LOW", 64)
    monkeypatch.setattr(neighbours, "SHARD_HIGH", 64)
    monkeypatch.setattr(neighbours, "RERANK", 24)
    monkeypatch.setattr(neighbours, "SAMPLE_BYTES", 16 * 8 * 600)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    hot = centres[0] + rng.normal(size=(700, 16)) * 0.05
    rest = centres[rng.integers(0, 12, 1300)] + rng.normal(size=(1300, 16)) * 0.6
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([hot, rest]))]
    got, want = run(spark, rows, 20), brute(rows, range(0, 2000, 20), 5)
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 5 for q in want])
    assert recall >= 0.9
    exact = {(q, i): s for q in want for i, s in want[q]}
    assert all(abs(exact.get((q, i), s) - s) < 1e-12 for q in got for i, s in got[q])


def test_recall_on_the_test_table(spark):
    from palimpsest.llm.neighbours_query import op3_nearest_neighbours

    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    want = brute(rows, range(0, 500, 50), 5)
    got = op3_nearest_neighbours(spark, "/root/testdata/sf0.01").collect()
    assert np.mean([r.vec_id in {i for i, _ in want[r.query_id]} for r in got]) >= 0.9


def shapes():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 32))
    yield "uniform", rng.normal(size=(21000, 32)), 0
    yield "near copies", np.concatenate([centres[0] + rng.normal(size=(7000, 32)) * 1e-3, centres[rng.integers(0, 40, 14000)] + rng.normal(size=(14000, 32)) * 0.4]), 7000
    flat = rng.normal(size=(24000, 16))
    flat[:12000] = rng.normal(size=16) + flat[:12000] * 0.01
    yield "half in one cluster", flat, 12000
    yield "many copies", np.concatenate([np.repeat(rng.normal(size=(30, 32)), 300, axis=0), centres[rng.integers(0, 40, 12000)] + rng.normal(size=(12000, 32)) * 0.5]), 9000


@pytest.mark.parametrize("name,x,dense", list(shapes()), ids=[s[0].replace(" ", "-") for s in shapes()])
def test_recall_with_pruned_cells(spark, name, x, dense):
    """More rows than the sample holds, fewer cells visited than there are; recall over all queries and inside the dense part."""
    got = run(spark, list(enumerate(x.tolist())), 100)
    codec = neighbours.fit(np.unique(x, axis=0)[:15000], len(np.unique(x, axis=0)), 5)
    assert codec.probes < codec.cells
    want = near(x, range(0, len(x), 100))
    hits = [len({i for i, _ in got[q]} & want[q]) / 5 for q in sorted(want)]
    assert np.mean(hits) >= 0.9 and (not dense or np.mean(hits[: dense // 100]) >= 0.9), (np.mean(hits), np.mean(hits[: dense // 100]))


def test_exact_mode_misses_nothing(spark):
    x = np.random.default_rng(8).normal(size=(3000, 24))
    got, want = run(spark, list(enumerate(x.tolist())), 50, exact=True), near(x, range(0, 3000, 50))
    assert all({i for i, _ in got[q]} == want[q] for q in want)


def test_divided_cells(spark, monkeypatch):
    """Cells beyond the coarse centroids: still every row in one cell, and recall holds."""
    monkeypatch.setattr(neighbours, "MAX_COARSE", 20)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(30, 16))[rng.integers(0, 30, 6000)] + rng.normal(size=(6000, 16)) * 0.3
    codec = neighbours.fit(x, len(x), 5)
    assert len(codec.fine) == 4 and codec.cells == 80 and codec.probes < 80
    got, want = run(spark, list(enumerate(x.tolist())), 50), near(x, range(0, 6000, 50))
    assert np.mean([len({i for i, _ in got[q]} & want[q]) / 5 for q in want]) >= 0.9
