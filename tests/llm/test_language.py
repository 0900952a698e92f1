import zlib

import numpy as np
import pyarrow as pa

from palimpsest.llm import language, language_query


def test_fold(spark):
    df = spark.range(200).selectExpr("id doc_id")
    got = {r.doc_id: r.h for r in df.select("doc_id", language.held_out(df["doc_id"]).alias("h")).collect()}
    assert got == {d: zlib.crc32(str(d).encode()) % 4 == 2 for d in range(200)}


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    got = language_query.op4_language_id(spark, path).toPandas()
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang").toPandas().merge(got, on="doc_id")
    assert len(docs) == len(got) == 1000 and got.score.between(0, 1).all()
    out = docs[docs.held_out]
    assert (out.lang == out.lang_pred).mean() > 0.98


def small():
    de = ["der hund und die katze sind im haus und nicht auf dem dach %d" % k for k in range(60)]
    en = ["the dog and the cat are in the house and not on the roof %d" % k for k in range(60)]
    return language.train(de + en, ["de"] * 60 + ["en"] * 60)


def test_windows_cover_whole_texts_and_batches_do_not_matter():
    net = small()
    texts = ["the dog and the house " * n for n in (1, 30, 3000)] + ["und die katze im haus " * 90_000, None, "", "12 34 !?", "日本"]
    names, score = language.predict_batch(net, pa.array(texts))
    assert names == ["en", "en", "en", "de", "und", "und", "und", names[7]] and names[7] in ("de", "en")
    assert (score[4:7] == 0).all() and ((score >= 0) & (score <= 1)).all()
    for k, t in enumerate(texts):
        one, s = language.predict_batch(net, pa.array([t], pa.string()))
        assert one == [names[k]] and abs(s[0] - score[k]) < 1e-6
    data = np.frombuffer(("x" * 1000).encode(), dtype=np.uint8)
    windows, owner, letters = language.cut(data, np.array([0, 300]), np.array([300, 1000]))
    assert letters.sum() == 1000 and list(owner) == [0, 0, 1, 1, 1]


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = language.Network(["a", "b", "c"])
    windows = rng.integers(1, 255, (4, language.WINDOW + language.REACH - 1)).astype(np.uint8)
    target = np.array([0, 1, 2, 1])
    loss = lambda: -np.log(net.probabilities(windows)[np.arange(4), target]).mean()
    for p, g in zip(net.parameters(), net.gradients(windows, target), strict=True):
        k = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = p[k]
        p[k] = old + 1e-2
        up = loss()
        p[k] = old - 1e-2
        down = loss()
        p[k] = old
        assert abs((up - down) / 2e-2 - g[k]) < 0.05 * abs(g[k]) + 1e-3


def test_edges(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language.identify(df).collect() == []
    rows = [(1, "the house", None), (None, "the house", "en"), (2, None, "en"), (3, "", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' score")
    got = language.identify(df).collect()
    assert len(got) == 4 and got[0].asDict().keys() == {"doc_id", "text", "lang", "lang_pred", "score"}
