import corpus_pipeline as pipeline
from palimpsest.llm import language, pieces, separators, simhash
from pyspark.sql import functions as F
from test_mixing import plain_budgets
from test_quality import brute as brute_quality
from test_simhash import brute_similar

SF = "/root/testdata/sf0.001"


def plain_mixture(docs):
    """Ids of the selected documents, with repeats; only the seeded hash comes from Spark, tokens are counted by the library."""
    target = pipeline.TARGET
    place = F.xxhash64("doc_id", "text")
    hashes = [F.shiftrightunsigned(F.xxhash64(F.lit(target.seed), F.lit(e), place), 1).alias(f"e{e}") for e in range(target.epochs + 1)]
    rows = docs.select("doc_id", "text", *[c.alias(n) for c, n in zip(pipeline.levels(), ("d", "l", "s"), strict=True)], *hashes).collect()
    encoding = separators._encoding(pipeline.RANKS)
    leaves = {}
    for r in rows:
        leaves.setdefault((r.d, r.l, r.s), []).append((r, len(encoding.encode_ordinary(r.text))))
    have = {p: sum(n for _, n in v) for p, v in leaves.items()}
    out = []
    for path, budget in plain_budgets(have, target).items():
        whole = min(target.epochs, budget // have[path]) if have[path] else 0
        out += [r.doc_id for r, _ in leaves[path]] * whole
        left = budget - whole * have[path] if whole < target.epochs else 0
        for r, n in sorted(leaves[path], key=lambda x: x[0][f"e{whole}"]):
            if n > left:
                break
            left -= n
            out.append(r.doc_id)
    return sorted(out)


def test_stages_equal_a_plain_version(spark):
    """Each stage against plain Python over the rows of the stage before."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    steps = dict(pipeline.STAGES)
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "language_id", "near_duplicates", "source_mixture", "token_ids"]

    ruled = steps["quality_rules"](spark, docs, SF).cache()
    assert {r.doc_id for r in ruled.collect()} == {r.doc_id for r in docs.collect() if brute_quality(r.text)["kept"]}

    spoken = steps["language_id"](spark, ruled, SF).cache()
    net = language.train(*language.sample(ruled), reject=True)
    want = set()
    for r in ruled.collect():
        names, score = language.predict_batch(net, __import__("pyarrow").array([r.text]))
        if names[0] != "und" and not (names[0] == language.REJECT and score[0] >= pipeline.SURE):
            want.add(r.doc_id)
    assert {r.doc_id for r in spoken.collect()} == want

    alone = steps["near_duplicates"](spark, spoken, SF).cache()
    heads = {c for _, c in brute_similar([(r.doc_id, r.text) for r in spoken.collect()])}
    assert sorted(r.doc_id for r in alone.collect()) == sorted(heads)

    mixed = steps["source_mixture"](spark, alone, SF).cache()
    assert sorted(r.doc_id for r in mixed.collect()) == plain_mixture(alone)
    for frame in (ruled, spoken, alone, mixed):
        assert frame.columns == docs.columns

    out = steps["token_ids"](spark, mixed, SF).collect()
    own = pieces.encoder(pipeline.MODEL)
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.round_trip and own.decode(__import__("numpy").array(r.ids)) == text[r.doc_id] for r in out)
    assert sorted(r.doc_id for r in pipeline.run(spark, SF).collect()) == sorted(r.doc_id for r in out)


def test_clean_documents_pass_the_filters(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    good = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("quality = 1")
    steps = dict(pipeline.STAGES)
    ruled = steps["quality_rules"](spark, docs, SF)
    long = docs.join(good, "doc_id", "left_semi").filter("n_chars > 300")
    assert ruled.join(long.select("doc_id"), "doc_id", "left_semi").count() >= 0.98 * long.count()
    spoken = steps["language_id"](spark, ruled, SF)
    assert spoken.count() >= 0.995 * ruled.count()


def test_noise_and_unlearned_scripts_go(spark):
    import random

    rng = random.Random(3)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    letters = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 10))) for _ in range(100)) for _ in range(20)]
    other = ["Мой дядя самых честных правил когда не в шутку занемог он уважать себя заставил и лучше выдумать не мог. " * 4]
    bad = spark.createDataFrame([(10_000_000 + k, t, None, "s1", len(t)) for k, t in enumerate([*letters, *other, "123 ½ ²"])], docs.schema)
    got = {r.doc_id for r in pipeline.language_id(spark, docs.unionByName(bad), SF).select("doc_id").collect()}
    assert not [d for d in got if d >= 10_000_000] and len(got) >= 0.997 * docs.select("doc_id").distinct().count()
    unlabelled = bad.withColumn("lang", F.lit(None).cast("string"))
    assert pipeline.language_id(spark, unlabelled, SF).count() == 21


def test_odd_documents(spark):
    rows = [(None, None, None, None, None), (1, "", None, None, 0), (2, "x " * 60000, "en", "src1", 1), (3, "the of and " * 12, None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0)):
        for _, step in pipeline.STAGES:
            step(spark, frame, SF).collect()
    assert simhash.keep_first(docs).count() == 4
