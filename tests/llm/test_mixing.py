import random

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import mixing

def levels():
    return [F.col("domain"), F.col("lang"), F.col("source")]



def test_shortage_goes_to_siblings_before_ancestors():
    tokens = {("a", "en", "s1"): 10, ("a", "en", "s2"): 1000, ("a", "de", "s1"): 1000, ("b", "en", "s1"): 1000}
    given = mixing.budgets(tokens, mixing.Target({}, share=400 / 3010, epochs=1))
    assert given == {("a", "en", "s1"): 10, ("a", "en", "s2"): 90, ("a", "de", "s1"): 100, ("b", "en", "s1"): 200}
    # a subtree that is short as a whole leaves the rest to the level above
    tokens = {("a", "en", "s1"): 10, ("a", "de", "s1"): 20, ("b", "en", "s1"): 1000}
    given = mixing.budgets(tokens, mixing.Target({}, share=200 / 1030, epochs=2))
    assert given == {("a", "en", "s1"): 20, ("a", "de", "s1"): 40, ("b", "en", "s1"): 140}
    given = mixing.budgets(tokens, mixing.Target({("b",): 0}, share=1.0, epochs=1))
    assert given == {("a", "en", "s1"): 10, ("a", "de", "s1"): 20, ("b", "en", "s1"): 0}


def plain_budgets(have, target):
    """Budgets by pouring: small drops go down the tree, at every node to the child furthest below its share that has room."""
    depth = len(next(iter(have), ()))
    paths = {p[:k] for p in have for k in range(depth + 1)}
    usable = {p: all(target.weights.get(p[:k], 1.0) > 0 for k in range(1, depth + 1)) for p in have}
    room = {q: sum(n * target.epochs for p, n in have.items() if usable[p] and p[: len(q)] == q) for q in paths}

    def pour(q, budget):
        below = sorted(c for c in paths if len(c) == len(q) + 1 and c[: len(q)] == q)
        if not below:
            return {q: budget}
        weight = {c: float(target.weights.get(c, 1.0)) if room[c] > 0 else 0.0 for c in below}
        given = {c: 0.0 for c in below}
        # The level L at which the sum of min(L * weight, room) is the budget, by bisection.
        budget = min(budget, sum(room[c] for c in below if weight[c]))
        low, high = 0.0, max((room[c] / weight[c] for c in below if weight[c]), default=0.0)
        for _ in range(200):
            level = (low + high) / 2
            if sum(min(level * weight[c], room[c]) for c in below) < budget:
                low = level
            else:
                high = level
        given = {c: min(high * weight[c], room[c]) for c in below}
        return {p: b for c in below for p, b in pour(c, given[c]).items()}

    return {p: int(b + 1e-6) for p, b in pour((), target.share * sum(have.values())).items()} if have else {}


def brute(spark, rows, target):
    """The same contract in plain Python; only the hash comes from Spark."""
    df = spark.createDataFrame(list(enumerate(rows)), "r int, x struct<doc_id:long,text:string,domain:string,lang:string,source:string>")
    df = df.select("r", "x.*").withColumn("p", F.xxhash64("doc_id", "text"))
    df = df.select("r", *[F.shiftrightunsigned(F.xxhash64(F.lit(target.seed), F.lit(e), "p"), 1).alias(f"e{e}") for e in range(target.epochs + 1)])
    place = {r["r"]: r for r in df.collect()}
    leaves = {}
    for r, x in enumerate(rows):
        leaves.setdefault(tuple(v or mixing.NONE for v in x[2:]), []).append(r)
    size = {r: len((x[1] or "").split()) for r, x in enumerate(rows)}
    have = {k: sum(size[r] for r in v) for k, v in leaves.items()}
    out = []
    given = plain_budgets(have, target)
    assert all(abs(given[p] - b) <= 1 for p, b in mixing.budgets(have, target).items())
    for leaf, budget in mixing.budgets(have, target).items():
        if not have[leaf]:
            continue
        whole = min(target.epochs, budget // have[leaf])
        out += [(r, e) for r in leaves[leaf] for e in range(whole)]
        rest = budget - whole * have[leaf] if whole < target.epochs else 0
        places = sorted({place[r][f"e{whole}"] for r in leaves[leaf]})
        for p in places if rest else []:
            if sum(size[r] for r in leaves[leaf] if place[r][f"e{whole}"] <= p) <= rest:
                out += [(r, whole) for r in leaves[leaf] if place[r][f"e{whole}"] == p]
    return sorted((rows[r][0] or -1, e, size[r]) for r, e in out)


@pytest.mark.parametrize("bucket", [3, 5000])
def test_selection_equals_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "BUCKET", bucket)
    rng = random.Random(5)
    rows = []
    for i in range(300):
        source = "hot" if rng.random() < 0.4 else rng.choice(["s1", "s2", None])
        rows.append((i, "w " * rng.choice([0, 1, 5, 50, 400]), rng.choice(["a", "b"]), rng.choice(["en", "de", None]), source))
    rows += [(7, rows[7][1], *rows[7][2:])] * 3 + [(None, "x y z", "a", "en", "s1"), (999, None, "a", "en", "s1"), (1000, "", "c", "en", "s1")]
    for share, epochs in ((0.3, 1), (0.9, 3), (5.0, 2)):
        target = mixing.Target({("a",): 3.0, ("a", "de"): 0.5}, share=share, epochs=epochs)
        df = spark.createDataFrame(rows, "doc_id long, text string, domain string, lang string, source string")
        got = sorted((r.doc_id or -1, r.epoch, r.tokens) for r in mixing.selection(df, target, levels()).collect())
        assert got == brute(spark, rows, target)


def test_mix_keeps_columns_and_rows(spark):
    rows = [(i, "a b c", "d", "en", "s", i) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, domain string, lang string, source string, epoch long")
    out = mixing.mix(df, mixing.Target({}, share=1.5, epochs=2), levels())
    assert out.columns == df.columns and out.count() == 30
    assert {(r.doc_id, r.epoch) for r in out.collect()} == {(i, i) for i in range(20)}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, domain string, lang string, source string")
    assert mixing.selection(df, mixing.Target({}), levels()).collect() == []


def test_budgets_equal_pouring():
    rng = random.Random(11)
    for _ in range(60):
        have = {(rng.choice("ab"), rng.choice("xyz"), f"s{k}"): rng.choice([0, 3, 50, 4000]) for k in range(rng.randint(1, 9))}
        weights = {p[:k]: rng.choice([0, 0.5, 1, 4]) for p in have for k in (1, 2, 3) if rng.random() < 0.5}
        target = mixing.Target(weights, share=rng.choice([0.1, 0.7, 3.0]), epochs=rng.randint(1, 3))
        want = plain_budgets(have, target)
        assert all(abs(want[p] - b) <= 1 for p, b in mixing.budgets(have, target).items())


def test_given_token_counts_decide(spark):
    rows = [(i, "text without spaces", "a", "en", "s", 10 if i else 1000) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, domain string, lang string, source string, n long")
    got = mixing.selection(df, mixing.Target({}, share=0.3, epochs=1), levels(), tokens=F.col("n")).collect()
    assert sum(r.tokens for r in got) <= 0.3 * 1490 and all(r.tokens == (10 if r.doc_id else 1000) for r in got)
