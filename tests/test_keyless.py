import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from palimpsest import ContentMatchIdentity, Repository
from palimpsest.evaluation import KEY, ChainConfig, equal_multisets, make_chain, rows_by_id, run_systems
from palimpsest.functions.similarity import lcs_length, numeric_ratio, numeric_similarity, string_ratio, string_similarity
from palimpsest.functions import similarity
from palimpsest.operators import matching
from palimpsest.plans.schema import RID


@pytest.fixture
def few_tasks(spark):
    """Two tasks a shuffle, for tables of a few rows."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, "2")
    yield
    spark.conf.set(key, before)


def people(seed=0, versions=6):
    rng = random.Random(seed)
    rows = [(f"name{k}", rng.choice(["Rome", "Oslo"]), rng.randrange(20, 90)) for k in range(8)]
    out = [list(rows)]
    for v in range(1, versions):
        for k in rng.sample(range(len(rows)), 2):
            rows[k] = (rows[k][0], rows[k][1], rows[k][2] + rng.randint(1, 9))
        rows.pop(rng.randrange(len(rows)))
        rows.append((f"new{v}", "Oslo", rng.randrange(20, 90)))
        out.append(list(rows))
    return out


@pytest.mark.parametrize("threshold", [0.0, 0.05, 0.5, 0.9, 1.0])
def test_wrong_guesses_never_change_content(spark, few_tasks, tmp_path, threshold):
    repo = Repository.init(spark, f"file://{tmp_path}/r", identity=ContentMatchIdentity(block_on=["city"], row_threshold=threshold))
    versions = people()
    frames = [spark.createDataFrame(v, "name string, city string, salary long").coalesce(1) for v in versions]
    for f in frames:
        repo.commit(f)
    again = Repository.open(spark, f"file://{tmp_path}/r")
    assert again.keyless and again.identity.to_config() == repo.identity.to_config()
    for k, rows in enumerate(versions, 1):
        assert sorted(map(tuple, again.checkout(k).collect())) == sorted(rows)


def test_one_edit(spark, tmp_path):
    t = "name string, city string, salary long"
    old, new = [("Ann", "Rome", 10), ("Bob", "Oslo", 20), ("Cid", "Rome", 30)], [("Ann", "Rome", 10), ("Bob", "Oslo", 25), ("Cid", "Rome", 30)]
    for exact_only, want in ((False, (1, 0, 0)), (True, (0, 1, 1))):
        repo = Repository.init(spark, f"file://{tmp_path}/{exact_only}", identity=ContentMatchIdentity(exact_only=exact_only))
        repo.commit(spark.createDataFrame(old, t))
        assert {r.method for r in repo.explain_last().collect()} == {"insert"}
        s = repo.commit(spark.createDataFrame(new, t)).stats
        assert (s["updated"], s["added"], s["deleted"]) == want
        methods = sorted(r.method for r in repo.explain_last().collect())
        assert methods == (["exact", "exact", "insert"] if exact_only else ["exact", "exact", "fuzzy"])


def test_duplicates_whitespace_and_small_differences(spark, few_tasks, tmp_path):
    repo = Repository.init(spark, f"file://{tmp_path}/r", identity=ContentMatchIdentity())
    t = "a double, b string"
    versions = [
        [(1.0, "x")] * 3 + [(2.0, "y")],
        [(1.0, "x")] * 2 + [(2.0, "y")] * 2,
        [(1.00000001, "x"), (1.0, "x "), (2.0, "y"), (None, None), (float("nan"), None)],
        [(None, None)] * 3,
        [],
        [(5.0, "z")],
    ]
    stats = []
    for v in versions:
        stats.append(repo.commit(spark.createDataFrame(v, t)).stats)
    for k, v in enumerate(versions, 1):
        got = sorted(map(repr, map(tuple, repo.checkout(k).collect())))
        assert got == sorted(map(repr, v))
    assert stats[1]["added"] + stats[1]["updated"] == 1
    assert stats[2]["updated"] >= 2  # equal under the canonical form, yet stored


def test_numbering_is_a_numbering_in_hot_groups(spark):
    df = spark.range(500).selectExpr("id", "if(id < 400, 0, id) k")
    got = matching.numbered(df, "k", df["id"]).collect()
    assert sorted(r.nth for r in got if r.k == 0) == list(range(1, 401))
    assert all(r.nth == 1 for r in got if r.k)


def test_hot_contents_are_paired_like_others(spark, monkeypatch):
    """With every frequent content called hot, and with none: as many pairs of each content, no row twice."""
    new = spark.range(900).selectExpr(f"id {matching.ORD}", "if(id < 500, 'hot', concat('c', id % 150)) c")
    old = spark.range(700).selectExpr(f"concat('r', id) {RID}", "if(id < 450, 'hot', concat('c', id % 200)) c")
    for least in (1, 100, 10_000):
        monkeypatch.setattr(matching, "HOT_ROWS", least)
        got = [tuple(r) for r in matching.exact_join(new, old, ["c"], matching.CanonConfig()).collect()]
        mine, theirs = {r[matching.ORD]: r.c for r in new.collect()}, {r[RID]: r.c for r in old.collect()}
        both = [(o, r) for o, r in got if o is not None and r is not None]
        assert sorted(o for o, _ in got if o is not None) == sorted(mine) and sorted(r for _, r in got if r is not None) == sorted(theirs)
        assert all(mine[o] == theirs[r] for o, r in both)
        n, m = Counter(mine.values()), Counter(theirs.values())
        assert Counter(mine[o] for o, _ in both) == n & m
        assert sorted(matching.exact_pairs(new, old, ["c"], matching.CanonConfig()).collect()) == sorted(both)


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_string_ratio(spark):
    rng = random.Random(1)
    pairs = [("".join(rng.choices("abcé", k=rng.randint(0, 90))), "".join(rng.choices("abcé", k=rng.randint(0, 90)))) for _ in range(300)]
    for a, b in pairs:
        assert lcs_length(a, b) == slow_lcs(a, b)
    assert string_ratio("", "") == 1.0 and string_ratio("ab", "") == 0.0
    df = spark.createDataFrame([*pairs[:20], (None, None), ("a", None)], "a string, b string")
    got = [r.s for r in df.select(string_similarity("a", "b").alias("s")).collect()]
    assert got == [string_ratio(a, b) for a, b in pairs[:20]] + [1.0, 0.0]


def test_numeric_similarity(spark):
    rows = [(1.0, 1.04), (1.0, 1.5), (1.0, 9.0), (None, None), (None, 1.0), (float("nan"), None)]
    got = [r.s for r in spark.createDataFrame(rows, "a double, b double").selectExpr("a", "b").select(numeric_similarity_("a", "b").alias("s")).collect()]
    assert got == [1.0, 0.5, 0.0, 1.0, 0.0, 1.0] and numeric_ratio(1.0, 1.5, 1.0, 0.05) == 0.5


def numeric_similarity_(a, b):
    from pyspark.sql import functions as F

    return numeric_similarity(F.col(a), F.col(b), 1.0, 0.05)


def test_every_row_of_a_large_block_finds_its_parent(spark, tmp_path):
    """4,000 edited rows without a block column; tiles of any size give the same links."""
    rows = spark.range(4000).selectExpr("id", "concat('name', id, '-', id * 7919 % 10007) n", "cast(id * 37 % 100000 as double) x", "cast(id % 5 as string) k")
    edited = rows.withColumn("k", rows["k"] * 0 + 9).selectExpr("id", "n", "x", "cast(k as string) k")
    repo = Repository.init(spark, f"file://{tmp_path}/r", identity=ContentMatchIdentity(compare_on=["n", "x", "k"]))
    repo.commit(rows)
    s = repo.commit(edited).stats
    assert (s["updated"], s["added"], s["deleted"]) == (4000, 0, 0)
    # The linked rows are the true ones.
    assert repo.frame(1).join(repo.frame(2).withColumnRenamed("id", "id2"), RID).filter("id <> id2").count() == 0


def plain_links(new, old, kinds, sim):
    """Best first over all pairs of one block, in plain Python."""
    scores = matching.similarity_matrix([c for c in new[1:]], [c for c in old[1:]], kinds, sim)
    rows, cols = np.divmod(np.arange(scores.size), scores.shape[1])
    order = matching.ranked(rows, cols, scores.ravel(), sim.row_threshold, new[0], old[0])
    used_r, used_c, out = set(), set(), []
    for r, c, s, _ in zip(*(x.tolist() for x in order), strict=True):
        if r not in used_r and c not in used_c:
            used_r.add(r)
            used_c.add(c)
            out.append((r, c, s))
    return out


@pytest.mark.parametrize("threshold,edits", [(0.6, 0.01), (0.3, 5.0), (0.0, 5.0)])
def test_tiles_equal_one_sorted_list(spark, few_tasks, threshold, edits):
    """Many equal scores, rows without partner, and lists that are cut and used up."""
    rng = random.Random(4)
    old = [(f"p{k}", rng.choice("abcd") * rng.randint(0, 3), float(rng.randrange(30)), rng.choice("xy")) for k in range(170)]
    new = [(k, t, x + rng.choice([0, edits]), b) for k, (_, t, x, b) in enumerate(rng.sample(old, 120))] + [(200 + k, None, None, "x") for k in range(20)]
    keep = lambda df: spark.createDataFrame(df.collect(), df.schema)
    sim = matching.SimConfig(threshold)
    scales = {"x": 9.0}
    columns = ["t", "x"]
    left = keep(matching.cells(spark.createDataFrame(new, f"{matching.ORD} long, t string, x double, b string"), matching.ORD, columns, ["b"], scales, matching.CanonConfig()))
    right = keep(matching.cells(spark.createDataFrame(old, f"{RID} string, t string, x double, b string"), RID, columns, ["b"], scales, matching.CanonConfig()))
    want = set()
    a, b = left.toPandas(), right.toPandas()
    for block in set(a.ba):
        x, y = a[a.ba == block].reset_index(drop=True), b[b.ba == block].reset_index(drop=True)
        for r, c, s in plain_links([x.h.to_numpy(), *matching.cell_arrays(x, [None, 9.0])], [y.h.to_numpy(), *matching.cell_arrays(y, [None, 9.0])], [None, 9.0], sim):
            want.add((int(x[matching.ORD][r]), y[RID][c], s))
    for size in (50, 700, 2_000_000):
        got = {tuple(r) for r in matching.fuzzy_pairs(left, right, [None, 9.0], sim, size, keep).collect()}
        assert got == want, size


def test_edited_numbers_of_a_large_block_cost_no_square(spark, few_tasks, monkeypatch):
    """Rows that keep their texts are not compared with all others; rows that do not still find their parents."""
    compared, plain = [], matching.score_tiles
    monkeypatch.setattr(matching, "score_tiles", lambda left, right, plan, *a: compared.append(plan.selectExpr("sum(n * m)").first()[0]) or plain(left, right, plan, *a))
    keep = lambda df: spark.createDataFrame(df.collect(), df.schema)
    old = spark.range(3000).selectExpr(f"concat('p', id) {RID}", "concat('order ', id * 7919 % 10007) n", "substr('abc', 1 + id % 3, 1) s", "cast(id * 37 % 1000 as double) x")
    new = spark.range(2990).selectExpr(f"id {matching.ORD}", "concat('order ', id * 7919 % 10007, if(id % 100 = 7, '!', '')) n", "substr('abc', 1 + id % 3, 1) s", "cast(id * 37 % 1000 as double) + 0.5 x")
    columns, scales = ["n", "s", "x"], {"x": 300.0}
    left, right = (keep(matching.cells(df, c, columns, [], scales, matching.CanonConfig())) for df, c in ((new, matching.ORD), (old, RID)))
    got = matching.fuzzy_pairs(left, right, [None, None, 300.0], matching.SimConfig(), 100_000, keep).collect()
    assert len(got) == 2990 and all(r[RID] == f"p{r[matching.ORD]}" for r in got)
    assert sorted(compared) == [30 * 40, 2960]


@pytest.mark.parametrize("threshold,soft", [(0.3, True), (0.6, False), (0.9, False), (0.99, True), (1.0, True)])
def test_links_of_equal_texts_come_first_as_in_one_sorted_list(spark, few_tasks, threshold, soft):
    """Repeated, missing and empty texts, texts with a NUL, numbers within and beyond the tolerance."""
    rng = random.Random(5)
    text = lambda k: rng.choice([None, "", "\x00", *[f"t{k % 7}{c}" for c in "abcdef"]])
    old = [(f"p{k}", text(k), text(k + 3), float(rng.randrange(40)), rng.choice("xy")) for k in range(150)]
    new = [(k, t, u if k % 4 else text(k), x + rng.choice([0, 0.3, 2.0]), b) for k, (_, t, u, x, b) in enumerate(rng.sample(old, 110))]
    new += [(200 + k, None, "\x00", None, "x") for k in range(10)]
    keep = lambda df: spark.createDataFrame(df.collect(), df.schema)
    sim, kinds, columns, scales = matching.SimConfig(threshold, string_soft=soft), [None, None, 9.0], ["t", "u", "x"], {"x": 9.0}
    schema = "t string, u string, x double, b string"
    left = keep(matching.cells(spark.createDataFrame(new, f"{matching.ORD} long, {schema}"), matching.ORD, columns, ["b"], scales, matching.CanonConfig()))
    right = keep(matching.cells(spark.createDataFrame(old, f"{RID} string, {schema}"), RID, columns, ["b"], scales, matching.CanonConfig()))
    want = set()
    a, b = left.toPandas(), right.toPandas()
    for block in set(a.ba):
        x, y = a[a.ba == block].reset_index(drop=True), b[b.ba == block].reset_index(drop=True)
        for r, c, s in plain_links([x.h.to_numpy(), *matching.cell_arrays(x, kinds)], [y.h.to_numpy(), *matching.cell_arrays(y, kinds)], kinds, sim):
            want.add((int(x[matching.ORD][r]), y[RID][c], s))
    assert want
    for size in (40, 1_000, 2_000_000):
        got = {tuple(r) for r in matching.fuzzy_pairs(left, right, kinds, sim, size, keep).collect()}
        assert got == want, size


@pytest.mark.parametrize("soft", [True, False])
def test_missing_empty_and_nul_texts_are_apart(soft):
    a, b = matching.cell_arrays(pd.DataFrame({"c0": ["", None, "a", "\x00"]}), [None]), matching.cell_arrays(pd.DataFrame({"c0": ["", None, "a\x00b", "\x00"]}), [None])
    got = matching.similarity_matrix(a, b, [None], matching.SimConfig(0.0, string_soft=soft))
    assert got.tolist() == [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 0.5 * soft, 0], [0, 0, 0.5 * soft, 1]]


def test_vectorised_ratios(monkeypatch):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choices("abcé ", k=rng.randint(0, n)))
    a, b = ["", "abc", *[word(n) for n in (10, 64, 65, 200) for _ in range(6)]], ["", "x", *[word(n) for n in (12, 64, 70, 300) for _ in range(6)]]
    i, j = np.divmod(np.arange(len(a) * len(b)), len(b))
    got = matching.string_ratios(a, b, i, j)
    assert all(s == string_ratio(a[x], b[y]) for s, x, y in zip(got, i, j, strict=True))
    need = got + np.where(np.arange(len(got)) % 2, 0.2, -0.1)
    some = matching.string_ratios(a, b, i, j, need)
    assert ((some == got) | ((some == 0) & (got < need))).all()
    monkeypatch.setattr(similarity, "CHUNK", 3)
    order = np.random.default_rng(1).permutation(len(got))
    assert (matching.string_ratios(a, b, i[order], j[order]) == got[order]).all()


def test_systems_on_a_synthetic_history(spark):
    table = spark.range(300).selectExpr("id", "concat('city', id % 5) city", "cast(id * 7 % 100 as double) x", "id * 13 % 1000 y")
    chain = make_chain(table, table["id"], ["x", "y"], ChainConfig(n_versions=3))
    chain = [c.drop("id").cache() for c in chain]
    assert chain[0].count() > 150 and chain[1].join(chain[0], KEY, "left_semi").count() < chain[0].count()
    got = {r["system"]: r for r in run_systems(spark, chain, ["city"])}
    assert all(r["exact"] for r in got.values())
    assert got["naive"]["vs_naive"] == 1.0 and got["naive"]["bytes"] == got["full"]["full_copies"]
    assert got["oracle"]["recall"] == 1.0 and got["full"]["recall"] > got["hash_only"]["recall"] and got["full"]["recall"] > 0.97


def test_rows_by_id(spark, tmp_path):
    repo = Repository.init(spark, f"file://{tmp_path}/r", "id")
    repo.commit(spark.range(10).selectExpr("id", "id * 2 v"))
    found, missing = rows_by_id(repo, ["7", "99", "3"])
    assert [r[RID] for r in found.collect()] == ["7", "3"] and missing == ["99"]
