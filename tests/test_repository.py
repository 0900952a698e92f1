import pytest

from palimpsest import ContentMatchIdentity, PrimaryKeyIdentity, Repository, StoreError
from palimpsest import repository
from palimpsest.plans.schema import RID
from palimpsest.sources.files import TakenError


def frames(spark):
    """Eight versions: append, delete, edit, add a column, drop one, narrow a type, delete."""
    t = "id long, vendor string, tip double, surcharge double"
    v1 = [(1, "a", 1.0, 0.1), (2, "b", 2.0, 0.2), (3, "a", 3.0, 0.3), (4, "c", 4.0, 0.4), (5, "b", 5.0, 0.5)]
    v2 = [*v1, (6, "c", 6.0, 0.6), (7, "a", 7.0, 0.7)]
    v3 = [r for r in v2 if r[0] not in (2, 4)]
    v4 = [(i, v, 9.9 if i == 1 else x, 1.0 if i == 6 else s) for i, v, x, s in v3]
    out = [spark.createDataFrame(v, t) for v in (v1, v2, v3, v4)]
    out.append(out[3].selectExpr("*", "id * 10 duration"))
    out.append(out[4].drop("vendor"))
    out.append(out[5].selectExpr("id", "tip", "surcharge", "cast(duration as int) duration"))
    out.append(out[6].filter("id <> 3"))
    return out


def same(a, b):
    assert [(f.name, f.dataType) for f in a.schema.fields] == [(f.name, f.dataType) for f in b.schema.fields]
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


@pytest.fixture(scope="module")
def chain(spark, tmp_path_factory):
    root = f"file://{tmp_path_factory.mktemp('chain')}/repo"
    repo = Repository.init(spark, root, "id", snapshot_interval=3)
    results = [repo.commit(df, f"v{k}", audit=True) for k, df in enumerate(frames(spark), 1)]
    return root, repo, results


def test_versions_stats_and_reopen(spark, chain):
    root, repo, results = chain
    keys = ("added", "deleted", "updated", "columns_added", "columns_removed", "types_changed")
    got = [tuple(r.stats[k] for k in keys) for r in results]
    assert got == [(5, 0, 0, 4, 0, 0), (2, 0, 0, 0, 0, 0), (0, 2, 0, 0, 0, 0), (0, 0, 2, 0, 0, 0), (0, 0, 0, 1, 0, 0), (0, 0, 0, 0, 1, 0), (0, 0, 0, 0, 0, 1), (0, 1, 0, 0, 0, 0)]
    again = Repository.open(spark, root)
    assert again.head == len(again) == 8 and again.keys == ["id"] and not again.keyless and again.versions == list(range(1, 9))
    for k, df in enumerate(frames(spark), 1):
        out = again.checkout(k)
        same(out, df)
        assert [r.id for r in out.collect()] == sorted(r.id for r in df.collect())
    assert [e["message"] for e in again.log()] == [f"v{k}" for k in range(1, 9)]
    assert again.log_df().count() == 8 and "head 8" in repr(again) and "2 updated" in str(results[3])
    assert again.register_views("chain")[3] == "chain_v4"
    assert spark.sql("SELECT count(*) n FROM chain_v4").first().n == 5


def test_diff_any_order(spark, chain):
    repo = chain[1]
    d = repo.diff(1, 2)
    assert (d.rows_added, d.rows_deleted, d.rows_updated) == (2, 0, 0)
    d = repo.diff(5, 4)
    assert d.columns_removed == ["duration"] and "columns removed" in str(d)
    d = repo.diff(6, 7)
    assert d.type_changes == [{"column": "duration", "old_type": "bigint", "new_type": "int"}]
    d = repo.diff(8, 1)
    assert (d.rows_added, d.rows_deleted, d.rows_updated) == (3, 2, 1)


def test_audit_and_components(chain):
    repo = chain[1]
    got = sorted((r[RID], r.column, r.old_val, r.new_val) for r in repo.audit(4).collect())
    assert got == [("1", "tip", "1.0", "9.9"), ("6", "surcharge", "0.6", "1.0")]
    assert repo.metadata(4)["components"] == {"updates": ["tip", "surcharge"], "cells": True}
    assert {r[RID] for r in repo.component(3, "deletes").collect()} == {"2", "4"}
    with pytest.raises(StoreError):
        repo.audit(2)


def test_snapshots(spark, chain, tmp_path):
    root, repo, _ = chain
    assert repo.store.files.names(f"{root}/snapshots") == ["v00003.json", "v00006.json"]
    other = Repository.init(spark, f"file://{tmp_path}/r", "id")
    for df in frames(spark)[:3]:
        other.commit(df)
    other.snapshot()
    other.store.files.remove(other.store.version_path(1, "base"))
    other.store.files.remove(other.store.version_path(2, "inserts"))
    same(other.checkout(3), frames(spark)[2])


def test_composite_key_and_separators(spark, tmp_path):
    repo = Repository.init(spark, f"file://{tmp_path}/r", ["region", "id"])
    t = "region string, id string, val long"
    repo.commit(spark.createDataFrame([("x", "1", 10), ("x", "2", 20), ("y", "1", 30), ("a\x1f1", "b", 1), ("a", "1\x1fb", 2)], t))
    r = repo.commit(spark.createDataFrame([("x", "1", 10), ("x", "2", 99), ("y", "1", 30), ("y", "2", 40), ("a\x1f1", "b", 1), ("a", "1\x1fb", 2)], t))
    assert (r.stats["updated"], r.stats["added"], r.stats["deleted"]) == (1, 1, 0)


def test_rejected(spark, tmp_path):
    t = "id long, v double"
    for rows, error in (([(1, 1.0), (1, 2.0)], ValueError), ([(1, 1.0), (None, 2.0)], ValueError)):
        repo = Repository.init(spark, f"file://{tmp_path}/r", "id", overwrite=True)
        with pytest.raises(error):
            repo.commit(spark.createDataFrame(rows, t))
        assert repo.head == 0 and repo.store.files.names(f"{repo.store.root}/versions") == []
    with pytest.raises(KeyError):
        repo.commit(spark.createDataFrame([(1,)], "other long"))
    with pytest.raises(ValueError):
        repo.commit(spark.createDataFrame([(1, "x")], f"id long, {RID} string"))
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            PrimaryKeyIdentity(bad)
    with pytest.raises(ValueError):
        Repository.init(spark, f"file://{tmp_path}/x")
    with pytest.raises(ValueError):
        Repository.init(spark, f"file://{tmp_path}/x", "id", identity=ContentMatchIdentity())
    with pytest.raises(StoreError):
        Repository.init(spark, f"file://{tmp_path}/r", "id")
    with pytest.raises(StoreError):
        repo.checkout()
    with pytest.raises(StoreError):
        Repository.open(spark, f"file://{tmp_path}/none")
    (tmp_path / "mine").mkdir()
    (tmp_path / "mine" / "file").write_text("kept")
    with pytest.raises(StoreError):
        Repository.init(spark, f"file://{tmp_path}/mine", "id", overwrite=True)
    assert (tmp_path / "mine" / "file").read_text() == "kept"


def history(spark, tmp_path, key, *versions):
    repo = Repository.init(spark, f"file://{tmp_path}/r", key, overwrite=True)
    stats = [repo.commit(v).stats for v in versions]
    for k, v in enumerate(versions, 1):
        same(repo.checkout(k), v)
    return repo, stats


def test_null_nan_and_types(spark, tmp_path):
    make = spark.createDataFrame
    nan = float("nan")
    _, stats = history(
        spark, tmp_path, "id",
        make([(1, 1.5, "7", None), (2, None, "x", 2.0), (3, nan, None, nan), (4, 3.0, "4", 0.0)], "id long, a double, b string, c double"),
        make([(1, None, "7", None), (2, 2.0, "x", None), (3, nan, None, nan), (4, 3.0, "4", nan)], "id long, a double, b string, c double"),
        make([(1, None, 7, None), (2, 2, None, None), (3, 0, None, nan), (4, 3, 4, nan)], "id long, a int, b int, c double"),
        make([(1, "p", 7), (2, None, None), (4, "q", 300), (5, "r", 1)], "id long, c string, b int"),
        make([(1, "p", 7), (2, None, None), (3, "back", 1), (4, "q", 44), (5, "r", 1)], "id long, c string, b byte"),
        make([], "id long, c string, b byte"),
        make([(3, "again", 5)], "id long, c string, b byte"),
    )
    assert stats[1]["updated"] == 3
    assert stats[4]["added"] == 1 and stats[4]["types_changed"] == 1
    assert stats[5]["deleted"] == 5 and stats[6]["added"] == 1


def test_dropped_and_added_again_with_nulls(spark, tmp_path):
    make = spark.createDataFrame
    repo, _ = history(
        spark, tmp_path, "id",
        make([(1, "a"), (2, "b"), (3, "c")], "id long, x string"),
        make([(1,), (2,), (3,)], "id long"),
        make([(1, None), (2, 5), (4, None)], "id long, x long"),
        make([(1, 3), (2, None), (4, None)], "id long, x long"),
    )
    assert repo.component(3, "columns").count() == 2


def test_nested_temporal_and_decimal(spark, tmp_path):
    v1 = spark.sql("SELECT id, array(id, 2) a, struct(id x, 'q' y) s, map('k', id, 'j', 1L) m, date'2020-01-01' d, timestamp_ntz'2020-01-01 00:00:00' t, true f, cast(id as decimal(10,2)) n, X'00ff' b, interval '1' day iv FROM range(5)")
    v2 = spark.sql("SELECT id, array(id, if(id = 1, 3, 2)) a, struct(id x, if(id = 2, 'z', 'q') y) s, map('j', 1L, 'k', if(id = 3, 9, id)) m, date'2020-01-01' d, timestamp_ntz'2020-01-01 00:00:00' t, id <> 4 f, cast(id as decimal(10,2)) n, X'00ff' b, interval '1' day iv FROM range(5)")
    repo = Repository.init(spark, f"file://{tmp_path}/r", "id")
    repo.commit(v1)
    assert repo.commit(v2, audit=True).stats["updated"] == 4
    assert {(r[RID], r.column) for r in repo.audit(2).collect()} == {("1", "a"), ("2", "s"), ("3", "m"), ("4", "f")}
    assert repo.checkout(2).drop("m").exceptAll(v2.drop("m")).isEmpty()


def test_interrupted_commit_leaves_no_trace(spark, tmp_path, monkeypatch):
    f = frames(spark)
    repo = Repository.init(spark, f"file://{tmp_path}/r", "id")
    repo.commit(f[0])

    def broken(*a):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(repo.store, "publish", broken)
        with pytest.raises(RuntimeError):
            repo.commit(f[2])
    stray = repo.store.draft(2)
    f[2].write.parquet(f"{stray}/deletes")
    assert repo.head == 1
    assert repo.commit(f[1]).version == 2
    same(repo.checkout(2), f[1])


@pytest.mark.parametrize("step", ["_put", "read_text"])
def test_crash_while_the_manifest_is_made(spark, tmp_path, monkeypatch, step):
    """Whatever breaks before the manifest has its name leaves the head where it was."""
    f = frames(spark)
    repo = Repository.init(spark, f"file://{tmp_path}/r", "id")
    repo.commit(f[0])
    real = getattr(type(repo.store.files), step)

    def broken(self, path, *more):
        if "v00002" in path:
            raise OSError("lost")
        return real(self, path, *more)

    with monkeypatch.context() as m:
        m.setattr(type(repo.store.files), step, broken)
        with pytest.raises(OSError):
            repo.commit(f[1])
    again = Repository.open(spark, f"file://{tmp_path}/r")
    assert again.head == (1 if step == "_put" else 2)
    if step == "_put":
        assert again.commit(f[1]).version == 2
    same(again.checkout(2), f[1])


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    f = frames(spark)
    one = Repository.init(spark, f"file://{tmp_path}/r", "id")
    one.commit(f[0])
    other = Repository.open(spark, f"file://{tmp_path}/r")
    publish = one.store.publish

    def late(*a):
        other.commit(f[1])
        publish(*a)

    with monkeypatch.context() as m:
        m.setattr(one.store, "publish", late)
        with pytest.raises(TakenError):
            one.commit(f[2])
    assert one.head == 2 and len(one.store.files.names(one.store.files.at("data"))) == 2
    same(one.checkout(), f[1])


def test_depth_is_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(repository, "MAX_DEPTH", 2)
    repo = Repository.init(spark, f"file://{tmp_path}/r", "id")
    for df in frames(spark)[:6]:
        repo.commit(df)
    assert repo.store.snapshots() == [3, 5]
    same(repo.checkout(6), frames(spark)[5])


def test_repeated_key_in_a_later_version(spark, tmp_path):
    repo = Repository.init(spark, f"file://{tmp_path}/r", "id")
    t = "id long, v double"
    repo.commit(spark.createDataFrame([(1, 1.0), (2, 2.0)], t))
    for rows in ([(1, 1.0), (1, 1.0)], [(1, 1.0), (3, 2.0), (3, 2.0)], [(1, 1.0), (None, 2.0)], [(None, 1.0), (None, 1.0)]):
        with pytest.raises(ValueError):
            repo.commit(spark.createDataFrame(rows, t))
    assert repo.head == 1
