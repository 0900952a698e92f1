import pytest

from palimpsest import Repository, cli
from palimpsest.streaming.ingest import commit_batch, commit_stream


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "a.csv").write_text("id,v\n1,a\n2,b\n")
    (tmp_path / "b.csv").write_text("id,v\n1,a\n2,c\n3,d\n")
    root = f"file://{tmp_path}/repo"
    run = lambda *a: cli.main(list(a))
    assert run("init", root, "-k", "id") == 0
    assert run("commit", root, f"{tmp_path}/a.csv", "-m", "first") == 0
    assert run("commit", root, f"{tmp_path}/b.csv", "--audit") == 0
    assert run("log", root) == 0 and run("diff", root, "1", "2") == 0 and run("snapshot", root) == 0
    assert run("checkout", root, "-v", "1") == 0
    assert run("checkout", root, "-o", f"{tmp_path}/out.parquet") == 0
    assert run("checkout", root, "-o", f"{tmp_path}/out.csv", "--single") == 0
    assert spark.read.parquet(f"{tmp_path}/out.parquet").count() == 3
    assert spark.read.csv(f"{tmp_path}/out.csv", header=True).count() == 3
    said = capsys.readouterr()
    assert "first" in said.out and "1 added, 0 deleted, 1 updated" in said.out
    assert run("checkout", root, "-v", "9") == 1 and run("commit", root, "data.xyz") == 1 and run("init", root, "-k", "id") == 1
    assert "error" in capsys.readouterr().err
    with pytest.raises(SystemExit):
        run("init", root)


def test_stream(spark, tmp_path):
    repo = Repository.init(spark, f"file://{tmp_path}/repo", "id")
    inbox = f"{tmp_path}/in"
    for n, rows in enumerate(([(1, "a"), (2, "b")], [(2, "c"), (3, "d"), (3, "e")])):
        spark.createDataFrame(rows, "id long, v string").coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema("id long, v string").parquet(inbox)
        commit_stream(repo, stream, f"{tmp_path}/check").awaitTermination()
        assert repo.head == n + 1
    assert [tuple(r) for r in repo.checkout().collect()] == [(1, "a"), (2, "c"), (3, "e")]
    # A second stream with its own checkpoint counts its own batches; so does a caller of commit_batch.
    spark.createDataFrame([(7, "x")], "id long, v string").write.parquet(f"{tmp_path}/more")
    commit_stream(repo, spark.readStream.schema("id long, v string").parquet(f"{tmp_path}/more"), f"{tmp_path}/check2").awaitTermination()
    assert repo.head == 3 and [r.id for r in repo.checkout().collect()] == [1, 2, 3, 7]
    repo.commit(repo.checkout(), "batch 0")
    row = spark.createDataFrame([(9, "z")], "id long, v string")
    assert commit_batch(repo, row, 0) == 5 and commit_batch(repo, row, 0) is None and commit_batch(repo, row, 1, stream="b") == 6 and commit_batch(repo, row, 0, stream="b") is None


def test_batch_that_loses_a_race_is_merged_into_the_winner(spark, tmp_path, monkeypatch):
    t = "id long, v string"
    repo = Repository.init(spark, f"file://{tmp_path}/repo", "id")
    repo.commit(spark.createDataFrame([(1, "a")], t))
    other, publish, once = Repository.open(spark, repo.store.root), repo.store.publish, [1]

    def late(*a):
        if once:
            once.pop()
            commit_batch(other, spark.createDataFrame([(2, "b")], t), 0, stream="first")
        publish(*a)

    monkeypatch.setattr(repo.store, "publish", late)
    assert commit_batch(repo, spark.createDataFrame([(3, "c")], t), 0, stream="second") == 3
    assert [tuple(r) for r in repo.checkout().collect()] == [(1, "a"), (2, "b"), (3, "c")]


def test_a_stream_is_needed(spark, tmp_path):
    repo = Repository.init(spark, f"file://{tmp_path}/repo", "id")
    with pytest.raises(ValueError):
        commit_stream(repo, spark.range(1), f"{tmp_path}/x")
