"""Registered queries of the versioning engine, and the SQL they are held against.

A history of eight versions of `orders` is defined by predicates on the key, so that each version is an SQL expression too.
The engine commits it once for each session and folder; a query reads the repository, never the defining frame.
"""

from __future__ import annotations

import contextlib
import io
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.evaluation import KEY, ChainConfig, OracleIdentity, equal_multisets, identity_quality, make_chain, md5_draw, rows_by_id, truth_pairs
from palimpsest.functions.canon import CanonConfig, content_key
from palimpsest.functions.similarity import numeric_similarity, string_similarity
from palimpsest.operators import diffing, matching
from palimpsest.operators.identity import ContentMatchIdentity, compute_row_ids, key_text, make_identity
from palimpsest.plans.schema import RID
from palimpsest.repository import Repository
from palimpsest.sources.tables import read_table, write_table
from palimpsest.sources.workspace import scratch

Query = Callable[[SparkSession, str], DataFrame]

_COLS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate"
_PRICE = "CASE WHEN o_orderkey % 17 = 0 THEN o_totalprice + 100 ELSE o_totalprice END AS o_totalprice"
_STATUS = "CASE WHEN o_orderkey % 23 = 0 THEN 'X' WHEN o_orderkey % 29 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus"

#: Each version as SQL that both engines understand: append, delete, edit, add, drop, change a type, delete.
VERSIONS = {
    1: f"SELECT {_COLS}, o_orderpriority FROM orders WHERE o_orderkey % 10 <> 9",
    2: f"SELECT {_COLS}, o_orderpriority FROM orders",
    3: f"SELECT {_COLS}, o_orderpriority FROM orders WHERE o_orderkey % 10 <> 0",
    4: f"SELECT o_orderkey, o_custkey, {_STATUS}, {_PRICE}, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 10 <> 0",
}
VERSIONS[5] = f"SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey * 10 END AS weight FROM ({VERSIONS[4]}) v4"
VERSIONS[6] = f"SELECT {_COLS}, weight FROM ({VERSIONS[5]}) v5"
VERSIONS[7] = f"SELECT {_COLS}, CAST(weight AS INT) AS weight FROM ({VERSIONS[6]}) v6"
VERSIONS[8] = f"SELECT * FROM ({VERSIONS[7]}) v7 WHERE o_orderkey % 13 <> 3"
HEAD = max(VERSIONS)

_EVENTS = "ts, user_id, event_type, value, props"
_ITEMS = "l_quantity, l_discount, l_tax, l_returnflag, l_linestatus"
#: Two versions of tables without a key: rows leave, rows come, a cell changes.
KEYLESS = {
    "events": (
        f"SELECT {_EVENTS} FROM events WHERE event_id % 11 <> 1",
        f"SELECT ts, user_id, event_type, CASE WHEN event_id % 19 = 3 THEN value + 0.001 ELSE value END AS value, props FROM events WHERE event_id % 7 <> 2",
    ),
    "lineitem": (
        f"SELECT {_ITEMS} FROM lineitem WHERE l_orderkey % 5 <> 1",
        f"SELECT {_ITEMS} FROM lineitem WHERE l_orderkey % 5 <> 2",
    ),
    # Suppliers differ in their name, which stays: one edited balance leaves one best match.
    "supplier": (
        "SELECT s_name, s_acctbal, s_nationkey FROM supplier",
        "SELECT s_name, CASE WHEN s_suppkey % 9 = 4 THEN s_acctbal + 1 ELSE s_acctbal END AS s_acctbal, s_nationkey FROM supplier WHERE s_suppkey % 10 <> 7",
    ),
}
#: The same rows, with one cell edited in every eleventh; the name of an order says which it is.
_LARGE = "SELECT o_orderkey, concat('order ', CAST(o_orderkey * 7919 % 1000003 AS VARCHAR(20)), ' of ', CAST(o_custkey AS VARCHAR(20))) AS o_name, o_orderstatus, {} AS o_totalprice FROM orders"
LARGE = (_LARGE.format("o_totalprice"), _LARGE.format("CASE WHEN o_orderkey % 11 = 5 THEN o_totalprice + 0.5 ELSE o_totalprice END"))
LARGE_COLUMNS = ["o_name", "o_orderstatus", "o_totalprice"]
THRESHOLDS = (0.0, 0.05, 0.5, 0.9, 1.0)
#: Pairs of texts and of rows that both engines make alike.
NAMES = "SELECT a.c_custkey, a.c_name AS a, b.c_name AS b FROM customer a JOIN customer b ON a.c_custkey = b.c_custkey + 7"
PAIRED = """SELECT s_suppkey, s_acctbal AS a, s_acctbal + s_suppkey % 20 * 400 AS b, s_name AS x, concat(substr(s_name, 1, 12), CAST(s_suppkey % 7 AS VARCHAR(9))) AS y,
CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'same' END AS p, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'same' END AS q FROM supplier"""
MATCHER = {"block_on": ["event_type", "user_id"]}
TABLES = ("orders", "conversations", "lineitem", "events", "customer", "supplier", "nation")

_MADE: dict[tuple, Repository] = {}


def views(spark: SparkSession, sf_dir: str) -> None:
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def _once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], Repository]) -> Repository:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _MADE:
        views(spark, sf_dir)
        _MADE[key] = make()
    return _MADE[key]


def orders(spark: SparkSession, sf_dir: str, upto: int = HEAD) -> Repository:
    """The history of orders; snapshots after versions 3 and 6."""

    def make() -> Repository:
        repo = Repository.init(spark, scratch(spark, "orders"), "o_orderkey", snapshot_interval=3 if upto == HEAD else None)
        for v in range(1, upto + 1):
            repo.commit(spark.sql(VERSIONS[v]), f"v{v}", audit=v == 4)
        return repo

    return _once(spark, sf_dir, f"orders{upto}", make)


def keyless(spark: SparkSession, sf_dir: str, table: str, **knobs) -> Repository:
    def make() -> Repository:
        repo = Repository.init(spark, scratch(spark, table), identity=ContentMatchIdentity(**knobs))
        for sql in KEYLESS[table]:
            repo.commit(spark.sql(sql))
        return repo

    return _once(spark, sf_dir, f"{table}{sorted(knobs.items())}", make)


def one_row(spark: SparkSession, **values) -> DataFrame:
    kinds = {int: "long", str: "string", float: "double", bool: "boolean"}
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))


def _stats(spark: SparkSession, stats: dict) -> DataFrame:
    return one_row(spark, **{k: int(v) for k, v in stats.items()})


# --- versions -------------------------------------------------------------------------------------------------------


def checkout(version: int | None, spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).checkout(version)


def checkout_from_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot stands by itself: everything it was made from is removed first."""

    def make() -> Repository:
        repo = Repository.init(spark, scratch(spark, "snap"), "o_orderkey")
        for v in (1, 2, 3, 4):
            repo.commit(spark.sql(VERSIONS[v]))
        repo.snapshot(4)
        for part in (repo.store.version_path(1, "base"), repo.store.version_path(2, "inserts"), repo.store.version_path(3, "deletes")):
            repo.store.files.remove(part)
        return repo

    return _once(spark, sf_dir, "snap", make).checkout(4)


def checkout_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version 4 through all deltas, no snapshot in the way."""
    return orders(spark, sf_dir, 4).checkout(4, ordered=False)


def composite_key_checkout(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make() -> Repository:
        repo = Repository.init(spark, scratch(spark, "conv"), ["conv_id", "turn"])
        repo.commit(spark.sql("SELECT * FROM conversations WHERE turn % 3 <> 2"))
        repo.commit(spark.sql("SELECT conv_id, turn, role, CASE WHEN conv_id % 4 = 1 THEN 'edited' ELSE text END AS text FROM conversations WHERE conv_id % 5 <> 0"))
        return repo

    return _once(spark, sf_dir, "conv", make).checkout(2)


def time_travel_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders(spark, sf_dir).register_views("orders_at")
    return spark.sql(
        "SELECT a.o_orderstatus AS status, count(*) AS n, sum(CASE WHEN b.o_totalprice > a.o_totalprice THEN 1 ELSE 0 END) AS raised "
        "FROM orders_at_v2 a JOIN orders_at_v4 b ON a.o_orderkey = b.o_orderkey GROUP BY a.o_orderstatus"
    )


# --- differences ----------------------------------------------------------------------------------------------------


def _ids(df: DataFrame) -> DataFrame:
    return df.select(F.col(RID).cast("long").alias("o_orderkey"))


def row_diff(part: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    repo = orders(spark, sf_dir)
    return _ids(diffing.row_diff(repo.frame(1), repo.frame(3))[part])


def changed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(diffing.changed_rows(orders(spark, sf_dir).changes(2, 4)))


def changed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffing.changed_columns(orders(spark, sf_dir).changes(2, 4))


def cell_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = orders(spark, sf_dir).audit(4)
    return a.select(F.col(RID).cast("long").alias("o_orderkey"), F.col("column"), *[F.when(F.col("column") == "o_orderstatus", F.col(c)).alias(c) for c in ("old_val", "new_val")],
                    *[F.when(F.col("column") == "o_totalprice", F.round(F.col(c).cast("double"), 2)).alias(f"{c}_price") for c in ("old_val", "new_val")])


def diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = orders(spark, sf_dir).diff(1, HEAD)
    return one_row(spark, rows_added=d.rows_added, rows_deleted=d.rows_deleted, rows_updated=d.rows_updated, columns_added=",".join(d.columns_added), columns_removed=",".join(d.columns_removed))


def column_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = orders(spark, sf_dir).diff(4, 6)
    return spark.createDataFrame([(c, "added") for c in d.columns_added] + [(c, "removed") for c in d.columns_removed], "column string, change string")


def type_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = orders(spark, sf_dir).diff(6, 7)
    return spark.createDataFrame([(t["column"], t["old_type"], t["new_type"]) for t in d.type_changes], "column string, old_type string, new_type string")


def log_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).log_df().drop("timestamp")


def component(version: int, name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    out = orders(spark, sf_dir).component(version, name)
    return out.withColumn("o_orderkey", F.col(RID).cast("long")).drop(RID)


def component_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    repo = orders(spark, sf_dir)
    names = repo.metadata(4)["components"]["updates"]
    out = repo.component(4, "updates")
    cells = [x for k, c in enumerate(names) for x in (F.col(f"__cell_{k}").isNotNull().alias(f"{c}_changed"), F.col(f"__cell_{k}.v").alias(c))]
    return out.select(F.col(RID).cast("long").alias("o_orderkey"), *cells)


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, missing = rows_by_id(orders(spark, sf_dir), ["21", "5", "10", "1"], HEAD)
    return found.select("o_orderkey", "o_custkey", F.lit(",".join(missing)).alias("not_found"))


# --- without a key --------------------------------------------------------------------------------------------------


def keyless_checkout(table: str, version: int, spark: SparkSession, sf_dir: str) -> DataFrame:
    knobs = MATCHER if table == "events" else {"exact_only": True} if table == "lineitem" else {"block_on": ["s_nationkey"]}
    return keyless(spark, sf_dir, table, **knobs).checkout(version)


def exact_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the exact multiset join, for each return flag."""
    views(spark, sf_dir)
    new = spark.sql(KEYLESS["lineitem"][1]).withColumn(matching.ORD, F.monotonically_increasing_id())
    old = spark.sql(KEYLESS["lineitem"][0]).withColumn(RID, F.monotonically_increasing_id().cast("string"))
    where = scratch(spark, "exact")
    new.write.parquet(f"{where}/new")
    old.write.parquet(f"{where}/old")
    new, old = spark.read.parquet(f"{where}/new"), spark.read.parquet(f"{where}/old")
    pairs = matching.exact_pairs(new, old, [c for c in new.columns if c != matching.ORD], CanonConfig())
    return pairs.join(new, matching.ORD).groupBy("l_returnflag").agg(F.count("*").alias("n_matched"), F.count_distinct(RID).alias("n_parents"))


def exact_only_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, keyless(spark, sf_dir, "lineitem", exact_only=True).log()[1]["stats"])


def fuzzy_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, keyless(spark, sf_dir, "supplier", block_on=["s_nationkey"]).log()[1]["stats"])


def provenance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    repo = keyless(spark, sf_dir, "supplier", block_on=["s_nationkey"])
    return repo.explain_last().groupBy("method").agg(F.count("*").alias("n"))


def fuzzy_large_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without a key and without blocks, one cell edited in every eleventh row: all edited rows find their parent."""

    def make() -> Repository:
        repo = Repository.init(spark, scratch(spark, "large"), identity=ContentMatchIdentity(compare_on=LARGE_COLUMNS))
        for sql in LARGE:
            repo.commit(spark.sql(sql))
        return repo

    repo = _once(spark, sf_dir, "large", make)
    # A link is right if it joins the rows of one order, whose key took no part in the comparison.
    old, new = repo.frame(1).select(RID, F.col("o_orderkey").alias("old_key")), repo.frame(2).select(RID, "o_orderkey", "o_orderstatus")
    right = new.join(old, RID).agg(F.count_if(F.col("old_key") == F.col("o_orderkey")).alias("right_links"), F.count_if(F.col("old_key") != F.col("o_orderkey")).alias("wrong_links"))
    stats = {k: v for k, v in repo.log()[1]["stats"].items() if k in ("added", "deleted", "updated")}
    return right.select("right_links", "wrong_links", *[F.lit(v).cast("long").alias(k) for k, v in stats.items()])


def reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a repository says of itself after it is opened anew."""
    repo = Repository.open(spark, orders(spark, sf_dir).store.root)
    again = make_identity(repo.identity.to_config())
    return one_row(spark, head=repo.head, versions=len(repo), key=",".join(repo.primary_key), keyless=repo.keyless, same_identity=again.to_config() == repo.identity.to_config(), rows=repo.checkout(ordered=False).count())


def history_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every version of a synthetic history, and how many survive, enter and leave from one to the next."""
    views(spark, sf_dir)
    table = spark.sql("SELECT o_orderkey, o_totalprice FROM orders")
    chain = make_chain(table, F.col("o_orderkey"), ["o_totalprice"], ChainConfig(n_versions=4), draw=md5_draw)
    out = None
    for v, now in enumerate(chain, 1):
        before = chain[v - 2] if v > 1 else now.limit(0)
        stay = truth_pairs(before, now)
        row = now.agg(F.lit(v).alias("version"), F.count("*").alias("n_rows"), F.sum("o_orderkey").alias("keys"))
        row = row.crossJoin(stay.agg(F.count("*").alias("survivors"), F.coalesce(F.sum(F.col(KEY).cast("long")), F.lit(0)).alias("survivor_keys")))  # one row each
        out = row if out is None else out.unionByName(row)
    return out


def command_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV file and a Parquet file committed and checked out by the command line; the rows of both versions as they were written."""
    from palimpsest import cli

    views(spark, sf_dir)
    where = scratch(spark, "cli")
    write_table(spark.sql("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 5 <> 1"), f"{where}/first.csv")
    write_table(spark.sql("SELECT n_nationkey, upper(n_name) AS n_name FROM nation"), f"{where}/second.parquet")
    root = f"{where}/repo"
    for command in (["init", root, "-k", "n_nationkey"], ["commit", root, f"{where}/first.csv"], ["commit", root, f"{where}/second.parquet"],
                    ["checkout", root, "-v", "1", "-o", f"{where}/one.parquet"], ["checkout", root, "-o", f"{where}/two.csv"]):
        with contextlib.redirect_stdout(io.StringIO()):
            cli.run(cli.parser().parse_args(command), spark)
    read = lambda name, v: read_table(spark, f"{where}/{name}").select(F.lit(v).alias("version"), F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")
    return read("one.parquet", 1).unionByName(read("two.csv", 2))


def row_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean cell similarity of two versions of each supplier: a number, a text, and a cell that one side may lack."""
    views(spark, sf_dir)
    rows = spark.sql(PAIRED)
    return rows.select("s_suppkey", F.round((numeric_similarity(F.col("a"), F.col("b"), 5000.0, 0.05) + string_similarity("x", "y") + string_similarity("p", "q")) / 3, 9).alias("similarity"))


def error_confinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under every threshold the version comes back; returns its rows once for each threshold."""
    out = None
    for threshold in THRESHOLDS:
        one = keyless(spark, sf_dir, "supplier", block_on=["s_nationkey"], row_threshold=threshold).checkout(2).withColumn("threshold", F.lit(threshold))
        out = one if out is None else out.unionByName(one)
    return out


def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that forbid (l_orderkey, l_linenumber) as a primary key."""
    views(spark, sf_dir)
    ids = spark.table("lineitem").select(key_text(["l_orderkey", "l_linenumber"]).alias(RID), "l_orderkey", "l_linenumber")
    return ids.groupBy(RID).agg(F.first("l_orderkey").alias("l_orderkey"), F.first("l_linenumber").alias("l_linenumber"), F.count("*").alias("n")).filter("n > 1").drop(RID)


def rejected_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said of a repeated, a null and a missing key."""
    views(spark, sf_dir)
    cases = {
        "repeated": (spark.table("lineitem"), ["l_orderkey", "l_linenumber"]),
        "null": (spark.sql("SELECT nullif(o_orderkey, 5) AS k FROM orders"), ["k"]),
        "missing": (spark.table("orders"), ["nothing"]),
        "fine": (spark.table("orders"), ["o_orderkey"]),
    }
    rows = []
    for name, (df, keys) in cases.items():
        try:
            compute_row_ids(df, keys)
            rows.append((name, "accepted"))
        except (ValueError, KeyError) as e:
            rows.append((name, type(e).__name__))
    return spark.createDataFrame(rows, "input string, outcome string")


def column_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir)
    a, b = (spark.sql(s) for s in KEYLESS["lineitem"])
    got = matching.column_scales(b, a, b.columns)
    return spark.createDataFrame([(c, round(v, 6)) for c, v in got.items()], "column string, scale double")


def numeric_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir)
    pair = spark.sql("SELECT o_orderkey, nullif(o_totalprice, o_totalprice * (o_orderkey % 11)) AS a, nullif(o_totalprice + o_orderkey % 100 * 700, o_totalprice) AS b FROM orders")
    return pair.select("o_orderkey", F.round(numeric_similarity(F.col("a"), F.col("b"), 50000.0, 0.05), 9).alias("similarity"))


def string_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir)
    pair = spark.sql(NAMES)
    return pair.select("c_custkey", F.round(string_similarity("a", "b"), 9).alias("ratio"))


def canonical_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of groups of equal canonical content: case and outer white space aside, numbers rounded."""
    views(spark, sf_dir)
    df = spark.sql("SELECT CASE WHEN l_orderkey % 2 = 0 THEN concat(' ', lower(l_returnflag), '\t') ELSE l_returnflag END AS flag, l_tax + CASE WHEN l_orderkey % 3 = 0 THEN 0.00000001 ELSE 0 END AS tax FROM lineitem")
    key = content_key(df, ["flag", "tax"], CanonConfig(round_decimals=6, case_insensitive=True))
    rows = df.select(key.alias("k"), F.upper(F.btrim("flag", F.lit(" \t"))).alias("flag"), F.round("tax", 6).alias("tax"))
    return rows.groupBy("k").agg(F.max("flag").alias("flag"), F.max("tax").alias("tax"), F.count("*").alias("n")).drop("k")


def identity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity with a hidden true key is right everywhere."""

    def make() -> Repository:
        repo = Repository.init(spark, scratch(spark, "oracle"), identity=OracleIdentity())
        for v in (3, 4):
            repo.commit(spark.sql(f"SELECT *, CAST(o_orderkey AS STRING) AS {KEY} FROM ({VERSIONS[v]}) v"))
        return repo

    repo = _once(spark, sf_dir, "oracle", make)
    q = identity_quality(repo.frame(1), repo.frame(2), ["o_custkey", "o_orderstatus", "o_totalprice"])
    return one_row(spark, **{k: round(v, 9) for k, v in q.items()})


def round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version of the history against the frame it was committed from."""
    repo = orders(spark, sf_dir)
    views(spark, sf_dir)
    rows = [(v, equal_multisets(repo.checkout(v, ordered=False), spark.sql(VERSIONS[v]))) for v in VERSIONS]
    return spark.createDataFrame(rows, "version int, equal boolean")


def storage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each version's components, and whether all of them together take less than the copies that they stand for."""
    repo = orders(spark, sf_dir)
    out = None
    for v in repo.versions:
        for c in repo.metadata(v)["components"]:
            one = repo.component(v, c).agg(F.lit(v).alias("version"), F.lit(c).alias("component"), F.count("*").alias("n_rows"))
            out = one if out is None else out.unionByName(one)
    base = repo.store.files.size(repo.store.version_path(1, "base"))
    size = sum(repo.store.files.size(repo.store.version_path(v)) for v in repo.versions)
    return out.withColumn("saves", F.lit(size < len(repo) * base))


QUERIES: dict[str, Query] = {f"checkout_v{v}": partial(checkout, v) for v in VERSIONS}
QUERIES |= {
    "checkout_head": partial(checkout, None),
    "checkout_from_snapshot": checkout_from_snapshot,
    "checkout_replayed": checkout_replayed,
    "composite_key_checkout": composite_key_checkout,
    "time_travel_sql": time_travel_sql,
    "row_diff_added": partial(row_diff, "appended"),
    "row_diff_deleted": partial(row_diff, "deleted"),
    "row_diff_unchanged": partial(row_diff, "unchanged"),
    "changed_rows": changed_rows,
    "changed_columns": changed_columns,
    "cell_audit": cell_audit,
    "diff_summary": diff_summary,
    "column_diff": column_diff,
    "type_changes": type_changes,
    "log_stats": log_stats,
    "component_inserts": partial(component, 2, "inserts"),
    "component_deletes": partial(component, 3, "deletes"),
    "component_updates": component_updates,
    "component_columns": partial(component, 5, "columns"),
    "point_lookup": point_lookup,
    "keyless_checkout_events": partial(keyless_checkout, "events", 2),
    "keyless_checkout_events_v1": partial(keyless_checkout, "events", 1),
    "keyless_checkout_lineitem": partial(keyless_checkout, "lineitem", 2),
    "keyless_checkout_supplier": partial(keyless_checkout, "supplier", 2),
    "exact_match_counts": exact_match_counts,
    "exact_only_stats": exact_only_stats,
    "fuzzy_stats": fuzzy_stats,
    "provenance_counts": provenance_counts,
    "error_confinement": error_confinement,
    "duplicate_keys": duplicate_keys,
    "rejected_keys": rejected_keys,
    "column_scales": column_scales,
    "numeric_similarities": numeric_similarities,
    "string_ratios": string_ratios,
    "canonical_groups": canonical_groups,
    "fuzzy_large_block": fuzzy_large_block,
    "reopened": reopened,
    "history_sizes": history_sizes,
    "command_line": command_line,
    "row_similarities": row_similarities,
    "identity_scores": identity_scores,
    "round_trip": round_trip,
    "storage_report": storage_report,
}

_V = lambda v: f"({VERSIONS[v]})"
_CELLS = f"""
SELECT a.o_orderkey AS o_orderkey, 'o_orderstatus' AS "column", a.o_orderstatus AS old_val, b.o_orderstatus AS new_val,
       CAST(NULL AS DOUBLE) AS old_val_price, CAST(NULL AS DOUBLE) AS new_val_price
FROM {_V(3)} a JOIN {_V(4)} b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderstatus IS DISTINCT FROM b.o_orderstatus
UNION ALL
SELECT a.o_orderkey, 'o_totalprice', NULL, NULL, round(a.o_totalprice, 2), round(b.o_totalprice, 2)
FROM {_V(3)} a JOIN {_V(4)} b ON a.o_orderkey = b.o_orderkey WHERE a.o_totalprice IS DISTINCT FROM b.o_totalprice
"""
_GROUPS = "SELECT l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, count(*) AS n FROM ({}) v GROUP BY ALL"
_COMMON = f"""(SELECT a.l_returnflag AS l_returnflag, least(a.n, b.n) AS n FROM ({_GROUPS.format(KEYLESS["lineitem"][0])}) a
JOIN ({_GROUPS.format(KEYLESS["lineitem"][1])}) b USING (l_quantity, l_discount, l_tax, l_returnflag, l_linestatus))"""
_SUPPLIERS = """SELECT CAST(sum(CASE WHEN s_suppkey % 10 = 7 THEN 1 ELSE 0 END) AS BIGINT) AS gone,
CAST(sum(CASE WHEN s_suppkey % 10 <> 7 AND s_suppkey % 9 = 4 THEN 1 ELSE 0 END) AS BIGINT) AS edited, count(*) AS n FROM supplier"""
_ZERO = ", ".join(f"CAST(0 AS BIGINT) AS {k}" for k in ("columns_added", "columns_removed", "types_changed"))


def _log_sql() -> str:
    n = lambda where: f"(SELECT count(*) FROM orders WHERE {where})"
    live = "o_orderkey % 10 <> 0"
    edited = f"{live} AND (o_orderkey % 17 = 0 OR (o_orderkey % 23 = 0 AND o_orderstatus <> 'X') OR (o_orderkey % 29 = 0 AND o_orderkey % 23 <> 0))"
    rows = [
        (1, n("o_orderkey % 10 <> 9"), 0, 0, 6, 0, 0), (2, n("o_orderkey % 10 = 9"), 0, 0, 0, 0, 0), (3, 0, n("o_orderkey % 10 = 0"), 0, 0, 0, 0),
        (4, 0, 0, n(edited), 0, 0, 0), (5, 0, 0, 0, 1, 0, 0), (6, 0, 0, 0, 0, 1, 0), (7, 0, 0, 0, 0, 0, 1), (8, 0, n(f"{live} AND o_orderkey % 13 = 3"), 0, 0, 0, 0),
    ]
    names = ("added", "deleted", "updated", "columns_added", "columns_removed", "types_changed")
    return " UNION ALL ".join(
        f"SELECT CAST({v} AS INT) AS version, CAST({v - 1} AS INT) AS parent, 'v{v}' AS message, " + ", ".join(f"CAST({x} AS BIGINT) AS {k}" for k, x in zip(names, r, strict=True))
        for v, *r in rows
    )


def _ratio_sql(pairs: str, key: str, a: str, b: str, out: str) -> str:
    """2 * LCS / (length + length) of two text columns, the table of the LCS filled row by row."""
    return f"""WITH RECURSIVE p AS (SELECT {key}, {a} AS a, {b} AS b FROM ({pairs}) s),
    t AS (SELECT {key}, a, b, 0 AS i, list_transform(range(0, length(b) + 1), lambda x: 0) AS line FROM p
        UNION ALL SELECT {key}, a, b, i + 1, list_reduce(range(1, length(b) + 1),
            lambda done, j: list_append(done, CASE WHEN substr(a, i + 1, 1) = substr(b, j, 1) THEN line[j] + 1 ELSE greatest(line[j + 1], done[len(done)]) END), [0])
        FROM t WHERE i < length(a))
    SELECT {key}, {out.replace("ratio", "(2.0 * line[length(b) + 1] / (length(a) + length(b)))", 1) if out != "ratio" else "2.0 * line[length(b) + 1] / (length(a) + length(b)) AS ratio"} FROM t WHERE i = length(a)"""


def _history_sql(n: int) -> str:
    """The rows of a synthetic history by the same draws: md5 of key and salt, which both engines have."""
    draw = lambda *salt: "CAST(CAST('0x' || substr(md5(concat_ws('|', k, " + ", ".join(f"'{s}'" for s in salt) + ")), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0"
    cfg = ChainConfig()
    enters = f"CASE WHEN {draw(cfg.seed, 'enter')} < {cfg.start} THEN 1 ELSE CAST(floor(({draw(cfg.seed, 'enter')} - {cfg.start}) / {cfg.inserts}) AS INT) + 2 END"
    gone = lambda v: " OR ".join([f"(enters < {w} AND {draw(cfg.seed, w, 'leave')} < {cfg.deletes})" for w in range(2, v + 1)] or ["false"])
    universe = f"(SELECT *, {enters} AS enters FROM (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS k FROM orders) o)"
    there = lambda v: f"enters <= {v} AND NOT ({gone(v)})"
    rows = []
    for v in range(1, n + 1):
        stay = f"({there(v)}) AND ({there(v - 1)})" if v > 1 else "false"
        total = lambda what, c: f"CAST(coalesce(sum(CASE WHEN {c} THEN {what} ELSE 0 END), 0) AS BIGINT)"
        rows.append(f"SELECT CAST({v} AS INT) AS version, {total('1', there(v))} AS n_rows, {total('o_orderkey', there(v))} AS keys, {total('1', stay)} AS survivors, {total('o_orderkey', stay)} AS survivor_keys FROM {universe} u")
    return " UNION ALL ".join(rows)


def _storage_sql() -> str:
    n = {"added": "added", "deleted": "deleted", "updated": "updated"}
    one = lambda v, name, what: f"SELECT CAST({v} AS INT) AS version, '{name}' AS component, {what} AS n_rows, true AS saves FROM ({_log_sql()}) l WHERE version = {v}"
    cells = f"(SELECT count(*) FROM ({_CELLS}) c)"
    weights = "(SELECT count(*) FROM orders WHERE o_orderkey % 10 <> 0 AND o_orderkey % 7 <> 0)"
    parts = [(1, "base", n["added"]), (2, "inserts", n["added"]), (3, "deletes", n["deleted"]), (4, "updates", n["updated"]), (4, "cells", cells), (5, "columns", weights), (8, "deletes", n["deleted"])]
    return " UNION ALL ".join(one(*p) for p in parts)


ORACLE_SQL = {f"checkout_v{v}": sql for v, sql in VERSIONS.items()}
ORACLE_SQL |= {
    "checkout_head": VERSIONS[HEAD],
    "checkout_from_snapshot": VERSIONS[4],
    "checkout_replayed": VERSIONS[4],
    "composite_key_checkout": "SELECT conv_id, turn, role, CASE WHEN conv_id % 4 = 1 THEN 'edited' ELSE text END AS text FROM conversations WHERE conv_id % 5 <> 0",
    "time_travel_sql": f"SELECT a.o_orderstatus AS status, count(*) AS n, CAST(sum(CASE WHEN b.o_totalprice > a.o_totalprice THEN 1 ELSE 0 END) AS BIGINT) AS raised FROM {_V(2)} a JOIN {_V(4)} b ON a.o_orderkey = b.o_orderkey GROUP BY a.o_orderstatus",
    "row_diff_added": f"SELECT o_orderkey FROM {_V(3)} EXCEPT SELECT o_orderkey FROM {_V(1)}",
    "row_diff_deleted": f"SELECT o_orderkey FROM {_V(1)} EXCEPT SELECT o_orderkey FROM {_V(3)}",
    "row_diff_unchanged": f"SELECT o_orderkey FROM {_V(1)} INTERSECT SELECT o_orderkey FROM {_V(3)}",
    "changed_rows": f"SELECT DISTINCT o_orderkey FROM ({_CELLS}) c",
    "changed_columns": f'SELECT "column", count(*) AS n_rows FROM ({_CELLS}) c GROUP BY "column"',
    "cell_audit": _CELLS,
    "diff_summary": f"""SELECT (SELECT count(*) FROM (SELECT o_orderkey FROM {_V(8)} EXCEPT SELECT o_orderkey FROM {_V(1)})) AS rows_added,
        (SELECT count(*) FROM (SELECT o_orderkey FROM {_V(1)} EXCEPT SELECT o_orderkey FROM {_V(8)})) AS rows_deleted,
        (SELECT count(*) FROM {_V(1)} a JOIN {_V(8)} b ON a.o_orderkey = b.o_orderkey
         WHERE a.o_orderstatus IS DISTINCT FROM b.o_orderstatus OR a.o_totalprice IS DISTINCT FROM b.o_totalprice) AS rows_updated,
        'weight' AS columns_added, 'o_orderpriority' AS columns_removed""",
    "column_diff": f"""SELECT column_name AS "column", 'added' AS change FROM (DESCRIBE {VERSIONS[6]}) WHERE column_name NOT IN (SELECT column_name FROM (DESCRIBE {VERSIONS[4]}))
        UNION ALL SELECT column_name, 'removed' FROM (DESCRIBE {VERSIONS[4]}) WHERE column_name NOT IN (SELECT column_name FROM (DESCRIBE {VERSIONS[6]}))""",
    "type_changes": f"""SELECT a.column_name AS "column", lower(a.column_type) AS old_type, replace(lower(b.column_type), 'integer', 'int') AS new_type
        FROM (DESCRIBE {VERSIONS[6]}) a JOIN (DESCRIBE {VERSIONS[7]}) b USING (column_name) WHERE a.column_type <> b.column_type""",
    "log_stats": _log_sql(),
    "component_inserts": f"SELECT {_COLS}, o_orderpriority FROM orders WHERE o_orderkey % 10 = 9",
    "component_deletes": "SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 0",
    "component_updates": f"""SELECT a.o_orderkey AS o_orderkey, a.o_orderstatus IS DISTINCT FROM b.o_orderstatus AS o_orderstatus_changed,
        CASE WHEN a.o_orderstatus IS DISTINCT FROM b.o_orderstatus THEN b.o_orderstatus END AS o_orderstatus,
        a.o_totalprice IS DISTINCT FROM b.o_totalprice AS o_totalprice_changed,
        CASE WHEN a.o_totalprice IS DISTINCT FROM b.o_totalprice THEN b.o_totalprice END AS o_totalprice
        FROM {_V(3)} a JOIN {_V(4)} b ON a.o_orderkey = b.o_orderkey
        WHERE a.o_orderstatus IS DISTINCT FROM b.o_orderstatus OR a.o_totalprice IS DISTINCT FROM b.o_totalprice""",
    "component_columns": "SELECT o_orderkey, o_orderkey * 10 AS weight FROM orders WHERE o_orderkey % 10 <> 0 AND o_orderkey % 7 <> 0",
    "point_lookup": f"SELECT o_orderkey, o_custkey, '10' AS not_found FROM {_V(8)} v WHERE o_orderkey IN (21, 5, 1)",
    "keyless_checkout_events": KEYLESS["events"][1],
    "keyless_checkout_events_v1": KEYLESS["events"][0],
    "keyless_checkout_lineitem": KEYLESS["lineitem"][1],
    "keyless_checkout_supplier": KEYLESS["supplier"][1],
    "exact_match_counts": f"SELECT l_returnflag, CAST(sum(n) AS BIGINT) AS n_matched, CAST(sum(n) AS BIGINT) AS n_parents FROM {_COMMON} c GROUP BY l_returnflag",
    "exact_only_stats": f"""SELECT (SELECT count(*) FROM ({KEYLESS["lineitem"][1]}) v) - (SELECT CAST(sum(n) AS BIGINT) FROM {_COMMON} c) AS added,
        (SELECT count(*) FROM ({KEYLESS["lineitem"][0]}) v) - (SELECT CAST(sum(n) AS BIGINT) FROM {_COMMON} c) AS deleted, CAST(0 AS BIGINT) AS updated, {_ZERO}""",
    "fuzzy_stats": f"SELECT CAST(0 AS BIGINT) AS added, gone AS deleted, edited AS updated, {_ZERO} FROM ({_SUPPLIERS}) s",
    "provenance_counts": f"SELECT 'exact' AS method, n - gone - edited AS n FROM ({_SUPPLIERS}) s UNION ALL SELECT 'fuzzy', edited FROM ({_SUPPLIERS}) s WHERE edited > 0",
    "error_confinement": f"SELECT v.*, CAST(t.threshold AS DOUBLE) AS threshold FROM ({KEYLESS['supplier'][1]}) v, (VALUES {', '.join(f'({t})' for t in THRESHOLDS)}) t(threshold)",
    "fuzzy_large_block": """SELECT count(*) AS right_links, CAST(0 AS BIGINT) AS wrong_links, CAST(0 AS BIGINT) AS added, CAST(0 AS BIGINT) AS deleted,
        CAST(sum(CASE WHEN o_orderkey % 11 = 5 THEN 1 ELSE 0 END) AS BIGINT) AS updated FROM orders""",
    "reopened": f"SELECT CAST({HEAD} AS BIGINT) AS head, CAST({HEAD} AS BIGINT) AS versions, 'o_orderkey' AS \"key\", false AS keyless, true AS same_identity, count(*) AS \"rows\" FROM ({VERSIONS[HEAD]}) v",
    "history_sizes": _history_sql(4),
    "command_line": "SELECT CAST(1 AS INT) AS version, CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation WHERE n_nationkey % 5 <> 1 UNION ALL SELECT 2, CAST(n_nationkey AS BIGINT), upper(n_name) FROM nation",
    "string_ratios": _ratio_sql(NAMES, "c_custkey", "a", "b", "round(ratio, 9) AS ratio"),
    "row_similarities": f"""SELECT s_suppkey, round((CASE WHEN abs(a - b) <= 250 THEN 1.0 ELSE greatest(0.0, 1 - abs(a - b) / 5000) END + ratio
        + CASE WHEN p IS NULL AND q IS NULL THEN 1.0 WHEN p IS NULL OR q IS NULL THEN 0.0 ELSE 1.0 END) / 3, 9) AS similarity
        FROM ({PAIRED}) v JOIN ({_ratio_sql(PAIRED, "s_suppkey", "x", "y", "ratio")}) r USING (s_suppkey)""",
    "storage_report": _storage_sql(),
    "duplicate_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
    "rejected_keys": """SELECT 'repeated' AS input, CASE WHEN max(n) > 1 THEN 'ValueError' ELSE 'accepted' END AS outcome FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber) g
        UNION ALL SELECT 'null', CASE WHEN count(*) > count(nullif(o_orderkey, 5)) THEN 'ValueError' ELSE 'accepted' END FROM orders
        UNION ALL SELECT 'missing', CASE WHEN count(*) = 0 THEN 'KeyError' ELSE 'accepted' END FROM (DESCRIBE SELECT * FROM orders) WHERE column_name = 'nothing'
        UNION ALL SELECT 'fine', CASE WHEN max(n) > 1 THEN 'ValueError' ELSE 'accepted' END FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderkey) g""",
    "column_scales": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(stddev_samp({c}), 6) AS scale FROM ({KEYLESS['lineitem'][0]} UNION ALL {KEYLESS['lineitem'][1]}) v" for c in ("l_quantity", "l_discount", "l_tax")
    ),
    "numeric_similarities": """SELECT o_orderkey, round(CASE WHEN a IS NULL AND b IS NULL THEN 1.0 WHEN a IS NULL OR b IS NULL THEN 0.0
        WHEN abs(a - b) <= 2500 THEN 1.0 ELSE greatest(0.0, 1 - abs(a - b) / 50000) END, 9) AS similarity
        FROM (SELECT o_orderkey, nullif(o_totalprice, o_totalprice * (o_orderkey % 11)) AS a, nullif(o_totalprice + o_orderkey % 100 * 700, o_totalprice) AS b FROM orders) p""",
    "canonical_groups": "SELECT l_returnflag AS flag, round(l_tax, 6) AS tax, count(*) AS n FROM lineitem GROUP BY l_returnflag, round(l_tax, 6)",
    "identity_scores": f"""SELECT hit / n AS precision, hit / n AS recall, 2.0 * (hit / n) * (hit / n) / (hit / n + hit / n) AS f1, hit_edited / edited AS recall_edited FROM (
        SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(CASE WHEN b.o_orderkey = a.o_orderkey THEN 1 ELSE 0 END) AS DOUBLE) AS hit,
        CAST(sum(CASE WHEN a.o_totalprice IS DISTINCT FROM b.o_totalprice OR a.o_orderstatus IS DISTINCT FROM b.o_orderstatus THEN 1 ELSE 0 END) AS DOUBLE) AS edited,
        CAST(sum(CASE WHEN (a.o_totalprice IS DISTINCT FROM b.o_totalprice OR a.o_orderstatus IS DISTINCT FROM b.o_orderstatus) AND b.o_orderkey = a.o_orderkey THEN 1 ELSE 0 END) AS DOUBLE) AS hit_edited
        FROM {_V(3)} a JOIN {_V(4)} b ON a.o_orderkey = b.o_orderkey) s""",
    "round_trip": " UNION ALL ".join(f"SELECT CAST({v} AS INT) AS version, count(*) = count(DISTINCT o_orderkey) AS equal FROM {_V(v)} v" for v in VERSIONS),
}
