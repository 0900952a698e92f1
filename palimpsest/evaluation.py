"""Synthetic histories with known truth, and what they measure: identity quality and storage.

Every choice is a hash of the key, the version and the seed, so a history is the same on any cluster. All steps are lazy
frames; `run_systems` commits them.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.operators.identity import ContentMatchIdentity, IdentityStrategy, register
from palimpsest.plans.schema import RID, is_numeric, quoted
from palimpsest.repository import Repository
from palimpsest.sources.files import Files
from palimpsest.sources.workspace import scratch

KEY = "__true_key__"


@register
class OracleIdentity(IdentityStrategy):
    """Ids from a key that other strategies do not see; for measurements only."""

    strategy = "oracle"

    def __init__(self, key: str = KEY):
        self.key = key

    def assign(self, df, parent, version, keep):
        return df.withColumn(RID, quoted(self.key).cast("string")), None

    def to_config(self) -> dict:
        return {"strategy": self.strategy, "key": self.key}


@dataclass(frozen=True)
class ChainConfig:
    n_versions: int = 6
    start: float = 0.7
    edits: float = 0.06
    deletes: float = 0.02
    inserts: float = 0.02
    seed: int = 0


def _draw(key: Column, *salt) -> Column:
    """A number in [0, 1) that depends on key and salt alone."""
    return F.pmod(F.xxhash64(key, *[F.lit(s) for s in salt]), F.lit(1_000_003)) / 1_000_003.0


def md5_draw(key: Column, *salt) -> Column:
    """The same by a hash that other engines have too: the first 32 bits of the md5 of key and salt, joined by |."""
    text = F.concat_ws("|", key, *[F.lit(str(s)) for s in salt])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def make_chain(table: DataFrame, key: Column, editable: list[str], cfg: ChainConfig = ChainConfig(), draw: Callable[..., Column] = _draw) -> list[DataFrame]:
    """Versions of table with the hidden key in KEY: rows enter and leave, and one editable cell of some rows changes."""
    universe = table.withColumn(KEY, key.cast("string"))
    k = F.col(KEY)
    # A row enters with version 1, or with the version of its draw; it leaves with the first version that draws it.
    late = (draw(k, cfg.seed, "enter") - cfg.start) / cfg.inserts
    enters = F.when(draw(k, cfg.seed, "enter") < cfg.start, 1).otherwise(F.floor(late).cast("int") + 2)
    out = []
    frame = universe.withColumn("__enters", enters)
    for v in range(1, cfg.n_versions + 1):
        if v > 1:
            frame = frame.withColumn("__gone", F.coalesce(F.col("__gone"), F.lit(False)) | ((F.col("__enters") < v) & (draw(k, cfg.seed, v, "leave") < cfg.deletes)))
            hit = (F.col("__enters") < v) & (draw(k, cfg.seed, v, "edit") < cfg.edits)
            which = F.pmod(F.xxhash64(k, F.lit(cfg.seed), F.lit(v), F.lit("which")), F.lit(len(editable)))
            for n, c in enumerate(editable):
                frame = frame.withColumn(c, F.when(hit & (which == n), perturbed(quoted(c), table.schema[c].dataType, k, cfg.seed, v)).otherwise(quoted(c)))
        else:
            frame = frame.withColumn("__gone", F.lit(False))
        out.append(frame.filter((F.col("__enters") <= v) & ~F.col("__gone")).select(*[quoted(c) for c in table.columns], KEY))
    return out


def perturbed(value: Column, t: T.DataType, key: Column, seed: int, version: int) -> Column:
    """A numeric cell moved by about a tenth of itself plus one; other cells, nulls and NaN as they are."""
    if not is_numeric(t):
        return value
    # The sum of twelve draws less six is close to a standard normal number.
    normal = sum((_draw(key, seed, version, f"n{n}") for n in range(12)), F.lit(0.0)) - 6.0
    moved = value.cast("double") + normal * (0.1 * F.abs(value.cast("double")) + 1.0)
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        moved = F.bround(moved, 0)
    return F.when(F.isnan(value.cast("double")), value).otherwise(moved.cast(t))


def truth_pairs(old: DataFrame, new: DataFrame) -> DataFrame:
    """(__true_key__) of rows that survive from one version to the next."""
    return new.select(KEY).join(old.select(KEY), KEY, "left_semi")


def identity_quality(old: DataFrame, new: DataFrame, columns: list[str]) -> dict[str, float]:
    """Precision, recall and F1 of row ids, over all survivors and over edited ones.

    Both frames have KEY and __rid__. A prediction is right if it names the true parent, or one of equal content.
    """
    content = lambda df: F.xxhash64(*[quoted(c) for c in columns])
    a = old.select(F.col(RID), F.col(KEY).alias("old_key"), content(old).alias("old_content"))
    true = old.select(F.col(KEY), content(old).alias("true_content"))
    rows = new.select(F.col(RID), F.col(KEY), content(new).alias("content")).join(a, RID, "left").join(true, KEY, "left")
    said, real = F.col("old_key").isNotNull(), F.col("true_content").isNotNull()
    right = said & real & ((F.col("old_key") == F.col(KEY)) | (F.col("old_content") == F.col("true_content")))
    edited = real & (F.col("content") != F.col("true_content"))
    n = rows.agg(*[F.count_if(c).alias(k) for k, c in (("said", said), ("real", real), ("right", right), ("edited", edited), ("right_edited", right & edited))]).first()
    share = lambda x, y: x / y if y else 1.0
    p, r = share(n["right"], n["said"]), share(n["right"], n["real"])
    return {"precision": p, "recall": r, "f1": 2 * p * r / (p + r) if p + r else 0.0, "recall_edited": share(n["right_edited"], n["edited"])}


def equal_multisets(a: DataFrame, b: DataFrame) -> bool:
    """Whether two frames hold the same rows equally often: one shuffle of both."""
    if a.columns != b.columns:
        return False
    names = [f"c{k}" for k in range(len(a.columns))]
    both = a.toDF(*names).withColumn("n", F.lit(1)).unionByName(b.toDF(*names).withColumn("n", F.lit(-1)))
    return both.groupBy(*names).agg(F.sum("n").alias("n")).filter(F.col("n") != 0).isEmpty()


def systems(block_on: list[str] | None, columns: list[str]) -> dict[str, IdentityStrategy]:
    """The identities that are compared. compare_on leaves the hidden key out."""
    knobs = {"compare_on": columns, "block_on": block_on, "row_threshold": 0.55, "num_rel_tol": 0.25}
    return {"hash_only": ContentMatchIdentity(exact_only=True, **knobs), "full": ContentMatchIdentity(**knobs), "oracle": OracleIdentity()}


@dataclass(frozen=True)
class Source:
    """A table that histories are made of: its file, its true key, columns that are edited, and columns that form blocks."""

    file: str
    key: str
    columns: tuple[str, ...]
    editable: tuple[str, ...]
    block_on: tuple[str, ...]
    cap: int = 20_000


#: Tables of the three kinds of the published measurement: a fine block, a coarse block, and mostly text and few numbers.
SOURCES = {
    "orders": Source("orders", "o_orderkey", ("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"), ("o_totalprice", "o_custkey"), ("o_orderdate", "o_orderstatus", "o_orderpriority")),
    "customer": Source("customer", "c_custkey", ("c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), ("c_acctbal",), ("c_mktsegment", "c_nationkey")),
    "events": Source("events", "event_id", ("ts", "user_id", "event_type", "value", "props"), ("value",), ("event_type", "user_id")),
}


def seeded_sample(df: DataFrame, key: Column, n: int, seed: int = 0) -> DataFrame:
    """n rows, those that come first in an order by a hash of key and seed; all rows if there are no more. The same on any cluster."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def run_all(spark: SparkSession, sf_dir: str, cfg: ChainConfig = ChainConfig(), sources: dict[str, Source] = SOURCES) -> list[dict]:
    """Every source under every system: {"table", "rows", "systems": {name: figures}}, the figures of a report."""
    out = []
    for name, source in sources.items():
        table = spark.read.parquet(f"{sf_dir}/{source.file}.parquet").select(*[quoted(c) for c in dict.fromkeys((source.key, *source.columns))])
        table = seeded_sample(table, quoted(source.key), source.cap, cfg.seed)
        chain = [c.drop(source.key).cache() for c in make_chain(table, quoted(source.key), list(source.editable), cfg)]
        rows = chain[0].count()
        found = run_systems(spark, chain, list(source.block_on))
        for c in chain:
            c.unpersist()
        keep = ("recall", "recall_edited", "precision", "saved_pct", "vs_naive", "seconds")
        out.append({"table": name, "rows": rows, "systems": {r["system"]: {k: round(r[k], 4) for k in keep} | {"exact": r["exact"]} for r in found}})
    return out


def report(results: list[dict]) -> str:
    """The figures of run_all as a table in Markdown."""
    head = ("table", "system", "recall", "edited", "precision", "storage, naive = 1", "saved %", "seconds", "exact")
    lines = ["| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    for r in results:
        for name, s in r["systems"].items():
            cells = (r["table"], name, s["recall"], s["recall_edited"], s["precision"], s["vs_naive"], s["saved_pct"], s["seconds"], "yes" if s["exact"] else "NO")
            lines.append("| " + " | ".join(str(c) for c in cells) + " |")
    return "\n".join(lines)


def run_systems(spark: SparkSession, chain: list[DataFrame], block_on: list[str] | None) -> list[dict]:
    """Commit a chain under every system: bytes against full copies, recall, seconds, and whether all versions came back.

    The naive system keeps a full copy of each version and knows nothing of rows: recall 0, storage 1.
    """
    columns = [c for c in chain[0].columns if c != KEY]
    where = scratch(spark, "copies")
    began = time.time()
    for v, df in enumerate(chain):
        df.drop(KEY).write.parquet(f"{where}/{v}")
    full = Files(spark, where).size(where)
    out = [{"system": "naive", "bytes": full, "full_copies": full, "saved_pct": 0.0, "vs_naive": 1.0, "recall": 0.0, "recall_edited": 0.0, "precision": 1.0, "exact": True, "seconds": time.time() - began}]
    for name, identity in systems(block_on, columns).items():
        repo = Repository.init(spark, scratch(spark, f"bench-{name}"), identity=identity)
        store = repo.store
        began = time.time()
        for df in chain:
            repo.commit(df)
        took = time.time() - began
        quality = [identity_quality(repo.frame(v), repo.frame(v + 1), columns) for v in range(1, len(chain))]
        mean = lambda k: sum(q[k] for q in quality) / max(1, len(quality))  # noqa: E731, B023
        exact = all(equal_multisets(repo.checkout(v, ordered=False), df) for v, df in enumerate(chain, 1))
        size = store.bytes() - sum(store.files.size(store.version_path(v, "provenance")) for v in repo.versions)
        out.append(
            {"system": name, "bytes": size, "full_copies": full, "saved_pct": 100 * (1 - size / full), "vs_naive": size / full, "recall": mean("recall"),
             "recall_edited": mean("recall_edited"), "precision": mean("precision"), "exact": exact, "seconds": took}
        )
    return out


def rows_by_id(repo: Repository, ids: list[str], version: int | None = None) -> tuple[DataFrame, list[str]]:
    """The rows with the given row ids, in their order, and the ids that are not there."""
    asked = repo.spark.createDataFrame([(k, i) for k, i in enumerate(ids)], f"__nth int, {RID} string")
    found = repo.frame(version).join(asked, RID)
    there = {r[RID] for r in found.select(RID).collect()}
    return found.orderBy("__nth").drop("__nth"), [i for i in ids if i not in there]
