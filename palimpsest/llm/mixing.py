"""Mixing sources to target weights by hierarchical budgeting.

Weights. A tree of domain, language and source; each node has a weight among its siblings (`Target.weight`). The token
budget is split from the root down. A child that cannot use its share, because its subtree holds too few tokens even
over `epochs` passes, leaves the shortage to its siblings in proportion to their weights; only what no sibling can take
reaches the level above. This happens on the driver over one row for each leaf (at most MAX_LEAVES).

Selection. In every epoch the documents of a leaf have a seeded order, a hash of seed, epoch, id and text. A leaf's budget
takes so many whole epochs, then the longest prefix of the next epoch that still fits. The end of that prefix is found
in two steps, sums over hash ranges of about BUCKET rows and then exact running sums within one range, so no task holds
a leaf. What remains is one comparison for each document with its leaf's cut-off: texts are never shuffled.

Unit. `tokens` is the caller's count of each document's tokens, for example separators.with_counts; null or less than 0 counts
as 0. Without it words between white space are counted, of which a text without spaces has about one a line.

Defined results. A document without tokens, such as null text, costs nothing; it is selected where its place in the order
falls into what is selected. Null labels form a leaf of their own
(NONE). Rows equal in id and text share a place in the order and are taken or left together. A leaf without tokens takes
nothing. Unknown nodes have weight 1; weight 0 excludes. An empty table gives an empty result. `mix`
gives the columns of its input, whatever their names; `selection` gives its own. More than MAX_LEAVES leaves raise an error.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.quality import words_of
from palimpsest.llm.work import spare, stage

NONE = "(none)"
BUCKET = 5_000
MAX_LEAVES = 100_000
LEVELS = ("domain", "language", "source")


class Target(NamedTuple):
    """weights: path of labels from the root -> weight among siblings; share: budget as a part of all tokens."""

    weights: Mapping[tuple[str, ...], float]
    share: float = 0.5
    epochs: int = 3
    seed: int = 17


def fill(budget: float, nodes: Sequence[tuple[float, float]]) -> list[float]:
    """Split a budget over (weight, capacity): in proportion to weight, shortages going to the others."""
    out = [0.0] * len(nodes)
    open_ = [k for k, (w, c) in enumerate(nodes) if w > 0 and c > 0]
    left = min(budget, sum(nodes[k][1] for k in open_))
    while open_:
        total = sum(nodes[k][0] for k in open_)
        full = [k for k in open_ if nodes[k][1] <= left * nodes[k][0] / total]
        if not full:
            for k in open_:
                out[k] = left * nodes[k][0] / total
            break
        for k in full:
            out[k] = nodes[k][1]
        left = max(0.0, left - sum(nodes[k][1] for k in full))
        open_ = [k for k in open_ if k not in set(full)]
    return out


def budgets(tokens: Mapping[tuple[str, ...], int], target: Target) -> dict[tuple[str, ...], int]:
    """Whole tokens for each leaf."""
    depth = len(next(iter(tokens), ()))
    room: dict[tuple[str, ...], float] = {}

    def weight(path: tuple[str, ...]) -> float:
        return float(target.weights.get(path, 1.0))

    usable = {p: all(weight(p[:k]) > 0 for k in range(1, depth + 1)) for p in tokens}
    for path, n in tokens.items():
        for k in range(depth + 1):
            room[path[:k]] = room.get(path[:k], 0) + n * target.epochs * usable[path]
    children: dict[tuple[str, ...], list[tuple[str, ...]]] = {}
    for path in sorted(room):
        if path:
            children.setdefault(path[:-1], []).append(path)
    given = {(): target.share * sum(tokens.values())}
    for path in sorted(room, key=len):
        below = children.get(path, [])
        for child, part in zip(below, fill(given[path], [(weight(c), room[c]) for c in below]), strict=True):
            given[child] = part
    return {p: int(given[p] + 1e-6) for p in tokens}


def _order(seed: int, epoch: Column, place: Column) -> Column:
    """Place of a document in its leaf's epoch: 63 hashed bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), epoch, place), 1)


class Plan(NamedTuple):
    cuts: DataFrame  # leaf columns, whole (epochs) and cut (last place taken in the next, or null)
    slim: DataFrame  # leaf columns, doc_id, place, tokens: staged


def _leaf(docs: DataFrame, levels: Sequence[Column], prefix: str = "__") -> list[Column]:
    return [F.coalesce(c.cast("string"), F.lit(NONE)).alias(f"{prefix}{name}") for name, c in zip(LEVELS, levels, strict=True)]


def _place(doc_id: str, text: str) -> Column:
    return F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{text}`"))


def plan(docs: DataFrame, target: Target, levels: Sequence[Column], doc_id: str = "doc_id", text: str = "text", tokens: Column | None = None) -> Plan:
    spark = docs.sparkSession
    keys = [f"__{name}" for name in LEVELS]
    tokens = F.size(words_of(F.col(f"`{text}`"))) if tokens is None else F.greatest(F.coalesce(tokens, F.lit(0)), F.lit(0))
    tokens = tokens.cast("long")
    slim = docs.select(*_leaf(docs, levels), F.col(f"`{doc_id}`").alias("doc_id"), _place(doc_id, text).alias("place"), tokens.alias("tokens"))
    slim = stage(slim, "mix-slim")
    totals = slim.groupBy(*keys).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows")).limit(MAX_LEAVES + 1).collect()
    if len(totals) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} leaves: map rare sources to a common name")
    have = {tuple(r[k] for k in keys): r["tokens"] for r in totals}
    given = budgets(have, target)
    rows = []
    for r in totals:
        path = tuple(r[k] for k in keys)
        n, b = have[path], given[path]
        whole = min(target.epochs, b // n) if n else 0
        rest = b - whole * n if n and whole < target.epochs else 0
        rows.append((*path, whole, rest, max(1, -(-r["rows"] // BUCKET))))
    schema = ", ".join(f"{k} string" for k in keys) + ", whole int, rest long, buckets int"
    leaves = F.broadcast(spark.createDataFrame(rows, schema))  # at most MAX_LEAVES rows

    part = slim.join(leaves.filter("rest > 0"), keys).withColumn("at", _order(target.seed, F.col("whole"), F.col("place")))
    bucket = F.least(F.floor(F.col("at") / float(1 << 63) * F.col("buckets")), F.col("buckets") - 1).cast("int")
    # Rows that share a place are summed first: a document repeated in a third of all rows is one row from here.
    part = part.withColumn("bucket", bucket).groupBy(*keys, "bucket", "at").agg(F.sum("tokens").alias("tokens"), F.first("rest").alias("rest"), F.first("buckets").alias("buckets"))
    sums = part.groupBy(*keys, "bucket").agg(F.sum("tokens").alias("n"), F.first("rest").alias("rest"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # The range in which the budget ends: the first whose running sum exceeds it. There is at most one for each leaf.
    edge = sums.withColumn("before", before).filter((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("n") > F.col("rest")))
    edge = stage(edge.select(*keys, "bucket", (F.col("rest") - F.col("before")).alias("room")), "mix-edge")
    inside = part.drop("rest").join(F.broadcast(edge), [*keys, "bucket"])
    upto = F.sum("tokens").over(Window.partitionBy(*keys).orderBy("at").rangeBetween(Window.unboundedPreceding, 0))
    fits = inside.withColumn("upto", upto).filter(F.col("upto") <= F.col("room")).groupBy(*keys).agg(F.max("at").alias("cut"))
    # Without a document that fits, the prefix ends where the range begins.
    begin = F.ceil(F.col("bucket") * (float(1 << 63) / F.col("buckets"))).cast("long") - 1
    ends = edge.join(leaves.select(*keys, "buckets"), keys).select(*keys, begin.alias("begin")).join(fits, keys, "left")
    ends = ends.select(*keys, F.coalesce("cut", "begin").alias("cut"))
    cuts = leaves.select(*keys, "whole").join(ends, keys, "left")
    return Plan(stage(cuts.coalesce(1), "mix-cuts"), slim)


def _taken(rows: DataFrame, target: Target, place: Column, p: str = "") -> DataFrame:
    """rows once for each epoch that selects them (column epoch, from 0). p: how the working columns begin."""
    whole = F.col(f"{p}whole")
    more = F.coalesce(_order(target.seed, whole, place) <= F.col(f"{p}cut"), F.lit(False)).cast("int")
    return rows.withColumn(f"{p}many", whole + more).filter(F.col(f"{p}many") > 0).withColumn(f"{p}epoch", F.explode(F.sequence(F.lit(0), F.col(f"{p}many") - 1)))


def selection(docs: DataFrame, target: Target, levels: Sequence[Column], doc_id: str = "doc_id", text: str = "text", tokens: Column | None = None) -> DataFrame:
    """(doc_id, domain, language, source, tokens, epoch) of everything selected."""
    made = plan(docs, target, levels, doc_id, text, tokens)
    keys = [f"__{name}" for name in LEVELS]
    out = _taken(made.slim.join(F.broadcast(made.cuts), keys), target, F.col("place"))
    return out.select("doc_id", *[F.col(f"__{n}").alias(n) for n in LEVELS], "tokens", "epoch")


def mix(docs: DataFrame, target: Target, levels: Sequence[Column], doc_id: str = "doc_id", text: str = "text", made: Plan | None = None) -> DataFrame:
    """The documents themselves, with all their columns, once for each epoch that selects them. made: a plan for the same documents."""
    made = made or plan(docs, target, levels, doc_id, text)
    p = spare(docs.columns)  # working columns cannot be taken for the user's
    cuts = made.cuts.select(*[F.col(f"__{n}").alias(f"{p}{n}") for n in LEVELS], F.col("whole").alias(f"{p}whole"), F.col("cut").alias(f"{p}cut"))
    rows = docs.select("*", *_leaf(docs, levels, p)).join(F.broadcast(cuts), [f"{p}{n}" for n in LEVELS])
    return _taken(rows, target, _place(doc_id, text), p).select(*[F.col(f"`{c}`") for c in docs.columns])
