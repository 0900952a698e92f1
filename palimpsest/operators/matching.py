"""Record linkage of two versions of a table without a key.

First an exact multiset join on canonical content: the k-th of equal new rows meets the k-th of equal parent rows.
A sketch finds contents so frequent that they would crowd a task; their numbers are given in salted groups, whose sizes
are summed first. What is left is compared inside blocks: cells are scored by kind, a row by their mean, and pairs
are taken best first, one to one, from the threshold upwards; a hash of the pair decides between equal scores. A block of
any size is compared in full: the rows of a large one that differ in numbers alone are linked first, as no other pair can
score higher; the rest is cut into tiles of bounded size, every row keeps its best candidates, and rows that are each
other's best are linked round by round. That gives the same links as one sorted list of all pairs would.
A wrong pair costs storage, never a wrong version.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.canon import NULL_TOKEN, CanonConfig, content_key, token
from palimpsest.functions.similarity import SimConfig, string_ratios
from palimpsest.plans.schema import RID, is_numeric, quoted

ORD = "__ord__"
SALTS = 32
BIN_ROWS = 4_000
#: Rows on the longer side of a tile at most, and candidates that a row keeps of each tile.
MAX_SIDE = 100_000
DEPTH = 8
#: About so many pairs of small tiles are scored at a time.
PAIRS = 1 << 20
#: A content of fewer rows is never hot; items that the sketch of frequent contents tracks.
HOT_ROWS = 50_000
SKETCH = 16_384
MATCH_SCHEMA = f"{ORD} long, {RID} string, method string, confidence double"
Keep = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class MatchResult:
    """matches: one row for each matched new row (its ordinal, the parent's row id, method, confidence)."""

    matches: DataFrame

    def counts(self) -> dict[str, int]:
        got = {r["method"]: r["count"] for r in self.matches.groupBy("method").count().collect()}
        return {"exact": got.get("exact", 0), "fuzzy": got.get("fuzzy", 0)}


def numbered(df: DataFrame, key: str, unique: Column) -> DataFrame:
    """df with `nth`, numbering the rows of each key from 1; unique must tell all rows apart."""
    df = df.withColumn("__u", unique).withColumn("__salt", F.pmod(F.xxhash64("__u"), F.lit(SALTS)))
    sizes = df.groupBy(key, "__salt").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(key).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(key, "__salt", F.coalesce(before, F.lit(0)).alias("__before"))
    nth = F.row_number().over(Window.partitionBy(key, "__salt").orderBy("__u"))
    out = df.withColumn("__in", nth).join(sizes, [key, "__salt"])
    return out.withColumn("nth", F.col("__in") + F.col("__before")).drop("__u", "__salt", "__in", "__before")


def hot_keys(rows: DataFrame) -> DataFrame | None:
    """(ka) of contents that hold a thousandth of rows and HOT_ROWS at least; None if there are none.

    A sketch of bounded size finds them in one pass without a shuffle; it overlooks no content that is so frequent.
    """
    found = rows.agg(F.expr(f"approx_top_k(ka, 2000, {SKETCH})").alias("top"), F.count("*").alias("n")).first()
    hot = [(r["item"],) for r in found["top"] or [] if r["count"] >= max(HOT_ROWS, found["n"] / 1000)]
    return rows.sparkSession.createDataFrame(hot, "ka long") if hot else None


def exact_join(new: DataFrame, parent: DataFrame, columns: list[str], canon: CanonConfig, how: str = "full_outer") -> DataFrame:
    """(__ord__, __rid__) of the multiset join; a row of either side that has no partner stands alone.

    The rows of both sides meet in one shuffle by content, where they are numbered and paired. Contents so frequent that
    they would crowd a task are numbered in salted groups instead.
    """
    side = lambda df, o, r: df.select(content_key(df, columns, canon).alias("k"), o.alias(ORD), r.alias(RID)).select("k.a", "k.b", ORD, RID).toDF("ka", "kb", ORD, RID)
    a = side(new, F.col(ORD), F.lit(None).cast("string"))
    b = side(parent, F.lit(None).cast("long"), F.col(RID))
    hot = hot_keys(a.unionByName(b))
    cold = lambda df: df if hot is None else df.join(F.broadcast(hot), "ka", "left_anti")
    both = cold(a.unionByName(b))
    nth = F.row_number().over(Window.partitionBy("ka", "kb", F.col(RID).isNull()).orderBy(ORD, RID))
    pairs = both.withColumn("nth", nth).groupBy("ka", "kb", "nth").agg(F.max(ORD).alias(ORD), F.max(RID).alias(RID)).select(ORD, RID)
    if how == "inner":
        pairs = pairs.filter(F.col(ORD).isNotNull() & F.col(RID).isNotNull())
    if hot is None:
        return pairs
    few = lambda df, c: numbered(df.join(F.broadcast(hot), "ka", "left_semi").select(F.struct("ka", "kb").alias("k"), c), "k", F.col(c))
    return pairs.unionByName(few(a, ORD).join(few(b, RID), ["k", "nth"], how).select(ORD, RID))


def exact_pairs(new: DataFrame, parent: DataFrame, columns: list[str], canon: CanonConfig) -> DataFrame:
    """(__ord__, __rid__) of the pairs alone."""
    return exact_join(new, parent, columns, canon, "inner")


def column_scales(new: DataFrame, parent: DataFrame, columns: list[str]) -> dict[str, float]:
    """Spread of each numeric column over both versions: standard deviation, else range, else 1."""
    names = [c for c in columns if is_numeric(new.schema[c].dataType) and is_numeric(parent.schema[c].dataType)]
    if not names:
        return {}
    clean = lambda c: F.nanvl(quoted(c).cast("double"), F.lit(None))
    both = new.select(*[clean(c).alias(f"c{k}") for k, c in enumerate(names)]).unionByName(parent.select(*[clean(c).alias(f"c{k}") for k, c in enumerate(names)]))
    aggs = [x for k in range(len(names)) for x in (F.stddev_samp(f"c{k}").alias(f"s{k}"), (F.max(f"c{k}") - F.min(f"c{k}")).alias(f"r{k}"))]
    row = both.agg(*aggs).first()
    good = lambda v: v is not None and np.isfinite(v) and v > 0
    return {c: next((v for v in (row[f"s{k}"], row[f"r{k}"]) if good(v)), 1.0) for k, c in enumerate(names)}


def cell_arrays(df: pd.DataFrame, kinds: list[float | None]) -> list[np.ndarray]:
    """Columns c0, c1, ... as arrays: numbers with NaN for null, text with None."""
    text = lambda c: c.astype(object).where(c.notna(), None).to_numpy(dtype=object)
    return [df[f"c{k}"].to_numpy(dtype=float) if s is not None else text(df[f"c{k}"]) for k, s in enumerate(kinds)]


def coded(values: np.ndarray) -> tuple[np.ndarray, list[str | None]]:
    """A code for each text and the texts by code. pandas' own codes end a text at its first NUL."""
    codes: dict[str | None, int] = {}
    return np.fromiter((codes.setdefault(v, len(codes)) for v in values), dtype=np.int64, count=len(values)), list(codes)


def pair_similarities(new: list[np.ndarray], old: list[np.ndarray], rows: np.ndarray, cols: np.ndarray, kinds: list[float | None], cfg: SimConfig) -> np.ndarray:
    """Mean cell similarity of the pairs (rows, cols). kinds: the scale of a numeric column, or None for text.

    The sum runs in the order of the columns, so a pair scores the same in any company. Ratios of two long texts are
    found only for pairs that can still reach the threshold with them; others come out below it.
    """
    parts: list[np.ndarray] = []
    soft: list[tuple[int, np.ndarray, np.ndarray, list[str]]] = []
    for k, (a, b, scale) in enumerate(zip(new, old, kinds, strict=True)):
        if scale is not None:
            x, y = a[rows], b[cols]
            with np.errstate(invalid="ignore"):
                gap = np.abs(x - y)
                sim = np.where(gap <= cfg.num_rel_tol * scale, 1.0, np.maximum(0.0, 1.0 - gap / scale))
            none_a, none_b = np.isnan(x), np.isnan(y)
            parts.append(np.where(none_a & none_b, 1.0, np.where(none_a | none_b, 0.0, np.nan_to_num(sim))))
            continue
        code, texts = coded(np.concatenate([a, b]))
        x, y = code[: len(a)][rows], code[len(a) :][cols]
        parts.append((x == y).astype(float))
        if cfg.string_soft:
            soft.append((k, x, y, texts))
    open_ = {k for k, *_ in soft}  # texts not yet compared, which may still give 1
    for k, x, y, texts in sorted(soft, key=lambda s: max((len(t or "") for t in s[3]), default=0)):
        open_.discard(k)
        null = texts.index(None) if None in texts else -1
        texts = [t or "" for t in texts]
        at = np.flatnonzero((x != y) & (x != null) & (y != null))
        which, back = np.unique(x[at] * len(texts) + y[at], return_inverse=True)
        need = None
        if sum(len(t) > 64 for t in texts) > 1:
            others = sum((np.ones(len(at)) if j in open_ else p[at] for j, p in enumerate(parts) if j != k), np.zeros(len(at)))
            need = np.full(len(which), np.inf)
            np.minimum.at(need, back, cfg.row_threshold * len(kinds) - 1e-9 - others)
        parts[k][at] = string_ratios(texts, texts, which // len(texts), which % len(texts), need)[back]
    total = np.zeros(len(rows))
    for p in parts:
        total += p
    return total / max(1, len(kinds))


def similarity_matrix(new: list[np.ndarray], old: list[np.ndarray], kinds: list[float | None], cfg: SimConfig) -> np.ndarray:
    """`pair_similarities` of all pairs."""
    rows, cols = np.divmod(np.arange(len(new[0]) * len(old[0])), max(1, len(old[0])))
    return pair_similarities(new, old, rows, cols, kinds, cfg).reshape(len(new[0]), len(old[0]))


def ties(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair (a[k], b[k]) of row hashes that decides between equal scores: 63 mixed bits."""
    with np.errstate(over="ignore"):
        x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ b.astype(np.uint64)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(1)).astype(np.int64)


def ranked(rows: np.ndarray, cols: np.ndarray, score: np.ndarray, threshold: float, new_hash: np.ndarray, old_hash: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score, tie) of the pairs from the threshold upwards, best first."""
    at = np.flatnonzero(score >= threshold)
    rows, cols, score = rows[at], cols[at], score[at]
    tie = ties(new_hash[rows], old_hash[cols])
    order = np.lexsort((tie, score))[::-1]
    return rows[order], cols[order], score[order], tie[order]


def greedy(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Positions of the pairs, given best first, that are taken when each row and column is used once.

    Pairs that are the first of both their row and their column are taken together; that is what taking the best pair
    again and again comes to.
    """
    out, live = [], np.arange(len(rows))
    first_r, first_c = np.zeros(rows.max(initial=-1) + 1, dtype=np.int64), np.zeros(cols.max(initial=-1) + 1, dtype=np.int64)
    free_r, free_c = np.ones(len(first_r), dtype=bool), np.ones(len(first_c), dtype=bool)
    while len(live):
        first_r[rows[live][::-1]] = live[::-1]  # of several the last written counts, which is the best
        first_c[cols[live][::-1]] = live[::-1]
        now = live[(first_r[rows[live]] == live) & (first_c[cols[live]] == live)]
        out.append(now)
        free_r[rows[now]] = False
        free_c[cols[now]] = False
        live = live[free_r[rows[live]] & free_c[cols[live]]]
    return np.sort(np.concatenate(out)) if out else live


def nth_of(keys: np.ndarray) -> np.ndarray:
    """For each place the number of equal keys before it."""
    order = np.argsort(keys, kind="stable")
    sorted_ = keys[order]
    begin = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(keys) else np.zeros(0, dtype=int)
    out = np.empty(len(keys), dtype=np.int64)
    out[order] = np.arange(len(keys)) - np.repeat(begin, np.diff(np.r_[begin, len(keys)]))
    return out


def tile_pairs(x: pd.DataFrame, y: pd.DataFrame, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, column) of all pairs of rows with equal keys; several small tiles together, up to about `most` pairs."""
    tile = pd.concat([x, y]).groupby(list(x.columns)).ngroup().to_numpy() if len(x) and len(y) else np.zeros(0, dtype=np.int64)
    tile_x, tile_y = tile[: len(x)], tile[len(x) :]
    count_x, count_y = (np.bincount(t, minlength=tile.max(initial=-1) + 1) for t in (tile_x, tile_y))
    by_x, by_y = np.argsort(tile_x, kind="stable"), np.argsort(tile_y, kind="stable")
    start_x, start_y = (np.cumsum(c) - c for c in (count_x, count_y))
    upto = np.cumsum(count_x * count_y)
    at = 0
    while at < len(upto):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, side="right")))
        mine = by_x[start_x[at] : start_x[end - 1] + count_x[end - 1]]
        many = count_y[tile_x[mine]]
        if many.sum():
            step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            yield np.repeat(mine, many), by_y[np.repeat(start_y[tile_x[mine]], many) + step]
        at = end


# Kinds of rows that a tile gives: a link; a candidate of the new row's list, of the parent row's, of both; the last entry
# of a list that was cut.
LINK, OF_NEW, OF_OLD, OF_BOTH, END_NEW, END_OLD = range(6)
TILE_SCHEMA = f"kind int, {ORD} long, {RID} string, score double, tie long"


def cells(df: DataFrame, unique: str, columns: list[str], blocks: list[str], scales: dict[str, float], canon: CanonConfig) -> DataFrame:
    """What comparing needs of a row: block, hash, and its cells as numbers or texts."""
    block = content_key(df, blocks, canon)
    plain = CanonConfig(None, False, False)
    cell = lambda c: quoted(c).cast("double") if c in scales else F.nullif(token(quoted(c), df.schema[c].dataType, plain), F.lit(NULL_TOKEN))
    return df.select(unique, block["a"].alias("ba"), block["b"].alias("bb"), F.xxhash64(F.lit(3), F.col(unique)).alias("h"), *[cell(c).alias(f"c{k}") for k, c in enumerate(columns)])


def tile_plan(left: DataFrame, right: DataFrame, max_pairs: int) -> DataFrame:
    """(ba, bb, n, m, ta, tb) of every block that has rows on both sides: its sizes and into how many parts each side is cut.

    Tiles hold about max_pairs pairs; a side that is short stays whole, and the other is cut into longer parts.
    """
    n = left.groupBy("ba", "bb").agg(F.count("*").alias("n"))
    m = right.groupBy("ba", "bb").agg(F.count("*").alias("m"))
    side = max(1, int(max_pairs**0.5))
    rows = lambda other: F.least(F.lit(max(side, MAX_SIDE)), F.greatest(F.lit(side), F.floor(F.lit(max_pairs) / F.col(other))))
    cut = lambda own, other: F.when(F.col("n") * F.col("m") <= max_pairs, 1).otherwise(F.ceil(F.col(own) / rows(other))).cast("int")
    return n.join(m, ["ba", "bb"]).withColumns({"ta": cut("n", "m"), "tb": cut("m", "n")})


def score_tiles(left: DataFrame, right: DataFrame, plan: DataFrame, kinds: list[float | None], sim: SimConfig, bins: int) -> DataFrame:
    """Compare the two sides of all blocks, tile by tile (TILE_SCHEMA).

    A block of one tile is settled there: links. Of a larger block each row's DEPTH best candidates in each tile come out.
    Tiles are dealt into bins, so that a call from Spark into Python serves many small ones.
    """
    part = F.pmod(F.col("h"), F.col("ta")).cast("int"), F.pmod(F.col("h"), F.col("tb")).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    bin_ = F.pmod(F.xxhash64("ba", "bb", "pa", "pb"), F.lit(bins)).alias("bin")
    split = (F.col("ta") * F.col("tb") > 1).alias("split")
    a = left.join(plan, ["ba", "bb"]).withColumn("pa", part[0]).withColumn("pb", every("tb")).select("*", split, bin_).drop("n", "m", "ta", "tb")
    b = right.join(plan, ["ba", "bb"]).withColumn("pb", part[1]).withColumn("pa", every("ta")).select("*", bin_).drop("n", "m", "ta", "tb")
    key = ["ba", "bb", "pa", "pb"]

    def pair(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        """All tiles of a bin. Small tiles are compared together, as their rows have no partners elsewhere."""
        ords, parents = x[ORD].to_numpy(), y[RID].to_numpy(dtype=object)
        hash_x, hash_y = x["h"].to_numpy(), y["h"].to_numpy()
        cells_x, cells_y = cell_arrays(x, kinds), cell_arrays(y, kinds)
        out: list[tuple] = []
        split = x["split"].to_numpy()
        for rows, cols in tile_pairs(x[key], y[key], PAIRS):
            (some_x, rows), (some_y, cols) = (np.unique(r, return_inverse=True) for r in (rows, cols))
            score = pair_similarities([c[some_x] for c in cells_x], [c[some_y] for c in cells_y], rows, cols, kinds, sim)
            rows, cols, score, tie = ranked(rows, cols, score, sim.row_threshold, hash_x[some_x], hash_y[some_y])
            cut = split[some_x[rows]]
            whole, at = np.flatnonzero(~cut), np.flatnonzero(cut)
            whole = whole[greedy(rows[whole], cols[whole])]
            nth_r, nth_c = nth_of(rows[at]), nth_of(cols[at])
            for ends, own, nth in ((END_NEW, rows[at], nth_r), (END_OLD, cols[at], nth_c)):
                last = at[(nth == DEPTH - 1) & (np.bincount(own, minlength=1)[own] > DEPTH)]
                none = np.full(len(last), None, dtype=object)
                ids = (ords[some_x[rows[last]]].astype(object), none) if ends == END_NEW else (none, parents[some_y[cols[last]]])
                out.append((np.full(len(last), ends), *ids, score[last], tie[last]))
            kind = OF_NEW * (nth_r < DEPTH) + OF_OLD * (nth_c < DEPTH)
            for kind, at in ((np.full(len(whole), LINK), whole), (kind[kind > 0], at[kind > 0])):
                out.append((kind, ords[some_x[rows[at]]].astype(object), parents[some_y[cols[at]]], score[at], tie[at]))
        cols_ = [np.concatenate([o[k] for o in out]) if out else [] for k in range(5)]
        types = ("int32", "Int64", object, "float64", "int64")
        return pd.DataFrame({c: pd.Series(v, dtype=t) for c, v, t in zip(("kind", ORD, RID, "score", "tie"), cols_, types, strict=True)})

    return a.groupBy("bin").cogroup(b.groupBy("bin")).applyInPandas(pair, TILE_SCHEMA)


def settle(found: DataFrame, keep: Keep) -> tuple[list[DataFrame], DataFrame | None, DataFrame | None]:
    """Links among the candidates of split blocks: (links, and the ids of both sides that must be compared again, or None).

    What a row's lists of all tiles hold down to the best of their cut ends is a true beginning of its order. Two rows that
    are each other's best there are linked and leave; so until no such pair is left. A row whose list was cut and is used
    up may still find a partner in another round of tiles.
    """
    key = F.struct("score", "tie")
    ends = lambda kind, c: found.filter(F.col("kind") == kind).groupBy(c).agg(F.max(key).alias(f"end_{c}"))
    end_new, end_old = keep(ends(END_NEW, ORD)), keep(ends(END_OLD, RID))
    pairs = found.filter(F.col("kind").isin(OF_NEW, OF_OLD, OF_BOTH)).join(end_new, ORD, "left").join(end_old, RID, "left")
    inside = lambda kind, c: F.col("kind").isin(kind, OF_BOTH) & F.coalesce(key >= F.col(f"end_{c}"), F.lit(True))
    pairs = keep(pairs.select(ORD, RID, "score", "tie", inside(OF_NEW, ORD).alias("of_new"), inside(OF_OLD, RID).alias("of_old")).filter("of_new or of_old"))
    links: list[DataFrame] = []
    while True:
        best = lambda own, other, flag: pairs.filter(flag).groupBy(own).agg(F.max(F.struct("score", "tie", other)).alias("best")).select(own, "best.*")  # noqa: E731, B023
        now = keep(best(ORD, RID, "of_new").join(best(RID, ORD, "of_old").select(ORD, RID), [ORD, RID]).select(ORD, RID, "score"))
        if now.isEmpty():
            break
        links.append(now)
        pairs = keep(pairs.join(now.select(ORD), ORD, "left_anti").join(now.select(RID), RID, "left_anti"))
    again = []
    for c, cut in ((ORD, end_new), (RID, end_old)):
        for one in links:
            cut = cut.join(one.select(c), c, "left_anti")
        again.append(keep(cut.select(c).unionByName(pairs.select(c)).distinct()))
    if any(x.isEmpty() for x in again):
        return links, None, None
    return links, again[0], again[1]


def alike(df: DataFrame, texts: list[int]) -> DataFrame:
    """Cells whose blocks are parted further by all their texts, of which null is one."""
    parts = [x for k in texts for x in (F.col(f"c{k}"), F.isnull(f"c{k}"))]
    return df.withColumns({"ba": F.xxhash64(F.lit(1), "ba", "bb", *parts), "bb": F.xxhash64(F.lit(2), "ba", "bb", *parts)})


def sure_score(left: DataFrame, right: DataFrame, kinds: list[float | None], texts: list[int], sim: SimConfig) -> float:
    """A score that no pair reaches unless all its texts are equal.

    Unequal texts of m characters at most have a ratio of 1 - 1 / (2 m - 1) at most, or 0 where texts are compared for
    equality alone. The doubled room leaves that bound clear of rounding.
    """
    room = 1.0
    if sim.string_soft:
        most = F.greatest(*[F.max(F.octet_length(f"c{k}")) for k in texts], F.lit(1))
        room = 1.0 / (2 * max(df.agg(most.alias("m")).first()["m"] for df in (left, right)))
    return 1.0 - room / (2 * len(kinds))


def block_pairs(left: DataFrame, right: DataFrame, plan: DataFrame, kinds: list[float | None], sim: SimConfig, max_pairs: int, keep: Keep) -> list[DataFrame]:
    """Frames of (__ord__, __rid__, score) with the links inside blocks. plan: the stored `tile_plan` of both sides."""
    links: list[DataFrame] = []
    while True:
        size = plan.agg(F.sum(F.col("n") * F.col("tb") + F.col("m") * F.col("ta")).alias("rows"), F.max(F.col("ta") * F.col("tb")).alias("tiles")).first()
        if size["rows"] is None:
            return links
        found = keep(score_tiles(left, right, plan, kinds, sim, 8 + size["rows"] // BIN_ROWS))
        links.append(found.filter(F.col("kind") == LINK).select(ORD, RID, "score"))
        if size["tiles"] == 1:
            return links
        more, again_left, again_right = settle(found, keep)
        links += more
        if again_left is None or again_right is None:
            return links
        left, right = keep(left.join(again_left, ORD, "left_semi")), keep(right.join(again_right, RID, "left_semi"))
        plan = keep(tile_plan(left, right, max_pairs))


def fuzzy_pairs(left: DataFrame, right: DataFrame, kinds: list[float | None], sim: SimConfig, max_pairs: int, keep: Keep) -> DataFrame | None:
    """(__ord__, __rid__, confidence) of similar rows inside blocks, best first, one to one; None if no block has both sides.

    left, right: stored frames of `cells`. Every pair that could be a link is compared whatever the block's size; max_pairs
    is the size of a tile. The best scores need equal texts, so large blocks are first parted by their texts and linked
    from such a score upwards, which is how one sorted list would begin; what is left is then compared with all the rest.
    """
    count = lambda plan: plan.agg(F.sum(F.col("n").cast("double") * F.col("m"))).first()[0]
    links: list[DataFrame] = []
    plan = keep(tile_plan(left, right, max_pairs))
    pairs = count(plan)
    if pairs is None:
        return None
    texts = [k for k, scale in enumerate(kinds) if scale is None]
    if texts and pairs > max_pairs:
        parted = [alike(df, texts) for df in (left, right)]
        fine = keep(tile_plan(*parted, max_pairs))
        if (count(fine) or 0) <= pairs / 4:  # else it saves little
            sure = sure_score(left, right, kinds, texts, sim)
            links = block_pairs(*parted, fine, kinds, replace(sim, row_threshold=max(sure, sim.row_threshold)), max_pairs, keep)
            if sim.row_threshold >= sure:
                plan = None
            elif links:
                done = reduce(DataFrame.unionByName, links)
                left, right = keep(left.join(done.select(ORD), ORD, "left_anti")), keep(right.join(done.select(RID), RID, "left_anti"))
                plan = keep(tile_plan(left, right, max_pairs))
    if plan is not None:
        links += block_pairs(left, right, plan, kinds, sim, max_pairs, keep)
    return reduce(DataFrame.unionByName, links).withColumnRenamed("score", "confidence") if links else None


def match_versions(
    new: DataFrame,
    parent: DataFrame,
    *,
    compare_on: list[str] | None = None,
    block_on: list[str] | None = None,
    exact_only: bool = False,
    canon: CanonConfig = CanonConfig(),
    sim: SimConfig = SimConfig(),
    max_block_pairs: int = 2_000_000,
    keep: Keep = lambda df: df,
) -> MatchResult:
    """Match new (with unique __ord__) to parent (with __rid__). keep stores an intermediate frame and returns it."""
    there = [c for c in new.columns if c != ORD]
    common = [c for c in there if c in parent.columns]
    columns = [c for c in (compare_on or common) if c in common]
    if not columns:
        return MatchResult(new.sparkSession.createDataFrame([], MATCH_SCHEMA))
    joined = keep(exact_join(new, parent, columns, canon, "inner" if exact_only else "full_outer"))
    exact = joined.filter(F.col(ORD).isNotNull() & F.col(RID).isNotNull()).select(ORD, RID, F.lit("exact").alias("method"), F.lit(1.0).alias("confidence"))
    if exact_only:
        return MatchResult(exact)
    alone = joined.agg(F.count_if(F.col(RID).isNull()).alias("new"), F.count_if(F.col(ORD).isNull()).alias("old")).first()
    if not alone["new"] or not alone["old"]:
        return MatchResult(exact)
    blocks = [c for c in (block_on or []) if c in columns]
    scales = column_scales(new, parent, columns)
    left = new.join(joined.filter(F.col(RID).isNull()).select(ORD), ORD, "left_semi")
    right = parent.join(joined.filter(F.col(ORD).isNull()).select(RID), RID, "left_semi")
    left, right = keep(cells(left, ORD, columns, blocks, scales, canon)), keep(cells(right, RID, columns, blocks, scales, canon))
    fuzzy = fuzzy_pairs(left, right, [scales.get(c) for c in columns], sim, max_block_pairs, keep)
    if fuzzy is None:
        return MatchResult(exact)
    return MatchResult(exact.unionByName(fuzzy.select(ORD, RID, F.lit("fuzzy").alias("method"), "confidence")))
