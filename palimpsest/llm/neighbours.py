"""Approximate nearest neighbours: inverted file, product-quantised residuals, exact reranking.

Index. Equal vectors become one row with the smallest vec_ids that could ever be reported. Coarse centroids and
codebooks are fitted on a bounded sample (SAMPLE_BYTES of vectors, chosen by hash); every vector is then assigned to
its nearest centroid and its residual is encoded. There are about as many cells as the root of the number of vectors: beyond
MAX_COARSE centroids, which is what the sample can tell apart, each is divided further by a second set of centroids for the
residuals, shared by all. Cells that are near to each other are packed into shards of bounded length, and a crowded cell is
spread over many, so no task holds a cell.

Search. A query visits the cells nearest to it; how many is calibrated on the sample so that TARGET of the true neighbours
lie in them, whatever the table's size. A task holds a shard, sorted by cell, while queries stream by in blocks. An asymmetric
distance table gives each candidate a score by look-ups alone; the best RERANK are scored again as exact cosines, in double
precision, on the original vectors. So is every other candidate that could still be among the k best: a look-up score is off
by at most the length of what the codes leave of the row, which is known, and the part of that length which sample queries
need (`slack`, with a margin) is allowed for. So near-copies that the codes cannot tell apart are all scored exactly. The
results of a query's shards are merged by rank. With exact=True all cells are visited and the full length is allowed for:
then the answer is exact for any input.

Defined results. Vectors that are null, empty, zero, hold null or non-finite components, or have not the most usual
length of the sample take no part, nor do rows without vec_id. Rows repeated with one vec_id and vector count once.
Ties go to the smaller vec_id. Fewer candidates than k give fewer rows. Empty tables give empty results. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.work import small_batches, stage

SAMPLE_BYTES = 8_000_000
SUB_DIM = 4
CODES = 256
MAX_COARSE = 1024
TARGET = 0.97
RERANK = 96
MARGIN, LEAST_SLACK = 1.25, 0.3
ROUNDING = 1e-5  # of look-up scores, in single precision
SHARD_LOW, SHARD_HIGH, SHARDS = 512, 16384, 64
BLOCK = 256  # queries at a time
PAIRS = 1 << 16  # exact scores at a time
ROUNDS = 12


class Codec(NamedTuple):
    coarse: np.ndarray  # (cells, dim), unit length
    fine: np.ndarray  # (parts of each cell, dim), for residuals; one row of zeros if cells are not divided
    books: np.ndarray  # (parts, codes, sub_dim)
    probes: int
    slack: float

    @property
    def dim(self) -> int:
        return self.coarse.shape[1]

    @property
    def cells(self) -> int:
        return len(self.coarse) * len(self.fine)

    def split(self, x: np.ndarray) -> np.ndarray:
        """(n, parts, sub_dim), the last part filled up with zeros."""
        parts, _, sub = self.books.shape
        out = np.zeros((len(x), parts * sub))
        out[:, : x.shape[1]] = x
        return out.reshape(len(x), parts, sub)

    def centre(self, cell: np.ndarray) -> np.ndarray:
        return self.coarse[cell // len(self.fine)] + self.fine[cell % len(self.fine)]

    def assign(self, unit: np.ndarray) -> np.ndarray:
        first = (unit @ self.coarse.T).argmax(axis=1)
        return first * len(self.fine) + _nearest(unit - self.coarse[first], self.fine)

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = self.assign(unit)
        rest = self.split(unit - self.centre(cell))
        code = np.empty((len(unit), len(self.books)), dtype=np.uint8)
        for p, book in enumerate(self.books):
            code[:, p] = _nearest(rest[:, p], book)
        return cell, code

    def left(self, unit: np.ndarray, cell: np.ndarray, code: np.ndarray) -> np.ndarray:
        """What centroid and codewords leave of each row."""
        rest = self.split(unit - self.centre(cell))
        for p, book in enumerate(self.books):
            rest[:, p] -= book[code[:, p]]
        return rest.reshape(len(unit), -1)[:, : self.dim]

    def gaps(self, unit: np.ndarray, cell: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Lengths of that: no look-up score is off by more."""
        return np.linalg.norm(self.left(unit, cell, code), axis=1)

    def order(self, unit: np.ndarray) -> np.ndarray:
        """(n, cells): the cells, nearest first."""
        score = (unit @ self.coarse.T)[:, :, None] + (unit @ self.fine.T)[:, None, :]
        score -= (self.coarse @ self.fine.T) + 0.5 * (self.fine**2).sum(axis=1)
        return np.argsort(-score.reshape(len(unit), self.cells), axis=1, kind="stable")

    def visits(self, unit: np.ndarray, many: np.ndarray, least: int) -> list[np.ndarray]:
        """The cells that each query visits: `probes` of those that have rows (many), more where they hold fewer than least."""
        out = []
        for cells in self.order(unit):
            cells = cells[many[cells] > 0]
            out.append(cells[: max(self.probes, int(np.searchsorted(np.cumsum(many[cells]), least)) + 1)])
        return out

    def tables(self, unit: np.ndarray) -> np.ndarray:
        """Asymmetric tables (parts, codes, n): products of a query's parts with every codeword, and of it with centroids."""
        return np.einsum("nps,pcs->pcn", self.split(unit), self.books).astype(np.float32)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ centres.T - 0.5 * (centres**2).sum(axis=1)).argmax(axis=1)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, sphere: bool = False) -> np.ndarray:
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        at = (x @ centres.T).argmax(axis=1) if sphere else _nearest(x, centres)
        many = np.bincount(at, minlength=len(centres))
        total = np.stack([np.bincount(at, weights=x[:, d], minlength=len(centres)) for d in range(x.shape[1])], axis=1)
        full = many > 0
        centres[full] = total[full] / many[full, None]
        if sphere:
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def fit(sample: np.ndarray, n_rows: int, k: int, seed: int = 5, exact: bool = False) -> Codec:
    """Centroids, codebooks, the number of cells to visit and the slack, from a sample of n_rows distinct vectors."""
    rng = np.random.default_rng(seed)
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    wanted = max(1, round(math.sqrt(n_rows)))
    coarse = _chained(_kmeans(unit, max(1, min(MAX_COARSE, wanted, len(unit) // 8)), rng, sphere=True))
    left = unit - coarse[(unit @ coarse.T).argmax(axis=1)]
    divided = wanted > MAX_COARSE <= len(unit) // 8
    fine = _kmeans(left, min(-(-wanted // MAX_COARSE), len(unit) // 8), rng) if divided else np.zeros((1, unit.shape[1]))
    parts = -(-unit.shape[1] // SUB_DIM)
    draft = Codec(coarse, fine, np.zeros((parts, 1, SUB_DIM)), 1, 1.0)
    at = draft.assign(unit)
    rest = draft.split(unit - draft.centre(at))
    draft = draft._replace(books=np.stack([_kmeans(rest[:, p], min(CODES, len(unit)), rng) for p in range(parts)]))
    if exact:
        return draft._replace(probes=draft.cells)

    # Sample queries against the sample: where their true neighbours lie, and by how much look-up scores miss them.
    asked = rng.permutation(len(unit))[:256]
    product = unit[asked] @ unit.T
    product[np.arange(len(asked)), asked] = -2
    near = np.argsort(-product, axis=1, kind="stable")[:, : min(k, len(unit) - 1)]
    if not near.size:
        return draft
    order = draft.order(unit[asked])
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(draft.cells)[None, :], axis=1)
    needed = np.sort(np.take_along_axis(rank, at[near], axis=1).ravel())
    code = draft.encode(unit)[1]
    gap = draft.gaps(unit, at, code)
    guess = unit - draft.left(unit, at, code)
    rough = np.einsum("qd,qkd->qk", unit[asked], guess[near])
    least = np.take_along_axis(product, near, axis=1).min(axis=1)
    missed = ((least[:, None] - rough) / np.maximum(gap[near], 1e-9))[gap[near] > 1e-6]
    slack = min(1.0, max(LEAST_SLACK, MARGIN * float(np.quantile(missed, 0.99)))) if len(missed) else 1.0
    return draft._replace(probes=int(needed[math.ceil(TARGET * len(needed)) - 1]) + 1, slack=slack)


def _chained(centres: np.ndarray) -> np.ndarray:
    """The centroids in an order in which neighbours are near: each is followed by the nearest that is left."""
    near = centres @ centres.T
    at, out = 0, [0] * bool(len(centres))
    near[:, 0] = -2
    for _ in range(len(centres) - 1):
        at = int(near[at].argmax())
        near[:, at] = -2
        out.append(at)
    return centres[out]


def usable(vector: Column) -> Column:
    """True for vectors that take part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _score(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact cosines of one vector with rows."""
    return np.einsum("ij,j->i", rows, q) / (np.sqrt(np.einsum("ij,ij->i", rows, rows)) * np.sqrt(np.einsum("j,j->", q, q)))


class Shard:
    """The rows of a shard, sorted by cell."""

    def __init__(self, vectors: np.ndarray, ids: list[list[int]], cells: np.ndarray, codes: np.ndarray, codec: Codec):
        order = np.argsort(cells, kind="stable")
        self.codec, self.vectors, self.ids = codec, vectors[order], [ids[i] for i in order.tolist()]
        self.codes = codes[order]
        self.unit = self.vectors / np.linalg.norm(self.vectors, axis=1, keepdims=True)
        self.there, begin = np.unique(cells[order], return_index=True)
        self.begin, self.end = begin, np.append(begin[1:], len(cells))
        self.reach = (codec.slack * codec.gaps(self.unit, cells[order], self.codes) + ROUNDING).astype(np.float32)

    def rough(self, unit: np.ndarray, probe: np.ndarray) -> np.ndarray:
        """(queries, rows) look-up scores; minus infinity outside the cells that a query visits (probe: queries x cells)."""
        tables = self.codec.tables(unit)
        base = (unit @ self.codec.centre(self.there).T).astype(np.float32)
        out = np.full((len(unit), len(self.vectors)), -np.inf, dtype=np.float32)
        for c, (lo, hi) in enumerate(zip(self.begin.tolist(), self.end.tolist(), strict=True)):
            who = np.flatnonzero(probe[:, c])
            if not len(who):
                continue
            some = tables if 2 * len(who) > len(unit) else tables[:, :, who]
            score = np.zeros((hi - lo, some.shape[2]), dtype=np.float32)
            for part, code in zip(some, self.codes[lo:hi].T, strict=True):
                score += part[code]
            out[who, lo:hi] = (score[:, who] if some is tables else score).T + base[who, c][:, None]
        return out

    def best(self, asked: np.ndarray, probe: np.ndarray, k: int) -> list[list[tuple[int, float]]]:
        """For each query the k best (vec_id, score): exact among the rows of the cells it visits, up to the slack."""
        unit = asked / np.linalg.norm(asked, axis=1, keepdims=True)
        rough = self.rough(unit, probe)
        n = min(max(RERANK, k), rough.shape[1])
        first = np.argpartition(-rough, n - 1, axis=1)[:, :n]
        exact = np.einsum("qrd,qd->qr", self.unit[first], unit)
        exact[np.take_along_axis(rough, first, axis=1) == -np.inf] = -np.inf
        least = np.partition(exact, n - k, axis=1)[:, n - k] if n >= k else np.full(len(unit), -np.inf)
        np.put_along_axis(rough, first, -np.inf, axis=1)
        # What may still be as near as the k-th.
        q, r = np.nonzero((rough + self.reach >= least[:, None]) & (rough > -np.inf))
        at_q, at_r = np.nonzero((exact >= least[:, None] - 1e-9) & (exact > -np.inf))
        kept_q, kept_r = [at_q], [first[at_q, at_r]]
        for at in range(0, len(q), PAIRS):
            a, b = q[at : at + PAIRS], r[at : at + PAIRS]
            near = np.einsum("pd,pd->p", self.unit[b], unit[a]) >= least[a] - 1e-9
            kept_q.append(a[near])
            kept_r.append(b[near])
        rows_q, rows = np.concatenate(kept_q), np.concatenate(kept_r)
        order = np.argsort(rows_q, kind="stable")
        rows_q, rows = rows_q[order], rows[order]
        out = []
        for i, (lo, hi) in enumerate(zip(np.searchsorted(rows_q, np.arange(len(unit))), np.searchsorted(rows_q, np.arange(len(unit)), side="right"), strict=True)):
            mine = rows[lo:hi]
            found = [(-s, j) for row, s in zip(mine.tolist(), _score(asked[i], self.vectors[mine]).tolist(), strict=True) for j in self.ids[row]]
            out.append([(j, -s) for s, j in sorted(found)[:k]])
        return out


def search(vectors: DataFrame, asked: Column, k: int, vec_id: str = "vec_id", vector: str = "embedding", exact: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of every row for which asked is true."""
    spark = vectors.sparkSession
    small_batches(spark)
    v = F.col("vec")
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("vec"), asked.alias("asked"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(v))
    rows = rows.select("vec_id", "vec", "asked", F.xxhash64(v).alias("h1"), F.xxhash64(F.lit(1), v).alias("h2"))
    key = ["h1", "h2"]

    nth = F.row_number().over(Window.partitionBy(*key).orderBy("vec_id"))
    slim = rows.select(*key, "vec_id").distinct().withColumn("nth", nth).filter(F.col("nth") <= k + 1)
    ids = slim.groupBy(*key).agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    distinct = stage(rows.groupBy(*key).agg(F.first("vec").alias("vec")).join(ids, key), "ann-distinct")
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n_rows = distinct.count()
    if not n_rows:
        return nothing

    # The sample: about SAMPLE_BYTES of vectors, those whose hash falls below a bound.
    usual = distinct.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()["dim"]
    size = max(256, SAMPLE_BYTES // (8 * usual))
    part = distinct.filter(F.size("vec") == usual)
    if n_rows > size:
        part = part.filter(F.pmod("h1", F.lit(1 << 30)) < int((1 << 30) * size / n_rows))
    chosen = part.select(*key, "vec").limit(2 * size).collect()
    chosen.sort(key=lambda r: (r["h1"], r["h2"]))
    if not chosen:  # the hash bound may leave none of a handful
        chosen = distinct.filter(F.size("vec") == usual).limit(256).collect()
    codec = fit(np.array([r["vec"] for r in chosen]), n_rows, k, exact=exact)

    def encode(batches):
        for b in batches:
            x = _matrix(b.column("vec"), codec.dim)
            cell, code = codec.encode(x / np.linalg.norm(x, axis=1, keepdims=True))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary())], [*b.schema.names, "cell", "code"]
            )

    fitting = distinct.filter(F.size("vec") == usual)
    index = stage(fitting.mapInArrow(encode, "h1 long, h2 long, vec array<double>, ids array<long>, cell int, code binary"), "ann-index")

    # Shards: neighbouring cells together, crowded cells over several. There are about as many cells as the root of n_rows.
    counts = {r["cell"]: r["count"] for r in index.groupBy("cell").count().collect()}
    limit = max(SHARD_LOW, min(SHARD_HIGH, n_rows // SHARDS))
    first, many, shard, room = {}, {}, 0, limit
    for c in sorted(counts):
        many[c] = -(-counts[c] // limit)
        if counts[c] > room and room < limit:
            shard, room = shard + 1, limit
        first[c] = shard
        if many[c] > 1:
            shard, room = shard + many[c], limit
        else:
            room -= counts[c]

    rows_of = np.zeros(codec.cells, dtype=np.int64)
    for c, n in counts.items():
        rows_of[c] = n

    def place(batches):
        for b in batches:
            cells, h = b.column("cell").to_pylist(), b.column("h1").to_pylist()
            at = [first[c] + x % many[c] for c, x in zip(cells, h, strict=True)]
            none = pa.nulls(b.num_rows, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([0] * len(at), pa.int32()), *b.columns, none], names)

    def visit(batches):
        for b in batches:
            x = _matrix(b.column("vec"), codec.dim)
            order = codec.visits(x / np.linalg.norm(x, axis=1, keepdims=True), rows_of, k + 1)
            h1, h2, vec = b.column("h1").to_pylist(), b.column("h2").to_pylist(), b.column("vec").to_pylist()
            out = []
            for i in range(len(x)):
                by = {}
                for c in order[i].tolist():
                    for s in range(first.get(c, 0), first.get(c, 0) + many.get(c, 0)):
                        by.setdefault(s, []).append(c)
                out += [(s, 1, h1[i], h2[i], vec[i], None, None, None, cells) for s, cells in by.items()]
            for k0 in range(0, len(out), 2048):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[k0 : k0 + 2048], strict=True), types, strict=True)], names)

    names = ["shard", "kind", "h1", "h2", "vec", "ids", "cell", "code", "cells"]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.list_(pa.int32())]
    layout = "shard int, kind int, h1 long, h2 long, vec array<double>, ids array<long>, cell int, code binary, cells array<int>"
    queries = rows.filter("asked").filter(F.size("vec") == usual)
    wanted = queries.groupBy(*key).agg(F.first("vec").alias("vec"))

    def scan(batches):
        """Index rows of a shard come first and are held; its queries follow, batch by batch."""
        at, parts, held = None, [], None
        for batch in batches:
            shards = batch.column("shard").to_numpy() * 2 + batch.column("kind").to_numpy()
            edges = np.flatnonzero(np.diff(shards)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(shards)], strict=True):
                if lo == hi:
                    continue
                b, here = batch.slice(lo, hi - lo), int(shards[lo]) // 2
                if here != at:
                    at, parts, held = here, [], None
                if shards[lo] % 2 == 0:
                    parts.append(b)
                    continue
                if held is None and parts:
                    t = pa.Table.from_batches(parts).combine_chunks()
                    codes = np.frombuffer(b"".join(t.column("code").to_pylist()), dtype=np.uint8).reshape(t.num_rows, -1)
                    held = Shard(_matrix(t.column("vec").combine_chunks(), codec.dim), t.column("ids").to_pylist(), t.column("cell").to_numpy(), codes, codec)
                if held is None:
                    continue
                for begin in range(0, b.num_rows, BLOCK):
                    some = b.slice(begin, BLOCK)
                    probe = np.zeros((some.num_rows, codec.cells), dtype=bool)
                    lists = some.column("cells")
                    probe[np.repeat(np.arange(some.num_rows), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()] = True
                    found = held.best(_matrix(some.column("vec"), codec.dim), probe[:, held.there], k + 1)
                    out = [(a, c, n, s) for a, c, hits in zip(some.column("h1").to_pylist(), some.column("h2").to_pylist(), found, strict=True) for n, s in hits]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["h1", "h2", "near", "score"])

    both = index.mapInArrow(place, layout).unionByName(wanted.mapInArrow(visit, layout))
    small = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "near"))
    hits = both.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(scan, "h1 long, h2 long, near long, score double")
    hits = hits.withColumn("nth", small).filter(F.col("nth") <= k + 1)
    lists = hits.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("nth", "near", "score"))).alias("found"))
    out = queries.select(*key, F.col("vec_id").alias("query_id")).distinct().join(lists, key)
    own = F.slice(F.filter("found", lambda x: x["near"] != F.col("query_id")), 1, k)
    out = out.select("query_id", F.posexplode(own).alias("pos", "hit"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.near").alias("vec_id"), F.col("hit.score").alias("score"))
