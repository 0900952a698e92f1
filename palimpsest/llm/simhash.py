"""SimHash near-dedup with pivot distance tables.

`fingerprints` turns texts into 64-bit SimHash values. `components` links fingerprints that differ in at
most `radius` bits and labels every document with the smallest doc_id it can reach.

How pairs are found. Only distinct fingerprints take part, so exact copies are never compared. Each
fingerprint is keyed by its bands: of radius + 1 disjoint bands of bits, two linked fingerprints agree in at
least one, and the distances of that band to any reference agree too. Within a run of equal keys, a table of
Hamming distances to many reference fingerprints is made; a pair is discarded as soon as one coordinate
differs by more than the radius (the triangle inequality makes that exact), and survivors are verified
bit by bit. Each run yields a spanning forest, never its pairs. Keys that hold too many fingerprints are keyed
again by bands of the remaining bits, and what is still too large is cut into blocks of which every two meet.
So no link is lost and no task grows with a key. Components come from large-star and small-star rounds over
staged tables; nothing about the corpus is collected to the driver.

Wider similarity. Three bits of 64 stand for nearly equal texts. With `similarity`, signatures of WIDE * 64 bits are made of the
same hashes; two texts whose shingle sets have that Jaccard similarity are expected to differ in a known part of the bits, and
are candidates at that many and SLACK standard deviations more, if they agree in one of WIDE_BANDS sets of WIDE_BITS bits, set by a
fixed rule. Pivot tables and bits decide on candidates as above. Inside the components of candidates the shingle sets themselves
are compared, every two of them, in blocks bounded by rows and bytes: only pairs that reach the similarity link. So no link is
wrong; of unequal pairs at 0.8 some 95 in 100 share a set of bits, at 0.85 nearly all. Equal signatures count as equal texts.

Defined results. A null text and a text without words have fingerprint zero, which links like any other.
Repeated rows are kept, each with its component. A null doc_id never names a component unless every reachable
doc_id is null. Empty tables give empty results. Extra columns are ignored by `fingerprints`. Components whose diameter
needs more than MAX_ROUNDS rounds raise an error; each round about halves it.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.work import discard, small_batches, stage, stage_at

SHINGLE = 3
SEED = 42
RADIUS = 3
BANDS = 4
BAND_BITS = 16
SUB_BITS = 12
MAX_RUN = 2048
BLOCK = 1024
N_PIVOTS = 24
WIDE = 4
WIDE_BANDS, WIDE_BITS = 80, 20
SLACK = 2.5
#: Bytes of shingle sets in a block, and postings looked up at once.
SET_BYTES, POSTINGS = 1 << 22, 1 << 21
#: Bits of the sketch of candidates, and of one row of it: 4 MB, whatever the input.
SKETCH_BITS, SKETCH_ROW = 1 << 25, 1 << 15
MAX_ROUNDS = 40

#: Each byte value as eight counters of one byte, most significant bit first in memory.
_SPREAD = np.array([sum(((b >> (7 - k)) & 1) << (8 * k) for k in range(8)) for b in range(256)], dtype=np.uint64)


def pivots(n: int = N_PIVOTS, words: int = 1) -> np.ndarray:
    """(n, words) reference fingerprints from a fixed rule: hashes of 0, 1, 2, ..."""
    return np.array([xxhash.xxh64_intdigest(str(k).encode(), SEED) for k in range(n * words)], dtype=np.uint64).reshape(n, words)


def shingle_hashes(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Hashes of all shingles of one whole text, repeats included; none for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    n = max(1, len(words) - shingle + 1)
    grams = map(b" ".join, zip(*(words[k : k + n] for k in range(min(shingle, len(words)))), strict=True))
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), dtype=np.uint64, count=n)


def majority(hashes: np.ndarray) -> np.ndarray:
    """For (n, words) hashes the bytes whose bits are set in over half the rows."""
    n, words = hashes.shape
    octets = hashes.astype(">u8").view(np.uint8).reshape(n, 8 * words)
    counts = np.zeros(64 * words, dtype=np.int64)
    for k in range(0, n, 255):  # a counter of one byte holds 255 rows
        counts += _SPREAD[octets[k : k + 255]].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return np.packbits(2 * counts > n)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of one whole text."""
    hashes = shingle_hashes(text, shingle, seed)
    return int.from_bytes(majority(hashes[:, None]).tobytes(), "big") if len(hashes) else 0


def signature(h: np.ndarray) -> bytes:
    """SimHash of WIDE * 64 bits of a set of shingle hashes: each is mixed into WIDE further ones."""
    x = h[:, None] + np.arange(1, WIDE + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return majority(x ^ (x >> np.uint64(31))).tobytes() if len(h) else bytes(8 * WIDE)


def wide_radius(similarity: float) -> int:
    """Bits in which signatures of texts of a Jaccard similarity are expected to differ, and SLACK standard deviations more."""
    bits = 64 * WIDE
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * p + SLACK * math.sqrt(bits * p * (1 - p)))


def wide_bands() -> np.ndarray:
    """(WIDE_BANDS, WIDE_BITS) bit positions from a fixed rule: pieces of shuffled positions."""
    rng = np.random.default_rng(SEED)
    per = 64 * WIDE // WIDE_BITS
    rows = [rng.permutation(64 * WIDE)[: per * WIDE_BITS].reshape(per, WIDE_BITS) for _ in range(-(-WIDE_BANDS // per))]
    return np.concatenate(rows)[:WIDE_BANDS]


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            values = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return slim.mapInArrow(run, "doc_id long, fp long")


def signatures(docs: DataFrame, shingle: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, sig, grams): grams is the sorted set of shingle hashes, sig its wide signature, fp a hash of that which names it."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), shingle)) for t in b.column(1)]
            sigs = [signature(h) for h in sets]
            names = np.array([xxhash.xxh64_intdigest(s, SEED) for s in sigs], dtype=np.uint64).view(np.int64)
            made = [pa.array(names, pa.int64()), pa.array(sigs, pa.binary()), pa.array([h.tobytes() for h in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), *made], ["doc_id", "fp", "sig", "grams"])

    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return slim.mapInArrow(run, "doc_id long, fp long, sig binary, grams binary")


# --- links inside runs of equal keys ---------------------------------------------------------------------------


def _find(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if np.array_equal(up, x):
            return x
        x = parent[up]


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while True:
        ra, rb = _find(parent, a), _find(parent, b)
        open_ = ra != rb
        if not open_.any():
            return
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))


def forest(keys: np.ndarray, fps: np.ndarray, cut: np.ndarray | None = None, radius: int = RADIUS) -> np.ndarray:
    """Parent positions of a spanning forest of the links between rows with equal keys.

    keys must be sorted; fps is (n,) or (n, words). With cut (0 or 1 for each row), only pairs with differing cut are compared.
    """
    n = len(fps)
    fps = fps.reshape(n, -1)
    parent = np.arange(n)
    rows = np.stack([np.bitwise_count(fps ^ p).sum(axis=1, dtype=np.int16) for p in pivots(words=fps.shape[1])], axis=1)
    offset, live = 1, np.arange(n - 1)
    while len(live):
        live = live[live + offset < n]
        live = live[keys[live] == keys[live + offset]]
        if offset % 16 == 0 and len(live):  # runs whose rows are all tied need no more pairs
            root = _find(parent, np.arange(n))
            begin = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            one = np.minimum.reduceat(root, begin) == np.maximum.reduceat(root, begin)
            live = live[~np.repeat(one, np.diff(np.r_[begin, n]))[live]]
        i, j = live, live + offset
        if cut is not None:
            apart = cut[i] != cut[j]
            i, j = i[apart], j[apart]
        for p in range(rows.shape[1]):  # the table: discard by the maximum coordinate difference
            near = np.abs(rows[i, p] - rows[j, p]) <= radius
            i, j = i[near], j[near]
        near = np.bitwise_count(fps[i] ^ fps[j]).sum(axis=1) <= radius
        if near.any():
            _union(parent, i[near], j[near])
        offset += 1
    return _find(parent, np.arange(n))


def similar(sets: list[np.ndarray], similarity: float, cut: np.ndarray | None = None) -> np.ndarray:
    """Parent positions of the links of sets of distinct hashes at a Jaccard similarity or more; with cut, of pairs with differing cut."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    at = np.r_[0, np.cumsum(sizes)]
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    postings = np.repeat(np.arange(n), sizes)[np.argsort(column, kind="stable")]
    begin = np.r_[0, np.cumsum(np.bincount(column))]
    parent = np.arange(n)
    for i in range(n - 1):
        if i % 16 == 1 and not _find(parent, np.arange(n)).any():  # all are tied to the first
            break
        mine = column[at[i] : at[i + 1]]
        total = np.cumsum(begin[mine + 1] - begin[mine])
        shared = np.zeros(n, dtype=np.int64)
        for part in np.split(mine, np.searchsorted(total, np.arange(POSTINGS, total[-1] if len(total) else 0, POSTINGS))):
            many = begin[part + 1] - begin[part]
            places = np.arange(many.sum()) + np.repeat(begin[part] - (np.cumsum(many) - many), many)
            shared += np.bincount(postings[places], minlength=n)
        near = shared >= similarity * (sizes + sizes[i] - shared) - 1e-9
        near[: i + 1] = False
        if cut is not None:
            near &= cut != cut[i]
        j = np.flatnonzero(near)
        _union(parent, np.full(len(j), i), j)
    return _find(parent, np.arange(n))


def _linked(keyed: DataFrame, key: list[str], cut: bool = False, radius: int = RADIUS, similarity: float | None = None) -> DataFrame:
    """(u, v) forest edges of all runs of equal key columns; keyed has key columns, fp, maybe cut.

    Compared are the fingerprints, or signatures in a column sig, or with a similarity the shingle sets in a column grams.
    """
    wide = "sig" in keyed.columns
    schema = "u long, v long"

    def edges(table: pa.Table):
        names = [table.column(k).to_numpy() for k in key]
        fps = table.column("fp").to_numpy().view(np.uint64)
        change = np.zeros(len(fps), dtype=bool)
        for c in names:
            change[1:] |= c[1:] != c[:-1]
        cuts = table.column("cut").to_numpy() if cut else None
        if similarity is None:
            bits = np.frombuffer(b"".join(table.column("sig").to_pylist()), dtype=np.uint64).reshape(len(fps), -1) if wide else fps
            root = forest(np.cumsum(change), bits, cuts, radius)
        else:
            root = np.arange(len(fps))
            ends = np.r_[0, np.flatnonzero(change), len(fps)]
            for lo, hi in zip(ends[:-1], ends[1:], strict=True):
                sets = [np.frombuffer(g.as_py(), dtype=np.uint64) for g in table.column("grams")[lo:hi]]
                root[lo:hi] = lo + similar(sets, similarity, cuts[lo:hi] if cut else None)
        move = root != np.arange(len(fps))
        return pa.RecordBatch.from_arrays(
            [pa.array(fps[move].view(np.int64)), pa.array(fps[root[move]].view(np.int64))], ["u", "v"]
        )

    def last_run(table: pa.Table) -> int:
        """Position where the last run of equal keys begins."""
        same = np.ones(table.num_rows, dtype=bool)
        for k in key:
            c = table.column(k).to_numpy()
            same &= c == c[-1]
        return int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0

    def run(batches):
        held = None
        for b in batches:
            if b.num_rows == 0:
                continue
            part = pa.Table.from_batches([b])
            held = part if held is None else pa.concat_tables([held, part]).combine_chunks()
            at = last_run(held)
            if at:
                yield edges(held.slice(0, at))
                held = held.slice(at)
        if held is not None and held.num_rows:
            yield edges(held)

    dealt = keyed.repartition(*key).sortWithinPartitions(*key, "fp")
    return dealt.mapInArrow(run, schema)


def _band(bits: F.Column, at: int, width: int) -> F.Column:
    return F.shiftrightunsigned(bits, at).bitwiseAND(F.lit((1 << width) - 1)).cast("int")


def links(distinct: DataFrame) -> DataFrame:
    """(u, v) edges over distinct fingerprints (column fp) whose components are those of all links."""
    fp = F.col("fp")
    first = distinct.select(
        "fp", F.explode(F.array(*[F.lit(b) * (1 << BAND_BITS) + _band(fp, b * BAND_BITS, BAND_BITS) for b in range(BANDS)])).alias("k1")
    )
    # At most BANDS * 2 ** BAND_BITS keys, whatever the input: small enough to broadcast.
    crowded = first.groupBy("k1").count().filter(F.col("count") > MAX_RUN).select("k1")
    crowded = stage(crowded.coalesce(1), "simhash-crowded")
    if crowded.isEmpty():
        return _linked(first, ["k1"])
    crowd = F.broadcast(crowded)
    plain = _linked(first.join(crowd, "k1", "left_anti"), ["k1"])

    # The rest of the bits of a crowded key, low bits first, in bands of SUB_BITS.
    band = F.floor(F.col("k1") / (1 << BAND_BITS)).cast("int")
    low = fp.bitwiseAND(F.expr(f"shiftleft(1L, {BAND_BITS} * b1) - 1"))
    high = F.expr(f"CASE WHEN b1 = {BANDS - 1} THEN 0L ELSE shiftrightunsigned(fp, {BAND_BITS} * b1 + {BAND_BITS}) END")
    rest = low.bitwiseOR(F.expr("shiftleft(__high, %d * b1)" % BAND_BITS))
    second = first.join(crowd, "k1", "left_semi").withColumn("b1", band).withColumn("__high", high).withColumn("__rest", rest)
    second = second.select(
        "fp",
        "k1",
        F.explode(F.array(*[F.lit(b) * (1 << SUB_BITS) + _band(F.col("__rest"), b * SUB_BITS, SUB_BITS) for b in range(BANDS)])).alias("k2"),
    )
    second = stage(second, "simhash-second")
    sizes = second.groupBy("k1", "k2").count().filter(F.col("count") > MAX_RUN)
    dense = stage(sizes.withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int")).drop("count"), "simhash-dense")
    out = plain.unionByName(_linked(second.join(dense, ["k1", "k2"], "left_anti"), ["k1", "k2"]))
    if dense.isEmpty():
        return out
    within, across = _blocked(second.join(dense, ["k1", "k2"]), ["k1", "k2"], ["fp"])
    keys = ["k1", "k2", "lo", "hi"]
    return out.unionByName(_linked(within, keys)).unionByName(_linked(across, keys, cut=True))


def wide_links(nodes: DataFrame, radius: int) -> DataFrame:
    """(u, v) edges over distinct signatures (columns fp, sig) whose components are those of all links that share a band."""
    places = wide_bands()
    weights = 1 << np.arange(WIDE_BITS, dtype=np.int64)

    def key(batches):
        for b in (whole.slice(lo, 4096) for whole in batches for lo in range(0, whole.num_rows, 4096)):
            octets = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.uint8).reshape(b.num_rows, -1)
            bits = np.unpackbits(octets, axis=1)
            keys = np.stack([bits[:, p].astype(np.int64) @ weights + (k << WIDE_BITS) for k, p in enumerate(places)], axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * len(places)), pa.array(keys.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], ["fp", "sig", "keys"])

    keyed = nodes.select("fp", "sig").mapInArrow(key, "fp long, sig binary, keys array<int>").select(F.explode("keys").alias("k1"), "fp", "sig")
    crowded = nodes.select("fp", "sig").mapInArrow(key, "fp long, sig binary, keys array<int>").select(F.explode("keys").alias("k1"))
    crowded = crowded.groupBy("k1").agg(F.count("*").alias("n")).filter(F.col("n") > MAX_RUN)
    crowded = stage(crowded.select("k1", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "simhash-crowded")
    if crowded.isEmpty():
        return _linked(keyed, ["k1"], radius=radius)
    plain = _linked(keyed.join(crowded, "k1", "left_anti"), ["k1"], radius=radius)
    within, across = _blocked(keyed.join(crowded, "k1"), ["k1"], ["fp", "sig"])
    keys = ["k1", "lo", "hi"]
    return plain.unionByName(_linked(within, keys, radius=radius)).unionByName(_linked(across, keys, True, radius))


def _sketched(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Rows whose fp may be one of members (column node): all that are, and few others as long as members are few.

    The bitmap of fixed size spares the other rows the shuffle of the join to come; a full one would let all rows pass.
    """
    bit = F.pmod(F.col("node"), F.lit(SKETCH_BITS))
    bitmap = members.groupBy(F.floor(bit / SKETCH_ROW).alias("part")).agg(F.bitmap_construct_agg(bit % SKETCH_ROW).alias("bits"))
    bitmap = F.broadcast(stage(bitmap.coalesce(1), "simhash-sketch"))
    mine = F.pmod(F.col("fp"), F.lit(SKETCH_BITS))
    octet = F.conv(F.hex(F.substring(F.col("bits"), (mine % SKETCH_ROW / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(octet, (mine % 8).cast("int")) == 1
    return rows.join(bitmap, (F.floor(mine / SKETCH_ROW) == F.col("part")) & hit, "left_semi")


def confirmed(prints: DataFrame, candidates: DataFrame, similarity: float) -> DataFrame:
    """(u, v) edges whose components are those of all pairs of the similarity or more inside a component of candidates (u, v)."""
    tied = stage(label(candidates), "simhash-candidates")
    member = tied.unionByName(tied.select(F.col("root").alias("node"), "root").distinct())
    rows = _sketched(prints.select("fp", "grams"), member).withColumnRenamed("fp", "node").join(member, "node")
    rows = stage(rows.groupBy(F.col("node").alias("fp")).agg(F.first("root").alias("root"), F.first("grams").alias("grams")), "simhash-sets")
    sizes = rows.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.length("grams")).alias("size"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("size") / SET_BYTES)).cast("int")
    dense = stage(sizes.select("root", blocks.alias("blocks")).filter("blocks > 1"), "simhash-dense")
    if dense.isEmpty():
        return _linked(rows, ["root"], similarity=similarity)
    plain = _linked(rows.join(dense, "root", "left_anti"), ["root"], similarity=similarity)
    within, across = _blocked(rows.join(dense, "root"), ["root"], ["fp", "grams"])
    keys = ["root", "lo", "hi"]
    return plain.unionByName(_linked(within, keys, similarity=similarity)).unionByName(_linked(across, keys, True, similarity=similarity))


def _blocked(rows: DataFrame, key: list[str], more: list[str]) -> tuple[DataFrame, DataFrame]:
    """Every two blocks of a dense key meet once: (rows within a block, rows of two blocks with `cut`)."""
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(*key, F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), *more, (F.col("mine") > F.col("other")).cast("int").alias("cut"))
    return rows.filter("lo = hi").drop("cut"), rows.filter("lo < hi")


# --- components --------------------------------------------------------------------------------------------------


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round over (u, v): neighbours larger (or not larger) than a node are tied to its least neighbour."""
    if large:
        near = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # Staged, so that below the join there are plain exchanges only, and adaptive execution can split a hub's rows.
    least = stage(near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "simhash-least")
    out = near.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"), "u")
    if large:
        return out.filter(F.col("a") > F.col("u")).select(F.col("a").alias("u"), F.col("b").alias("v"))
    own = least.select(F.col("u"), F.col("m").alias("v"))
    return out.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(own)


def label(edges: DataFrame) -> DataFrame:
    """(node, root): for every node that has an edge, the least node of its component."""
    clean = lambda e: e.filter(F.col("u") != F.col("v")).distinct()
    spark = edges.sparkSession
    now, path = stage_at(clean(edges), "simhash-edges")
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = mark(now)
    for _ in range(MAX_ROUNDS):
        if not seen[0]:
            break
        now, done = stage_at(clean(_star(clean(_star(now, True)), False)), "simhash-edges")
        discard(spark, path)
        path = done
        last, seen = seen, mark(now)
        if seen == last:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def components(prints: DataFrame, similarity: float | None = None) -> DataFrame:
    """(doc_id, fp, component_id) for every row of prints, which should be a staged table.

    Fingerprints (doc_id, fp) link at RADIUS bits; with a similarity, signatures (sig and grams too) link by their shingle sets.
    """
    wide = similarity is not None
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"), *[F.first("sig").alias("sig")] * wide)
    nodes = stage(nodes, "simhash-nodes")
    edges = stage(wide_links(nodes, wide_radius(similarity)) if wide else links(nodes.select("fp")), "simhash-links")
    if wide and not edges.isEmpty():
        edges = stage(confirmed(prints, edges, similarity), "simhash-confirmed")
    if edges.isEmpty():
        named = nodes.select("fp", F.col("first").alias("component_id"))
    else:
        tied = nodes.join(label(edges), nodes["fp"] == F.col("node"), "left").select(
            "fp", "first", F.coalesce("root", "fp").alias("root")
        )
        least = stage(tied.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-named")
        named = tied.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """(doc_id, fp, component_id) of every document: by RADIUS bits of 64, or by the Jaccard similarity of shingle sets."""
    if similarity is None:
        if shingle != SHINGLE:
            raise ValueError(f"fingerprints are made of {SHINGLE} words; give a similarity for others")
        return components(stage(fingerprints(docs, doc_id, text), "simhash-prints"))
    prints, path = stage_at(signatures(docs, shingle, doc_id, text), "simhash-prints")
    out = stage(components(prints, similarity), "simhash-components")
    discard(docs.sparkSession, path)  # the shingle sets are as large as the texts
    return out


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """The document with the smallest doc_id of each component; of repeated rows of that doc_id, one row.

    Documents without doc_id belong to no component that can be named, and all stay. Texts are shuffled once.
    """
    name = F.col(f"`{doc_id}`")
    heads = near_duplicates(docs, doc_id, text, shingle, similarity).filter("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("rows"))
    heads = stage(heads.withColumnRenamed("doc_id", doc_id), "simhash-heads")
    # As many ids as documents: never to be broadcast, so the same plan at every size.
    kept = docs.join(heads.filter("rows = 1").select(name).hint("merge"), doc_id, "left_semi")
    twice = heads.filter("rows > 1").select(name)
    if not twice.isEmpty():
        kept = kept.unionByName(docs.join(twice.hint("merge"), doc_id, "left_semi").dropDuplicates([doc_id]))
    return kept.unionByName(docs.filter(name.isNull()))


def hex_digits(fp: F.Column) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
