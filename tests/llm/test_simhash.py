import random

import numpy as np
import xxhash

from palimpsest.llm import simhash


def brute_fingerprint(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_signature(text, shingle):
    """The wide signature as an integer, bit by bit."""
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    grams = {b" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)} or ({b" ".join(words)} if words else set())
    full, out = (1 << 64) - 1, 0
    for w in range(1, simhash.WIDE + 1):
        counts = [0] * 64
        for g in grams:
            x = (xxhash.xxh64_intdigest(g, 42) + w * 0x9E3779B97F4A7C15) & full
            x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & full
            x = ((x ^ x >> 27) * 0x94D049BB133111EB) & full
            x ^= x >> 31
            for b in range(64):
                counts[b] += x >> b & 1
        out = out << 64 | sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))
    return out


def brute_wide(a, b, radius):
    """Whether two wide signatures agree in a band and differ in at most radius bits. Bit positions count from the first bit."""
    n, x = 64 * simhash.WIDE, a ^ b
    return x.bit_count() <= radius and any(all(not x >> (n - 1 - int(p)) & 1 for p in band) for band in simhash.wide_bands())


def brute_grams(text, shingle=5):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    return frozenset(tuple(words[i : i + shingle]) for i in range(max(len(words) - shingle + 1, 1 if words else 0)))


def brute_similar(rows, similarity=0.8):
    """[(doc_id, component)]: exact Jaccard similarity of every two texts whose signatures are joined by candidates."""
    radius = simhash.wide_radius(similarity)
    signature = {t: brute_signature(t, 5) for _, t in rows}
    loose = dict(brute_components([(s, s) for s in set(signature.values())], lambda a, b: brute_wide(a, b, radius)))
    known = [(d, (loose[signature[t]], signature[t], brute_grams(t))) for d, t in rows]
    return brute_components(known, lambda a, b: a[0] == b[0] and (a[1] == b[1] or len(a[2] & b[2]) >= similarity * len(a[2] | b[2]) - 1e-9))


def brute_components(pairs, linked=lambda a, b: bin(a ^ b).count("1") <= 3):
    """pairs: (doc_id, fp); [(doc_id, component)]."""
    ids = {}
    parent = {}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for d, f in pairs:
        ids.setdefault(f, []).append(d)
        parent[f] = f
    fps = list(parent)
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if linked(a, b):
                parent[find(a)] = find(b)
    least = {}
    for d, f in pairs:
        r = find(f)
        least[r] = min(least.get(r, d), d)
    return sorted((d, least[find(f)]) for d, f in pairs)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprint_equals_definition():
    rng = random.Random(1)
    texts = [None, "", " \t\n", "one", "One TWO", "É é ẞ x", "a b c", "a b c a b c a b c"]
    texts += [" ".join(rng.choice(["ab", "Cd", "é", "x\x0by", "z"]) for _ in range(n)) for n in (3, 20, 254, 257, 258, 900, 3000)]
    for t in texts:
        assert simhash.fingerprint(t) == brute_fingerprint(t)


def family(rng, size, flips=3):
    base = rng.getrandbits(64)
    out = [base]
    while len(out) < size:
        x = rng.choice(out)
        for _ in range(rng.randint(0, flips)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return out


def run(spark, pairs):
    df = spark.createDataFrame([(d, signed(f)) for d, f in pairs], "doc_id long, fp long")
    return sorted((r.doc_id, r.component_id) for r in simhash.components(df).collect())


def test_components_equal_brute_force(spark):
    rng = random.Random(2)
    fps = [0, 0, 0, 1, 7, 15] + [rng.getrandbits(64) for _ in range(150)]
    for size in (2, 5, 40):
        fps += family(rng, size)
    fps += [fps[20]] * 30
    rng.shuffle(fps)
    pairs = list(enumerate(fps, 100))
    assert run(spark, pairs) == brute_components(pairs)


def test_crowded_keys_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MAX_RUN", 8)
    monkeypatch.setattr(simhash, "BLOCK", 5)
    rng = random.Random(3)
    low = [(rng.getrandbits(48) << 16) | 0xBEEF for _ in range(120)]
    same28 = [(rng.getrandbits(36) << 28) | 0xABCBEEF for _ in range(60)]
    top = [(0xBEEF << 48) | rng.getrandbits(48) for _ in range(60)]
    fps = low + same28 + top + family(rng, 60)
    for x in (*low[:40], *same28[:40], *top[:40]):
        y = x
        for _ in range(rng.randint(1, 3)):
            y ^= 1 << rng.randrange(64)
        fps.append(y)
    pairs = list(enumerate(fps))
    assert run(spark, pairs) == brute_components(pairs)


def test_pivots_discard_no_link():
    rng = random.Random(4)
    fps = np.array(sorted(family(rng, 300)), dtype=np.uint64)
    root = simhash.forest(np.zeros(len(fps), dtype=int), fps)
    labels = {int(f): int(r) for f, r in zip(fps, root, strict=True)}
    near = [(i, j) for i in range(300) for j in range(i) if bin(int(fps[i]) ^ int(fps[j])).count("1") <= 3]
    assert near and all(labels[int(fps[i])] == labels[int(fps[j])] for i, j in near)


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).collect() == []
    rows = [(None, "a b c d"), (4, "a b c d"), (4, "A b  c d"), (9, None), (8, ""), (2, "word " * 40000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 fp", "2 component_id")
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == [(-1, 4), (2, 2), (4, 4), (4, 4), (8, 8), (9, 8)]
    kept = sorted(r.doc_id or -1 for r in simhash.keep_first(df).collect())
    assert kept == [-1, 2, 4, 8]


def edited(rng, words, share):
    return [rng.choice(["new", "other", "word"]) + str(rng.randrange(9999)) if rng.random() < share else w for w in words]


def jaccard(a, b, n=5):
    x, y = ({tuple(t[i : i + n]) for i in range(len(t) - n + 1)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_similar_texts_are_linked(spark, monkeypatch):
    """Groups by similarity: equal to brute force with plain and with crowded keys; near pairs caught, unrelated texts alone."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    texts = []
    for _ in range(40):
        base = [word() for _ in range(rng.randint(60, 300))]
        texts += [base, edited(rng, base, 0.01), edited(rng, base, 0.03)]
    big = [word() for _ in range(200)]
    texts += [edited(rng, big, 0.008) for _ in range(90)] + [[word() for _ in range(120)] for _ in range(100)] + [[], [], ["a", "b"], ["a", "b"]]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)] + [(900, None), (None, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 k1", "2 sig", "3 cut").repartition(3)
    assert 50 <= simhash.wide_radius(0.8) <= 56
    assert all(int.from_bytes(simhash.signature(np.unique(simhash.shingle_hashes(t, 5))), "big") == brute_signature(t, 5) for _, t in rows)
    known = brute_similar([(d if d is not None else float("inf"), t) for d, t in rows])
    want = [(d if d != float("inf") else None, c if c != float("inf") else None) for d, c in known]
    for run, block, size in ((2048, 1024, 1 << 22), (20, 8, 1 << 22), (2048, 1024, 20_000)):
        monkeypatch.setattr(simhash, "MAX_RUN", run)
        monkeypatch.setattr(simhash, "BLOCK", block)
        monkeypatch.setattr(simhash, "SET_BYTES", size)
        got = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs, shingle=5, similarity=0.8).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    group = dict(want)
    near = [(a, b) for a in range(len(texts)) for b in range(a) if len(texts[a]) > 5 < len(texts[b]) and jaccard(texts[a], texts[b]) >= 0.8]
    assert len(near) > 1000 and np.mean([group[a] == group[b] for a, b in near]) > 0.98
    exact = dict(brute_components([(k, brute_grams(t)) for k, t in rows[:-2]], lambda a, b: len(a & b) >= 0.8 * len(a | b) > 0))
    assert all(exact[a] == exact[b] for a in range(310) for b in range(a) if group[a] == group[b])
    assert len({group[k] for k in range(210, 310)}) == 100
    kept = simhash.keep_first(docs, shingle=5, similarity=0.8)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({c for _, c in want if c is not None})


def test_sets_of_hashes_are_compared_exactly(monkeypatch):
    rng = random.Random(8)
    pool = [rng.getrandbits(64) for _ in range(60)]
    sets = [np.array(sorted(rng.sample(pool, rng.randint(40, 60))), dtype=np.uint64) for _ in range(50)]
    sets += [np.zeros(0, dtype=np.uint64), np.array(pool[:1], dtype=np.uint64)]
    cut = np.array([rng.randrange(2) for _ in sets])
    for postings in (1 << 21, 100):
        monkeypatch.setattr(simhash, "POSTINGS", postings)
        for parts in (None, cut):
            alike = lambda a, b: len(set(sets[a]) & set(sets[b])) >= 0.8 * len(set(sets[a]) | set(sets[b])) > 0 and (parts is None or parts[a] != parts[b])  # noqa: E731, B023
            want = dict(brute_components([(k, k) for k in range(len(sets))], alike))
            assert simhash.similar(sets, 0.8, parts).tolist() == [want[k] for k in range(len(sets))]


def test_settings_that_do_not_go_together(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    try:
        simhash.near_duplicates(docs, shingle=5)
    except ValueError:
        return
    raise AssertionError
