"""SentencePiece encoding and decoding by streaming Viterbi.

The vocabulary is a BPE one, so the best path of a text is the one merging would give. It is found as a shortest-path
problem over piece boundaries: at each boundary the pieces that end there are candidates, the transition from the
piece before is free if the two stay apart under merging and barred otherwise, and one candidate survives, with a
backpointer. Only the last `longest piece` boundaries can still be extended; as soon as the backpointer paths from all
of them meet in one boundary, the ids before it are committed and forgotten (class Stream). Where no piece can span
two neighbouring characters all paths meet at once, so a text falls into independent stretches: short stretches run
through the same recurrence side by side in numpy (`lanes`), long ones through Stream, and stretches seen lately are
remembered up to a bound.

Whether two pieces stay apart: follow the last piece of the left one and the first piece of the right one as they grow
by their own merges, in order of rank, and see whether a merge across would come first.

Decoding joins the pieces' bytes, turns the word mark into a space and drops the added first space. Ids equal those of
the library for this model, and decode(encode(text)) equals text except that U+2581 comes back as a space.

Defined results. Null text gives null ids and text; empty text gives no ids. Unknown characters become byte pieces.
Repeated rows are encoded alike; empty tables give empty results; clashing input columns are replaced.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from palimpsest.llm.work import position, small_batches

MARK = "▁"
LONG = 48  # longer stretches are streamed
MEMO = 300_000
COMMIT_EVERY = 64
INF = np.int64(1) << 40
_NORMAL, _UNKNOWN, _BYTE = 1, 2, 6


class Vocabulary:
    """Pieces of a model file, their merge tree and tables for the recurrence."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces:
            raise ValueError("a BPE model without normalisation is needed")
        self.prefix = MARK if norm.add_dummy_prefix else ""
        pieces = model.pieces
        self.size = len(pieces)
        self.unknown = next(i for i, p in enumerate(pieces) if p.type == _UNKNOWN)
        self.bytes = np.zeros(256, dtype=np.int32)
        self.raw = [b""] * (self.size + 1)
        ids: dict[str, int] = {}
        for i, p in enumerate(pieces):
            if p.type == _BYTE:
                self.bytes[int(p.piece[3:5], 16)] = i
                self.raw[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type == _NORMAL:
                ids[p.piece] = i
                self.raw[i] = p.piece.replace(MARK, " ").encode()
            elif p.type == _UNKNOWN:
                self.raw[i] = " ⁇ ".encode()
        self.ids = ids
        order = sorted(ids.values(), key=lambda i: (-pieces[i].score, i))
        self.rank = {i: k for k, i in enumerate(order)}
        self._merge_trees()
        self._tables()

    def _merge_trees(self) -> None:
        """For every piece its two halves under merging, and the time by which it is made."""
        self.half: dict[int, tuple[int, int]] = {}
        self.time = np.full(self.size + 1, -1, dtype=np.int64)
        usable = {}
        for text, i in sorted(self.ids.items(), key=lambda x: len(x[0])):
            if len(text) == 1:
                usable[text] = i
                continue
            if any(c not in self.ids for c in text):
                continue
            parts = [self.ids[c] for c in text]
            texts = list(text)
            halves = None
            while len(parts) > 1:
                best = min(((self.rank[m], k) for k in range(len(parts) - 1) if (m := self.ids.get(texts[k] + texts[k + 1])) is not None), default=None)
                if best is None:
                    break
                k = best[1]
                halves = (parts[k], parts[k + 1])
                texts[k : k + 2] = [texts[k] + texts[k + 1]]
                parts[k : k + 2] = [self.ids[texts[k]]]
            if len(parts) == 1:  # merging does reach it
                usable[text] = i
                self.half[i] = halves
                self.time[i] = max(self.rank[i], self.time[halves[0]], self.time[halves[1]])
        self.usable = usable

    def _tables(self) -> None:
        usable, n = self.usable, self.size + 1
        self.longest = max(map(len, usable), default=1)
        joined = {c for t in usable if len(t) > 1 for c in t}
        if any(MARK in t.lstrip(MARK) for t in usable):
            raise ValueError("a piece has the word mark inside")
        inner = "".join(sorted(re.escape(c) for c in joined - {MARK}))
        self.stretch = re.compile(f"{MARK}*[{inner}]+|{MARK}+|." if inner else f"{MARK}+|.", re.S)
        # What each piece looks like at its ends while it grows: spine[side][id] from one character to the whole piece.
        depth = 1
        spines = ({}, {})
        for i in usable.values():
            for side in (0, 1):
                line, x = [i], i
                while x in self.half:
                    x = self.half[x][1 - side]
                    line.append(x)
                spines[side][i] = line[::-1]
                depth = max(depth, len(line))
        self.spine = np.full((2, n, depth), -1, dtype=np.int64)
        for side in (0, 1):
            for i, line in spines[side].items():
                self.spine[side, i, : len(line)] = line
        pairs = {}
        for text, i in usable.items():
            for k in range(1, len(text)):
                a, b = usable.get(text[:k]), usable.get(text[k:])
                if a is not None and b is not None:
                    pairs[a * n + b] = i
        # Pieces that merging never reaches still win a merge of their halves.
        for text, i in self.ids.items():
            for k in range(1, len(text)):
                a, b = usable.get(text[:k]), usable.get(text[k:])
                if a is not None and b is not None:
                    pairs.setdefault(a * n + b, i)
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_rank = np.array([self.rank[pairs[k]] for k in self.pair_keys.tolist()], dtype=np.int64)
        # A trie over reversed pieces: node * width + character -> node.
        chars = {c: k + 1 for k, c in enumerate(sorted({c for t in usable for c in t}))}
        self.chars, self.width = chars, len(chars) + 1
        nodes, trie, piece = 1, {}, {0: -1}
        for text, i in usable.items():
            at = 0
            for c in reversed(text):
                key = at * self.width + chars[c]
                if key not in trie:
                    trie[key] = nodes
                    piece[nodes] = -1
                    nodes += 1
                at = trie[key]
            piece[at] = i
        self.trie = trie
        self.node_piece = np.array([piece[k] for k in range(nodes)], dtype=np.int64)
        self.leaf = np.ones(nodes, dtype=bool)
        self.leaf[np.array([k // self.width for k in trie], dtype=np.int64)] = False
        self._hash_trie()
        self.seen_key = np.full(1 << 20, -1, dtype=np.int64)
        self.seen_ok = np.zeros(1 << 20, dtype=bool)

    def _hash_trie(self) -> None:
        """The trie as an open hash table whose longest probe is known."""
        bits = max(10, int(len(self.trie) * 3).bit_length())
        size = 1 << bits
        self.slot_shift = np.uint64(64 - bits)
        key, to, far = np.full(size + 64, -1, dtype=np.int64), np.zeros(size + 64, dtype=np.int32), 0
        slots = self._slot(np.array(list(self.trie), dtype=np.int64)).tolist()
        for (k, v), s in zip(self.trie.items(), slots, strict=True):
            p = s
            while key[p] >= 0:
                p += 1
            key[p], to[p], far = k, v, max(far, p - s)
        self.hash_key, self.hash_to, self.far = key, to, far

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.slot_shift).astype(np.int64)

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The next trie node, or 0."""
        key = node * self.width + char
        slot = self._slot(key)
        out = np.where(self.hash_key[slot] == key, self.hash_to[slot], 0)
        open_ = np.flatnonzero((out == 0) & (self.hash_key[slot] >= 0))
        for p in range(1, self.far + 1):
            if not len(open_):
                break
            s = slot[open_] + p
            found = self.hash_key[s] == key[open_]
            out[open_[found]] = self.hash_to[s[found]]
            open_ = open_[~found & (self.hash_key[s] >= 0)]
        return out

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces a and b stay apart under merging; unknown characters (id size) always do."""
        n, depth = self.size + 1, self.spine.shape[2]
        ok = np.ones(len(a), dtype=bool)
        todo = np.flatnonzero((a < self.size) & (b < self.size))
        i = np.zeros(len(todo), dtype=np.int64)
        j = np.zeros(len(todo), dtype=np.int64)
        while len(todo):
            x, y = self.spine[0, a[todo], i], self.spine[1, b[todo], j]
            up_x = np.where(i + 1 < depth, self.spine[0, a[todo], np.minimum(i + 1, depth - 1)], -1)
            up_y = np.where(j + 1 < depth, self.spine[1, b[todo], np.minimum(j + 1, depth - 1)], -1)
            grow_x, grow_y = np.where(up_x < 0, INF, self.time[up_x]), np.where(up_y < 0, INF, self.time[up_y])
            key = x * n + y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            cross = np.where(self.pair_keys[at] == key, np.maximum(self.pair_rank[at], np.maximum(self.time[x], self.time[y])), INF)
            barred = (cross < grow_x) & (cross <= grow_y) & (cross < INF)
            ok[todo[barred]] = False
            left = grow_x <= grow_y
            go = ~barred & ~((grow_x == INF) & (grow_y == INF))
            i, j, todo = (i + left)[go], (j + ~left)[go], todo[go]
        return ok

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """_apart, with a table of what has been asked lately."""
        key = a * (self.size + 1) + b
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
        ok = self.seen_ok[slot]
        new = np.flatnonzero(self.seen_key[slot] != key)
        if len(new):
            asked, back = np.unique(key[new], return_inverse=True)
            answer = self._apart(asked // (self.size + 1), asked % (self.size + 1))[back]
            ok[new] = answer
            order = new[np.argsort(slot[new], kind="stable")]
            last = np.flatnonzero(np.append(np.diff(slot[order]) != 0, True))
            keep = order[last]
            self.seen_key[slot[keep]], self.seen_ok[slot[keep]] = key[keep], ok[keep]
        return ok

    def codes(self, text: str) -> np.ndarray:
        return np.fromiter((self.chars.get(c, 0) for c in text), dtype=np.int64, count=len(text))

    def spell(self, ids: np.ndarray, text: str) -> np.ndarray:
        """Unknown characters, in order, as byte pieces."""
        if not (ids == self.size).any():
            return ids.astype(np.int32)
        out, at = [], 0
        for i in ids.tolist():
            if i == self.size:
                raw = text[at].encode("utf-8", "surrogatepass")
                out += [self.bytes[x] or self.unknown for x in raw]
                at += 1
            else:
                out.append(i)
                at += len(self.raw[i].decode())
        return np.array(out, dtype=np.int32)

    # --- the recurrence, many short stretches side by side ---------------------------------------------------

    def lanes(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each stretch."""
        out: list[np.ndarray | None] = [None] * len(texts)
        order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
        for at in range(0, len(order), 8192):
            group = order[at : at + 8192]
            sizes = np.array([len(texts[k]) for k in group])
            top = int(sizes[0])
            char = np.zeros((top, len(group)), dtype=np.int64)
            flat = self.codes("".join(texts[k] for k in group))
            lane = np.repeat(np.arange(len(group)), sizes)
            char[np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes), lane] = flat
            last = np.full((top + 1, len(group)), -1, dtype=np.int64)  # surviving piece at each boundary
            span = np.zeros((top + 1, len(group)), dtype=np.int64)  # its backpointer
            live = np.searchsorted(-sizes, -np.arange(1, top + 1), side="right")
            for t in range(top):
                lane = np.arange(live[t])
                node = np.zeros(len(lane), dtype=np.int64)
                strange = char[t, : live[t]] == 0
                last[t + 1, lane[strange]], span[t + 1, lane[strange]] = self.size, 1
                lane, node = lane[~strange], node[~strange]
                cands = []
                for back in range(min(t + 1, self.longest)):
                    node = self.step(node, char[t - back, lane])
                    alive = node > 0
                    lane, node = lane[alive], node[alive]
                    if not len(lane):
                        break
                    piece = self.node_piece[node]
                    hit = piece >= 0
                    if hit.any():
                        cands.append((lane[hit], piece[hit], np.full(int(hit.sum()), back + 1)))
                    deeper = ~self.leaf[node]
                    lane, node = lane[deeper], node[deeper]
                if cands:
                    lane, piece, length = (np.concatenate(x) for x in zip(*cands, strict=True))
                    before = last[t + 1 - length, lane]
                    ok = before < 0
                    inner = np.flatnonzero(~ok)
                    ok[inner] = self.apart(before[inner], piece[inner])
                    last[t + 1, lane[ok]], span[t + 1, lane[ok]] = piece[ok], length[ok]
            at_end, lane, steps = sizes.copy(), np.arange(len(group)), []
            while len(lane):
                steps.append((lane, last[at_end[lane], lane]))
                at_end[lane] -= span[at_end[lane], lane]
                lane = lane[at_end[lane] > 0]
            who, what = np.concatenate([s[0] for s in steps][::-1]), np.concatenate([s[1] for s in steps][::-1])
            by = np.argsort(who, kind="stable")
            for k, ids in zip(group, np.split(what[by], np.cumsum(np.bincount(who, minlength=len(group)))[:-1]), strict=True):
                out[k] = self.spell(ids, texts[k])
        return out


class Stream:
    """The same recurrence over one unbounded stretch; holds a window and the ids not yet committed."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.w = vocabulary, vocabulary.longest
        self.chars: list[int] = []  # of the window
        self.base = 0  # boundary at which last and span begin
        self.at = 0
        self.last: list[int] = [-1]
        self.span: list[int] = [0]
        self.memo: dict[tuple[int, int], bool] = {}

    def _apart(self, a: int, b: int) -> bool:
        key = (a, b)
        if key not in self.memo:
            if len(self.memo) > MEMO:
                self.memo.clear()
            self.memo[key] = bool(self.v.apart(np.array([a]), np.array([b]))[0])
        return self.memo[key]

    def feed(self, text: str):
        """Take more characters; yield the ids that are settled."""
        v = self.v
        for c in text:
            code = v.chars.get(c, 0)
            self.chars.append(code)
            del self.chars[: -self.w]
            self.at += 1
            piece, length = (v.size, 1) if code == 0 else (-1, 0)
            node = 0
            for back in range(1, min(len(self.chars), self.at - self.base if code else 0) + 1):
                node = v.trie.get(node * v.width + self.chars[-back], 0)
                if not node:
                    break
                found = int(v.node_piece[node])
                if found >= 0:
                    before = self.last[self.at - back - self.base]
                    if before < 0 or self._apart(before, found):
                        piece, length = found, back
            self.last.append(piece)
            self.span.append(length)
            if self.at % COMMIT_EVERY == 0:
                yield from self._commit()

    def _commit(self):
        """Ids before the boundary in which the paths from all boundaries of the window meet."""
        open_ = {k for k in range(max(self.base, self.at - self.w + 1), self.at + 1)}
        while len(open_) > 1:
            top = max(open_)
            open_.remove(top)
            open_.add(top - self.span[top - self.base] if top > self.base else top)
        yield from self._take(open_.pop())

    def _take(self, boundary: int):
        out, k = [], boundary
        while k > self.base:
            out.append(self.last[k - self.base])
            k -= self.span[k - self.base]
        cut = boundary - self.base
        if cut:
            del self.last[:cut], self.span[:cut]
            self.base = boundary
        yield from reversed(out)

    def finish(self):
        yield from self._take(self.at)


class Encoder:
    """Encodes whole texts; remembers a bounded number of stretches."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.memo: dict[str, bytes] = {}

    def _long(self, stretch: str) -> bytes:
        stream = Stream(self.v)
        ids = list(stream.feed(stretch))
        ids += stream.finish()
        return self.v.spell(np.array(ids, dtype=np.int64), stretch).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        v = self.v
        cut = [v.stretch.findall(v.prefix + t.replace(" ", MARK)) if t else [] for t in texts]
        new = set(chain.from_iterable(cut)).difference(self.memo)
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
            new = set(chain.from_iterable(cut))
        short = [s for s in new if len(s) <= LONG]
        known = self.memo if len(new) <= MEMO else dict(self.memo)  # too many at once are not remembered
        known.update(zip(short, map(np.ndarray.tobytes, v.lanes(short)), strict=True))
        for s in new:
            if len(s) > LONG:
                known[s] = self._long(s)
        out = [np.frombuffer(b"".join(map(known.__getitem__, c)), dtype=np.int32) for c in cut]
        for s in new:
            if len(s) > LONG:
                known.pop(s, None)
        return out

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.v.raw.__getitem__, ids.tolist()))
        text = raw.decode("utf-8", "replace")
        return text[1:] if self.v.prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each model file and Python worker."""
    return Encoder(Vocabulary(path))


def _parts(texts: list[str | None], most: int = 2_000_000):
    """Runs of texts of about so many characters."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(texts):
        yield at, len(texts)


def encode(docs: DataFrame, model: str, text: str = "text", check: bool = False) -> DataFrame:
    """docs with ids (array<int>) and n_tokens; with check also round_trip, whether decoding gives the text back."""
    small_batches(docs.sparkSession)
    added = ["ids", "n_tokens"] + ["round_trip"] * check
    docs = docs.drop(*[c for c in added if c != text])
    at = position(docs, text)
    fields = [*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())]
    fields += [T.StructField("round_trip", T.BooleanType())] * check
    names = [f.name for f in fields]

    def run(batches):
        own = encoder(model)
        for b in batches:
            texts = b.column(at).to_pylist()
            for lo, hi in _parts(texts):
                some = texts[lo:hi]
                ids = own.encode([t or "" for t in some])
                null = np.array([t is None for t in some])
                sizes = np.array([len(x) for x in ids], dtype=np.int32)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.append(null, False))
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32()))
                more = [lists, pa.array(sizes.astype(np.int64), mask=null)]
                if check:
                    same = [t is not None and own.decode(x) == t for t, x in zip(some, ids, strict=True)]
                    more.append(pa.array(np.array(same, dtype=bool), mask=null))
                yield pa.RecordBatch.from_arrays([*b.slice(lo, hi - lo).columns, *more], names)

    return docs.mapInArrow(run, T.StructType(fields))


def decode(rows: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """rows with text decoded from the column ids; null ids give null text."""
    small_batches(rows.sparkSession)
    rows = rows.drop("text")
    at = position(rows, ids)
    schema = T.StructType([*rows.schema.fields, T.StructField("text", T.StringType())])

    def run(batches):
        own = encoder(model)
        for b in batches:
            texts = [None if not x.is_valid else own.decode(x.values.to_numpy(zero_copy_only=False)) for x in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], schema.names)

    return rows.mapInArrow(run, schema)
