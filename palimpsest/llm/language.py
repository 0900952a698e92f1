"""Language ID by a byte convolutional network.

Filters of several widths slide over embedded UTF-8 bytes of fixed-length windows, a maximum is pooled for each
filter, and a softmax layer names the language. The network is trained in numpy on a bounded sample of labelled
rows; prediction covers all windows of the whole text, weighs each window by its letters, and averages.

The sample: of every label about PER_LABEL rows, chosen by hash, and a piece of PIECE characters of each at a place set
by that hash. More than MAX_LABELS labels raise an error, as the network could not name the others. All other work covers all rows, in the scan stage.

Defined results. Null text, or a text without a letter, gives `und` and score 0. With no labelled row everything
is `und` with score 0. Repeated rows are predicted independently and alike. Empty tables give empty results. Input
columns that clash with the output columns are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.work import position, small_batches

WINDOW = 256
WIDTHS = (2, 3, 4, 5)
DIM = 8
FILTERS = 12
REACH = max(WIDTHS)
CHUNK = 96  # windows at a time: what they take stays in the cache
PER_LABEL = 400
PIECE = 600
MAX_LABELS = 1024
UNKNOWN = "und"
REJECT = "(noise)"
NOISE = 400
HELD_OUT = 2
_WORD = re.compile(r"[^\W\d_]+")
_IS_LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])


def has_letter(text: str) -> bool:
    """Whether a text holds a character of a letter category; ½ and ² are word characters but no letters."""
    return any(any(map(str.isalpha, m[0])) for m in _WORD.finditer(text))


class Network:
    """Weights and the two passes."""

    def __init__(self, labels: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        n = FILTERS * len(WIDTHS)
        self.labels = labels
        self.embed = rng.normal(0, 0.5, (256, DIM)).astype(np.float32)
        self.embed[0] = 0
        self.kernel = rng.normal(0, 0.3, (REACH, DIM, n)).astype(np.float32)
        self.open = np.zeros((REACH, 1, n), dtype=np.float32)
        for k, width in enumerate(WIDTHS):
            self.open[:width, :, k * FILTERS : (k + 1) * FILTERS] = 1
        self.kernel *= self.open
        self.bias = np.zeros(n, dtype=np.float32)
        self.out = rng.normal(0, 0.2, (n, len(labels))).astype(np.float32)
        self.out_bias = np.zeros(len(labels), dtype=np.float32)

    def columns(self, windows: np.ndarray) -> np.ndarray:
        """(windows * WINDOW, REACH * DIM): the embedded bytes that each position of a filter sees."""
        x = self.embed[windows]
        b, s = len(windows), x.strides
        view = np.lib.stride_tricks.as_strided(x, (b, WINDOW, REACH * DIM), (s[0], s[1], s[2]))
        return view.reshape(b * WINDOW, REACH * DIM)

    def responses(self, columns: np.ndarray) -> np.ndarray:
        flat = columns @ self.kernel.reshape(REACH * DIM, -1)
        return flat.reshape(-1, WINDOW, flat.shape[1])

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """(n, labels) for windows (n, WINDOW + REACH - 1) of bytes."""
        out = np.empty((len(windows), len(self.labels)), dtype=np.float64)
        for k in range(0, len(windows), CHUNK):
            pooled = self.responses(self.columns(windows[k : k + CHUNK])).max(axis=1) + self.bias
            out[k : k + CHUNK] = softmax(np.maximum(pooled, 0) @ self.out + self.out_bias)
        return out

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.kernel, self.bias, self.out, self.out_bias]

    def gradients(self, windows: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
        b = len(windows)
        columns = self.columns(windows)
        reply = self.responses(columns)
        at = reply.argmax(axis=1)
        pooled = np.take_along_axis(reply, at[:, None, :], 1)[:, 0] + self.bias
        hidden = np.maximum(pooled, 0)
        error = softmax(hidden @ self.out + self.out_bias).astype(np.float32)
        error[np.arange(b), target] -= 1
        error /= b
        back = (error @ self.out.T) * (pooled > 0)
        rows = (np.arange(b)[:, None] * WINDOW + at).ravel()
        seen = columns[rows].reshape(b, at.shape[1], REACH, DIM)
        g_kernel = np.einsum("bf,bfkd->kdf", back, seen) * self.open
        g_seen = np.einsum("bf,kdf->bfkd", back, self.kernel)
        places = windows[np.arange(b)[:, None, None], at[:, :, None] + np.arange(REACH)]
        g_embed = np.zeros_like(self.embed)
        np.add.at(g_embed, places.ravel(), g_seen.reshape(-1, DIM))
        g_embed[0] = 0
        return [g_embed, g_kernel, back.sum(0), hidden.T @ error, error.sum(0)]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts data[starts[i]:ends[i]]: (windows, text of each window, letters in each window)."""
    sizes = np.maximum(ends - starts, 0)
    many = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(starts)), many)
    first = np.cumsum(many) - many
    begin = starts[owner] + (np.arange(len(owner)) - first[owner]) * WINDOW
    at = begin[:, None] + np.arange(WINDOW + REACH - 1)
    inside = at < ends[owner][:, None]
    windows = np.where(inside, data[np.where(inside, at, 0)] if len(data) else 0, 0).astype(np.uint8)
    return windows, owner, _IS_LETTER[windows[:, :WINDOW]].sum(axis=1)


def noise(texts: list[str], n: int = NOISE, seed: int = 7) -> list[str]:
    """n pieces that are in no language: half are words of random letters of the texts, half texts with their characters shuffled."""
    rng = np.random.default_rng(seed)
    letters = sorted({c for t in texts for c in t if c.isalpha()}) or ["a"]
    out = []
    for k in range(n):
        if k % 2 or not texts:
            sizes = rng.integers(2, 11, size=100)
            some = letters if k % 4 == 1 else [c for c in letters if c.isascii()] or letters
            out.append(" ".join("".join(rng.choice(some, size=s)) for s in sizes))
        else:
            out.append("".join(rng.permutation(list(texts[int(rng.integers(len(texts)))]))))
    return out


def train(texts: list[str], labels: list[str], epochs: int = 6, seed: int = 7, reject: bool = False) -> Network | None:
    """Fit a network on labelled pieces of text; None if there are none. With reject, one more label, REJECT, stands for noise."""
    if not labels:
        return None
    if reject:
        made = noise(texts, seed=seed)
        texts, labels = [*texts, *made], [*labels, *[REJECT] * len(made)]
    names = sorted(set(labels))
    net, rng = Network(names, seed), np.random.default_rng(seed)
    index = {name: k for k, name in enumerate(names)}
    windows, target = [], []
    for text, label in zip(texts, labels, strict=True):
        raw = text.encode("utf-8", "replace")
        for size in (WINDOW, WINDOW, 96, 32):  # short windows too, as short texts have
            at = int(rng.integers(0, max(1, len(raw) - size + 1)))
            piece = np.zeros(WINDOW + REACH - 1, dtype=np.uint8)
            take = raw[at : at + (len(piece) if size == WINDOW else size)]
            piece[: len(take)] = np.frombuffer(take, dtype=np.uint8)
            if _IS_LETTER[piece].any():
                windows.append(piece)
                target.append(index[label])
    if len(names) == 1 or not windows:
        return net
    x, y = np.array(windows), np.array(target)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    step = 0
    for epoch in range(epochs):
        rate = 0.004 * (1 - epoch / epochs) + 0.0004
        order = rng.permutation(len(x))
        for k in range(0, len(x), 64):
            rows, step = order[k : k + 64], step + 1
            for p, g, (m, v) in zip(net.parameters(), net.gradients(x[rows], y[rows]), moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def held_out(doc_id: Column) -> Column:
    """True for the fold that is never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def sample(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[list[str], list[str]]:
    """The bounded training sample: (pieces, labels). The id chooses rows and is not part of it."""
    body = F.col("text")
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))
    rows = rows.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & body.isNotNull() & F.col("lang").isNotNull())
    many = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MAX_LABELS + 1).collect()}
    if len(many) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels: map rare ones to a common name")
    if not many:
        return [], []
    h = F.xxhash64("doc_id", "text")
    place = F.pmod(h, F.greatest(F.length(body) - PIECE, F.lit(0)) + 1) + 1
    bounds = [F.lit(x) for name, n in many.items() for x in (name, min(1 << 30, (PER_LABEL << 30) // n + 1))]
    bound = F.element_at(F.create_map(*bounds), F.col("lang"))
    rows = rows.filter(F.pmod(F.shiftrightunsigned(h, 8), F.lit(1 << 30)) < bound)
    found = rows.select("lang", F.substr(body, place.cast("int"), F.lit(PIECE)).alias("piece")).limit(2 * PER_LABEL * len(many)).collect()
    pairs = sorted((r.lang, r.piece) for r in found)
    return [p for _, p in pairs], [name for name, _ in pairs]


def predict_batch(net: Network | None, text: pa.Array) -> tuple[list[str], np.ndarray]:
    n = len(text)
    names, score = [UNKNOWN] * n, np.zeros(n)
    if net is None or not n:
        return names, score
    text = text.cast(pa.large_string())
    _, offsets, data = text.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[text.offset : text.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    valid = text.is_valid().to_numpy(zero_copy_only=False)
    starts, ends = offsets[:-1], np.where(valid, offsets[1:], offsets[:-1])
    total = np.zeros((n, len(net.labels)))
    weight = np.zeros(n)
    many = -(-(ends - starts) // WINDOW)
    upto = np.cumsum(many)
    at = 0
    while at < n:  # a bounded number of windows at a time, whatever the texts' lengths; one text may be cut too
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + 4096, side="right")))
        pieces = [(starts[at:stop], ends[at:stop])]
        if stop == at + 1 and many[at] > 4096:
            edges = np.arange(starts[at], ends[at], 4096 * WINDOW)
            pieces = [(edges[k : k + 1], np.minimum(edges[k : k + 1] + 4096 * WINDOW, ends[at])) for k in range(len(edges))]
        for a, b in pieces:
            windows, owner, letters = cut(data, a, b)
            used = letters > 0
            owner = owner[used] + at
            np.add.at(total, owner, net.probabilities(windows[used]) * letters[used, None])
            np.add.at(weight, owner, letters[used])
        at = stop
    best = total.argmax(axis=1)
    for i in np.flatnonzero(weight):
        if has_letter(text[i].as_py()):
            names[i] = net.labels[best[i]]
            score[i] = min(1.0, total[i, best[i]] / weight[i])
    return names, score


def predict(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """docs with lang_pred and score."""
    small_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    at = position(docs, text)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        for b in batches:
            names, score = predict_batch(net, b.column(at))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(score)], schema.names)

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", reject: bool = False) -> DataFrame:
    """Train on the labelled rows outside the held-out fold and predict every row; with reject, REJECT is a prediction too."""
    return predict(docs, train(*sample(docs, doc_id, text, lang), reject=reject), text)
