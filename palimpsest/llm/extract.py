"""HTML extraction by a recurrent block labeller.

A page becomes a sequence of blocks (module blocks). Every block has a tag-path vector, a hashed-word vector and a
few ratios, among them the density of text and links in the element that holds it; a bidirectional LSTM in numpy reads the sequence of the whole page in both directions and labels each
block as article or not. The article blocks, in page order, joined by an empty line, are the text.

The network is trained on seeded pages of known layout (module pages_made), never on the input, so the result of a
page depends on that page alone: scan stage only, no shuffle. Pages go through the network in groups of like length.

Defined results. Null or empty html, or a page without article blocks, gives the empty string and 0 characters.
Pages of any length and depth are read whole; of a path deeper than blocks.OUTER + INNER its two ends are kept. Repeated rows are extracted alike; empty tables give empty results; input columns
that clash with the outputs are replaced.
"""

from __future__ import annotations

import math
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from palimpsest.llm.blocks import Leaf, leaves
from palimpsest.llm.pages_made import Maker, known_words
from palimpsest.llm.work import small_batches, without

TAGS = 32
NAMES = {w: k for k, w in enumerate(known_words())}
PATH = 2 * TAGS + len(NAMES) + 1
WORDS = 32
RATIOS = 11
INPUT = PATH + WORDS + RATIOS
HIDDEN = 20
MEMO = 100_000
GROUP_CELLS = 60_000  # blocks, padding included, that pass the network at a time
GAP = "\n\n"


class Buckets(dict):
    """Bucket of each word seen lately; emptied when it has grown to MEMO words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = k = zlib.crc32(word.encode("utf-8", "replace")) % WORDS
        return k


_BUCKETS = Buckets()


@lru_cache(maxsize=MEMO)
def _path(path: tuple[str, ...]) -> np.ndarray:
    """Tag path: hashed tags anywhere on the path and again for the innermost two, usual names of parts, and whether others occur."""
    v = np.zeros(PATH, dtype=np.float32)
    for k, key in enumerate(path):
        tag, *words = key.split(" ")
        v[zlib.crc32(tag.encode()) % TAGS] = 1
        if k >= len(path) - 2:
            v[TAGS + zlib.crc32(f"{len(path) - k} {tag}".encode()) % TAGS] = 1
        for w in words:
            v[2 * TAGS + NAMES.get(w, len(NAMES))] = 1
    return v


def _density(page: list[Leaf]) -> list[tuple[float, float, float, float, float]]:
    """For each block: words, share of link text and number of blocks in the element that holds its own, the same share a level up,
    and its part of the page's words."""
    held: dict[tuple, list[int]] = {}
    total = 0
    for leaf in page:
        n = leaf.text.count(" ") + 1
        total += n
        for up in (1, 2):
            one = held.setdefault((up, leaf.depth, leaf.path[:-up]), [0, 0, 0, 0])
            one[0] += n
            one[1] += min(leaf.link_chars, len(leaf.text))
            one[2] += len(leaf.text)
            one[3] += 1
    out = []
    for leaf in page:
        a, b = held[1, leaf.depth, leaf.path[:-1]], held[2, leaf.depth, leaf.path[:-2]]
        out.append((math.log1p(a[0]) / 6, a[1] / a[2], math.log1p(a[3]) / 4, b[1] / b[2], a[0] / total))
    return out


def features(pages: list[list[Leaf]]) -> list[np.ndarray]:
    """The vectors of all blocks of each page."""
    every = [leaf for page in pages for leaf in page]
    x = np.zeros((len(every), INPUT), dtype=np.float32)
    if every:
        words = [leaf.text.lower().split(" ") for leaf in every]
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        buckets = np.fromiter((_BUCKETS[w] for one in words for w in one), dtype=np.int64, count=int(sizes.sum()))
        counts = np.bincount(np.repeat(np.arange(len(every)), sizes) * WORDS + buckets, minlength=len(every) * WORDS)
        x[:, :PATH] = [_path(leaf.path) for leaf in every]
        x[:, PATH : PATH + WORDS] = counts.reshape(-1, WORDS) / sizes[:, None]
        ratios = x[:, PATH + WORDS :]
        ratios[:, 0] = np.log1p(sizes) / 4
        ratios[:, 1] = [min(1.0, leaf.link_chars / len(leaf.text)) for leaf in every]
        ratios[:, 2] = [leaf.text[-1] in ".!?:\"'" for leaf in every]
        ratios[:, 3] = [k / len(page) for page in pages for k in range(len(page))]
        ratios[:, 4] = [min(leaf.depth, 30) / 10 for leaf in every]
        ratios[:, 5:10] = [d for page in pages for d in _density(page)]
        ratios[:, 10] = 1
    return np.split(x, np.cumsum([len(p) for p in pages])[:-1])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Direction:
    """One LSTM direction over padded sequences (time, batch, input)."""

    def __init__(self, rng: np.random.Generator):
        self.wx = (rng.normal(0, 1, (INPUT, 4 * HIDDEN)) / np.sqrt(24)).astype(np.float32)
        self.wh = (rng.normal(0, 1, (HIDDEN, 4 * HIDDEN)) / np.sqrt(HIDDEN)).astype(np.float32)
        self.b = np.zeros(4 * HIDDEN, dtype=np.float32)
        self.b[HIDDEN : 2 * HIDDEN] = 1

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        steps, batch, _ = x.shape
        pre = x.reshape(steps * batch, INPUT) @ self.wx + self.b
        pre = pre.reshape(steps, batch, 4 * HIDDEN)
        h = np.zeros((batch, HIDDEN), dtype=np.float32)
        c = np.zeros_like(h)
        out = np.empty((steps, batch, HIDDEN), dtype=np.float32)
        tape = []
        for t in range(steps):
            z = pre[t] + h @ self.wh
            s = _sigmoid(z)
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 3 * HIDDEN :]
            g = np.tanh(z[:, 2 * HIDDEN : 3 * HIDDEN])
            m = mask[t][:, None]
            c_new = f * c + i * g
            th = np.tanh(c_new)
            if keep:
                tape.append((h, c, i, f, g, o, th))
            h = np.where(m, o * th, h)
            c = np.where(m, c_new, c)
            out[t] = h
        return out, tape

    def backward(self, x, mask, tape, d_out):
        steps, batch, _ = x.shape
        d_pre = np.zeros((steps, batch, 4 * HIDDEN), dtype=np.float32)
        g_wh = np.zeros_like(self.wh)
        dh = np.zeros((batch, HIDDEN), dtype=np.float32)
        dc = np.zeros_like(dh)
        for t in range(steps - 1, -1, -1):
            h, c, i, f, g, o, th = tape[t]
            m = mask[t][:, None]
            dh = dh + d_out[t]
            d_new, dc_new = np.where(m, dh, 0), np.where(m, dc, 0)
            d_c = dc_new + d_new * o * (1 - th * th)
            d_pre[t] = np.concatenate(
                [d_c * g * i * (1 - i), d_c * c * f * (1 - f), d_c * i * (1 - g * g), d_new * th * o * (1 - o)], axis=1
            )
            g_wh += h.T @ d_pre[t]
            dh = np.where(m, d_pre[t] @ self.wh.T, dh)
            dc = np.where(m, d_c * f, dc)
        flat = d_pre.reshape(-1, 4 * HIDDEN)
        return [x.reshape(-1, INPUT).T @ flat, g_wh, flat.sum(0)]

    def parameters(self):
        return [self.wx, self.wh, self.b]


class Labeller:
    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.ahead, self.back = Direction(rng), Direction(rng)
        self.out = rng.normal(0, 0.2, 2 * HIDDEN + INPUT).astype(np.float32)
        self.bias = np.zeros(1, dtype=np.float32)

    def parameters(self):
        return [*self.ahead.parameters(), *self.back.parameters(), self.out, self.bias]

    def scores(self, x, mask, keep: bool = False):
        a, tape_a = self.ahead.forward(x, mask, keep)
        b, tape_b = self.back.forward(x[::-1], mask[::-1], keep)
        joined = np.concatenate([a, b[::-1], x], axis=2)
        return joined @ self.out + self.bias, joined, tape_a, tape_b

    def gradients(self, x, mask, y):
        score, joined, tape_a, tape_b = self.scores(x, mask, True)
        error = (np.where(mask, _sigmoid(score) - y, 0) / max(1, mask.sum())).astype(np.float32)
        d = error[:, :, None] * self.out
        g_a = self.ahead.backward(x, mask, tape_a, d[:, :, :HIDDEN])
        g_b = self.back.backward(x[::-1], mask[::-1], tape_b, d[::-1, :, HIDDEN : 2 * HIDDEN])
        g_out = np.tensordot(error, joined, axes=([0, 1], [0, 1]))
        return [*g_a, *g_b, g_out, error.sum(keepdims=True).reshape(1)]

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """For each page, whether each block belongs to the article."""
        out = [np.zeros(0, dtype=bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end - at + 1) * len(pages[order[end]]) <= GROUP_CELLS:
                end += 1
            group = order[at:end]
            x, mask = padded([pages[k] for k in group])
            score = self.scores(x, mask)[0]
            for col, k in enumerate(group):
                out[k] = score[: len(pages[k]), col] > 0
            at = end
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x = np.zeros((steps, len(pages), INPUT), dtype=np.float32)
    mask = np.zeros((steps, len(pages)), dtype=bool)
    for col, p in enumerate(pages):
        x[: len(p), col] = p
        mask[: len(p), col] = True
    return x, mask


def made(n: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """n seeded pages as (features, labels)."""
    maker, out = Maker(seed), []
    while len(out) < n:
        page = leaves(maker.page())
        if page:
            truth = np.array(["\x02" in leaf.text for leaf in page])
            clean = [leaf._replace(text=leaf.text.replace("\x02", "") or "-") for leaf in page]
            out.append((features([clean])[0], truth))
    return out


@lru_cache(maxsize=2)
def trained(n_pages: int = 4000, epochs: int = 8, seed: int = 11) -> Labeller:
    """The labeller, trained on n_pages seeded pages."""
    data, model = made(n_pages, seed), Labeller(seed)
    rng = np.random.default_rng(seed)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in model.parameters()]
    step = 0
    for epoch in range(epochs):
        rate = 0.008 * (1 - epoch / epochs) + 0.0005
        order = sorted(range(len(data)), key=lambda k: len(data[k][0]) + rng.random() * 12)
        groups = [order[k : k + 24] for k in range(0, len(order), 24)]
        for g in rng.permutation(len(groups)):
            x, mask = padded([data[k][0] for k in groups[g]])
            y = np.zeros(mask.shape, dtype=np.float32)
            for col, k in enumerate(groups[g]):
                y[: len(data[k][1]), col] = data[k][1]
            step += 1
            for p, grad, (m, v) in zip(model.parameters(), model.gradients(x, mask, y), moments, strict=True):
                grad = np.clip(grad, -1, 1)
                m += 0.1 * (grad - m)
                v += 0.002 * (grad * grad - v)
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.998**step)) + 1e-8)).astype(np.float32)
    return model


def main_texts(model: Labeller, pages: list[str | None]) -> list[str]:
    out = []
    for k in range(0, len(pages), 64):  # so many pages' features at a time
        parsed = [leaves(p) for p in pages[k : k + 64]]
        kept = model.label(features(parsed))
        out += [GAP.join(leaf.text for leaf, yes in zip(p, keep, strict=True) if yes) for p, keep in zip(parsed, kept, strict=True)]
    return out


def extract(pages: DataFrame, html: str = "html", model: Labeller | None = None) -> DataFrame:
    """pages with text and n_chars in place of the html column."""
    small_batches(pages.sparkSession)
    model = model or trained()
    rest = without(pages.columns, html, "text", "n_chars")
    slim = pages.select(*[f"`{c}`" for c in rest], f"`{html}`")
    fields = [slim.schema[c] for c in rest] + [T.StructField("text", T.StringType(), False), T.StructField("n_chars", T.LongType(), False)]

    def run(batches):
        for b in batches:
            texts = main_texts(model, b.column(len(rest)).to_pylist())
            sizes = pa.array([len(t) for t in texts], pa.int64())
            texts = pa.array([t.encode("utf-8", "replace").decode() for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], texts, sizes], [f.name for f in fields])

    return slim.mapInArrow(run, T.StructType(fields))
