"""Similarities of cells and strings in [0, 1]."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


CHUNK = 2048  # strings whose characters are held as masks at a time


@dataclass(frozen=True)
class SimConfig:
    row_threshold: float = 0.6
    num_rel_tol: float = 0.05
    string_soft: bool = True


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a machine word of positions at a time (Python's long integers)."""
    if len(a) < len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for k, c in enumerate(b):
        where[c] = where.get(c, 0) | (1 << k)
    full = (1 << len(b)) - 1
    free = full  # a zero bit marks a place at which the subsequence grew
    for c in a:
        hits = where.get(c)
        if hits:
            grown = free & hits
            free = ((free + grown) | (free - grown)) & full
    return len(b) - free.bit_count()


def string_ratio(a: str, b: str) -> float:
    """2 * LCS / (length + length); two empty strings are alike."""
    if a == b:
        return 1.0
    n = len(a) + len(b)
    return 2.0 * lcs_length(a, b) / n if n else 1.0


def _points(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All characters one after the other, and where each string begins (one place more than strings)."""
    flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return flat, np.cumsum([0, *map(len, strings)])


def short_lcs(a: list[str], b: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """lcs_length of the pairs (a[i], b[j]); the strings of b that are asked for hold at most 64 characters.

    Every pair is one machine word, and all words take a step together: a character of each left string.
    """
    out = np.zeros(len(i), dtype=np.int64)
    if not len(i):
        return out
    points_a, at_a = _points(a)
    points_b, at_b = _points(b)
    size_a, size_b = np.diff(at_a), np.diff(at_b)
    order = np.lexsort((-size_a[i], j // CHUNK))
    for part in np.split(order, np.flatnonzero(np.diff(j[order] // CHUNK)) + 1):
        left, right = i[part], j[part]  # the longest left strings first, so that those still running are a beginning
        low, high = at_b[right.min() // CHUNK * CHUNK], at_b[min(len(b), right.min() // CHUNK * CHUNK + CHUNK)]
        own = np.repeat(np.arange(len(b)), np.minimum(size_b, high))[low:high] - right.min() // CHUNK * CHUNK
        place = np.arange(low, high) - np.repeat(at_b[:-1], size_b)[low:high]
        usable = place < 64
        alphabet, code = np.unique(points_b[low:high][usable], return_inverse=True)
        where = np.zeros((len(alphabet) + 1, CHUNK), dtype=np.uint64)
        np.bitwise_or.at(where, (code, own[usable]), np.uint64(1) << place[usable].astype(np.uint64))
        full = np.where(size_b[right] >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(size_b[right], 63).astype(np.uint64)) - np.uint64(1))
        found = np.searchsorted(alphabet, points_a)
        codes = np.where(np.append(alphabet, 0)[found] == points_a, found, len(alphabet)) if len(alphabet) else np.zeros(len(points_a), dtype=int)
        codes = np.where(found >= len(alphabet), len(alphabet), codes)
        free, begin, column, sizes = full.copy(), at_a[left], right % CHUNK, size_a[left]
        for step in range(int(sizes[0])):
            live = int(np.searchsorted(-sizes, -step, side="left"))
            now = free[:live]
            grown = now & where[codes[begin[:live] + step], column[:live]]
            free[:live] = ((now + grown) | (now - grown)) & full[:live]
        out[part] = size_b[right] - np.bitwise_count(free)
    return out


def string_ratios(a: list[str], b: list[str], i: np.ndarray, j: np.ndarray, need: np.ndarray | None = None) -> np.ndarray:
    """string_ratio of the pairs (a[i], b[j]). Where need is given, a ratio that cannot reach it may come out as 0."""
    la, lb = np.array([len(x) for x in a], dtype=np.int64), np.array([len(y) for y in b], dtype=np.int64)
    total = la[i] + lb[j]
    lcs = np.zeros(len(i), dtype=np.int64)
    ahead, turned = lb[j] <= 64, (lb[j] > 64) & (la[i] <= 64)
    lcs[ahead] = short_lcs(a, b, i[ahead], j[ahead])
    lcs[turned] = short_lcs(b, a, j[turned], i[turned])
    long_ = np.flatnonzero(~ahead & ~turned)
    chars: dict[str, Counter] = {}
    for k in long_.tolist():
        x, y = a[i[k]], b[j[k]]
        want = 0.0 if need is None else need[k] * total[k] / 2
        if min(len(x), len(y)) < want:
            continue
        if want > 0:
            for z in (x, y):
                if z not in chars:
                    chars[z] = Counter(z)
            if (chars[x] & chars[y]).total() < want:
                continue
        lcs[k] = lcs_length(x, y)
    return np.where(total > 0, 2.0 * lcs / np.maximum(total, 1), 1.0)


def numeric_ratio(a: float, b: float, scale: float, tol: float) -> float:
    """1 within the tolerance, then falling linearly to 0 at one scale."""
    gap = abs(a - b)
    return 1.0 if gap <= tol * scale else max(0.0, 1.0 - gap / scale) if math.isfinite(gap) else 0.0


def numeric_similarity(a: Column, b: Column, scale: float, tol: float) -> Column:
    """The same as a column expression; null on both sides is 1, on one side 0; NaN is null."""
    a, b = F.nanvl(a.cast("double"), F.lit(None)), F.nanvl(b.cast("double"), F.lit(None))
    gap = F.abs(a - b)
    near = F.when(gap <= tol * scale, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - gap / scale))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(F.nanvl(near, F.lit(0.0)))


@F.pandas_udf(T.DoubleType())
def string_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """string_ratio over Arrow batches; null on both sides is 1, on one side 0."""
    memo: dict[tuple[str, str], float] = {}
    out = []
    for x, y in zip(a, b, strict=True):
        if x is None or y is None:
            out.append(1.0 if x is None and y is None else 0.0)
        else:
            if (x, y) not in memo:
                memo[x, y] = string_ratio(x, y)
            out.append(memo[x, y])
    return pd.Series(out, dtype="float64")
