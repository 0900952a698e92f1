"""License scans by patience alignment.

A text and a template are compared as words. Anchors are words that occur once in both; the longest increasing run of
anchors is kept; equal words next to an anchor are taken along; and the gaps between anchors are aligned in the same way,
where more words have become unique. Coverage is the part of the template's words that are aligned, and a template is
found where that is at least THRESHOLD.

Where to align. A place with the threshold coverage holds at least one of any `missing allowed + 1` different words of
the template, so those most telling ones are looked for. Each occurrence foretells where the template would begin;
occurrences that foretell nearly the same are one region. So several copies in a text are found each by itself.

Insertions. A region reaches a little beyond the template's length, so a longer insertion parts a notice. What lies
outside the regions found is therefore searched again with gaps of any length: of all places where two neighbouring words
of the template are neighbours in the text, the longest run rising in both is taken. Single words do not count there, as
the common ones occur in any long text, nor do pairs of plain words. What stands in a gap is looked at by itself: only a finding within one piece of a
longer one, or a parted one with most of its words there, is left out. Coverage then counts to a little beyond the template's length after enough has been met: a last
part behind another long insertion does not raise it.

Kin. Words that tell a version or variant (DECISIVE) must be aligned, and words of another license (FOREIGN) be absent,
before a license is named.

Defined results. Null and blank texts, and texts without a license, give no row. Texts of any length are read whole.
Repeated rows give repeated results; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.license_texts import TEXTS
from palimpsest.llm.work import small_batches

THRESHOLD = 0.8
LONG = 40
_WORD = re.compile(r"[^\W_]+(?:[.\-'][^\W_]+)*")

# Usual wordings of license notices, and whole texts.
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT-notice": "Released under the MIT License",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + TEXTS["MIT-warranty"],
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "BSD-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-2-Clause": TEXTS["BSD-2-Clause"],
    "BSD-3-Clause": TEXTS["BSD-3-Clause"],
    "ISC": TEXTS["ISC"],
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0",
    "CC-BY-ND-4.0-notice": "Licensed under CC BY-ND 4.0",
    "CC-BY-NC-SA-4.0-notice": "Licensed under CC BY-NC-SA 4.0",
    "CC-BY-NC-ND-4.0-notice": "Licensed under CC BY-NC-ND 4.0",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2",
    "LGPL-2.1-notice": "This work is licensed under the GNU Lesser General Public License, version 2.1",
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3",
    "AGPL-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    **{name: TEXTS[name] for name in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0")},
    "All-rights-reserved": "All rights reserved",
}
#: What tells versions and variants apart: of each group one word must be aligned, or stand in the notice in place of the first.
DECISIVE = {
    "Apache-2.0-notice": [["apache"], ["2.0", "2"]],
    "Apache-2.0-header": [["apache"], ["2.0", "2"]],
    "MIT-notice": [["mit"]],
    "BSD-3-Clause": [["endorse", "promote"]],
    "MPL-2.0-notice": [["mozilla"], ["2.0", "2"]],
    "MPL-2.0": [["2.0", "2"]],
    "GPL-2.0": [["1991"]],
    "GPL-3.0": [["29"], ["june"], ["2007"]],
    "LGPL-2.1": [["2.1"], ["lesser"]],
    "LGPL-3.0": [["lesser"]],
    "CC-BY-4.0-notice": [["by"], ["4.0"]],
    **{f"CC-{x}-4.0-notice": [[x.lower()], ["4.0"]] for x in ("BY-NC", "BY-SA", "BY-ND", "BY-NC-SA", "BY-NC-ND")},
    **{f"GPL-{v}-{k}": [["general"], [v[0], v, "v" + v[0]]] for v in ("2.0", "3.0") for k in ("notice", "header")},
    **{f"LGPL-2.1-{k}": [["lesser"], ["2.1", "v2.1"]] for k in ("notice", "header")},
    "LGPL-3.0-notice": [["lesser"], ["3", "3.0", "v3"]],
    **{f"AGPL-3.0-{k}": [["affero"], ["3", "3.0", "v3"]] for k in ("notice", "header")},
}
#: Words that make a notice another license's.
FOREIGN = {"BSD-2-Clause": {"endorse", "promote"}, **{f"GPL-{v}-{k}": {"lesser", "library", "affero"} for v in ("2.0", "3.0") for k in ("notice", "header")}}
_PLAIN = set("the of and to in a is that for it with as was on be by this are from or an at not under all any you version".split())


class Template(NamedTuple):
    name: str
    words: list[str]
    telling: list[tuple[str, int]]  # a word and where it stands
    bag: Counter
    decisive: list[list[str]]
    foreign: set[str]
    least_chars: int  # no shorter text holds enough of its words


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def compile_templates(texts: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> list[Template]:
    out = []
    for name, text in texts.items():
        words = words_of(text)
        lost = int(len(words) * (1 - threshold) + 1e-9)
        chosen, places, many = set(), 0, Counter(words)
        for w in sorted(set(words), key=lambda w: (w in _PLAIN, many[w], -len(w), w)):
            if places > lost:
                break
            chosen.add(w)
            places += many[w]
        out.append(Template(name, words, [(w, k) for k, w in enumerate(words) if w in chosen], many, DECISIVE.get(name, []), FOREIGN.get(name, set()), sum(sorted(map(len, words))[: len(words) - lost])))
    return out


def _once(words: list[str], lo: int, hi: int) -> dict[str, int]:
    seen: dict[str, int] = {}
    for k in range(lo, hi):
        seen[words[k]] = -1 if words[k] in seen else k
    return seen


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs (sorted by first) with rising second."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, b) in enumerate(pairs):
        p = bisect_left(tops, b)
        back[k] = at[p - 1] if p else -1
        tops[p : p + 1] = [b]
        at[p : p + 1] = [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(a: list[str], b: list[str], a_lo: int = 0, a_hi: int | None = None) -> list[tuple[int, int]]:
    """Aligned places (in a[a_lo:a_hi], in b), rising in both."""
    out, todo = [], [(a_lo, len(a) if a_hi is None else a_hi, 0, len(b))]
    while todo:
        lo, hi, low, high = todo.pop()
        if lo >= hi or low >= high:
            continue
        once = _once(b, low, high)
        mine = {w: k for w, k in _once(a, lo, hi).items() if k >= 0 and once.get(w, -1) >= 0}
        anchors = _rising(sorted((k, once[w]) for w, k in mine.items()))
        if not anchors:
            while lo < hi and low < high and a[lo] == b[low]:  # a gap without anchors: what touches its ends
                out.append((lo, low))
                lo, low = lo + 1, low + 1
            while lo < hi and low < high and a[hi - 1] == b[high - 1]:
                hi, high = hi - 1, high - 1
                out.append((hi, high))
            continue
        last_a, last_b = lo, low
        for i, j in anchors:
            if i < last_a or j < last_b:  # taken along with the anchor before
                continue
            x, y = i, j
            while x > last_a and y > last_b and a[x - 1] == b[y - 1]:
                x, y = x - 1, y - 1
            todo.append((last_a, x, last_b, y))
            while x < hi and y < high and a[x] == b[y]:
                out.append((x, y))
                x, y = x + 1, y + 1
            last_a, last_b = x, y
        todo.append((last_a, hi, last_b, high))
    return sorted(out)


def _parted(words: list[str], t: Template, lo: int, hi: int, least: float) -> list[list[tuple[int, int]]]:
    """Alignments of at least `least` words in words[lo:hi], with gaps of any length between runs of two words or more."""
    at: dict[tuple[str, str], list[int]] = {}
    for j in range(len(t.words) - 1):
        if not {t.words[j], t.words[j + 1]} <= _PLAIN:
            at.setdefault((t.words[j], t.words[j + 1]), []).append(j)
    pairs = {(k + d, j + d) for k in range(lo, hi - 1) for j in at.get((words[k], words[k + 1]), ()) for d in (0, 1)}
    rest, out = sorted(pairs, key=lambda p: (p[0], -p[1])), []
    while rest:
        tops: list[int] = []
        end = None
        for k, j in rest:  # where enough has been met first
            p = bisect_left(tops, j)
            tops[p : p + 1] = [j]
            if len(tops) >= least:
                end = k + len(t.words) - j + max(2, len(t.words) // 4)
                break
        if end is None:
            break
        here = [p for p in rest if p[0] < end]
        # From behind, so that the alignment begins as late as it can.
        back = _rising(sorted(((-k, -j) for k, j in here), key=lambda p: (p[0], -p[1])))
        out.append([(-k, -j) for k, j in back[::-1]])
        rest = [p for p in rest if p[0] > out[-1][-1][0]]
    return out


def _named(words: list[str], t: Template, pairs: list[tuple[int, int]]) -> bool:
    """True if an alignment holds what tells this license from its kin, and no word of another."""
    have = {words[k] for k, _ in pairs}
    near = {w for a, b in _pieces(pairs, max(2, len(t.words) // 4)) for w in words[a : b + 2]} if t.decisive or t.foreign else set()
    return not near & t.foreign and all(g[0] in have or any(w in near for w in g[1:]) for g in t.decisive)


def _pieces(pairs: list[tuple[int, int]], slack: int) -> list[tuple[int, int]]:
    """(first, past last) text places of stretches of an alignment without a gap longer than slack."""
    out = [[pairs[0][0], pairs[0][0] + 1]]
    for k, _ in pairs[1:]:
        if k - out[-1][1] > slack:
            out.append([k, k + 1])
        out[-1][1] = k + 1
    return [(a, b) for a, b in out]


def scan_text(text: str | None, templates: list[Template], threshold: float = THRESHOLD) -> list[tuple[str, float, int, int]]:
    """(template, coverage, first word, past last word) of everything found; a template inside a longer one is left out."""
    if not text:
        return []
    low = text.lower()
    # Of long templates nearly any text has a telling word, so they are looked for by what words there are in common.
    asked = [t for t in templates if len(low) >= t.least_chars and (len(t.words) > LONG or any(w in low for w, _ in t.telling))]
    if not asked:
        return []
    words = words_of(text)
    bag = Counter(words)
    common = lambda t: sum(min(t.bag[w], bag[w]) for w in t.bag.keys() & bag.keys())
    # No alignment holds more words than the two have in common.
    asked = [t for t in asked if len(words) >= threshold * len(t.words) and common(t) >= threshold * len(t.words)]
    if not asked:
        return []
    where: dict[str, list[int]] = {w: [] for t in asked for w, _ in t.telling}
    for k, w in enumerate(words):
        if w in where:
            where[w].append(k)
    found, pieces, places = [], [], []
    for t in asked:
        size = len(t.words)
        slack = max(2, size // 4)
        begins = sorted(k - j for w, j in t.telling for k in where[w])
        regions: list[list[int]] = []
        for b in begins:
            if regions and b - regions[-1][1] <= slack:
                regions[-1][1] = b
            else:
                regions.append([b, b])
        for first, last in regions:
            pairs = align(words, t.words, max(0, first - slack), min(len(words), last + size + slack))
            if len(pairs) >= threshold * size and _named(words, t, pairs):
                found.append((t.name, len(pairs) / size, pairs[0][0], pairs[-1][0] + 1))
                pieces.append([found[-1][2:]])
                places.append([])
        taken = sorted(x[2:] for x in found if x[0] == t.name)
        for lo, hi in zip([0, *(x[1] for x in taken)], [*(x[0] for x in taken), len(words)], strict=True):
            for pairs in _parted(words, t, lo, hi, threshold * size):
                if not _named(words, t, pairs):
                    continue
                found.append((t.name, len(pairs) / size, pairs[0][0], pairs[-1][0] + 1))
                pieces.append(_pieces(pairs, slack))
                places.append([k for k, _ in pairs])
    sizes = {t.name: len(t.words) for t in asked}

    def inside(x: int, y: int) -> bool:
        """Within one piece of a longer finding, or, for a parted one, most of its words there."""
        (name, share, first, past), (other, more) = found[x], found[y][:2]
        for lo, hi in pieces[y]:
            longer = (hi - lo, more * sizes[other]) > (past - first if not places[x] else max(d - c for c, d in pieces[x]), share * sizes[name])
            if x != y and longer and (lo <= first and past <= hi or 2 * sum(lo <= k < hi for k in places[x]) > len(places[x]) > 0):
                return True
        return False

    kept = {(x[0], x[2]): x for i, x in enumerate(found) if not any(inside(i, j) for j in range(len(found)))}
    return sorted(kept.values(), key=lambda x: (x[2], x[0]))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, license, coverage, first_word, past_word) of everything found in every text."""
    small_batches(docs.sparkSession)
    made = compile_templates(templates, threshold)
    names = ["doc_id", "license", "coverage", "first_word", "past_word"]

    def run(batches):
        for b in batches:
            rows = [(d, *x) for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) for x in scan_text(t.as_py(), made, threshold)]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            types = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return slim.mapInArrow(run, "doc_id long, license string, coverage double, first_word long, past_word long")
