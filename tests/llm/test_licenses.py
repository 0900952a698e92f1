import random

from palimpsest.llm import licenses


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_alignment_is_common_and_close_to_the_longest():
    rng = random.Random(1)
    for _ in range(200):
        b = licenses.words_of(licenses.TEMPLATES["MIT"])
        a = [w for w in b if rng.random() > 0.1]
        for _ in range(rng.randint(0, 8)):
            a.insert(rng.randrange(len(a)), rng.choice(["new", "the", "software", "x"]))
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
        assert lcs(a, b) >= len(pairs) >= 0.9 * lcs(a, b)


def test_notices_are_found_and_clean_text_is_not():
    made = licenses.compile_templates()
    rng = random.Random(2)
    prose = lambda n: " ".join(rng.choice(["the", "of", "and", "license", "under", "version", "tion", "x"]) for _ in range(n))
    for name, text in licenses.TEMPLATES.items():
        for before, after in ((0, 0), (5, 300), (3000, 10)):
            got = licenses.scan_text(f"{prose(before)}\n{text.upper()}.\n{prose(after)}", made)
            assert [x[0] for x in got] == [name] and got[0][1] == 1.0
        got = licenses.scan_text(f"{text}. {prose(200)} {text}; {prose(40)}. {text}", made)
        assert [x[0] for x in got] == [name] * 3
    assert licenses.scan_text(prose(5000), made) == []


def test_edited_notice_and_threshold():
    words = licenses.TEMPLATES["BSD-2-Clause"].split()
    made = licenses.compile_templates()
    rng = random.Random(3)
    for _ in range(40):
        some = [w if rng.random() > 0.08 else "changed" for w in words]
        assert [x[0] for x in licenses.scan_text(" ".join(some), made)] == ["BSD-2-Clause"]
        some = [w if rng.random() > 0.6 else "changed" for w in words]
        assert licenses.scan_text(" ".join(some), made) == []


def test_frame(spark):
    rows = [(1, None), (2, ""), (3, "Released under the MIT License."), (3, "Released under the MIT License."), (None, "All rights reserved"), (4, "x " * 50000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'a' license", "1.0 coverage")
    got = sorted((r.doc_id or -1, r.license) for r in licenses.scan(df).collect())
    assert got == [(-1, "All-rights-reserved"), (3, "MIT-notice"), (3, "MIT-notice")]
    assert licenses.scan(df.limit(0)).collect() == []


def test_insertions_of_any_length():
    made = licenses.compile_templates()
    rng = random.Random(4)
    filler = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "of", "and"]) for _ in range(n))
    got = licenses.scan_text("Licensed under the terms and conditions of the Apache License, Version 2.0", made)
    assert got == [("Apache-2.0-notice", 1.0, 0, 12)]
    for name in ("MIT", "BSD-2-Clause", "Apache-2.0-header", "GPL-3.0-header"):
        words = licenses.TEMPLATES[name].split()
        half = len(words) // 2
        for gap in (len(words) // 2, len(words), 3000):
            text = f"{filler(20)} {' '.join(words[:half])} {filler(gap)} {' '.join(words[half:])} {filler(20)}"
            got = [x for x in licenses.scan_text(text, made) if x[0] == name]
            assert len(got) == 1 and got[0][1] >= 0.95 and got[0][2] >= 18
    # A notice in the gap is found by itself; lone words far apart are no notice.
    words = licenses.TEMPLATES["MIT"].split()
    text = f"{' '.join(words[:50])} {filler(300)} All rights reserved {filler(300)} {' '.join(words[50:])}"
    assert [x[0] for x in licenses.scan_text(text, made)] == ["MIT", "All-rights-reserved"]
    assert licenses.scan_text(f"all {filler(50)} rights {filler(50)} reserved", made) == []


def test_versions_and_variants_are_told_apart():
    made = licenses.compile_templates()
    names = lambda text: [x[0] for x in licenses.scan_text(text, made)]
    gnu = "This work is licensed under the GNU {}General Public License, version {}".format
    assert names(gnu("", 2)) == ["GPL-2.0-notice"] and names(gnu("", "3.0")) == ["GPL-3.0-notice"] and names(gnu("", 1)) == []
    assert names(gnu("Lesser ", "2.1")) == ["LGPL-2.1-notice"] and names(gnu("Affero ", 3)) == ["AGPL-3.0-notice"]
    assert names("Licensed under CC BY-ND 4.0") == ["CC-BY-ND-4.0-notice"] and names("Licensed under CC BY 3.0") == []
    three = licenses.TEMPLATES["BSD-3-Clause"]
    assert names(three) == ["BSD-3-Clause"] and names(licenses.TEMPLATES["BSD-2-Clause"]) == ["BSD-2-Clause"]
    for name in ("MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "ISC", "CC0-1.0"):
        assert names(licenses.TEMPLATES[name]) == [name]
