import html
import re

import numpy as np
import pytest

from layouts import LAYOUTS
from palimpsest.llm import blocks, extract, extract_query


@pytest.fixture(scope="module")
def model():
    return extract.trained()


def test_blocks():
    page = """<html><head><title>no</title><style>p{}</style></head><body class="x"><!-- <p>no</p> --><nav class="mainMenu"><ul><li>Home<li><a href=x>About</a></ul></nav>
    <article id=story><h1>A &amp; B</h1><p>one <b>bo</b>ld&nbsp;two<br>three
      four<p>five</p><script>if (a < b) { "<p>no</p>" }</script>six<div>seven &lt;p&gt;</div></article></body>"""
    got = blocks.leaves(page)
    assert [x.text for x in got] == ["Home", "About", "A & B", "one bold two three four", "five", "six", "seven <p>"]
    assert got[1].path == ("html", "body x", "nav main menu", "ul", "li") and got[1].link_chars == 5
    assert got[3].path == ("html", "body x", "article story", "p") and got[5].path[-1] == "article story"


@pytest.mark.parametrize("page", [None, "", "   ", "plain", "<", "<p", "<p>x", "</p>", "a < b > c", "<!--", "<script>", "<a href='x", "&amp", "<p>" * 3000 + "x", "x\x00<p>\ud800"])
def test_odd_pages(model, page):
    texts = extract.main_texts(model, [page])
    assert len(texts) == 1 and all(t == " ".join(t.split()) for t in texts[0].split(extract.GAP))


def truth(page):
    """The article of the test tables' pages, by their own fixed layout."""
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    parts = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)\b[^>]*>", inner))
    return "\n\n".join(x for x in parts if x)


def test_test_tables_are_extracted_exactly(spark):
    got = extract_query.op2_html_extraction(spark, "/root/testdata/sf0.01").toPandas().set_index("page_id")
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").toPandas().set_index("page_id")
    assert len(got) == len(pages) == 250
    assert (got.n_chars == got.text.str.len()).all()
    assert np.mean([got.text[k] == truth(pages.html[k]) for k in pages.index]) > 0.99


def test_unseen_layouts(model):
    data = extract.made(300, seed=4242)
    found = model.label([x for x, _ in data])
    right = np.concatenate([a == y for a, (_, y) in zip(found, data, strict=True)])
    assert right.mean() > 0.97


@pytest.mark.parametrize("name", list(LAYOUTS))
def test_hand_written_layouts(model, name):
    page = LAYOUTS[name]
    want = "\n\n".join(x.text.replace("§", "") for x in blocks.leaves(page) if "§" in x.text)
    assert extract.main_texts(model, [page.replace("§", "")]) == [want]


def plain_scores(net, page):
    """The network written out block by block, with no batches, masks or stacked gates."""
    sig = lambda x: 1 / (1 + np.exp(-x))
    n = extract.HIDDEN

    def one_way(direction, xs):
        h, c, out = np.zeros(n), np.zeros(n), []
        for x in xs:
            i, f, g, o = (x @ direction.wx[:, k * n : (k + 1) * n] + h @ direction.wh[:, k * n : (k + 1) * n] + direction.b[k * n : (k + 1) * n] for k in range(4))
            c = sig(f) * c + sig(i) * np.tanh(g)
            h = sig(o) * np.tanh(c)
            out.append(h)
        return out

    xs = page.astype(np.float64)
    ahead, back = one_way(net.ahead, xs), one_way(net.back, xs[::-1])[::-1]
    return [float(np.concatenate([a, b, x]) @ net.out + net.bias[0]) for a, b, x in zip(ahead, back, xs, strict=True)]


def test_plain_forward_pass(model):
    data = [x for x, _ in extract.made(25, seed=77)]
    found = model.label(data)
    for page, got in zip(data, found, strict=True):
        want = plain_scores(model, page)
        x, mask = extract.padded([page])
        assert np.allclose(model.scores(x, mask)[0][:, 0], want, atol=1e-3)
        assert all(g == (w > 0) for g, w in zip(got, want, strict=True) if abs(w) > 1e-2)


def test_deep_nesting_within_bounds(model):
    """100,000 nested elements with text at every depth, in bounded memory and linear time."""
    import resource

    page = "<div>x" * 100_000 + "</div>" * 100_000 + "</section>" * 1000
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    got = blocks.leaves(page)
    assert len(got) == 100_000 and max(len(x.path) for x in got) == blocks.OUTER + blocks.INNER and got[-1].depth == 100_000
    assert len(extract.main_texts(model, [page])) == 1
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000


def test_gradients_match_differences():
    net = extract.Labeller(3)
    rng = np.random.default_rng(0)
    pages = [rng.normal(0, 1, (n, extract.INPUT)).astype(np.float32) for n in (3, 5)]
    x, mask = extract.padded(pages)
    y = (rng.random(mask.shape) > 0.5).astype(np.float32)

    def loss():
        p = 1 / (1 + np.exp(-net.scores(x, mask)[0].astype(np.float64)))
        return -(np.where(y > 0, np.log(p), np.log(1 - p)) * mask).sum() / mask.sum()

    for p, g in zip(net.parameters(), net.gradients(x, mask, y), strict=True):
        k = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = p[k]
        p[k] = old + 1e-2
        up = loss()
        p[k] = old - 1e-2
        down = loss()
        p[k] = old
        assert abs((up - down) / 2e-2 - g[k]) < 0.05 * abs(g[k]) + 1e-3


def test_batches_do_not_matter_and_repeats(model, spark):
    pages = [p.html for p in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(20).collect()]
    assert extract.main_texts(model, pages) == [extract.main_texts(model, [p])[0] for p in pages]
    df = spark.createDataFrame([(1, "u", pages[0]), (1, "u", pages[0]), (None, None, None)], "page_id long, url string, html string").selectExpr("*", "5 n_chars", "7 extra")
    got = extract.extract(df, model=model).collect()
    assert len(got) == 3 and {r.extra for r in got} == {7} and [r.n_chars for r in got if r.page_id is None] == [0]
    assert extract.extract(df.limit(0), model=model).collect() == []
