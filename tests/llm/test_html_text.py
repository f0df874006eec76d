from __future__ import annotations

import os
from collections import Counter
from html import unescape

import numpy as np
import pytest

from sparkwell.llm import html_text as H
from sparkwell.llm.queries import QUERIES

from .handmade_pages import PAGES


def test_blocks():
    page = '<title>T</title><nav class="top-menu"><a href=x>A</a> b</nav><!-- <p>no</p> --><script>"</p>"</script><p><b>One&nbsp;&amp;\n two<br>x<p>Three <i>3</i><ul><li>i<li>ii</ul>tail <'
    got = [(b.text, b.path[-1] if b.path else "") for b in H.blocks_of(page)]
    assert [t for t, _ in got] == ["T", "A b", "One & two x", "Three 3", "i", "ii", "tail <"]
    assert H.blocks_of("<p>cut off <a href='x") == H.blocks_of("<p>cut off ")
    assert H.blocks_of('<p title="a>b">x</p>')[0].text == "x"
    assert H.blocks_of("<p>a &lt;b&gt; &#233; &am") [0].text == "a <b> é &am"


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    m = H.Labeller(1)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x, mask, y = rng.standard_normal((2, 5, H.SIZE)), np.array([[1.0] * 5, [1.0] * 3 + [0.0] * 2]), (rng.random((2, 5)) < 0.5).astype(float)
    loss = lambda: -float((np.where(y > 0, np.log(p := m.forward(x, mask)[0]), np.log(1 - p)) * mask).sum() / mask.sum())
    g = m.gradients(x, mask, y)
    for k in ("out", "xf", "hf", "bb", "hb", "skip"):
        at = tuple(rng.integers(0, n) for n in m.p[k].shape)
        old = m.p[k][at]
        m.p[k][at] = old + 1e-3
        up = loss()
        m.p[k][at] = old - 1e-3
        down = loss()
        m.p[k][at] = old
        assert (up - down) / 2e-3 == pytest.approx(float(g[k][at]), rel=0.05, abs=2e-4)


def test_held_out_pages():
    make = H.Pages(4242)
    cut = [b for b in (H.blocks_of(make.page(), labelled=True) for _ in range(200)) if b]
    keep = H.trained().label(H.vectors(cut))
    right = sum(int((k == np.array([b.label == 1 for b in page])).sum()) for k, page in zip(keep, cut, strict=True))
    assert right / sum(map(len, cut)) > 0.975


PAGE = """<!DOCTYPE html><html><head><title>Title here</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies.</p></div><div class="ad">Buy this now.</div><article><h1>A heading of some words</h1><p>First   paragraph
of text, with a <a href="/x">link</a>.</p><p>Second &amp; last paragraph, long enough to be read.</p></article><aside class="sidebar"><h3>Popular</h3><ul><li><a href="/z">More</a></li></ul></aside>
<section class="comments"><h3>Comments</h3><div class="comment"><p>Great post, thank you.</p></div></section><form><label>Email</label><button>Send</button></form><footer>&copy; site.com</footer></body></html>"""
WANT = "A heading of some words\nFirst paragraph of text, with a link.\nSecond & last paragraph, long enough to be read."


def test_extract(spark):
    df = spark.createDataFrame([(1, PAGE, "x"), (2, None, "x"), (3, "", "x"), (4, "<nav><a href=/>Home</a></nav>", "x"), (1, PAGE, "x"), (5, "<article>" + "<p>Some words in a row, and more.</p>" * 3000 + "</article>", "x")], "page_id long, html string, text string")
    out = H.extract_text(df)
    assert out.columns == ["page_id", "html", "text"]
    rows = {r["page_id"]: r["text"] for r in out.collect()}
    assert rows[1] == WANT and rows[2] == rows[3] == rows[4] == "" and rows[5].count("\n") == 2999
    assert out.where("page_id = 1").count() == 2 and H.extract_text(df.limit(0)).count() == 0


def test_batches_dont_change_labels():
    make = H.Pages(77)
    pages = [make.page() for _ in range(40)]
    together = H.main_texts(pages, H.trained())
    assert together == [H.main_texts([p], H.trained())[0] for p in pages]


def test_handmade_pages():
    """Blocks kept of pages that weren't generated: precision and recall."""
    got = [Counter(t.split("\n") if t else []) for t in H.main_texts([p for p, _ in PAGES], H.trained())]
    want = [Counter(w) for _, w in PAGES]
    right = sum((g & w).total() for g, w in zip(got, want, strict=True))
    assert right / sum(g.total() for g in got) > 0.95 and right / sum(w.total() for w in want) > 0.95


@pytest.mark.parametrize("attributes", ['data-year="2020"', 'data-y="5"', "data-y", "data-y=", "data-y=1", "data-y='0'", "data-id=x class", "class", "id=", "hidden", 'x="<p>"', "class='a", "=", '"'])
def test_odd_attributes(spark, attributes):
    """No attribute of a page is a label, or an error."""
    pages = spark.createDataFrame([(1, PAGE.replace("<article>", f"<article><div {attributes}></div>")), (2, f"<p {attributes}>x</p>"), (3, f"<{attributes}")], "page_id long, html string")
    rows = {r["page_id"]: r["text"] for r in H.extract_text(pages).collect()}
    assert len(rows) == 3 and (WANT in rows[1] or attributes in ("class='a", '"'))
    labels = [b.label for b in H.blocks_of(f"<p {attributes}>x</p>")]
    assert set(labels) <= {-1}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_query_gives_the_articles(spark):
    """Every page of the table against a reading of its article by regular expressions."""
    import re

    from pyspark.sql import functions as F

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html").collect()}
    rows = QUERIES["op9_html_text"](spark, "/root/testdata/sf0.01").withColumn("n", F.length("text")).collect()
    good = 0
    for r in rows:
        article = re.sub(r"(?s)<!--.*?-->|<(script|style)\b.*?</\1>", "", (re.search(r"(?s)<article\b[^>]*>(.*?)(?:</article>|\Z)", pages[r["page_id"]]) or ["", ""])[1])
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h[1-6]|div|ul|ol|li|section|aside|table|tr|td)\b[^>]*>", re.sub(r"<br\s*/?>", " ", article))]
        good += r["text"] == "\n".join(b for b in blocks if b)
        assert r["n_chars"] == r["n"] == len(r["text"])
    assert len(rows) == len(pages) and good >= 0.97 * len(rows)
