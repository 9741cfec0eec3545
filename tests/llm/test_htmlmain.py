import html
import random
import re

import numpy as np
import pytest

from roadpulse.llm import htmlmain as hm


@pytest.fixture(scope="module")
def model(spark, sf):
    return hm.fit(spark.read.parquet(f"{sf}/pages.parquet"), sample=50)


def article(page):
    """Main text of the test pages, whose article holds only h1 and p."""
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside))
    return "\n".join(b for b in blocks if b)


def test_query_gives_the_articles(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = hm.op4_html_main_text(spark, sf).collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    right = sum(r.text == article(pages[r.page_id].html) for r in got)
    assert right >= 0.95 * len(got)
    assert all(r.n_chars == len(r.text) and r.url == pages[r.page_id].url for r in got)


def test_held_out_layouts(spark, model):
    """Layouts with seeds and texts that were not trained on."""
    rng, right, total, exact = random.Random(77), 0, 0, 0
    for k in range(150):
        texts = [" ".join(rng.choice(["alpha", "beta,", "gamma.", "delta", "of", "the"]) for _ in range(rng.randint(4, 80)))
                 for _ in range(rng.randint(2, 9))]
        order, label = hm.laid_out(texts, rng)
        keep = hm.decode(order, model.margin(hm.features([order])))
        leaves = np.array([n.tag == "#text" for n in order])
        right, total = right + (keep == label)[leaves].sum(), total + leaves.sum()
        exact += (keep == label)[leaves].all()
    assert right >= 0.97 * total and exact >= 0.8 * 150


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><div id="cookie-notice"><p>We use cookies here.</p></div>
<header><a href="/">Home</a></header><nav><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></nav>
<article><h1>The title</h1><p>First&nbsp;paragraph &amp; more, with
 <b>bold</b> words and a <a href=z>link</a>.<p>Second paragraph, not closed, which is rather long as well.
<script>var a = "<p>no</p>";</script><!-- <p>no</p> --><p>Third<br>paragraph is here as the last one of them.</p></article>
<aside class="sidebar"><h3>Related</h3><ul><li><a href=q>Other</a></li></ul></aside>
<section id="comments"><div class="comment"><p>Nice article, I liked it very much!</p></div></section>
<form><label>Search</label><input name=q></form><footer>&copy; 2024 Someone</footer></body></html>"""


def test_a_page_with_every_kind_of_clutter(model):
    order = hm.nodes(hm.parse(PAGE))
    assert hm.main_text(order, hm.decode(order, model.margin(hm.features([order])))) == (
        "The title\nFirst paragraph & more, with bold words and a link.\n"
        "Second paragraph, not closed, which is rather long as well.\nThird paragraph is here as the last one of them.")


def test_decoding_is_the_most_probable_consistent_labelling():
    rng = random.Random(3)
    for _ in range(40):
        root = hm.Node("html", None)
        inner = [root]
        for _ in range(rng.randint(1, 7)):
            if rng.random() < 0.5:
                inner.append(hm.Node("div", rng.choice(inner)))
            else:
                hm.Node("#text", rng.choice(inner), text="t")
        order = hm.nodes(root)
        margin = np.array([rng.uniform(-2, 2) for _ in order])
        place = {id(n): k for k, n in enumerate(order)}

        def consistent(keep):
            for k, n in enumerate(order):
                if keep[k] and n.parent is not None and not keep[place[id(n.parent)]]:
                    return False
                if keep[k] and n.tag != "#text" and not any(keep[place[id(c)]] for c in n.children):
                    return False
            return True
        best = max(2 * margin[[k for k in range(len(order)) if m >> k & 1]].sum() for m in range(1 << len(order))
                   if consistent([m >> k & 1 for k in range(len(order))]))
        keep = hm.decode(order, margin)
        assert consistent(keep) and 2 * margin[keep].sum() == pytest.approx(best)


def test_odd_pages(spark, model):
    deep = "<div>" * 5000 + "<p>deep text</p>"
    rows = [(1, None, None), (2, "u", ""), (3, "u", "plain words only"), (None, None, "<p>x"), (4, "u", "<"), (5, "u", deep),
            (6, "u", "<a href=\"unclosed>text</a><p>after"), (6, "u", "<script>never closed"), (7, "u", "<head><title>t</title><body>b")]
    frame = spark.createDataFrame([(k, u, t, "e", "e") for k, u, t in rows],
                                  "page_id long, url string, html string, text string, id string")
    got = hm.extract(frame, model).collect()
    assert len(got) == len(rows) and all(r.text is not None for r in got)
    assert {r.text for r in got if r.page_id in (1, 2)} == {""}
    assert hm.extract(frame.limit(0), model).count() == 0
    assert hm.fit(frame.limit(0)) is None
    assert all(r.text == "" for r in hm.extract(frame, None).collect())


def test_parser_details():
    def texts(page):
        return [n.text for n in hm.nodes(hm.parse(page)) if n.text]
    assert texts("<p>a &lt;b&gt; &eacute; &#8364;</p><p> x \n\t y </p>") == ["a <b> é €", "x y"]
    assert texts("<ul><li>a<li>b</ul>c") == ["a", "b", "c"]
    assert texts("a<b>b</b>c<div>d</div>e") == ["abc", "d", "e"]
    assert texts("<textarea>no</textarea><svg><text>no</text></svg>yes<br>too") == ["yes too"]
    assert texts("<p title='>'>ok") == ["ok"]


def long_page(k):
    words = " ".join(f"word{k}x{i}" for i in range(60))
    body = "".join(f"<p>{words} {i}.</p>" for i in range(230))
    return f"<html><body><nav><ul><li><a href=x>One</a></ul></nav><article><h1>Title {k}</h1>{body}</article><footer>(c) {k}</footer></body></html>"


def test_a_table_of_only_long_pages_gives_their_articles(spark):
    pages = [long_page(k) for k in range(3)]
    assert min(map(len, pages)) > 100_000
    frame = spark.createDataFrame([(k, "u", p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    for r in hm.extract(frame, hm.fit(frame, sample=3, layouts=1)).collect():
        assert r.text == article(pages[r.page_id])


def test_sample_holds_distinct_pages_and_short_ones_first(spark):
    rows = ["<p>copy</p>"] * 500 + [f"<p>own {k}</p>" for k in range(9)] + ["<p>" + "x" * 2000, "", None]
    frame = spark.createDataFrame([(r,) for r in rows], "html string")
    assert {len(r.html) for r in hm.sampled(frame, "html", 10, 1000).collect()} == {11, 12}
    got = [r.html for r in hm.sampled(frame, "html", 300, 1000).collect()]
    assert len(got) == len(set(got)) == 11


@pytest.mark.parametrize("page", ["<a " * 350_000, '<a "x ' * 170_000, "<a 'x <b " * 120_000 + ">", "<" * 1_000_000,
                                  "<div class=\"nav menu\">" * 50_000 + "deep", "<h2>" * 40_000 + "<tr></tr>" * 40_000,
                                  "<div>" * 40_000 + "</p>" * 40_000, "<li><div>" + "<h2>" * 40_000 + "<li></li>" * 40_000,
                                  "<!--" * 250_000, "&amp" * 250_000])
def test_hostile_pages_take_linear_time_and_memory(page, model):
    import time
    import tracemalloc
    began = time.process_time()
    order = hm.nodes(hm.parse(page))
    tracemalloc.start()
    x = hm.features([order])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    hm.main_text(order, hm.decode(order, model.margin(x)))
    assert time.process_time() - began < 30 and peak < 500e6
