import html
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm.html_text import extract, main_text, op6_html_extraction, smoothed, threshold

PAGE = "<html><body class='has-sidebar'><nav><a href=x>Home</a></nav>{}<footer>foot</footer></body></html>"


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ("<article><h1>Title</h1><p>One &amp; two&nbsp;three<br>four</p><p>  Five\n six </p></article>", "Title\nOne & two three four\nFive six"),
        ("<article><p>a<p><b>b<br><p>c</article>", "a\nb\nc"),
        ("<article><p>Text of it.</p><aside>side</aside><form>f<p>x</p></form><script>var t='</p>';</script><style>p{}</style></article>", "Text of it."),
        ("<main><p>Words in main that count.</p><div class='comments'><p>A reader says something long enough to count.</p></div></main>", "Words in main that count."),
        ("<div class='cookie-notice'>We use cookies</div><div class=ad>Buy this now please, it is good.</div><article><p>x</article>", "x"),
        ("<div><p>A long paragraph of running text in no article at all, to be found.</p><p>Short.</p></div><div><a href=a>One</a> <a href=b>Two</a></div>", "A long paragraph of running text in no article at all, to be found.\nShort."),
        ("<article><ul><li>one<li>two</ul><table><tr><td>a<td>b</table><pre>p  q</pre></article>", "one\ntwo\na\nb\np q"),
        ("<article><p hidden>no</p><p style='display: none'>no</p><p>yes</p><!-- c --><p>&#233;&#x1F642;</p></article>", "yes\né🙂"),
        ("<article><p>unclosed <b>bold <i>both</p></article>", "unclosed bold both"),
    ],
)
def test_pages(body, text):
    assert main_text(PAGE.format(body)) == text


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<html></html>") == main_text("<p") == ""
    assert main_text("plain text") == "plain text"
    assert len(main_text("<article>" + "<p>word</p>" * 20_000 + "</article>").split("\n")) == 20_000
    deep = "<div>" * 3000 + "deep words" + "</div>" * 3000
    assert main_text(deep) == "deep words"


def test_smoothing_and_threshold():
    assert np.allclose(smoothed(np.ones(7)), 1) and 2 < threshold(np.array([1.0, 1.2, 1.1, 5.0, 6.0])) < 5 and threshold(np.array([3.0])) == 3.0


def expected(page):
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(b for b in blocks if b)


def test_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {r.page_id: expected(r.html) for r in pages.collect()}
    rows = op6_html_extraction(pages).collect()
    assert {r.page_id: r.text for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)
    odd = spark.createDataFrame([(1, None, None), (None, "u", "<p>x"), (1, None, None)], pages.schema)
    assert sorted((r.text, r.n_chars) for r in op6_html_extraction(odd).collect()) == [("", 0), ("", 0), ("x", 1)]
    assert op6_html_extraction(pages.limit(0)).count() == 0
    assert extract(odd.withColumn("Text", F.lit("old"))).columns == ["page_id", "url", "html", "text"]


LONG = "A paragraph of running text that goes on for a while, as those of articles do, with a second sentence in it."


@pytest.mark.parametrize(
    ("body", "text"),
    [
        (f"<div class='content widget'><article><h1>T</h1><p>{LONG}</p><p>Short.</p></article></div><div class=box><p>Another block with some text of its own here.</p></div>", f"T\n{LONG}\nShort."),
        (f"<article><p>{LONG}</p><section id='related-work'><h2>Related work</h2><p>{LONG}</p></section></article>", f"{LONG}\nRelated work\n{LONG}"),
        (f"<article><p>{LONG}</p><div class='related'><ul><li><a href=1>One more</a><li><a href=2>And another</a></ul></div></article>", LONG),
        (f"<article><p>See <a href=a>{LONG}</a> and more.</p><p><a href=b>{LONG}</a> said so too, at length.</p></article><div id='ad-300x250'><p>{LONG}</p></div>", f"See {LONG} and more.\n{LONG} said so too, at length."),
        (f"<div><h1>T</h1><p>{LONG}</p><p>{LONG}</p><p>Short one.</p></div><div><a href=a>Home</a> <a href=b>News</a></div><div>All rights reserved</div>", f"T\n{LONG}\n{LONG}\nShort one."),
        (f"<div class='has-sidebar'><section><p>{LONG}</p></section><section><p>Short section.</p><p>{LONG}</p></section></div><div class='comment-list'><article><p>{LONG}</p></article></div>", f"{LONG}\nShort section.\n{LONG}"),
        (f"<div class='search results'><p>{LONG}</p><p>{LONG}</p></div>", f"{LONG}\n{LONG}"),
    ],
)
def test_marks_are_weights(body, text):
    assert main_text(PAGE.format(body)) == text


def test_clusters_decide_where_nothing_is_marked(spark):
    """The tables' pages with their marks taken out: exact pages, and the mean F1 of lines, with and without the clusters."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    bare = lambda h: re.sub(r"<(/?)(?:article|nav|footer)>", r"<\1div>", h).replace(' class="ad"', "")

    def quality(**options):
        pairs = [(set(main_text(bare(r.html), **options).split("\n")), set(expected(r.html).split("\n"))) for r in rows]
        return sum(a == b for a, b in pairs) / len(pairs), sum(2 * len(a & b) / (len(a) + len(b)) for a, b in pairs) / len(pairs)

    with_clusters, without_ = quality(), quality(clusters=False)
    assert with_clusters[0] > 0.74 and with_clusters[1] > 0.93 and without_[0] < with_clusters[0] - 0.08 and without_[1] < with_clusters[1]
    assert sum(main_text(r.html) == expected(r.html) for r in rows) == len(rows) > sum(main_text(r.html, marks=False) == expected(r.html) for r in rows)
