"""Main text: odd pages, the part of each step of the method, and the tables' pages against a plain reading."""

import html as entities
import os
import re

import numpy as np
import pytest

from tallyspark.llm import htmltext

SF = "/root/testdata/sf0.01"
P = ("Some long paragraph of running text that has quite a few words in it, as articles have them. " * 3).strip()
NAV = "<nav><ul><li><a href=/>Home</a></li><li><a href=/b>About us</a></li></ul></nav>"
FOOT = "<footer>Copyright and other small words</footer>"

ODD = {
    "a form around the page": (
        f"<form id=aspnetForm><input type=hidden name=v>{NAV}<div class=content><h1>T</h1><p>{P}</p><p>Short.</p><p>{P}</p></div><div class=footer>Copyright</div><input name=q><button>Go</button></form>",
        ["T", P, "Short.", P],
    ),
    "a form inside an article": (f"<article><h1>T</h1><p>{P}</p><form><label>Name</label><input><p>Send us mail.</p></form><p>End.</p></article>", ["T", P, "End."]),
    "prose inside a form of an article": (f"<article><h1>T</h1><p>{P}</p><form><p>{P}</p></form><p>End.</p></article>", ["T", P, P, "End."]),
    "a page header with the title": (f"<div class='page-header'><h1>The title</h1></div><div class=body><p>{P}</p><p>{P}</p></div>", ["The title", P, P]),
    "related work": (f"<article><h1>T</h1><p>{P}</p><div class='related-work'><h2>Related work</h2><p>{P}</p></div></article>", ["T", P, "Related work", P]),
    "related posts": (f"<article><h1>T</h1><p>{P}</p><div class='related-posts'><h2>Related posts</h2><p>Another one</p></div></article>", ["T", P]),
    "two articles": (f"{NAV}<article><h1>A</h1><p>{P}</p></article><article><h1>B</h1><p>{P}</p></article>{FOOT}", ["A", P, "B", P]),
    "a list of links": (f"<div id=main><h1>T</h1><p>{P}</p><ul><li><a href=a>One source</a></li><li><a href=b>Two</a></li></ul><p>{P}</p></div>{FOOT}", ["T", P, "One source", "Two", P]),
    "comments after": (f"<article><h1>T</h1><p>Short text.</p><p>{P}</p></article><div id=comments><h2>Comments</h2><p>{P} {P}</p></div>", ["T", "Short text.", P]),
    "comments inside": (f"<article><h1>T</h1><p>{P}</p><section class=comments><article class=comment><p>{P} so a reader</p></article></section></article>", ["T", P]),
    "a sidebar beside main": (f"<div class=has-sidebar><div class=sidebar><p>{P}</p></div><main><h1>T</h1><p>{P}</p><aside>beside</aside><p>x</p></main></div>", ["T", P, "x"]),
    "the site's header": (f"<header><h1>Site</h1></header><article><header><h1>Title</h1><p>By A</p></header><p>{P}</p></article>", ["Title", "By A", P]),
    "nav left open": (f"<nav><ul><li><a href=a>x</a><article><h1>T</h1><p>{P}</article><footer>f</footer>", ["T", P]),
    "no names at all": (f"<ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul><div><h1>T</h1><p>{P}</p><p>ok.</p></div><div>All rights</div>", ["T", P, "ok."]),
    "hidden parts": (f"<article><h1>T</h1><p hidden>no</p><p style='display: none'>no</p><script>var a='</p>'</script><p>{P}</p></article>", ["T", P]),
    "a table": (f"<div class=wrap><h2>Data</h2><p>{P}</p><table><tr><td>1<td>two</table><p>{P}</p></div>", ["Data", P, "1", "two", P]),
}


@pytest.mark.parametrize("name", list(ODD))
def test_odd_pages(name):
    html, want = ODD[name]
    assert htmltext.extract(f"<html><body>{html}</body></html>").split("\n") == want


def test_threshold_clusters():
    r = htmltext.smoothed(np.array([0.0, 0, 90, 100, 95, 0, 0]))
    assert r[0] < r[1] < r[2] < r[3] and np.isclose(htmltext.smoothed(np.full(5, 3.0)), 3).all()
    assert 0 < htmltext.threshold(np.array([1.0, 2, 90, 100])) < 90
    assert htmltext.threshold(np.array([5.0, 5])) == 5
    assert 0.1 < htmltext.threshold(np.array([0.0, 0.1, 1.8, 2.0, 3.8])) < 1.8  # two clusters of content above the low one


BLIND = {
    "long links beside short prose": (  # only ratios tell these apart
        "<ul>" + "".join(f"<li><a href={i}>A headline of another story number {i} that has as many words as prose</a></li>" for i in range(8)) + "</ul>"
        "<div><p>Prose that isn't long but runs on for some words without a link in it.</p><p>More of such prose, which goes on for just as many words.</p></div>",
        "text_to_tag",
    ),
    "a lone advert among links": (  # only its neighbours tell it from prose
        "<ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul><div>An advert of one longer sentence that no name gives away, and which has many words.</div>"
        "<ul><li><a href=c>More</a></li><li><a href=d>Shop</a></li></ul>"
        f"<div><p>{P}</p><p>{P}</p></div>",
        "smoothed",
    ),
}
OFF = {"text_to_tag": lambda lines: np.ones(len(lines)), "smoothed": lambda values: values, "threshold": lambda values: -np.inf}


@pytest.mark.parametrize("name", list(BLIND))
def test_pages_without_names_need_the_method(name, monkeypatch):
    """The div's paragraphs are the text; with just one step of the method off they aren't."""
    html, step = BLIND[name]
    want = "\n".join(re.findall("<p>(.*?)</p>", html))
    assert htmltext.extract(html) == htmltext.extract(html, names=False) == want
    monkeypatch.setattr(htmltext, step, OFF[step])
    assert htmltext.extract(html, names=False) != want


def plain_article(html):
    inner = re.search(r"(?s)<article>(.*?)</article>", html)[1]
    blocks = re.split(r"</?(?:p|h1)>", inner.replace("<br>", " "))
    texts = [" ".join(entities.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_tables_pages_by_names_and_without(spark, monkeypatch):
    """Texts equal a plain reading of the one template; without names most do, fewer with each one step of the method off."""
    rows = htmltext.query(spark, SF).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    want = {p: plain_article(h) for p, h in pages.items()}
    assert {r.page_id: r.text for r in rows} == want

    def right():
        return sum(htmltext.extract(h, names=False) == want[p] for p, h in pages.items())

    blind = right()
    assert blind > 0.7 * len(pages)
    for step, off in OFF.items():
        with monkeypatch.context() as m:
            m.setattr(htmltext, step, off)
            assert right() < blind - 0.1 * len(pages), step
