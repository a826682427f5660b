"""Posting links: only open links are staged in full, and plain markup is read without the parser's events."""

from __future__ import annotations

from pyspark.sql import functions as F

from snapledger.functions import text
from snapledger.operators import pages as pg
from snapledger.sources import html_elements as he
from tests.test_elements import random_pages  # noqa: F401  (a fixture)


def test_only_open_links_are_staged_in_full(spark, monkeypatch):
    staged = []
    monkeypatch.setattr(pg, "stage", lambda df, label: staged.append(df) or df)
    html = (
        '<nav><a href="/jobs/head-1">Head</a></nav><a href="/open/Dev-7">Dev</a><a href="/open/Ops-8">Ops</a><a href="/jobs">All</a>'
        '<a href="mailto:x@y.z">m</a><a href="/jobs/dev-3 #f">Apply now</a><a href="/about/us">Role</a>'
    )
    pages = spark.createDataFrame([(1, "https://c.example.com/jobs", html)], "k int, url string, html string")
    found = {r["link_url"]: r["slug_title"] for r in pg.job_link_candidates(pages, ["k"]).collect()}
    assert found == {
        "https://c.example.com/open/Dev-7": "Dev 7", "https://c.example.com/open/Ops-8": "Ops 8",
        "https://c.example.com/jobs/dev-3 ": "Dev 3",
    }
    links = staged[0].collect()
    assert sorted(r["route_key"] for r in links) == [
        "c.example.com/about", "c.example.com/jobs", "c.example.com/jobs", "c.example.com/open", "c.example.com/open"
    ]
    assert sum(r["link_url"] is not None for r in links) == sum(r["_open"] for r in links) == 3


def test_plain_markup_gives_the_events_of_the_parser(random_pages, monkeypatch):  # noqa: F811
    odd = [
        "<!DOCTYPE html><p>a &lt; b</p>", "a < b <p>c", "<p class='x'>1", "<script>'<a>'</script><b>x</b>", "<br/><i />t", "<p", "x &am",
        '<a href="a&amp;b">t</a>', '<A HREF="q" href="r">T</A >', "<!-- c --><p>d", "<title>T &amp; <b></title>", "</p x><p>", '<p a="1"b="2">',
    ]
    given = [*random_pages, *odd]
    fast = [list(he.element_rows(html)) for html in given]
    plain = '<div class="nav"><p>a &amp; b</p><br/></div>'
    with monkeypatch.context() as m:
        m.setattr(he._Tree, "feed", lambda tree, html: (_ for _ in ()).throw(AssertionError(html)))
        assert [r["tag"] for r in he.element_rows(plain)] == ["div", "p", "br"]  # the parser reads none of it
    monkeypatch.setattr(he._Tree, "read", lambda tree, html: (tree.feed(html), tree.close()))
    assert fast == [list(he.element_rows(html)) for html in given]


def test_white_space_is_that_of_the_list(spark):
    chars = [chr(c) for c in (*range(0x100), *range(0x1670, 0x1690), *range(0x1FF0, 0x2070), 0x2FFF, 0x3000, 0x3001, 0xFEFF)]
    rows = spark.createDataFrame([(c, f"{c}a{c}b{c}") for c in chars], "c string, v string")
    for r in rows.select("c", text.strip_ws(F.col("v")).alias("s"), text.norm_text(F.col("v")).alias("n")).collect():
        blank = r["c"] in text.WS_LIST
        assert (r["s"] == f"a{r['c']}b") == blank and (r["n"] == "a b") == blank, hex(ord(r["c"]))
