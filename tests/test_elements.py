"""Element rows: texts, peers and ancestors against plain restatements, and growth with the page."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from snapledger.operators import pages as pg
from snapledger.sources.html_elements import Want, element_rows, html_elements, under

TAGS = "a li p tr td th dt dd ul table dl div section span b strong h1 br img i".split()


def random_page(rng: random.Random) -> str:
    parts = []
    for _ in range(rng.randint(0, 60)):
        kind, tag = rng.random(), rng.choice(TAGS)
        if kind < 0.5:
            mark = f' class="{rng.choice(("nav", "job-card", "x", ""))}"' if rng.random() < 0.4 else ""
            parts.append(f"<{tag}{mark}>")
        elif kind < 0.7:
            parts.append(f"</{tag}>")
        else:
            parts.append(rng.choice(["word", "  two  words ", "\n", "&amp; x", " a b", " : - value"]))
    return "".join(parts)


@pytest.fixture(scope="module")
def random_pages():
    rng = random.Random(11)
    return [random_page(rng) for _ in range(300)]


def test_intervals_are_the_chain(random_pages):
    for html in random_pages:
        rows = list(element_rows(html))
        for row in rows:
            around = [r for r in rows if r["pos"] <= row["pos"] <= r["last"]]
            assert [r["tag"] for r in reversed(around)] == [c["tag"] for c in row["chain"]]


def test_text_of_an_element_is_that_of_its_parts(random_pages):
    for html in random_pages:
        rows = list(element_rows(html))
        for row in rows:
            if row["tag"] in ("tr", "br", "img"):
                continue
            inner = [r["text"] for r in rows if row["pos"] < r["pos"] <= row["last"] and r["tag"] != "tr" and r["text"]]
            assert all(t in row["text"] for t in inner) and row["text"] == " ".join(row["text"].split())


def test_cut_peers_keep_what_is_asked(random_pages):
    for html in random_pages:
        for full, cut in zip(element_rows(html), element_rows(html, peer_chars=3), strict=True):
            assert (full["peer"] is None) == (cut["peer"] is None)
            if full["peer"] is not None:
                label = len(full["text"]) if full["tag"] in ("a", "b", "strong") else 0
                assert full["peer"].startswith(cut["peer"])
                rest, kept = full["peer"][label:].lstrip(" :-"), cut["peer"][label:].lstrip(" :-")
                assert kept[:3] == rest[:3] and (len(kept) > 3 or kept == rest)


def test_under_equals_the_chain(spark, random_pages):
    # Equal keys and repeated pages must not mix.
    rows = [(i % 7, html) for i, html in enumerate(random_pages + random_pages[:20])] + [(1, None), (2, "")]
    pages = spark.createDataFrame(rows, "k int, html string").repartition(4)
    nodes = html_elements(pages, ["k"])
    marked = lambda n: n["attrs"].contains("nav")
    flag = F.coalesce(F.col("attrs")["class"], F.lit("")).contains("nav")
    out = under(under(nodes, ["k"], {"above": flag}), ["k"], {"here": flag}, own=True)
    above = F.slice("chain", 2, F.greatest(F.size("chain") - 1, F.lit(0)))
    wrong = out.where((F.col("above") != F.exists(above, marked)) | (F.col("here") != F.exists("chain", marked)))
    assert out.count() == nodes.count() > 1000 and wrong.isEmpty()


@pytest.mark.parametrize("shape", ["wide", "deep"])
def test_rows_grow_with_the_page(shape):
    def size(n: int) -> int:
        if shape == "wide":
            html = "<div>" + "".join(f'<a href="/j/{i}">Job {i}</a><b>Place</b> x ' for i in range(n)) + "</div>"
        else:
            html = "".join(f'<span class=x><a href="/j/{i}">Job {i}</a></i>' for i in range(n))
        rows = element_rows(html, Want(frozenset(("a", "b")), {"class": None}), Want(frozenset(("a", "b"))), 240, False)
        return sum(len(r["text"] or "") + len(r["peer"] or "") + len(r["attrs"]) for r in rows)

    assert size(20_000) < 12 * size(2_000)


def test_links_of_a_large_page(spark):
    """20,000 postings under one parent, behind 5,000 elements that never end: all found, the navigation's left out."""
    body = "<span class=x>" * 5_000 + "".join(f'<a href="/jobs/role-{i}">Engineer role {i}</a>' for i in range(20_000))
    html = '<nav><a href="/jobs/role-nav">Engineer role nav</a></nav><div>' + body + "</div>"
    pages = spark.createDataFrame([(1, "https://a.example/careers", html)], "k int, url string, html string")
    found = pg.job_link_candidates(pages, ["k"])
    assert found.count() == 20_000 and found.where(F.col("link_url").contains("nav")).isEmpty()
    assert found.agg(F.max(F.length("nearby_text"))).first()[0] <= pg.MAX_NEARBY_TEXT


def test_detail_values_behind_long_separators(spark):
    dashes = " - " * 200
    html = f"<h1>T</h1><p><b>Location</b>{dashes}Graz</p><p><b>Salary</b>: {'9' * 251}</p><dl><dt>Country</dt><dt>x</dt><dd>AT</dd></dl>"
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "k int, html string")
    got = {r["k"]: r for r in pg.detail_metadata(pages, ["k"]).collect()}
    assert (got[1]["location"], got[1]["compensation_text"], got[1]["country"]) == ("Graz", None, "AT")
    assert got[2]["title"] is None and got[3]["title"] is None


def test_form_owner(spark):
    html = (
        '<form class="search" action="/a"><input name="x"></form><input name="q">'
        '<form class="job-search" action="/b"><div><input name="Q"><form><input name="location"></form></div></form>'
    )
    pages = spark.createDataFrame([(1, "https://a.example/", html)] * 2, "k int, url string, html string")
    assert {r["target"] for r in pg.search_form_targets(pages, ["k"]).collect()} == {"https://a.example/b?location=&q="}
