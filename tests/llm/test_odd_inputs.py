"""Pages with controls and foreign elements, and column names that clash."""

from __future__ import annotations

import pytest

from snapledger.llm.html_marginals import Page
from snapledger.llm.quality import judge


def texts(html):
    return [t for t in Page(html).text if t]


@pytest.mark.parametrize("tag", ["button", "select", "object", "svg", "math", "noscript"])
def test_a_missing_end_tag_loses_no_other_block(tag):
    found = texts(f"<article><p>First <{tag}>inside</p><p>Second</p><p>Third</p></article>")
    assert found[1:] == ["Second", "Third"] and found[0].startswith("First")


@pytest.mark.parametrize("tag", ["object", "math", "noscript", "svg"])
def test_text_of_foreign_elements_stays(tag):
    assert texts(f"<p>Formula <{tag}>x + 1</{tag}> holds</p>") == ["Formula x + 1 holds"]


@pytest.mark.parametrize("tag", ["button", "select"])
def test_text_of_controls_goes(tag):
    assert texts(f"<p>Press <{tag}>Go <i>now</i></{tag}> twice</p><p>x</p>") == ["Press twice", "x"]


@pytest.mark.parametrize("tag", ["script", "style", "template", "textarea", "iframe", "title"])
def test_raw_text_goes(tag):
    assert texts(f"<p>a <{tag}>b < c <p></{tag}> d</p>") == ["a d"]


def test_quality_rules_with_clashing_names(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(20)
    labels = spark.read.parquet(f"{small}/labels.parquet")
    extra = docs.selectExpr("doc_id", "text", "doc_id AS _measured", "source AS _row", "lang AS score")
    got = {r.doc_id: (r._measured, r.kept) for r in judge(extra, labels).collect()}
    assert got == {r.doc_id: (r.doc_id, r.kept) for r in judge(docs.select("doc_id", "text"), labels).collect()}
