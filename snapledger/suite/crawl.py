"""Queries over crawled pages of companies (suppliers play the companies)."""

from __future__ import annotations

from pyspark.sql import functions as F

from snapledger.plans import discovery as dc
from snapledger.suite.registry import query

_KEY = "s_suppkey"


def _say(*parts):
    """Concatenate literals, the supplier key (written ``_KEY``) and other columns."""
    column = lambda p: F.col(p) if p == _KEY else F.lit(p)
    return F.concat(*[column(p) if isinstance(p, str) else p for p in parts])


def _companies(t):
    return t.supplier.select(F.col(_KEY).alias("company_id"), _say("Acme", _KEY).alias("name"), _say("https://www.acme", _KEY, ".example.com/").alias("official_url"))


def _pages(t):
    none = F.array().cast("array<string>")
    portal = _say("https://portal", _KEY, ".example.net/jobs")
    home = _say("https://www.acme", _KEY, ".example.com/")
    links = F.array(_say("https://jobs.lever.co/acme", _KEY), _say("https://acme", _KEY, ".example.com/careers"), portal)
    first = t.supplier.select(F.col(_KEY).alias("company_id"), F.lit(1).alias("page_at"), home.alias("requested_url"), home.alias("url"), F.lit("<p>hello</p>").alias("body"), F.lit(0).alias("depth"), links.alias("links"), none.alias("navigation_links"))
    body = F.lit('<ul><li><a href="/jobs/dev-1">Developer</a></li></ul>')
    hop = t.supplier.select(F.col(_KEY).alias("company_id"), F.lit(2).alias("page_at"), portal.alias("requested_url"), portal.alias("url"), body.alias("body"), F.lit(1).alias("depth"), none.alias("links"), none.alias("navigation_links"))
    return first.unionByName(hop)


@query("direct_official_links", "SELECT s_suppkey AS company_id, 1 AS page_at, true AS official_page, false AS direct_external, false AS first_hop FROM supplier UNION ALL SELECT s_suppkey, 2, false, true, true FROM supplier")
def _direct(t):
    return dc.place_pages(_companies(t), _pages(t)).select("company_id", "page_at", "official_page", "direct_external", "first_hop")


@query("crawl_detections", "SELECT s_suppkey AS company_id, 'lever' AS platform, 'https://jobs.lever.co/acme' || s_suppkey AS canonical_url, 98 AS confidence, 2 AS notes FROM supplier")
def _crawl(t):
    return dc.crawl_detections(_companies(t), _pages(t)).select("company_id", "platform", "canonical_url", "confidence", F.size("evidence").alias("notes"))


@query("listing_parent", "SELECT s_suppkey AS company_id, 'https://portal' || s_suppkey || '.example.net/jobs/dev-1' AS job_url, 'https://portal' || s_suppkey || '.example.net/jobs' AS parent FROM supplier")
def _parents(t):
    return dc.listing_parents(_pages(t))


@query("unknown_careers", "SELECT s_suppkey AS company_id, 'https://acme' || s_suppkey || '.example.com/careers' AS canonical_url, false AS listing_confirmed FROM supplier UNION ALL SELECT s_suppkey, 'https://portal' || s_suppkey || '.example.net/jobs', true FROM supplier")
def _unknown(t):
    pages, companies = _pages(t), _companies(t)
    return dc.unknown_careers(companies, pages, dc.crawl_detections(companies, pages), dc.listing_parents(pages))


@query(
    "search_inventory",
    """SELECT s_suppkey AS company_id, CASE WHEN s_nationkey < 20 THEN 'source' ELSE 'careers' END AS kind, CASE WHEN s_nationkey < 20 THEN 'lever' ELSE '' END AS platform,
         'https://jobs.lever.co/' || CASE WHEN s_nationkey < 20 THEN 'acme' ELSE 'zed' END || s_suppkey AS canonical_url, CASE WHEN s_nationkey < 20 THEN 'needs_review' ELSE 'rejected' END AS decision FROM supplier
       UNION ALL SELECT s_suppkey, 'careers', '', 'https://acme' || s_suppkey || '.example.com/careers/list', 'needs_review' FROM supplier""",
)
def _inventory(t):
    mine = F.col("s_nationkey") < 20
    row = lambda seq, url, title: F.struct(F.lit(seq).alias("seq"), url.alias("url"), title.alias("title"))
    found = F.array(
        row(1, _say("https://jobs.lever.co/", F.when(mine, F.lit("acme")).otherwise(F.lit("zed")), _KEY), F.when(mine, _say("Acme", _KEY, " jobs")).otherwise(F.lit("Other"))),
        row(2, _say("https://acme", _KEY, ".example.com/careers/list?utm_source=x"), F.lit("Careers")),
        row(3, F.lit("https://www.linkedin.com/company/x"), F.lit("Company")),
    )
    results = t.supplier.select(F.col(_KEY).alias("company_id"), F.explode(found).alias("_r")).select(
        "company_id", "_r.*", F.lit("text").alias("description"), F.array(F.lit("acme")).alias("queries")
    )
    parents = t.spark.createDataFrame([], "company_id bigint, job_url string, parent string")
    return dc.search_inventory(_companies(t), results, parents).select("company_id", "kind", "platform", "canonical_url", "decision")
