"""Queries for page analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from snapledger.functions import urls
from snapledger.operators import classify as cl
from snapledger.operators import pages as pg
from snapledger.operators import platforms as pf
from snapledger.sources import html_text as ht
from snapledger.suite.registry import query
from snapledger.suite.roles import CAREER_PAGES, DETAIL_PAGES, wrap

_ORIGIN = "regexp_extract(url, '^(https?://[^/]+)', 1)"


@query(
    "extract_links",
    f"""SELECT page_id, href, {_ORIGIN} || href AS link_url, regexp_replace(replace(label, '&amp;', '&'), '\\s+', ' ', 'g') AS link_text FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href,
        unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS label FROM pages)""",
)
def _links(t):
    return pg.extract_links(t.pages, ["page_id"]).select("page_id", "href", "link_url", "link_text")


@query(
    "route_counts",
    """SELECT page_id, '/' || segs AS route_key, count(*) AS route_count FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="/([^"/]*)"', 1)) AS segs FROM pages) GROUP BY ALL""",
)
def _routes(t):
    links = pg.extract_links(t.pages, ["page_id"]).select("page_id", F.col("href").alias("route_key"))
    return pg.route_counts(links, ["page_id"])


_TITLE = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ')"
_LINK = """CASE WHEN p_size <= 10 THEN 'https://c' || p_partkey || '.example.com/jobs/' || replace(p_name, ' ', '-') || '-' || p_partkey
   WHEN p_size <= 20 THEN 'https://c' || p_partkey || '.example.com/jobs/' || replace(p_name, ' ', '-') || '-' || p_partkey || '?v=1'
   ELSE 'https://c' || p_partkey || '.example.com/open/vacancy/' || p_partkey END"""
_WANTED = "p_size <= 20 OR p_size > 40"


@query(
    "job_link_candidates",
    f"""SELECT p_partkey, {_LINK} AS link_url, substr(sha256({_LINK}), 1, 32) AS candidate_id,
        CASE WHEN p_size <= 10 THEN p_name || ' & Co' WHEN p_size <= 20 THEN 'Apply now' ELSE 'Senior role' END AS anchor_text FROM part WHERE {_WANTED}""",
)
def _job_links(t):
    return pg.job_link_candidates(t.sql(CAREER_PAGES), ["p_partkey"]).select("p_partkey", "link_url", "candidate_id", "anchor_text")


@query(
    "candidate_titles",
    f"""SELECT p_partkey, CASE WHEN p_size <= 10 THEN p_name || ' & Co' WHEN p_size <= 20 THEN {_TITLE} || ' ' || p_partkey ELSE 'Senior role' END AS title FROM part WHERE {_WANTED}""",
)
def _titles(t):
    return pg.candidate_titles(pg.job_link_candidates(t.sql(CAREER_PAGES), ["p_partkey"])).select("p_partkey", "title")


@query("generic_records", f"""SELECT p_partkey, {_LINK} AS source_job_url, substr(sha256({_LINK}), 1, 32) AS source_job_id,
    CASE WHEN p_size <= 5 THEN 'Detail ' || p_name WHEN p_size <= 10 THEN p_name || ' & Co' WHEN p_size <= 20 THEN {_TITLE} || ' ' || p_partkey ELSE 'Senior role' END AS title,
    CASE WHEN p_size <= 5 THEN p_type END AS location FROM part WHERE {_WANTED}""")
def _generic(t):
    pages = t.sql(CAREER_PAGES)
    detail_html = F.concat(F.lit("<h1>Detail "), F.col("p_name"), F.lit("</h1><dl><dt>Location</dt><dd>"), F.col("p_type"), F.lit("</dd></dl>"))
    fetched = t.part.where("p_size <= 5").select(
        F.concat(F.lit("https://c"), F.col("p_partkey"), F.lit(".example.com/jobs/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), F.col("p_partkey")).alias("url"),
        detail_html.alias("html"),
    )
    details = pg.detail_metadata(fetched, ["url"])
    return pg.generic_records(pages, details, ["p_partkey"]).select("p_partkey", "source_job_url", "source_job_id", "title", "location")


@query(
    "provider_output_check",
    f"""SELECT p_partkey, 'duplicate' AS violation FROM part WHERE ({_WANTED}) AND p_size <= 10 UNION ALL SELECT p_partkey, 'unknown' FROM part WHERE NOT ({_WANTED})
        UNION ALL SELECT p_partkey, 'empty_title' FROM part WHERE p_size > 40""",
)
def _provider(t):
    pages = t.sql(CAREER_PAGES)
    found = pg.job_link_candidates(pages, ["p_partkey"])
    size = t.part.select("p_partkey", "p_size")
    offered = found.join(size, "p_partkey").select("p_partkey", "candidate_id", F.when(F.col("p_size") > 40, F.lit(" ")).otherwise(F.lit("T")).alias("title"), "p_size")
    twice = offered.unionByName(offered.where("p_size <= 10")).drop("p_size")
    invented = size.where("p_size > 20 AND p_size <= 40").select("p_partkey", F.lit("nope").alias("candidate_id"), F.lit("T").alias("title"))
    return pg.provider_violations(found, twice.unionByName(invented), ["p_partkey"]).select("p_partkey", "violation")


@query(
    "detail_metadata",
    """SELECT p_partkey, CASE WHEN p_size <= 10 THEN p_name || ' role' ELSE p_name END AS title,
      CASE WHEN p_size <= 10 THEN p_type || ', AT' WHEN p_size <= 20 THEN p_type WHEN p_size <= 30 THEN NULL WHEN p_size <= 40 THEN p_brand ELSE p_type || ' | ' || p_brand END AS location,
      CASE WHEN p_size <= 10 THEN p_type END AS city, CASE WHEN p_size <= 10 OR p_size BETWEEN 21 AND 30 THEN 'AT' END AS country,
      CASE WHEN p_size <= 10 THEN 'remote' WHEN p_size BETWEEN 31 AND 40 THEN p_type END AS workplace_type,
      CASE WHEN p_size <= 10 THEN 'FULL_TIME' WHEN p_size BETWEEN 21 AND 30 THEN p_type END AS employment_type,
      CASE WHEN p_size <= 20 THEN p_partkey || ' EUR' WHEN p_size BETWEEN 31 AND 40 THEN p_partkey::VARCHAR END AS compensation_text,
      CASE WHEN p_size > 40 THEN 'Lead' END AS seniority_level, CASE WHEN p_size <= 10 THEN '2024-01-02' END AS published_at,
      CASE WHEN p_size <= 10 THEN 'd ' || p_brand WHEN p_size <= 20 THEN 'Text ' || p_brand END AS description,
      NULL AS job_function, CASE WHEN p_size <= 10 THEN 'IT' END AS industry FROM part""",
)
def _detail(t):
    return pg.detail_metadata(t.sql(DETAIL_PAGES), ["p_partkey"])


@query("jsonld_postings", "SELECT p_partkey, 1 AS postings, p_name || ' role' AS title FROM part WHERE p_size <= 10")
def _jsonld(t):
    found = pg.jsonld_postings(t.sql(DETAIL_PAGES), ["p_partkey"])
    title = F.regexp_replace(F.trim(F.try_variant_get("posting", "$.title", "string")), " +", " ")
    return found.groupBy("p_partkey").agg(F.count("*").alias("postings"), F.max(title).alias("title"))


@query(
    "pagination_targets",
    """SELECT p_partkey, 'https://c' || p_partkey || '.example.com/jobs?page=2' AS target FROM part
       UNION ALL SELECT p_partkey, 'https://c' || p_partkey || '.example.com/jobs/list/3' FROM part WHERE p_size BETWEEN 31 AND 40""",
)
def _pagination(t):
    return pg.pagination_targets(t.sql(CAREER_PAGES), ["p_partkey"]).select("p_partkey", "target")


@query(
    "same_listing_family",
    r"""SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) = 'https://' || regexp_extract(url, '://([^/]+)', 1)
          AND regexp_matches(regexp_extract(url, '://[^/]+([^?#]*)', 1), '^/en(/|$)') AS family FROM pages""",
)
def _family(t):
    base = t.pages.withColumn("home", F.concat(F.lit("https://"), F.regexp_extract("url", r"://([^/]+)", 1), F.lit("/en/")))
    parts = urls.with_parts(urls.with_parts(base, "home", "i_"), "url", "t_")
    return parts.select("page_id", pg.same_listing_family("i_", "i_", "t_").alias("family"))


@query(
    "search_form_target",
    """SELECT p_partkey, 'https://c' || p_partkey || '.example.com/find?x=1' || CASE WHEN p_size <= 20 THEN '&location=' ELSE '' END || '&q=' AS target FROM part WHERE p_size <= 30""",
)
def _form(t):
    method = F.when(F.col("p_size") > 40, F.lit("post")).otherwise(F.lit("get"))
    action = F.when(F.col("p_size") > 30, F.lit("https://other.example.net/find")).otherwise(F.lit("/find?x=1"))
    place = F.when(F.col("p_size") <= 20, F.lit('<input name="location">')).otherwise(F.lit('<input name="Other">'))
    html = F.concat(
        F.lit('<form action="/login"><input name="q"></form><form class="job-search" method="'), method, F.lit('" action="'), action,
        F.lit('"><div><input name="Q">'), place, F.lit("</div></form>"),
    )
    pages = t.part.select("p_partkey", F.concat(F.lit("https://c"), F.col("p_partkey"), F.lit(".example.com/jobs")).alias("url"), html.alias("html"))
    return pg.search_form_targets(pages, ["p_partkey"])


@query(
    "blocked_page",
    """SELECT p_partkey, p_size BETWEEN 21 AND 30 AS has_cards, p_size <= 20 OR p_size > 40 AS blocked_cards,
        p_size <= 10 OR p_size > 40 AS blocked_listing, p_size <= 10 OR p_size > 40 AS blocked_embedded FROM part""",
)
def _blocked(t):
    size = F.col("p_size")
    html = (
        F.when(size <= 10, F.lit("<html><head><title>Access  Denied</title></head><body><p>Verify you are HUMAN</p></body></html>"))
        .when(size <= 20, F.lit("<html><head><title>Jobs</title></head><body><p>security verification</p></body></html>"))
        .when(size <= 30, F.lit('<html><body><div class="job-search-card">x</div><p>security verification</p></body></html>'))
        .when(size <= 40, F.lit("<html><body><script>access denied</script><p hidden>access denied</p><p>jobs</p></body></html>"))
        .otherwise(F.lit('<html><body><form id="captcha-form" action="/login">x</form></body></html>'))
    )
    pages = t.part.select("p_partkey", F.lit("https://x.example.com/jobs").alias("url"), html.alias("html"))
    return pg.blocked_pages(pages, ["p_partkey"])


@query("html_unescape", "SELECT page_id, regexp_extract(html, '<h1>([^<&]*)', 1) || ' & < ü' AS text FROM pages")
def _unescape(t):
    head = F.regexp_extract("html", "<h1>([^<&]*)", 1)
    return t.pages.select("page_id", ht.html_unescape(F.concat(head, F.lit(" &amp; &lt; &uuml;"))).alias("text"))


@query("html_to_lines", r"SELECT doc_id, nullif(array_to_string(list_filter(list_transform(string_split(regexp_replace(text, '[\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]', chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)), '') AS lines FROM documents")
def _lines(t):
    safe = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    wrapped = t.documents.select("doc_id", F.concat(F.lit("<div><p>"), F.replace(safe, F.lit("\n"), F.lit("</p><p>")), F.lit("</p></div>")).alias("html"))
    return ht.html_to_lines(wrapped, "html", "lines").select("doc_id", "lines")


@query("sanitize_html", r"SELECT p_partkey, '<p>' || p_name || ' <b>x</b> y &amp; z</p>' AS html FROM part UNION ALL SELECT -p_partkey - 1, p_name || ' &amp; ' || p_brand || '<br>' || chr(10) || 'z' FROM part")
def _sanitize(t):
    name = F.col("p_name")
    rich = F.concat(F.lit('<section><p class="a">'), name, F.lit(' <b onclick="x()">x</b> <a href="#">y</a><script>bad()</script> &amp; z</p></section>'))
    plain = F.concat(name, F.lit(" & "), F.col("p_brand"), F.lit("\r\nz"))
    both = t.part.select("p_partkey", rich.alias("description")).unionByName(t.part.select((-F.col("p_partkey") - 1).alias("p_partkey"), plain.alias("description")))
    return ht.sanitize_descriptions(both).select("p_partkey", F.col("description_html").alias("html"))


@query(
    "crawl_frontier",
    wrap(c=CAREER_PAGES) + """SELECT p_partkey, link, rank FROM (SELECT p_partkey, link, row_number() OVER (PARTITION BY p_partkey ORDER BY prio, pos) AS rank FROM (
        SELECT p_partkey, unnest(['/news', '/a', '/jobs/x', 'https://jobs.lever.co/acme']) AS link, unnest([5, 4, 2, 0]) AS prio, unnest([1, 2, 3, 4]) AS pos FROM part)) WHERE rank <= 3""",
)
def _frontier(t):
    from snapledger.plans.views import top_per_key

    hrefs = F.array(*map(F.lit, ("/news", "/a", "/jobs/x", "https://jobs.lever.co/acme")))
    rows = t.part.select("p_partkey", F.posexplode(hrefs).alias("pos", "link")).withColumn(
        "target", urls.resolve_href(F.lit("https://www.example.com/"), F.col("link"))
    )
    parts = pf.with_segments(urls.add_canonical_url(rows, "target", "c", keep="u_"), "u_")
    ranked = parts.withColumn("priority", cl.frontier_class(pf.Parts("u_"), F.lit("more"), F.lit("www.example.com")))
    return top_per_key(ranked, ["p_partkey"], [F.col("priority"), F.col("pos")], 3).select("p_partkey", "link", "rank")


@query(
    "trusted_navigation",
    """SELECT page_id, depth, target FROM (SELECT page_id, 1 AS depth, 'jobs.' || host AS target FROM (SELECT page_id, regexp_extract(url, '://([^/]+)', 1) AS host FROM pages)
       UNION ALL SELECT page_id, 2, 'portal.example.net' FROM pages WHERE false)""",
)
def _trusted(t):
    from snapledger.plans.discovery import trusted_navigation

    host = F.regexp_extract("url", r"://([^/]+)", 1)
    base = t.pages.select("page_id", host.alias("host"))
    hop = base.select(
        F.col("page_id").alias("company_id"), F.concat(F.lit("https://"), F.col("host"), F.lit("/")).alias("parent_url"),
        F.concat(F.lit("https://jobs."), F.col("host"), F.lit("/list")).alias("url"), F.lit("View jobs").alias("text"),
    )
    stray = base.select(
        F.col("page_id").alias("company_id"), F.lit("https://stranger.example.net/").alias("parent_url"),
        F.lit("https://portal.example.net/jobs").alias("url"), F.lit("View jobs").alias("text"),
    )
    official = base.select(F.col("page_id").alias("company_id"), F.col("host").alias("root"))
    done = trusted_navigation(hop.unionByName(stray), official, max_depth=2)
    return done.select(F.col("company_id").alias("page_id"), "depth", F.regexp_extract("url", r"://([^/]+)", 1).alias("target"))


@query(
    "auto_detect_source",
    """SELECT p_partkey, CASE WHEN p_size <= 24 THEN 'supported' WHEN p_size <= 44 THEN 'reject' WHEN p_size <= 47 THEN 'generic' ELSE 'reject' END AS verdict FROM part""",
)
def _auto(t):
    from snapledger.plans.discovery import auto_detect_source
    from snapledger.suite.roles import ADDRESSES

    body = F.when(F.col("p_size") <= 47, F.lit('<a href="/careers/dev-1">Developer</a>')).otherwise(F.lit("<p>none</p>"))
    pages = t.sql(ADDRESSES).select(F.col("p_partkey").alias("key"), "url", body.alias("body"), F.array().cast("array<string>").alias("links"))
    return auto_detect_source(pages).select(F.col("key").alias("p_partkey"), "verdict")
