"""Queries for URL normal forms, platform rules and URL predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from snapledger.functions import text as tx
from snapledger.functions import urls
from snapledger.operators import classify as cl
from snapledger.operators import platforms as pf
from snapledger.suite.registry import query
from snapledger.suite.roles import ADDRESSES, CAREER_URLS, wrap

_RAW_URL = """
SELECT page_id, CASE
  WHEN url LIKE '%utm_source%' THEN concat('  ', replace(url, '.com', '.COM'), ' ')
  WHEN url LIKE '%page=2%' THEN replace(replace(url, '.com/', '.com:443/'), '://', '://Ann:pw@')
  WHEN url LIKE '%.html' THEN replace(replace(url, 'https://', 'ftp://'), '.org/', '.org:8080/')
  WHEN url LIKE '%/' THEN replace(url, '.net/', '.net:80/')
  ELSE url END AS raw FROM {pages}"""
# Splits a trimmed address on the SQL side.
_SPLIT = r"""
SELECT *, lower(regexp_extract(u, '^([A-Za-z]+)://', 1)) AS scheme,
  regexp_extract(u, '^[A-Za-z]+://([^/?#]*)', 1) AS netloc,
  regexp_extract(u, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path,
  regexp_extract(u, '^[^?#]*(\?[^#]*)', 1) AS query FROM {src}"""


def _split(source: str) -> str:
    return _SPLIT.replace("{src}", source)


@query(
    "norm_source_url",
    wrap(raw=_RAW_URL, t="SELECT page_id, trim(raw) AS u FROM raw", s=_split("t"))
    + r"""SELECT page_id, scheme NOT IN ('http', 'https') AS rejected, CASE WHEN scheme IN ('http', 'https') THEN
      scheme || '://' || CASE WHEN netloc LIKE '%@%' THEN regexp_extract(netloc, '^(.*@)', 1) ELSE '' END
      || CASE WHEN scheme = 'http' THEN regexp_replace(lower(regexp_extract(netloc, '([^@]*)$', 1)), ':80$', '')
              ELSE regexp_replace(lower(regexp_extract(netloc, '([^@]*)$', 1)), ':443$', '') END
      || path || query END AS url FROM s""",
)
def _source_url(t):
    done = urls.add_source_url(t.sql(_RAW_URL), "raw", "url")
    return done.select("page_id", F.col("url_bad").alias("rejected"), "url")


@query(
    "canonical_url",
    wrap(raw=_RAW_URL, t="SELECT page_id, trim(raw) AS u FROM raw", s=_split("t"))
    + """SELECT page_id, CASE WHEN scheme IN ('http', 'https') AND netloc NOT LIKE '%@%' THEN
      scheme || '://' || lower(netloc) || CASE WHEN path = '' THEN '/' ELSE path END || query END AS url FROM s""",
)
def _canonical(t):
    return urls.add_canonical_url(t.sql(_RAW_URL), "raw", "url").select("page_id", "url")


_CANDIDATE_SQL = r"""SELECT page_id, scheme || '://' || lower(netloc)
   || CASE WHEN rtrim(p2, '/') = '' THEN '/' ELSE rtrim(p2, '/') END
   || CASE WHEN q3 = '' THEN '' ELSE '?' || q3 END AS url
 FROM (SELECT *, CASE WHEN regexp_matches(netloc || ' ' || p2, 'career|job|opening|position|vacan')
      THEN regexp_replace(q2, '(^|&)page=2($|&)', '') ELSE q2 END AS q3
   FROM (SELECT *, CASE WHEN regexp_matches(rtrim(path, '/'), '/page/[1-9][0-9]*$')
          AND regexp_matches(netloc || path, 'career|job|opening|position|vacan')
        THEN regexp_replace(rtrim(path, '/'), '/page/[1-9][0-9]*$', '') ELSE path END AS p2,
      CASE WHEN query LIKE '%utm_source%' THEN '' ELSE ltrim(query, '?') END AS q2 FROM s))"""


@query("candidate_url", wrap(c=CAREER_URLS, t="SELECT page_id, link AS u FROM c", s=_split("t")) + _CANDIDATE_SQL)
def _candidate(t):
    return urls.add_candidate_url(t.sql(CAREER_URLS), "link", "url").select("page_id", "url")


_LISTING = r"""CASE
  WHEN p_size <= 4 THEN 'https://jobs.lever.co/Acme' || p_partkey
  WHEN p_size <= 8 THEN 'https://t' || p_partkey || '.darwinbox.com/ms/candidate/careers'
  WHEN p_size <= 12 THEN 'https://t' || p_partkey || '.darwinbox.com/ms/candidatev2/C' || p_partkey || '/careers'
  WHEN p_size <= 16 THEN 'https://t' || p_partkey || '.applytojob.com/apply'
  WHEN p_size <= 20 THEN 'https://t' || p_partkey || '.dream.jobs/jobs'
  WHEN p_size <= 24 THEN 'https://t' || p_partkey || '.zohorecruit.com/jobs/Careers'
  WHEN p_size <= 28 THEN 'https://t' || p_partkey || '.myworkdayjobs.com/'
  WHEN p_size <= 32 THEN 'https://boards.greenhouse.io/Org' || p_partkey
  WHEN p_size <= 36 THEN 'https://t' || p_partkey || '.jobs.personio.de/'
  WHEN p_size <= 40 THEN 'https://apply.workable.com/Org' || p_partkey
  WHEN p_size <= 44 THEN 'https://t' || p_partkey || '.teamtailor.com/' END"""


def _with_parts(df, url="url"):
    return pf.with_segments(urls.add_canonical_url(df, url, "_canonical", keep="u_"), "u_")


_P = pf.Parts("u_")


@query("platform_canonical", wrap(a=ADDRESSES) + f"SELECT p_partkey, {_LISTING} AS listing FROM a")
def _platform_canonical(t):
    return _with_parts(t.sql(ADDRESSES)).select("p_partkey", pf.platform_canonical(F.col("platform"), _P).alias("listing"))


_IDENTITY = r"""SELECT p_partkey, platform AS identity_platform, CASE
  WHEN p_size <= 4 THEN 'jobs.lever.co:acme' || p_partkey
  WHEN p_size <= 8 THEN 't' || p_partkey || '.darwinbox.com:main'
  WHEN p_size <= 12 THEN 't' || p_partkey || '.darwinbox.com:c' || p_partkey
  WHEN p_size <= 16 THEN 't' || p_partkey || '.applytojob.com'
  WHEN p_size <= 20 THEN 't' || p_partkey || '.dream.jobs'
  WHEN p_size <= 24 THEN 't' || p_partkey || '.zohorecruit.com'
  WHEN p_size <= 28 THEN 't' || p_partkey || '.myworkdayjobs.com'
  WHEN p_size <= 32 THEN 'boards.greenhouse.io:org' || p_partkey
  WHEN p_size <= 36 THEN 't' || p_partkey || '.jobs.personio.de'
  WHEN p_size <= 40 THEN 'apply.workable.com:org' || p_partkey
  WHEN p_size <= 44 THEN 't' || p_partkey || '.teamtailor.com'
  ELSE 'https://www.c' || p_partkey || '.example.com/careers' END AS identity_key FROM a"""


@query("logical_identity", wrap(a=ADDRESSES) + _IDENTITY)
def _identity(t):
    return pf.add_identity(t.sql(ADDRESSES), "platform", "url").select("p_partkey", "identity_platform", "identity_key")


@query("source_url_valid", wrap(a=ADDRESSES) + "SELECT p_partkey, p_size BETWEEN 5 AND 24 AS valid FROM a")
def _valid(t):
    return pf.add_source_valid(t.sql(ADDRESSES), "platform", "url", "valid").select("p_partkey", "valid")


_IDS = """
SELECT o_orderkey, CASE o_orderpriority
  WHEN '1-URGENT' THEN concat('urn:li:jobPosting:', o_orderkey)
  WHEN '2-HIGH' THEN concat('https://www.linkedin.com/jobs/view/a-role-', o_orderkey, '?x=1')
  WHEN '3-MEDIUM' THEN concat('https://www.linkedin.com/jobs/search?jobId=', o_orderkey, '&y=2')
  WHEN '4-NOT SPECIFIED' THEN CAST(o_orderkey AS VARCHAR(20)) ELSE 'none' END AS value,
  concat('https://acme.applytojob.com/apply/', CASE WHEN o_orderstatus = 'F' THEN 'jobs/details/Key' ELSE 'Key' END,
    lpad(CAST(o_orderkey AS VARCHAR(20)), 8, '0'), CASE WHEN o_orderstatus = 'F' THEN '' ELSE '/Some-Role' END) AS apply_url
FROM {orders}"""


@query(
    "url_job_id",
    wrap(i=_IDS) + """SELECT o_orderkey, CASE WHEN value <> 'none' THEN CAST(o_orderkey AS VARCHAR) END AS card_id,
       'Key' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS apply_id FROM i""",
)
def _job_id(t):
    return _with_parts(t.sql(_IDS), "apply_url").select(
        "o_orderkey", pf.card_job_id(F.col("value")).alias("card_id"), pf.apply_job_id(_P).alias("apply_id")
    )


@query(
    "continuation_url",
    """SELECT o_orderkey, 'https://www.linkedin.com/jobs-guest/jobs/api/seeMoreJobPostings/acme-jobs-worldwide?f_C='
       || least(o_custkey, o_orderkey) || CASE WHEN o_custkey = o_orderkey THEN '' ELSE '%2C' || greatest(o_custkey, o_orderkey) END
       || '&start=' || (o_custkey * 25) AS next_url FROM orders""",
)
def _continuation(t):
    ids = F.array(F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"))
    return t.orders.select("o_orderkey", pf.continuation_url(F.lit("acme-jobs-worldwide"), ids, F.col("o_custkey") * 25).alias("next_url"))


@query(
    "job_detail_url",
    wrap(i=_IDS) + "SELECT o_orderkey, CASE WHEN value <> 'none' THEN 'https://www.linkedin.com/jobs/view/' || o_orderkey END AS detail_url FROM i",
)
def _detail_url(t):
    return t.sql(_IDS).select(
        "o_orderkey", F.concat(F.lit("https://www.linkedin.com/jobs/view/"), pf.card_job_id(F.col("value"))).alias("detail_url")
    )


@query(
    "title_from_slug",
    """SELECT p_partkey, CASE WHEN p_size > 25 THEN NULL ELSE array_to_string(list_transform(string_split(p_name, ' '),
         lambda w: upper(w[1:1]) || lower(w[2:])), ' ') || ' ' || p_partkey END AS title FROM part""",
)
def _slug(t):
    path = F.concat(F.lit("/jobs/"), F.replace(F.col("p_name"), F.lit(" "), F.lit("-")), F.lit("_"), F.col("p_partkey"),
                    F.when(F.col("p_size") > 25, F.lit(".html")).otherwise(F.lit("/")))
    return t.part.select("p_partkey", urls.title_from_slug(path).alias("title"))


@query("domain_seed", "SELECT c_custkey, 'https://c' || c_custkey || '.example.com/' AS seed FROM customer")
def _seed(t):
    bare = t.customer.select("c_custkey", F.concat(F.lit(" C"), F.col("c_custkey"), F.lit(".example.com. ")).alias("domain"))
    from snapledger.operators.candidates import domain_seed

    return urls.add_canonical_url(bare.withColumn("d", domain_seed(F.col("domain"))), "d", "seed").select("c_custkey", "seed")


@query(
    "excluded_unknown_url",
    wrap(c=CAREER_URLS, t="SELECT page_id, link AS u FROM c", s=_split("t"))
    + r"""SELECT page_id, regexp_matches(lower(netloc), '(^|\.)(facebook|glassdoor|indeed|instagram|leadiq|linkedin|naukri|twitter|x|youtube)\.com$')
      OR list_has_any(string_split(lower(path), '/'), ['article','articles','blog','blogs','employee','employees','event','events','insight','insights','news','people','person','press','press-release','press-releases','profile','profiles','resource','resources'])
      OR regexp_matches(lower(path), 'application|apply|cookie|legal|login|privacy|signin|sign-in|terms|wp-login') AS excluded FROM s""",
)
def _excluded(t):
    return _with_parts(t.sql(CAREER_URLS), "link").select("page_id", cl.excluded_unknown(_P).alias("excluded"))


@query(
    "blocked_official_host",
    wrap(a=ADDRESSES) + """SELECT p_partkey, CASE WHEN p_size <= 4 THEN 'jobs.lever.co' WHEN p_size <= 12 THEN 'darwinbox.com'
       WHEN p_size <= 16 THEN 'applytojob.com' WHEN p_size <= 20 THEN 'dream.jobs' WHEN p_size BETWEEN 29 AND 32 THEN 'boards.greenhouse.io'
       WHEN p_size BETWEEN 37 AND 40 THEN 'workable.com' WHEN p_size BETWEEN 41 AND 44 THEN 'teamtailor.com' END AS blocked FROM a""",
)
def _blocked(t):
    return _with_parts(t.sql(ADDRESSES)).select("p_partkey", cl.blocked_official_host(_P.host).alias("blocked"))


@query(
    "job_navigation",
    wrap(a=ADDRESSES) + r"""SELECT p_partkey, regexp_matches(regexp_extract(url, '^https://[^/]+(/[^?]*)', 1), '/(careers|jobs)/?$')
         OR p_size IN (5, 26, 30) AS navigation FROM a""",
)
def _navigation(t):
    size = F.col("p_size")
    text = F.when(size == 5, F.lit("See  our: Open-Positions!")).when(size == 26, F.lit("Apply")).when(
        size == 30, F.lit("join US today")
    ).otherwise(F.lit("more"))
    return _with_parts(t.sql(ADDRESSES)).select("p_partkey", cl.job_navigation(_P, text).alias("navigation"))


@query(
    "source_landing",
    wrap(c=CAREER_URLS, t="SELECT page_id, link AS u FROM c", s=_split("t"))
    + r"""SELECT page_id, NOT (regexp_matches(lower(query), 'jobid=|job=|ref=|vacancy=|gh_jid=')
        OR regexp_matches(path, '(^|/)[0-9]{3,}(/|$)') OR regexp_matches(lower(path), 'detail|apply|candidateexperience|vacancy\.aspx'))
        AND len(list_filter(string_split(path, '/'), lambda x: x <> '')) <= 2 AS landing FROM s""",
)
def _landing(t):
    return _with_parts(t.sql(CAREER_URLS), "link").select("page_id", cl.source_landing(_P).alias("landing"))


@query(
    "default_link_admission",
    wrap(c=CAREER_URLS) + """SELECT page_id, regexp_matches(lower(link || ' ' || url), 'career|jobs|vacan|work-with|work_with|karriere|stellen|kariéra|prace|lever\\.co|applytojob\\.com|dream\\.jobs|darwinbox|greenhouse\\.io|workable\\.com|smartrecruiters\\.com|teamtailor') AS admitted FROM c""",
)
def _admission(t):
    return t.sql(CAREER_URLS).select("page_id", cl.link_admitted(F.col("link"), F.col("url")).alias("admitted"))


@query(
    "url_identity_parts",
    r"""SELECT page_id, list_sort(list_distinct(list_concat(
          list_filter(list_transform(string_split(regexp_replace(regexp_extract(url, '://([^/]*)', 1), '^www\.', ''), '.'),
            lambda x: regexp_replace(x, '[^\p{L}\p{N}]+', '', 'g')), lambda x: x <> ''),
          regexp_extract_all(regexp_extract(url, '://[^/]*([^#]*)', 1), '[a-z0-9]+')))) AS parts FROM pages""",
)
def _parts(t):
    return _with_parts(t.pages).select("page_id", F.array_sort(cl.url_components(_P)).alias("parts"))


@query(
    "identity_needles",
    r"""SELECT c_custkey, list_sort(list_distinct(list_concat([regexp_replace(lower(c_name), '[^a-z0-9]+', '', 'g')],
         list_filter(regexp_extract_all(lower(c_name), '[a-z0-9]+'), lambda w: len(w) >= 4),
         ['shop' || c_custkey || 'acmeexample'], ['acme' || ''], ['example'],
         list_filter(['shop' || c_custkey], lambda w: len(w) >= 4)))) AS needles FROM customer""",
)
def _needles(t):
    host = F.concat(F.lit("www.shop"), F.col("c_custkey"), F.lit(".acme.example"))
    return t.customer.select("c_custkey", F.array_sort(cl.identity_needles(F.col("c_name"), host)).alias("needles"))


@query(
    "official_score",
    r"""SELECT c_custkey, least(100, 25 + CASE WHEN c_nationkey < 10 THEN 55 ELSE 0 END
         + CASE WHEN c_acctbal > 0 THEN 15 ELSE 0 END + CASE WHEN c_nationkey BETWEEN 5 AND 15 THEN 5 ELSE 0 END) AS score FROM customer""",
)
def _score(t):
    label = F.when(F.col("c_nationkey") < 10, F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("-")))).otherwise(F.lit("other"))
    host = F.concat(F.when(F.col("c_nationkey").between(5, 15), F.lit("www.")).otherwise(F.lit("")), label, F.lit(".example.com"))
    title = F.when(F.col("c_acctbal") > 0, F.concat(F.upper("c_name"), F.lit(" - home"))).otherwise(F.lit("Home"))
    return t.customer.select("c_custkey", cl.official_score(F.col("c_name"), host, title).alias("score"))


@query(
    "detect_platforms",
    wrap(a=ADDRESSES) + f"""SELECT p_partkey, platform, {_LISTING} AS canonical_url,
         CASE WHEN p_size <= 12 OR p_size BETWEEN 17 AND 24 THEN 98 ELSE 96 END AS confidence,
         p_size <= 24 AS supported FROM a WHERE platform <> ''
       UNION ALL SELECT p_partkey, 'lever', 'https://jobs.lever.co/Shared', 98, true FROM a""",
)
def _detect(t):
    pages = t.sql(ADDRESSES).withColumns(
        {"links": F.array(F.lit("https://jobs.lever.co/Shared/1"), F.lit("https://jobs.lever.co/Shared/2"), F.lit("mailto:x")),
         "body": F.lit("plain")}
    )
    found = pf.detect_platforms(pages, ["p_partkey"])
    return found.select("p_partkey", "platform", "canonical_url", "confidence", "supported")


@query(
    "platform_coverage_diff",
    wrap(a=ADDRESSES) + """SELECT platform, 'extra' AS side FROM (SELECT DISTINCT platform FROM a) WHERE platform NOT IN ('darwinbox','dreamjobs','jazzhr','lever','zoho_recruit')""",
)
def _coverage(t):
    hints = t.sql("SELECT DISTINCT platform FROM (" + ADDRESSES + ")")
    expected = hints.where(F.col("platform").isin(*pf.HINTED_PLATFORMS))
    return pf.coverage_diff(expected, t.sql(ADDRESSES))


@query(
    "host_family",
    """WITH h AS (SELECT page_id, regexp_replace(regexp_extract(url, '://([^/]*)', 1), '^www\\.', '') AS host FROM pages),
       r AS (SELECT DISTINCT regexp_replace(host, '^(m|blog)\\.', '') AS root FROM h)
       SELECT page_id, root FROM h JOIN r ON host = root OR host LIKE '%.' || root""",
)
def _family(t):
    from snapledger.operators.candidates import host_family

    pages = _with_parts(t.pages).select("page_id", cl.bare_host(_P.host).alias("host"))
    roots = pages.select(F.regexp_replace("host", r"\A(m|blog)\.", "").alias("root")).distinct()
    return host_family(pages, roots).select("page_id", "root")


@query(
    "title_safe",
    r"""SELECT page_id, len(trim(title)) <= 200 AND trim(title) <> '' AND NOT regexp_matches(lower(title), 'privacy policy|terms of service|cookie policy|login|sign in|sign up|linkedin|facebook|twitter|instagram|about us|contact us|work with us|what to do after applying|after applying')
        AND lower(trim(title)) NOT IN ('apply', 'jobs') AND title NOT LIKE '%://%' AND NOT regexp_matches(trim(title), '^[/\\]') AND regexp_matches(title, '\p{L}') AS safe
        FROM (SELECT page_id, CASE WHEN url LIKE '%#top' THEN ' Apply ' WHEN url LIKE '%/' THEN url WHEN url LIKE '%.html' THEN '12 34' WHEN url LIKE '%page=2%' THEN 'About Us today' ELSE html END AS title FROM pages)""",
)
def _safe(t):
    from snapledger.operators.pages import title_safe

    url = F.col("url")
    title = (F.when(url.endswith("#top"), F.lit(" Apply ")).when(url.endswith("/"), url).when(url.endswith(".html"), F.lit("12 34"))
             .when(url.contains("page=2"), F.lit("About Us today")).otherwise(F.col("html")))
    return t.pages.select("page_id", title_safe(tx.norm_text(title)).alias("safe"))


@query(
    "frontier_class",
    wrap(a=ADDRESSES) + """SELECT p_partkey, CASE WHEN p_size <= 24 THEN 0 WHEN p_size = 25 THEN 1
        WHEN p_size BETWEEN 29 AND 36 OR p_size BETWEEN 41 AND 50 THEN 2 ELSE 4 END AS priority FROM a""",
)
def _frontier(t):
    text = F.when(F.col("p_size") == 25, F.lit("Our  JOB portal")).otherwise(F.lit("more"))
    return _with_parts(t.sql(ADDRESSES)).select("p_partkey", cl.frontier_class(_P, text, F.lit("example.org")).alias("priority"))
