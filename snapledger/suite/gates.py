"""Queries for the completeness gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from snapledger.operators import complete as co
from snapledger.suite.registry import Tables, query
from snapledger.suite.roles import FETCHED, ITEMS, wrap


def _numbered(t):
    """Items with the gap-free page number of their page."""
    pages = t.sql(FETCHED)
    items = t.sql(ITEMS).withColumnRenamed("page_no", "raw_page")
    return items.join(pages.select("run_id", "raw_page", "page_no"), ["run_id", "raw_page"]), pages


class _ByRun(Tables):
    """The same tables with the items of a run in one task: its pages are numbered there, and all that a stop reason
    compares lies within its run, so nothing needs to move a second time."""

    @property
    def lineitem(self):
        return self.spark.read.parquet(f"{self.folder}/lineitem.parquet").repartition("l_orderkey")


_NUMBERED = {
    "raw": ITEMS, "p": FETCHED,
    "i": "SELECT raw.run_id, p.page_no, position, item_id, title, advertised_total FROM raw JOIN p ON raw.run_id = p.run_id AND raw.page_no = p.raw_page",
    "f": "SELECT run_id, item_id, min(page_no) AS first_page FROM i GROUP BY run_id, item_id",
    "g": "SELECT p.run_id, p.page_no, count(f.item_id) AS new_ids FROM p LEFT JOIN f ON p.run_id = f.run_id AND p.page_no = f.first_page GROUP BY p.run_id, p.page_no",
}


@query(
    "snapshot_complete",
    wrap(i=ITEMS) + """SELECT run_id, min(advertised_total) AS total, count(DISTINCT item_id) AS distinct_ids,
        CASE WHEN min(advertised_total) <> max(advertised_total) THEN 'total_changed'
             WHEN count(DISTINCT item_id) > min(advertised_total) THEN 'exceeds_total'
             WHEN count(DISTINCT item_id) < min(advertised_total) THEN 'incomplete' ELSE 'complete' END AS verdict
        FROM i GROUP BY run_id""",
)
def _snapshot(t):
    return co.snapshot_complete(t.sql(ITEMS))


# The signature sees the whole ordered id list of a page; SQL compares the lists themselves.
@query(
    "page_repeat",
    wrap(i="SELECT l_suppkey AS run_id, l_orderkey AS page_no, l_linenumber AS item_id, count(*) AS n FROM {lineitem} GROUP BY 1, 2, 3",
         s="SELECT run_id, page_no, list(item_id ORDER BY item_id) AS ids FROM i GROUP BY run_id, page_no",
         m="SELECT run_id, ids, min(page_no) AS first FROM s GROUP BY run_id, ids")
    + "SELECT s.run_id, page_no, page_no > first AS repeated FROM s JOIN m ON s.run_id = m.run_id AND s.ids = m.ids",
)
def _page_repeat(t):
    items = t.sql("SELECT DISTINCT l_suppkey AS run_id, l_orderkey AS page_no, l_linenumber AS item_id, l_linenumber AS position FROM {lineitem}")
    return co.page_repeat(items).select("run_id", "page_no", "repeated")


@query(
    "content_repeat",
    wrap(p=FETCHED) + "SELECT run_id, page_no, page_no > min(page_no) OVER (PARTITION BY run_id, body) AS repeated FROM p",
)
def _content(t):
    return co.content_repeat(t.sql(FETCHED)).select("run_id", "page_no", "repeated")


@query(
    "url_repeat",
    wrap(p=FETCHED) + "SELECT run_id, page_no, page_no > min(page_no) OVER (PARTITION BY run_id, requested_url) AS repeated FROM p",
)
def _url(t):
    return co.url_repeat(t.sql(FETCHED)).select("run_id", "page_no", "repeated")


@query("no_progress", wrap(**_NUMBERED) + "SELECT run_id, page_no, new_ids FROM g WHERE new_ids = 0 AND page_no >= 2")
def _progress(t):
    items, pages = _numbered(t)
    return co.no_progress(co.page_progress(items, pages), 2)


@query(
    "overlap_streak",
    wrap(**_NUMBERED, z="SELECT *, coalesce(max(CASE WHEN new_ids > 0 THEN page_no END) OVER (PARTITION BY run_id ORDER BY page_no), 0) AS last_new FROM g")
    + "SELECT run_id, page_no, new_ids, page_no - last_new AS streak, page_no - last_new > 0 AS exhausted FROM z",
)
def _streak(t):
    items, pages = _numbered(t)
    return co.overlap_streak(co.page_progress(items, pages), 0)


_SIZES = """SELECT l_orderkey AS run_id, l_linenumber AS page_no, count(*) AS page_len, 6 AS advertised_total
            FROM {lineitem} GROUP BY l_orderkey, l_linenumber"""


@query(
    "terminal_page",
    wrap(s=_SIZES) + """SELECT run_id, last_page, last_len, CASE WHEN last_len = 0 THEN 'empty' WHEN last_len < 2 THEN 'short'
        WHEN last_page >= 3 THEN 'total_reached' WHEN last_page >= 5 THEN 'cap_reached' ELSE 'unfinished' END AS ending
        FROM (SELECT run_id, max(page_no) AS last_page, arg_max(page_len, page_no) AS last_len FROM s GROUP BY run_id)""",
)
def _terminal(t):
    return co.terminal_page(t.sql(_SIZES), page_size=2, max_pages=5)


@query(
    "row_cap",
    "SELECT l_suppkey AS run_id, count(*) AS rows, CASE WHEN count(*) >= 600 THEN 'cap_reached' ELSE 'ok' END AS verdict FROM lineitem GROUP BY l_suppkey",
)
def _cap(t):
    return co.row_cap(t.lineitem.select(F.col("l_suppkey").alias("run_id")), 600)


@query(
    "duplicate_policy",
    wrap(i=ITEMS, d="SELECT run_id, item_id, count(*) AS n, count(DISTINCT title) AS k FROM i GROUP BY run_id, item_id")
    + """SELECT run_id, 'fail' AS policy, sum(n - 1)::BIGINT AS duplicates, count_if(n > 1)::BIGINT AS bad_ids, count_if(n > 1) = 0 AS ok FROM d GROUP BY run_id
       UNION ALL SELECT run_id, 'same_title', sum(n - 1)::BIGINT, count_if(k > 1)::BIGINT, count_if(k > 1) = 0 FROM d GROUP BY run_id
       UNION ALL SELECT run_id, 'keep_first', sum(n - 1)::BIGINT, 0, true FROM d GROUP BY run_id""",
)
def _policy(t):
    items, out = t.sql(ITEMS), None
    for policy in ("fail", "same_title", "keep_first"):
        part = co.duplicate_policy(items, policy).withColumn("policy", F.lit(policy))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "first_seen_dedupe",
    wrap(i=ITEMS) + """SELECT run_id, item_id, page_no, position FROM (SELECT *, row_number() OVER
        (PARTITION BY run_id, item_id ORDER BY page_no, position) AS rn FROM i) WHERE rn = 1""",
)
def _dedupe(t):
    return co.keep_first(t.sql(ITEMS), ["page_no", "position"]).select("run_id", "item_id", "page_no", "position")


@query("new_ids", wrap(**_NUMBERED) + "SELECT i.run_id, i.page_no, count(DISTINCT f.item_id) AS new_ids FROM i JOIN f ON i.run_id = f.run_id AND i.item_id = f.item_id AND i.page_no = f.first_page GROUP BY i.run_id, i.page_no")
def _new(t):
    items, _pages = _numbered(t)
    return co.first_seen(items).groupBy("run_id", F.col("first_page").alias("page_no")).agg(F.count("*").alias("new_ids"))


_CARDS = """SELECT l_orderkey AS run_id, concat(l_linenumber, ':', l_partkey, ':', l_suppkey, ':', CAST(l_extendedprice AS DECIMAL(12,2))) AS seq,
            CASE WHEN l_tax > 0.01 THEN concat('c', l_suppkey) END AS card_id,
            concat('https://x.example.com/', CAST(l_quantity AS INT)) AS url FROM {lineitem}"""


@query("unique_cards")
def _cards(t):
    return co.unique_cards(t.sql(_CARDS))


_REASONS = """, h AS (SELECT p.*, g.new_ids, page_no_first_url, page_no_first_body FROM p JOIN g ON p.run_id = g.run_id AND p.page_no = g.page_no
    JOIN (SELECT run_id, requested_url, min(page_no) AS page_no_first_url FROM p GROUP BY 1, 2) u ON u.run_id = p.run_id AND u.requested_url = p.requested_url
    JOIN (SELECT run_id, body, min(page_no) AS page_no_first_body FROM p GROUP BY 1, 2) b ON b.run_id = p.run_id AND b.body = p.body) """


@query(
    "stop_reason",
    wrap(**_NUMBERED) + _REASONS + """SELECT run_id, min(page_no) AS stopped_at, arg_min(reason, page_no) AS stop_reason FROM (
      SELECT run_id, page_no, CASE WHEN page_no > 5 THEN 'max_pages' WHEN page_no > 6 THEN 'max_requests'
        WHEN page_no_first_url < page_no THEN 'repeated_url' WHEN page_no_first_body < page_no THEN 'repeated_content'
        WHEN new_ids = 0 THEN 'no_new_job_ids' WHEN next_url IS NULL THEN 'no_next_page' END AS reason FROM h)
      WHERE reason IS NOT NULL GROUP BY run_id""",
)
def _stop(t):
    items, _pages = _numbered(t)
    pages = _ByRun(t.spark, t.folder).sql(FETCHED)
    return co.stop_reason(co.page_reasons(pages, items, max_pages=5, max_requests=6))


@query(
    "stop_reason_live",
    wrap(**_NUMBERED) + _REASONS + """SELECT run_id, min(page_no) AS stopped_at, arg_min(reason, page_no) AS stop_reason FROM (
      SELECT run_id, page_no, CASE WHEN page_no > 6 THEN 'page_limit'
        WHEN page_no_first_url < page_no THEN 'repeated_url' WHEN quantity > 49 THEN 'http_403' WHEN quantity > 48 THEN 'http_error_500'
        WHEN quantity > 47 THEN 'redirect_login' WHEN quantity > 46 THEN 'redirect_other'
        WHEN page_no_first_body < page_no THEN 'repeated_content' WHEN discount < 0.01 THEN 'captcha'
        WHEN page_no = 1 AND new_ids = 0 THEN 'no_new_job_ids' WHEN page_no > 1 AND new_ids = 0 THEN 'overlap_limit' END AS reason FROM h)
      WHERE reason IS NOT NULL GROUP BY run_id""",
)
def _stop_live(t):
    items, _pages = _numbered(t)
    pages = _ByRun(t.spark, t.folder).sql(FETCHED)
    q = F.col("quantity")
    live = pages.withColumns(
        {
            "status": F.when(q > 49, 403).when(q > 48, 500).when(q > 46, 302).otherwise(200),
            "redirect_path": F.when(q > 47, F.lit("/uas/login")).when(q > 46, F.lit("/elsewhere")),
            "block_reason": F.when(F.col("discount") < 0.01, F.lit("captcha")),
        }
    )
    return co.stop_reason(co.page_reasons(live, items, max_pages=6, max_requests=9, live=True, overlap_limit=0))


@query(
    "check_complete",
    wrap(**_NUMBERED, v="SELECT run_id, CASE WHEN min(advertised_total) <> max(advertised_total) THEN 'total_changed' WHEN count(DISTINCT item_id) > min(advertised_total) THEN 'exceeds_total' WHEN count(DISTINCT item_id) < min(advertised_total) THEN 'incomplete' END AS e FROM i GROUP BY run_id",
         s="SELECT run_id, page_no, list(item_id || ':' || position ORDER BY position, item_id) AS ids FROM i GROUP BY run_id, page_no",
         r="SELECT DISTINCT a.run_id FROM s a JOIN s b ON a.run_id = b.run_id AND a.ids = b.ids AND a.page_no > b.page_no")
    + """SELECT q.run_id, min(e) AS fetch_error FROM (SELECT DISTINCT run_id FROM p) q LEFT JOIN (SELECT run_id, e FROM v
        UNION ALL SELECT run_id, 'no_progress' FROM g WHERE new_ids = 0 AND page_no >= 2
        UNION ALL SELECT run_id, 'page_repeat' FROM r) x ON q.run_id = x.run_id GROUP BY q.run_id""",
)
def _check(t):
    items, pages = _numbered(t)
    return co.check_complete(items, pages)
