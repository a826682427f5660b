"""Queries for the ledger, serving views, mutations and audits."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from snapledger.operators import audit as au
from snapledger.operators import mutate as mu
from snapledger.operators import runs as rn
from snapledger.plans import views as vw
from snapledger.suite.registry import query
from snapledger.suite.roles import COMPANIES, POSTINGS, RUN_COMPANIES, RUN_SOURCES, RUNS, SOURCES, wrap


def _utc(df):
    return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in df.schema if f.dataType.typeName() == "timestamp_ntz"})


def _runs(t):
    return _utc(t.sql(RUNS))


def _postings(t):
    return _utc(t.sql(POSTINGS))


def _iso(column, out=None):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(out or column)


_SQL_ISO = "strftime({c}, '%Y-%m-%d %H:%M:%S.%f') AS {c}"


@query(
    "run_outcome_counts",
    """SELECT user_id AS run_id, count(*) AS jobs_found, count(*) FILTER (WHERE event_type = 'signup') AS jobs_created,
       count(*) FILTER (WHERE event_type = 'purchase') AS jobs_updated, count(*) FILTER (WHERE event_type IN ('view', 'click')) AS jobs_unchanged,
       count(*) FILTER (WHERE event_type = 'error') AS jobs_failed FROM events GROUP BY user_id""",
)
def _counts(t):
    kind = F.col("event_type")
    outcome = F.when(kind == "signup", "created").when(kind == "purchase", "updated").when(kind == "error", "failed").otherwise("unchanged")
    return rn.run_outcome_counts(t.events.select(F.col("user_id").alias("run_id"), outcome.alias("outcome")))


@query(
    "run_status",
    """SELECT run_id, CASE WHEN best > 9000 THEN 'failed' WHEN failed > 0 AND ok = 0 THEN 'failed' WHEN failed > 0 THEN 'partial' ELSE 'success' END AS status
       FROM (SELECT o_custkey AS run_id, count(*) FILTER (WHERE o_orderstatus = 'F') AS failed, count(*) FILTER (WHERE o_orderstatus <> 'F') AS ok,
             max(o_orderkey) AS best FROM orders GROUP BY o_custkey)""",
)
def _status(t):
    c = t.orders.groupBy(F.col("o_custkey").alias("run_id")).agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("failed"), F.count_if(F.col("o_orderstatus") != "F").alias("ok"), F.max("o_orderkey").alias("best")
    )
    error = F.when(F.col("best") > 9000, F.lit("incomplete"))
    return c.select("run_id", rn.run_status(F.col("failed"), F.col("ok"), F.lit(True), error).alias("status"))


@query("latest_run_per_source", wrap(r=RUNS) + f"SELECT company_source_id, id, status, {_SQL_ISO.format(c='started_at')} FROM (SELECT *, row_number() OVER (PARTITION BY company_source_id ORDER BY started_at DESC, id DESC) AS rn FROM r) WHERE rn = 1")
def _latest(t):
    return rn.latest_by(_runs(t), ["company_source_id"], ("id", "status", "started_at")).select("company_source_id", "id", "status", _iso("started_at"))


@query("first_run_after", wrap(r=RUNS) + "SELECT company_source_id, min(id) AS first_run_id, arg_min(status, id) AS first_status FROM r WHERE id > 1000 GROUP BY 1")
def _first(t):
    return rn.first_run_after(_runs(t), 1000)


@query("latest_failure", wrap(r=RUNS) + "SELECT strftime(finished_at, '%Y-%m-%d %H:%M:%S.%f') AS finished_at, id FROM r WHERE status = 'failed' ORDER BY r.finished_at DESC, id DESC LIMIT 1")
def _failure(t):
    return rn.latest_failure(_runs(t)).select("boundary.*").select(_iso("finished_at"), "id")


@query("unread_failures", wrap(r=RUNS) + "SELECT count(*) AS unread FROM r WHERE status = 'failed' AND (finished_at, id) > (TIMESTAMP '2024-01-10 00:00:00', 5)")
def _unread(t):
    seen = F.struct(F.timestamp_seconds(F.lit(1_704_844_800)).alias("finished_at"), F.lit(5).cast("bigint").alias("id"))
    return rn.unread_failures(_runs(t), seen)


@query(
    "acknowledge_failure",
    wrap(r=RUNS, a="SELECT company_id AS viewer, max((finished_at, id)) AS seen FROM r WHERE status = 'failed' GROUP BY company_id")
    + "SELECT viewer, CASE WHEN viewer < 10 THEN 999999999 ELSE seen[2] END AS id FROM a",
)
def _ack(t):
    runs = _runs(t)
    acks = runs.select(F.col("company_id").alias("viewer"), F.col("id").alias("run_id"))
    ahead = F.struct(F.timestamp_seconds(F.lit(4_000_000_000)).alias("finished_at"), F.lit(999999999).cast("bigint").alias("id"))
    markers = runs.where("company_id < 10").select(F.col("company_id").alias("viewer")).distinct().withColumn("seen", ahead)
    return rn.acknowledge(markers, acks, runs).select("viewer", F.col("seen.id").alias("id"))


@query(
    "batch_progress",
    wrap(r=RUNS, e="SELECT DISTINCT company_source_id FROM r", f="SELECT company_source_id, arg_min(status, id) AS s FROM r WHERE id > 8000 GROUP BY 1")
    + "SELECT count(*) AS expected_sources, count(*) FILTER (WHERE s <> 'running') AS terminal_sources, bool_and(coalesce(s <> 'running', false)) AS batch_complete FROM e LEFT JOIN f USING (company_source_id)",
)
def _batch(t):
    runs = _runs(t)
    return rn.batch_progress(runs.select("company_source_id"), runs, 8000)


@query(
    "submission_complete",
    wrap(r=RUNS, e="SELECT DISTINCT company_id, company_source_id FROM r", f="SELECT company_source_id, arg_max(status, (started_at, id)) AS s FROM r WHERE id > 5000 GROUP BY 1")
    + "SELECT company_id, count(*) AS expected_sources, bool_and(coalesce(s <> 'running', false)) AS submission_complete FROM e LEFT JOIN f USING (company_source_id) GROUP BY 1",
)
def _submission(t):
    runs = _runs(t)
    return rn.submission_complete(runs.select("company_id", "company_source_id").distinct(), runs, 5000)


_COMPANY = wrap(
    r=RUNS, s=RUN_SOURCES, c=RUN_COMPANIES,
    l="SELECT company_source_id, arg_max(status, (started_at, id)) AS st, max(finished_at) AS fin FROM r GROUP BY 1",
    k="SELECT s.company_id, bool_or(st = 'running') AS a, bool_or(st = 'failed') AS b, bool_or(st = 'partial') AS p, count(st) = count(*) AS q, max(fin) AS fin FROM s LEFT JOIN l ON s.id = l.company_source_id WHERE approval_status = 'approved' AND is_active GROUP BY 1",
)


@query(
    "company_status",
    _COMPANY + """SELECT c.id AS company_id, CASE WHEN a THEN 'running' WHEN b THEN 'failed' WHEN p THEN 'partial' WHEN q THEN 'success' ELSE 'never' END AS last_scrape_status
       FROM c LEFT JOIN k ON c.id = k.company_id""",
)
def _company(t):
    return rn.company_status(t.sql(RUN_COMPANIES), t.sql(RUN_SOURCES), _runs(t)).select("company_id", "last_scrape_status")


@query("last_scraped_at", _COMPANY + "SELECT c.id AS company_id, strftime(fin, '%Y-%m-%d %H:%M:%S.%f') AS last_scraped_at FROM c LEFT JOIN k ON c.id = k.company_id")
def _scraped(t):
    return rn.company_status(t.sql(RUN_COMPANIES), t.sql(RUN_SOURCES), _runs(t)).select("company_id", _iso("last_scraped_at"))


@query(
    "executable_sources",
    wrap(s=RUN_SOURCES, c=RUN_COMPANIES) + """SELECT s.id, CASE WHEN NOT c.is_active THEN 'inactive_company' WHEN NOT s.is_active OR approval_status <> 'approved' THEN 'skipped'
       WHEN source = 'linkedin' THEN 'failed' ELSE 'run' END AS disposition FROM s JOIN c ON s.company_id = c.id""",
)
def _executable(t):
    return rn.executable_sources(t.sql(RUN_SOURCES), t.sql(RUN_COMPANIES)).select("id", "disposition")


@query(
    "submission_summary",
    wrap(s=RUN_SOURCES, c=RUN_COMPANIES, r=RUNS, b="SELECT DISTINCT company_source_id FROM r WHERE status = 'running'",
         m="SELECT s.company_id, CASE WHEN NOT s.is_active OR approval_status <> 'approved' THEN 'skipped' WHEN source = 'linkedin' THEN 'failed' WHEN b.company_source_id IS NOT NULL THEN 'busy' ELSE 'run' END AS d FROM s JOIN c ON s.company_id = c.id AND c.is_active LEFT JOIN b ON b.company_source_id = s.id",
         n="SELECT company_id, count(*) FILTER (WHERE d = 'run') AS started, count(*) FILTER (WHERE d = 'busy') AS already_running, count(*) FILTER (WHERE d = 'skipped') AS skipped, count(*) FILTER (WHERE d = 'failed') AS failed FROM m GROUP BY 1")
    + "SELECT n.*, started + already_running + failed = 0 AS no_executable_source FROM n",
)
def _summary(t):
    return rn.submission_summary(t.sql(RUN_SOURCES), t.sql(RUN_COMPANIES), _runs(t))


@query(
    "run_rules_valid",
    wrap(r=RUNS) + """SELECT id, CASE WHEN jobs_created > jobs_found THEN 'created_exceeds_found' WHEN jobs_updated > jobs_found THEN 'updated_exceeds_found'
       ELSE 'message_required' END AS rule FROM r WHERE jobs_updated > jobs_found OR (status IN ('partial', 'failed') AND error_message = '')""",
)
def _rules(t):
    return rn.rule_violations(_runs(t)).select("id", "rule")


@query("run_filter", wrap(r=RUNS) + "SELECT id, status FROM r WHERE (id IN (1, 5, 9, 40) OR status = 'running') AND company_id = 3")
def _filter(t):
    return rn.run_filter(_runs(t), [1, 5, 9, 40], 3).select("id", "status")


@query("run_history_page", wrap(r=RUNS) + "SELECT id, status FROM r ORDER BY started_at DESC, id DESC LIMIT 25 OFFSET 50")
def _history(t):
    return rn.run_history(_runs(t), page=3).select("id", "status")


@query(
    "parse_id_list",
    "SELECT event_id, list_filter(CASE WHEN user_id = event_id THEN [user_id] ELSE [user_id, event_id] END, lambda x: x > 0) AS ids FROM events",
)
def _ids(t):
    text = F.concat(F.lit(" "), F.col("user_id"), F.lit(",x,-3,"), F.col("event_id"), F.lit(" ,"), F.col("user_id"), F.lit(",0,"), F.col("event_type"))
    return t.events.select("event_id", rn.parse_id_list(text).alias("ids"))


@query(
    "filter_postings",
    wrap(p=POSTINGS, c=COMPANIES) + """SELECT p.id, c.name AS company_name, CASE WHEN last_reviewed_content_hash IS NULL THEN 'new' WHEN last_reviewed_content_hash = content_hash THEN 'reviewed' ELSE 'updated' END AS review_state
      FROM p JOIN c ON p.company_id = c.id WHERE status = 'active' AND workplace_type = 'hybrid' AND lower(country) = 'nation_11' AND contains(lower(location), 'city 1')
      AND contains(lower(title), 'o') AND c.company_type = 'product' AND (last_reviewed_content_hash IS NULL OR last_reviewed_content_hash <> content_hash)
      AND timezone('Europe/Vienna', timezone('UTC', published_at))::DATE BETWEEN DATE '1996-03-31' AND DATE '2001-05-01'
      AND timezone('Europe/Vienna', timezone('UTC', first_seen_at))::DATE BETWEEN DATE '1996-03-31' AND DATE '2001-05-01'""",
)
def _filter_postings(t):
    spec = vw.PostingFilter(
        company_type="product", country=" Nation_11", location="CITY 1", title="O", status="active", workplace_type="hybrid",
        review_state="unreviewed", published_from=date(1996, 3, 31), published_to=date(2001, 5, 1),
        first_seen_from=date(1996, 3, 31), first_seen_to=date(2001, 5, 1),
    )
    return vw.filter_postings(_postings(t), t.sql(COMPANIES), spec).select("id", "company_name", "review_state")


@query("filter_review_state", wrap(p=POSTINGS) + """SELECT 'new' AS wanted, id FROM p WHERE last_reviewed_content_hash IS NULL UNION ALL SELECT 'updated', id FROM p WHERE last_reviewed_content_hash <> content_hash
   UNION ALL SELECT 'unreviewed', id FROM p WHERE last_reviewed_content_hash IS NULL OR last_reviewed_content_hash <> content_hash UNION ALL SELECT 'all', id FROM p""")
def _review_filter(t):
    p = _postings(t)
    out = None
    for wanted in ("new", "updated", "unreviewed", "all"):
        part = p.where(vw.in_review_state(wanted)).select(F.lit(wanted).alias("wanted"), "id")
        out = part if out is None else out.unionByName(part)
    return out


@query("review_state", wrap(p=POSTINGS) + "SELECT id, CASE WHEN last_reviewed_content_hash IS NULL THEN 'new' WHEN last_reviewed_content_hash = content_hash THEN 'reviewed' ELSE 'updated' END AS review_state FROM p")
def _review(t):
    return _postings(t).select("id", vw.review_state().alias("review_state"))


@query("list_postings", wrap(p=POSTINGS) + "SELECT id, title FROM p ORDER BY published_at DESC NULLS LAST, first_seen_at DESC, id DESC")
def _list(t):
    return vw.list_postings(_postings(t)).select("id", "title")


@query("list_company_postings", wrap(p=POSTINGS) + "SELECT id, title FROM p WHERE company_id = 7 ORDER BY last_seen_at DESC, id DESC")
def _list_company(t):
    return vw.list_company_postings(_postings(t).where("company_id = 7")).select("id", "title")


@query("list_companies", wrap(c=COMPANIES) + "SELECT id, name FROM c ORDER BY name, id")
def _companies(t):
    return vw.list_companies(t.sql(COMPANIES)).select("id", "name")


@query("postings_with_company", wrap(p=POSTINGS, c=COMPANIES) + "SELECT p.id, c.name AS company_name FROM p JOIN c ON p.company_id = c.id")
def _with_company(t):
    return vw.postings_with_company(_postings(t), t.sql(COMPANIES)).select("id", "company_name")


@query("distinct_countries", wrap(p=POSTINGS) + "SELECT DISTINCT country FROM p ORDER BY lower(country)")
def _countries(t):
    return vw.distinct_countries(_postings(t))


@query("has_running_run", wrap(s=RUN_SOURCES, r=RUNS) + "SELECT s.id, EXISTS (SELECT 1 FROM r WHERE r.company_source_id = s.id AND r.status = 'running') AS has_running_run FROM s")
def _busy(t):
    return vw.has_running_run(t.sql(RUN_SOURCES), _runs(t)).select("id", "has_running_run")


@query(
    "company_counts",
    wrap(c=COMPANIES, s=SOURCES, p=POSTINGS, r=RUNS) + """SELECT c.id AS company_id, coalesce(j.n, 0) AS jobs, coalesce(j.a, 0) AS active_jobs, coalesce(o.n, 0) AS sources, coalesce(o.a, 0) AS active_sources,
      coalesce(q.n, 0) AS runs, coalesce(q.a, 0) AS running_runs FROM c LEFT JOIN (SELECT company_id, count(*) AS n, count(*) FILTER (WHERE status = 'active') AS a FROM p GROUP BY 1) j ON j.company_id = c.id
      LEFT JOIN (SELECT company_id, count(*) AS n, count(*) FILTER (WHERE is_active AND approval_status = 'approved') AS a FROM s GROUP BY 1) o ON o.company_id = c.id
      LEFT JOIN (SELECT company_id, count(*) AS n, count(*) FILTER (WHERE status = 'running') AS a FROM r GROUP BY 1) q ON q.company_id = c.id""",
)
def _company_counts(t):
    return vw.company_counts(t.sql(COMPANIES), t.sql(SOURCES), _postings(t), _runs(t))


@query(
    "dashboard",
    wrap(c=COMPANIES, p=POSTINGS, r=RUNS) + """SELECT (SELECT count(*) FROM p WHERE last_reviewed_content_hash IS NULL) AS new_jobs, (SELECT count(*) FROM p WHERE last_reviewed_content_hash <> content_hash) AS updated_jobs,
      (SELECT count(*) FROM p WHERE last_reviewed_content_hash IS NULL OR last_reviewed_content_hash <> content_hash) AS unreviewed_jobs, (SELECT count(*) FROM p WHERE status = 'active') AS active_jobs,
      (SELECT count(*) FROM c WHERE is_active) AS monitored_companies, (SELECT count(*) FROM r WHERE status = 'running') AS running_runs, (SELECT count(*) FROM r WHERE status = 'failed') AS failed_runs,
      (SELECT strftime(max(finished_at), '%Y-%m-%d %H:%M:%S.%f') FROM r WHERE status = 'success') AS latest_successful_run""",
)
def _dashboard(t):
    return vw.dashboard(t.sql(COMPANIES), _postings(t), _runs(t)).withColumn("latest_successful_run", _iso("latest_successful_run"))


@query(
    "detail_fetch_plan",
    wrap(p=POSTINGS) + """SELECT company_source_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY company_source_id ORDER BY id) AS rank
        FROM p WHERE employment_type IS NULL AND status <> 'closed') WHERE rank <= 3""",
)
def _fetch_plan(t):
    p = _postings(t)
    links = p.select(
        "company_source_id", "id", F.col("source_job_url").alias("url"), F.lit("a").alias("host"),
        F.when(F.col("status") == "closed", F.lit("b")).otherwise(F.lit("a")).alias("listing_host"), F.col("id").alias("position"),
    )
    return vw.detail_fetch_plan(links, p.withColumn("enriched", F.col("employment_type").isNotNull()), 3).select("company_source_id", "id", "rank")


# --- mutations ---


@query("mark_reviewed", wrap(p=POSTINGS) + "SELECT id, CASE WHEN status = 'active' THEN content_hash ELSE last_reviewed_content_hash END AS reviewed FROM p")
def _mark(t):
    p = _postings(t)
    acks = p.select("id", F.when(F.col("status") == "active", F.col("content_hash")).otherwise(F.lit("stale")).alias("content_hash"))
    return mu.mark_reviewed(p, acks).select("id", F.col("last_reviewed_content_hash").alias("reviewed"))


@query("backfill_reviewed_hash", wrap(p=POSTINGS) + "SELECT id, content_hash AS reviewed FROM p")
def _backfill_hash(t):
    return mu.backfill_reviewed_hash(_postings(t)).select("id", F.col("last_reviewed_content_hash").alias("reviewed"))


_DELETE = wrap(s=RUN_SOURCES, r=RUNS, b="SELECT DISTINCT company_source_id FROM r WHERE status = 'running' AND id > 9900",
               v="SELECT s.id, company_id, CASE WHEN source = 'linkedin' THEN 'not_allowed' WHEN b.company_source_id IS NOT NULL THEN 'running' ELSE 'ok' END AS verdict FROM s LEFT JOIN b ON b.company_source_id = s.id WHERE s.id < 140")


def _late(t):
    return _runs(t).withColumn("status", F.when((F.col("status") == "running") & (F.col("id") <= 9900), F.lit("failed")).otherwise(F.col("status")))


@query("delete_source", _DELETE + "SELECT v.id AS company_source_id, verdict, CASE WHEN verdict = 'ok' THEN (SELECT count(*) FROM r WHERE r.company_source_id = v.id) ELSE 0 END AS runs_preserved, CASE WHEN verdict = 'ok' THEN (SELECT count(*) FROM orders WHERE o_custkey = v.id) ELSE 0 END AS jobs_deleted FROM v")
def _delete(t):
    jobs = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("company_source_id"))
    asked = t.sql(RUN_SOURCES).where("id < 140").select("id")
    return mu.delete_sources(t.sql(RUN_SOURCES), jobs, _late(t), asked)[3].select("company_source_id", "verdict", "runs_preserved", "jobs_deleted")


@query("delete_source_runs", _DELETE + "SELECT r.id, CASE WHEN v.verdict = 'ok' THEN NULL ELSE r.company_source_id END AS company_source_id FROM r LEFT JOIN v ON v.id = r.company_source_id")
def _delete_runs(t):
    jobs = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("company_source_id"))
    asked = t.sql(RUN_SOURCES).where("id < 140").select("id")
    return mu.delete_sources(t.sql(RUN_SOURCES), jobs, _late(t), asked)[2].select("id", "company_source_id")


_GONE = wrap(s=RUN_SOURCES, r=RUNS, c=RUN_COMPANIES, g="SELECT DISTINCT c.id FROM c WHERE c.id < 25 AND c.id NOT IN (SELECT company_id FROM r WHERE status = 'running' AND id > 9900)")


@query("cascade_counts", _GONE + """SELECT g.id AS company_id, (SELECT count(*) FROM s WHERE s.company_id = g.id) AS sources_deleted, (SELECT count(*) FROM orders WHERE o_custkey = g.id) AS jobs_deleted,
    (SELECT count(*) FROM r WHERE r.company_id = g.id) AS runs_deleted FROM g""")
def _cascade(t):
    jobs = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("company_id"))
    companies = t.sql(RUN_COMPANIES)
    return mu.delete_companies(companies, t.sql(RUN_SOURCES), jobs, _late(t), companies.where("id < 25"))[4]


@query("delete_company", _GONE + "SELECT 'source' AS kind, s.id FROM s WHERE company_id NOT IN (SELECT id FROM g) UNION ALL SELECT 'run', r.id FROM r WHERE company_id NOT IN (SELECT id FROM g) UNION ALL SELECT 'company', c.id FROM c WHERE c.id NOT IN (SELECT id FROM g)")
def _delete_company(t):
    companies = t.sql(RUN_COMPANIES)
    jobs = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("company_id"))
    left = mu.delete_companies(companies, t.sql(RUN_SOURCES), jobs, _late(t), companies.where("id < 25"))
    part = lambda df, kind: df.select(F.lit(kind).alias("kind"), "id")
    return part(left[1], "source").unionByName(part(left[3], "run")).unionByName(part(left[0], "company"))


_LEGACY = """SELECT c_custkey AS id, CASE WHEN c_nationkey < 12 THEN ' Lever' ELSE 'generic' END AS source,
    concat(' https://c', c_custkey, '.example.com ') AS source_jobs_url, c_acctbal > 0 AS is_active FROM {customer} WHERE c_mktsegment <> 'FURNITURE'"""


@query("backfill_sources", wrap(l=_LEGACY) + "SELECT id AS company_id, lower(trim(source)) AS source, trim(source_jobs_url) AS source_jobs_url, 'approved' AS approval_status, is_active FROM l")
def _backfill(t):
    return mu.backfill_sources(t.sql(_LEGACY), _postings(t), _runs(t))[0].drop("id")


@query(
    "backfill_problems",
    wrap(l=_LEGACY, p=POSTINGS, r=RUNS) + """SELECT p.id, 'orphan_posting' AS problem FROM p WHERE company_id NOT IN (SELECT id FROM l) UNION ALL SELECT r.id, 'orphan_run' FROM r WHERE company_id NOT IN (SELECT id FROM l)
      UNION ALL SELECT p.id, 'posting_source_mismatch' FROM p JOIN l ON p.company_id = l.id WHERE p.source <> lower(trim(l.source))""",
)
def _problems(t):
    return mu.backfill_sources(t.sql(_LEGACY), _postings(t), _runs(t))[3]


@query(
    "ownership_audit",
    wrap(p=POSTINGS, s=SOURCES) + """SELECT p.id, CASE WHEN s.id IS NULL THEN 'orphan' WHEN s.company_id <> p.company_id THEN 'company_mismatch' ELSE 'source_mismatch' END AS problem
        FROM p LEFT JOIN (SELECT * FROM s WHERE approval_status <> 'pending') s ON s.id = p.company_source_id WHERE s.id IS NULL OR s.company_id <> p.company_id OR s.source <> p.source""",
)
def _ownership(t):
    return au.ownership_audit(_postings(t), t.sql(SOURCES).where("approval_status <> 'pending'"))


@query(
    "audit_postings",
    """SELECT o_custkey || '/' || o_totalprice::INT AS subject, 'dedupe_key_unique' AS rule FROM orders GROUP BY o_custkey, o_totalprice::INT HAVING count(*) > 1
       UNION ALL SELECT o_custkey || '/' || o_orderdate::DATE, 'source_job_id_unique' FROM orders GROUP BY o_custkey, o_orderdate::DATE HAVING count(*) > 1""",
)
def _audit(t):
    o = t.orders
    p = o.select(
        F.col("o_orderkey").alias("id"), F.lit(1).alias("company_id"), F.col("o_custkey").alias("company_source_id"), F.lit("x").alias("source"),
        F.bround("o_totalprice").cast("int").cast("string").alias("dedupe_key"), F.to_date("o_orderdate").cast("string").alias("source_job_id"),
        F.lit(None).cast("string").alias("source_job_url"), F.lit("active").alias("status"), F.lit(0).alias("consecutive_successful_misses"),
    )
    return au.audit_postings(p)


@query("audit_runs", wrap(r=RUNS) + "SELECT 's' || company_source_id AS subject, 'one_running_run' AS rule FROM r WHERE status = 'running' GROUP BY company_source_id HAVING count(*) > 1")
def _audit_runs(t):
    return au.audit_runs(_runs(t))


@query("audit_sources", wrap(s=SOURCES) + "SELECT id::VARCHAR AS subject, 'active_requires_approval' AS rule FROM s WHERE is_active AND approval_status <> 'approved'")
def _audit_sources(t):
    return au.audit_sources(t.sql(SOURCES))


@query("provenance_changes", wrap(p=POSTINGS) + "SELECT id FROM p WHERE status = 'closed'")
def _provenance(t):
    p = _postings(t)
    after = p.withColumn("company_id", F.when(F.col("status") == "closed", F.lit(-1)).otherwise(F.col("company_id")))
    return au.provenance_changes(p, after)
