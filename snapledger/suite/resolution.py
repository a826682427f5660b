"""Queries for candidate resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from snapledger.operators import audit as au
from snapledger.operators import candidates as ca
from snapledger.operators import classify as cl
from snapledger.operators import platforms as pf
from snapledger.suite.registry import query
from snapledger.suite.roles import (
    ADDRESSES, CANDIDATES, CAREER_URLS, CHECKS, DISCOVERY_RUNS, RESULTS, TENANT_SOURCES, wrap,
)


def _candidates(t):
    empty = F.array().cast("array<string>")
    return t.sql(CANDIDATES).withColumns(
        {"evidence": F.array("note"), "redirects": empty, "discovered_url": F.col("canonical_url"), "company_source_id": F.lit(None).cast("bigint")}
    ).drop("note", "p_size", "p_retailprice")


def _runs(t):
    return t.sql(DISCOVERY_RUNS).withColumn("started_at", F.col("started_at").cast("timestamp"))


def _results(t):
    return ca.merge_search_results(t.sql(RESULTS)).join(
        t.customer.select(F.col("c_custkey").alias("company_id"), F.col("c_name").alias("name")), "company_id"
    )


@query("merge_search_results", wrap(r=RESULTS) + "SELECT company_id, url, min(seq) AS seq, arg_min(title, seq) AS title, list(query ORDER BY seq) AS queries FROM r GROUP BY company_id, url")
def _merge(t):
    return ca.merge_search_results(t.sql(RESULTS)).select("company_id", "url", "seq", "title", "queries")


@query("search_queries", """SELECT c_custkey, unnest(list_filter(['"' || c_name || '" official website', '"' || c_name || '" careers jobs vacancies recruiting', CASE WHEN c_acctbal > 0 THEN 'site:c' || c_custkey || '.example careers jobs vacancies' END,
   '"' || c_name || '" jobs Lever JazzHR Darwinbox DreamJobs Zoho Recruit Workable Ashby Teamtailor', '"' || c_name || '" jobs Personio Workday Greenhouse SmartRecruiters'], lambda x: x IS NOT NULL)) AS query FROM customer""")
def _queries(t):
    host = F.when(F.col("c_acctbal") > 0, F.concat(F.lit("c"), F.col("c_custkey"), F.lit(".example")))
    return ca.search_queries(t.customer.withColumns({"name": F.col("c_name"), "official_host": host})).select("c_custkey", "query")


_COVER = """SELECT o_custkey AS run_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'acme jobs Lever JazzHR' WHEN '2-HIGH' THEN 'acme Zoho Recruit careers' ELSE 'acme jobs' END AS query FROM {orders}"""


@query(
    "covered_platforms",
    wrap(q=_COVER) + """SELECT DISTINCT run_id, platform, 'not_found' AS status FROM (SELECT run_id, 'lever' AS platform FROM q WHERE query LIKE '%Lever%' UNION ALL SELECT run_id, 'jazzhr' FROM q WHERE query LIKE '%JazzHR%'
        UNION ALL SELECT run_id, 'zoho_recruit' FROM q WHERE query LIKE '%Zoho%')""",
)
def _covered(t):
    covered = ca.covered_platforms(t.sql(_COVER))
    checks = t.sql(_COVER).select("run_id", F.explode(F.array(*map(F.lit, pf.HINTED_PLATFORMS))).alias("platform")).distinct().withColumn("status", F.lit("not_checked"))
    return ca.mark_covered(checks, covered).where("status = 'not_found'").select("run_id", "platform", "status")


@query(
    "company_aliases",
    wrap(r=RESULTS) + """SELECT company_id, alias, rank FROM (SELECT company_id, CASE kind WHEN '1-URGENT' THEN 'Alias ' ELSE 'Old ' END || seq AS alias,
        row_number() OVER (PARTITION BY company_id ORDER BY seq) AS rank FROM r WHERE kind IN ('1-URGENT', '2-HIGH')) WHERE rank <= 2""",
)
def _aliases(t):
    return ca.company_aliases(t.sql(RESULTS), limit=2)


@query(
    "customer_alias",
    wrap(r=RESULTS) + """SELECT company_id, alias, rank, 'https://customer0l' || substr(seq::VARCHAR, 1, 1) || '.darwinbox.com/ms/candidate/careers' AS tenant_url FROM (SELECT company_id, seq, name || ' Labs ' || seq AS alias,
        row_number() OVER (PARTITION BY company_id ORDER BY seq) AS rank FROM r WHERE kind = '3-MEDIUM') WHERE rank <= 2""",
)
def _customer(t):
    return ca.customer_aliases(t.sql(RESULTS).withColumn("url", F.lit("https://explore.darwinbox.com/stories/x")), limit=2)


@query(
    "company_aliases_all",
    wrap(r=RESULTS) + """SELECT company_id, CASE kind WHEN '1-URGENT' THEN 'Alias ' ELSE 'Old ' END || seq AS alias,
        row_number() OVER (PARTITION BY company_id ORDER BY seq) AS rank FROM r WHERE kind IN ('1-URGENT', '2-HIGH')""",
)
def _all_aliases(t):
    return ca.company_aliases(t.sql(RESULTS))


@query(
    "customer_alias_all",
    wrap(r=RESULTS) + """SELECT company_id, name || ' Labs ' || seq AS alias, row_number() OVER (PARTITION BY company_id ORDER BY seq) AS rank,
        'https://customer0l' || substr(seq::VARCHAR, 1, 1) || '.darwinbox.com/ms/candidate/careers' AS tenant_url FROM r WHERE kind = '3-MEDIUM'""",
)
def _all_customer(t):
    return ca.customer_aliases(t.sql(RESULTS).withColumn("url", F.lit("https://explore.darwinbox.com/stories/x")))


_OFFICIAL = """CASE kind WHEN '1-URGENT' THEN 100 WHEN '4-NOT SPECIFIED' THEN 80 WHEN '5-LOW' THEN 40 ELSE 0 END"""


@query(
    "classify_official_site",
    wrap(r=RESULTS) + f"""SELECT seq, {_OFFICIAL} AS confidence, kind IN ('1-URGENT', '4-NOT SPECIFIED') AS accepted,
        CASE WHEN kind = '1-URGENT' THEN regexp_extract(url, '^(https://[^/]+/)', 1) ELSE url END AS canonical_url FROM r""",
)
def _official(t):
    rows = t.sql(RESULTS).withColumn("queries", F.array("query"))
    return ca.classify_official(rows).select("seq", "confidence", "accepted", "canonical_url")


@query(
    "official_rank",
    wrap(r=RESULTS, k="SELECT company_id, name, max(CASE kind WHEN '1-URGENT' THEN 100 WHEN '4-NOT SPECIFIED' THEN 80 END) AS confidence FROM r GROUP BY 1, 2")
    + """SELECT company_id, confidence, 1 AS rank, 1 AS tie_size, CASE WHEN confidence = 100 THEN 'https://www.' || lower(replace(name, '#', '')) || '.example.com/'
         ELSE 'https://' || lower(replace(name, '#', '')) || '.example.org/' END AS canonical_url FROM k WHERE confidence IS NOT NULL""",
)
def _rank(t):
    rows = _results(t).withColumn("manual", F.lit(False))
    return ca.official_candidates(ca.classify_official(rows)).select("company_id", "confidence", "rank", "tie_size", "canonical_url")


@query("tie_set", """WITH x AS (SELECT s_nationkey AS g, s_suppkey, floor(s_acctbal / 100)::BIGINT AS score FROM supplier), m AS (SELECT g, max(score) AS b FROM x GROUP BY g)
   SELECT x.g, s_suppkey, score, count(*) OVER (PARTITION BY x.g) AS tie_size FROM x JOIN m ON x.g = m.g WHERE score >= b - 5""")
def _ties(t):
    x = t.supplier.select(F.col("s_nationkey").alias("g"), "s_suppkey", F.floor(F.col("s_acctbal") / 100).alias("score"))
    return cl.is_tied(x, ["g"], "score")


@query("seed_top3", """SELECT g, s_suppkey, rank FROM (SELECT s_nationkey AS g, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rank FROM supplier) WHERE rank <= 3""")
def _top3(t):
    from snapledger.plans.views import top_per_key

    return top_per_key(t.supplier.withColumnRenamed("s_nationkey", "g"), ["g"], [F.desc("s_acctbal"), F.col("s_suppkey")], 3).select("g", "s_suppkey", "rank")


@query("persist_official", wrap(r=RESULTS) + """SELECT seq, CASE WHEN kind = '3-MEDIUM' THEN 'possible_job_source' WHEN kind = '2-HIGH' THEN 'not_a_job_source' ELSE 'uncertain' END AS job_source_eligibility,
   CASE WHEN kind IN ('1-URGENT', '4-NOT SPECIFIED') THEN 'official_site' WHEN kind = '5-LOW' THEN 'uncertain' ELSE 'not_official_site' END AS official_site_eligibility,
   CASE WHEN kind IN ('1-URGENT', '4-NOT SPECIFIED') THEN 'selected' WHEN kind = '3-MEDIUM' THEN 'needs_review' ELSE 'rejected' END AS decision FROM r""")
def _persist(t):
    rows = t.sql(RESULTS).withColumns({"queries": F.array("query"), "title": F.when(F.col("kind") == "3-MEDIUM", F.lit("Careers")).otherwise(F.col("title"))})
    done = ca.classify_official(rows).withColumn("decision", F.when(F.col("accepted"), F.lit("selected")).otherwise(F.lit("rejected")))
    return ca.persist_official(done).select("seq", "job_source_eligibility", "official_site_eligibility", "decision")


@query(
    "confirm_official",
    """SELECT c_custkey AS company_id, c_nationkey < 20 AS confirmed, CASE WHEN c_nationkey >= 20 THEN 0 ELSE 2 + CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END END AS notes FROM customer""",
)
def _confirm(t):
    site = F.concat(F.lit("https://www."), F.lower(F.replace("c_name", F.lit("#"), F.lit(""))), F.lit(".example.com/"))
    official = t.customer.select(F.col("c_custkey").alias("company_id"), F.col("c_name").alias("name"), site.alias("canonical_url"))
    pages = t.customer.where("c_nationkey < 20").select(
        F.col("c_custkey").alias("company_id"), site.alias("url"), F.concat(F.lit("<h1>Hi "), F.lower("c_name"), F.lit("!</h1>")).alias("body"),
        F.lit(0).alias("depth"), F.when(F.col("c_acctbal") > 0, F.array(F.lit("https://x.example"))).otherwise(F.array().cast("array<string>")).alias("links"), F.lit(1).alias("position"),
    )
    return ca.confirm_official(official, pages).select("company_id", "confirmed", F.size("confirm_evidence").alias("notes"))


@query(
    "classify_job_source",
    r"""WITH x AS (SELECT page_id, link, lower(regexp_extract(link, '://[^/]+([^?#]*)', 1)) AS path, regexp_replace(regexp_extract(link, '://([^/?#]+)', 1), '^www\.', '') AS host FROM (""" + CAREER_URLS.replace("{pages}", "pages") + r"""))
      SELECT page_id, CASE WHEN host LIKE '%.linkedin.com' THEN CASE WHEN path LIKE '%/jobs%' OR regexp_matches(path, 'career|job|vacan|opening|karriere') THEN 'external_job_board' ELSE 'not_a_job_source' END
        WHEN regexp_matches(path, '/article|/blog|/news|/contact|/people|/person/') AND NOT regexp_matches(path, 'career|job|vacan|opening|karriere') THEN 'not_a_job_source'
        WHEN regexp_matches(path, 'career|job|vacan|opening|karriere') THEN 'company_jobs_page' ELSE 'uncertain' END AS eligibility FROM x""",
)
def _classify(t):
    p = pf.Parts("u_")
    staged = ca.with_url(t.sql(CAREER_URLS), "link", "u_")
    none = F.lit("")
    return staged.select("page_id", cl.classify_job_source(p, none, none, F.lit("careers"), none, F.lit(False))["eligibility"].alias("eligibility"))


@query("generic_eligible", wrap(c=CANDIDATES) + "SELECT id, NOT is_ignored AND decision <> 'rejected' AND NOT supported AND (p_size > 47 OR p_size BETWEEN 25 AND 34) AS eligible FROM c")
def _eligible(t):
    return ca.with_url(_candidates(t), "canonical_url", "u_").select("id", cl.generic_eligible(pf.Parts("u_")).alias("eligible"))


@query(
    "attribute_source",
    wrap(a=ADDRESSES) + """SELECT p_partkey, platform <> '' OR p_size > 44 AS attributed FROM a UNION ALL SELECT -p_partkey - 1, false FROM a WHERE p_size <= 24
        UNION ALL SELECT -p_partkey - 1, p_size <= 44 FROM a WHERE p_size > 24""",
)
def _attribute(t):
    # Own company: the tenant name holds the company word. Foreign company: no link at all, except
    # unsupported platforms that first-party search found.
    base = t.sql(ADDRESSES).select(
        "p_partkey", "p_size", F.col("url").alias("candidate_url"), "platform", (F.col("p_size") <= 24).alias("supported"), F.lit(False).alias("first_hop"),
        F.lit(False).alias("adapter_search"), F.lit(False).alias("page_match"),
    )
    token = F.regexp_extract("candidate_url", r"(?i)(acme\d+|org\d+|\bt\d+|\bc\d+)", 1)
    mine = base.withColumns({"name": F.concat(token, F.lit("")), "official_url": F.when(F.col("platform") == "", F.col("candidate_url")).otherwise(F.lit("https://home.invalid/")),
                             "official_link": F.lit(True), "search_identity": F.lit(False), "first_party_search": F.lit(False)})
    other = base.withColumns({"p_partkey": -F.col("p_partkey") - 1, "name": F.lit("Zzyzx"), "official_url": F.lit("https://zzyzx.invalid/"), "official_link": F.lit(False),
                              "search_identity": (F.col("p_size") > 24) & (F.col("platform") != ""), "first_party_search": F.lit(True)})
    return ca.attribute(mine.unionByName(other)).select("p_partkey", "attributed")


@query("equivalent_source", wrap(c=CANDIDATES, s=TENANT_SOURCES) + "SELECT c.id, s.id AS equivalent_source_id FROM c LEFT JOIN s ON c.company_id = s.company_id AND c.platform = 'lever' AND c.canonical_url = 'https://jobs.lever.co/Acme' || s.id")
def _equivalent(t):
    return ca.equivalent_source(_candidates(t), t.sql(TENANT_SOURCES)).select("id", "equivalent_source_id")


@query("candidate_rank", wrap(c=CANDIDATES) + """SELECT id, CASE WHEN p_size <= 24 THEN 0 ELSE 1 END AS by_support, CASE WHEN p_size BETWEEN 25 AND 44 THEN 1 ELSE 0 END AS by_change,
   CASE WHEN p_size > 44 THEN 0 ELSE 1 END AS by_listing, CASE WHEN p_size BETWEEN 25 AND 44 THEN 0 ELSE 1 END AS by_depth FROM c""")
def _ranked(t):
    done = ca.add_rank(_candidates(t))
    return done.select("id", "rank_key.by_support", "rank_key.by_change", "rank_key.by_listing", "rank_key.by_depth")


@query("dedupe_detections", wrap(c=CANDIDATES) + "SELECT company_id, platform, arg_min(id, (supported::INT * -1, id)) AS id FROM c WHERE platform <> '' GROUP BY company_id, platform, canonical_url")
def _dedupe(t):
    rows = _candidates(t).where("platform <> ''").withColumn("position", F.col("id"))
    return ca.dedupe_detections(rows, ["company_id"]).select("company_id", "platform", "id")


_UPSERT = {
    "c": CANDIDATES, "s": TENANT_SOURCES,
    "m": """SELECT run_id, platform, canonical_url, max(confidence) AS confidence, max(job_source_confidence) AS job_source_confidence, arg_max(decision, id) AS decision,
        list_sort(list(DISTINCT note)) AS evidence FROM c GROUP BY ALL""",
}


@query(
    "upsert_candidates",
    wrap(**_UPSERT) + """SELECT run_id, m.canonical_url, confidence, job_source_confidence, m.decision, m.evidence, s.id AS company_source_id,
        CASE WHEN s.id IS NULL THEN 'current_discovery' ELSE 'existing_source' END AS origin FROM m LEFT JOIN s ON m.platform = 'lever' AND m.canonical_url = 'https://jobs.lever.co/Acme' || s.id""",
)
def _upsert(t):
    rows = _candidates(t).withColumn("seq", F.col("id"))
    done = ca.upsert_candidates(rows, t.sql(TENANT_SOURCES))
    return done.select("run_id", "canonical_url", "confidence", "job_source_confidence", "decision", F.array_sort("evidence").alias("evidence"), "company_source_id", "origin")


@query("evidence_union", wrap(c=CANDIDATES) + "SELECT company_id, list_sort(list(DISTINCT x)) AS united FROM (SELECT company_id, unnest([note, platform]) AS x FROM c) GROUP BY 1")
def _united(t):
    rows = t.sql(CANDIDATES).select("company_id", F.explode(F.array("note", "platform")).alias("x")).groupBy("company_id", "x").agg(F.count("*").alias("n"))
    return rows.groupBy("company_id").agg(F.array_sort(F.collect_list("x")).alias("united"))


_SEED = wrap(s=TENANT_SOURCES, r="SELECT DISTINCT CAST(floor(CAST(replace(p_brand, 'Brand#', '') AS BIGINT) / 5) AS BIGINT) AS company_id FROM {part}")


@query(
    "seed_inventory",
    _SEED + """SELECT r.company_id AS run_id, p.platform, coalesce(CASE WHEN p.platform = 'lever' THEN (SELECT arg_max(CASE WHEN approval_status = 'approved' AND is_active THEN 'already_connected' ELSE 'found' END, s.id)
        FROM s WHERE s.company_id = r.company_id) END, 'not_checked') AS status FROM r, (SELECT unnest(['darwinbox','dreamjobs','jazzhr','lever','zoho_recruit']) AS platform) p""",
)
def _seed(t):
    brand = F.regexp_replace("p_brand", "Brand#", "").cast("bigint")
    runs = t.part.select(F.floor(brand / 5).alias("company_id")).distinct().withColumn("id", F.col("company_id"))
    sources = t.sql(TENANT_SOURCES).withColumn("source_jobs_url", F.regexp_replace("source_jobs_url", r"/\?.*", ""))
    return ca.seed_inventory(runs, sources)[1].select("run_id", "platform", "status")


@query(
    "previous_candidates",
    wrap(c=CANDIDATES, r="SELECT * FROM (" + DISCOVERY_RUNS + ") AS q") + """SELECT company_id, platform, canonical_url, arg_max(c.id, (started_at, c.id)) AS id FROM (SELECT c.*, r.started_at FROM c JOIN r ON c.run_id = r.id) c
        WHERE kind = 'source' AND decision <> 'rejected' AND supported GROUP BY ALL""",
)
def _previous(t):
    old = _runs(t)
    runs = old.select("company_id").distinct().withColumn("id", -F.col("company_id") - 1)
    checks = runs.select(F.col("id").alias("run_id"), F.explode(F.array(F.lit("lever"), F.lit("jazzhr"))).alias("platform")).withColumn("status", F.lit("not_checked"))
    return ca.previous_candidates(runs, _candidates(t), old, checks).select("company_id", F.col("identity_platform").alias("platform"), "canonical_url", "id")


@query(
    "adapter_sweep",
    wrap(c=CHECKS) + """SELECT run_id, platform, CASE WHEN status = 'already_connected' THEN status WHEN run_id <= 100 THEN 'found' WHEN run_id <= 150 AND platform = 'jazzhr' THEN 'found' ELSE 'not_found' END AS status,
        CASE WHEN status = 'already_connected' THEN NULL WHEN run_id <= 100 THEN '0' WHEN run_id <= 150 AND platform = 'jazzhr' THEN '1' END AS stage FROM c""",
)
def _sweep(t):
    checks = t.sql(CHECKS)
    general = checks.where("run_id <= 100").select("run_id", "platform")
    adapter = checks.where("run_id <= 150 AND platform = 'jazzhr'").select("run_id", "platform")
    return ca.sweep_status(checks, [general, adapter]).select("run_id", "platform", "status", F.col("found_in_stage").cast("string").alias("stage"))


_BASE = {
    "c": CANDIDATES, "r": DISCOVERY_RUNS, "k": CHECKS, "s": TENANT_SOURCES,
    "i": "SELECT DISTINCT run_id FROM k WHERE status IN ('not_checked', 'search_failed')",
    "w": """SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY c.company_id, platform, canonical_url ORDER BY (c.run_id IN (SELECT run_id FROM i))::INT, r.started_at DESC, c.run_id DESC, confidence DESC, c.id) AS rn
        FROM c JOIN r ON c.run_id = r.id WHERE r.status NOT IN ('running', 'failed')) WHERE rn = 1 AND NOT is_ignored AND decision <> 'rejected'""",
    "l": "SELECT c.id AS cid, s.* FROM c JOIN s ON c.company_id = s.company_id AND c.platform = 'lever' AND c.canonical_url = 'https://jobs.lever.co/Acme' || s.id",
    "z": """SELECT c.id, c.company_id, c.run_id, l.id AS linked, CASE WHEN c.is_ignored THEN 'ignored' WHEN l.id IS NOT NULL AND NOT (NOT l.is_active AND l.approval_status = 'approved') THEN 'connected'
        WHEN c.decision <> 'rejected' AND NOT c.supported AND (c.p_size > 47 OR c.p_size BETWEEN 25 AND 34) THEN 'generic_available'
        WHEN c.p_size BETWEEN 25 AND 44 THEN 'adapter_required' WHEN c.p_size > 47 THEN 'investigation_required'
        WHEN c.decision = 'needs_review' THEN 'needs_review' WHEN c.p_size <= 24 AND c.decision <> 'rejected' THEN 'ready_to_connect' ELSE 'not_a_job_source' END AS state,
        c.p_size > 47 OR c.p_size BETWEEN 25 AND 44 AS listing, c.p_size, c.decision, c.kind, c.supported FROM c LEFT JOIN l ON l.cid = c.id""",
}


@query("supersede_candidates", wrap(**_BASE) + "SELECT id, company_id FROM w")
def _supersede(t):
    return ca.supersede(_candidates(t), _runs(t), t.sql(CHECKS)).select("id", "company_id")


@query("candidate_state", wrap(**_BASE) + "SELECT id, state, linked AS linked_source_id FROM z")
def _states(t):
    return ca.present(_candidates(t), t.sql(TENANT_SOURCES)).select("id", "state", "linked_source_id")


@query("display_name", wrap(c=CANDIDATES) + """SELECT id, CASE platform WHEN 'lever' THEN 'Lever' WHEN 'jazzhr' THEN 'JazzHR' WHEN 'workday' THEN 'Workday' WHEN 'teamtailor' THEN 'Teamtailor' ELSE 'Unrecognized careers source' END AS display_name,
   rtrim(regexp_replace(replace(canonical_url, 'https://', ''), '^www\\.', ''), '/') AS short_url, 'Current discovery' AS origin_label FROM c""")
def _display(t):
    shown = ca.present(_candidates(t), t.sql(TENANT_SOURCES))
    return ca.with_url(shown, "canonical_url", "u_").select(
        "id", "display_name", ca.short_url("u_", F.col("canonical_url")).alias("short_url"), ca.origin_label(F.col("evidence"), F.col("origin")).alias("origin_label")
    )


@query("suppress_supported", wrap(c=CANDIDATES) + "SELECT id FROM c UNION ALL SELECT -id - 1 FROM c WHERE p_size > 24")
def _suppress(t):
    rows = _candidates(t)
    shadow = rows.withColumns({"id": -F.col("id") - 1, "platform": F.lit("generic"), "supported": F.lit(False)})
    return ca.suppress_supported(rows.unionByName(shadow)).select("id")


@query("published_candidates", wrap(**_BASE) + "SELECT w.id, z.state FROM w JOIN z ON w.id = z.id WHERE (z.linked IS NULL OR z.state IN ('ready_to_connect', 'generic_available')) AND z.state IN ('ready_to_connect', 'generic_available', 'adapter_required', 'investigation_required', 'needs_review')")
def _published(t):
    return ca.published_candidates(_candidates(t), _runs(t), t.sql(CHECKS), t.sql(TENANT_SOURCES)).select("id", "state")


@query("discovery_coverage", wrap(c=CANDIDATES, k=CHECKS, f="SELECT run_id, count(DISTINCT (platform, canonical_url)) AS n FROM c WHERE kind = 'source' GROUP BY 1")
       + """SELECT k.run_id, count(*) AS registered, count(*) FILTER (WHERE status <> 'not_checked') AS checked, count(*) FILTER (WHERE status = 'already_connected') AS already_connected, count(*) FILTER (WHERE status = 'not_found') AS not_found,
            count(*) FILTER (WHERE status = 'not_checked') AS not_checked, bool_or(status IN ('not_checked', 'search_failed')) AS partial, coalesce(max(f.n), 0) AS sources_found FROM k LEFT JOIN f ON f.run_id = k.run_id GROUP BY k.run_id""")
def _coverage(t):
    return ca.coverage(t.sql(CHECKS), _candidates(t))


@query("discovery_result", wrap(**_BASE, v="SELECT *, state IN ('ready_to_connect', 'generic_available') AS cc, state = 'needs_review' AND kind = 'source' AND supported AS cf FROM z")
       + """SELECT run_id, count(*) FILTER (WHERE state = 'connected') AS connected, count(*) FILTER (WHERE state = 'ready_to_connect') AS new, count(*) FILTER (WHERE state = 'needs_review') AS needs_review,
            count(*) FILTER (WHERE state = 'adapter_required') AS adapter_required, count(*) FILTER (WHERE state = 'investigation_required') AS investigation_required, count(*) FILTER (WHERE state = 'ignored') AS rejected,
            count(*) FILTER (WHERE state NOT IN ('not_a_job_source', 'ignored')) AS additional FROM v WHERE (linked IS NULL OR cc) AND (listing OR cc OR cf) GROUP BY run_id""")
def _result(t):
    return ca.discovery_result(ca.present(_candidates(t), t.sql(TENANT_SOURCES)))


@query("finish_status", wrap(r=DISCOVERY_RUNS, k=CHECKS, o="SELECT run_id, bool_or(status IN ('not_checked', 'search_failed')) AS open FROM k GROUP BY 1")
       + "SELECT r.id, CASE WHEN NOT open AND status <> 'failed' AND r.id < 80 THEN 'already_connected' WHEN open AND status <> 'failed' THEN 'needs_review' ELSE status END AS status FROM r JOIN o ON o.run_id = r.id")
def _finish(t):
    early = F.col("run_id") < 80
    rows = _candidates(t).withColumns({"kind": F.lit("source"), "company_source_id": F.when(early, F.lit(1)), "decision": F.when(early, F.lit("already_connected")).otherwise(F.col("decision"))})
    return ca.finish_status(_runs(t), t.sql(CHECKS), rows).select("id", "status")


@query(
    "connect_decision",
    """SELECT s_suppkey AS company_id, s_nationkey BETWEEN 5 AND 19 AS connect, CASE WHEN s_nationkey BETWEEN 5 AND 9 THEN 'already_connected' WHEN s_nationkey BETWEEN 10 AND 19 THEN 'connected' END AS decision,
        CASE WHEN s_nationkey BETWEEN 5 AND 9 THEN 'already_connected' WHEN s_nationkey BETWEEN 10 AND 19 THEN 'connected' WHEN s_nationkey < 5 THEN 'needs_review' ELSE 'not_found' END AS status FROM supplier""",
)
def _connect(t):
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    url = F.concat(F.lit("https://jobs.lever.co/s"), key)
    official = t.supplier.select(key.alias("company_id"), F.when(nation < 5, 75).otherwise(90).alias("confidence"))
    found = t.supplier.where(nation < 20).select(key.alias("company_id"), F.lit("lever").alias("platform"), url.alias("canonical_url"), F.lit(98).alias("confidence"), F.lit(True).alias("supported"))
    pages = t.supplier.select(key.alias("company_id"), F.lit("https://home.example.com/").alias("url"), F.array(url).alias("links"))
    sources = t.supplier.where(nation.between(5, 9)).select(key.alias("id"), key.alias("company_id"), F.lit("lever").alias("source"), url.alias("source_jobs_url"), F.lit("approved").alias("approval_status"), F.lit(True).alias("is_active"))
    return ca.connect_decision(official, found, pages, sources).select("company_id", "connect", "decision", "status")


_CONFIRM = wrap(**_BASE, n="SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY id) AS q FROM c", h="SELECT n.*, l.id AS lid, l.approval_status AS ap, l.is_active AS live FROM n LEFT JOIN l ON l.cid = n.id",
                o="""SELECT *, CASE WHEN is_ignored OR decision = 'rejected' OR NOT (p_size <= 24 OR p_size > 47 OR p_size BETWEEN 25 AND 34) THEN 'refused_not_eligible' WHEN ap IN ('blocked', 'rejected') THEN 'refused_blocked'
                    WHEN lid IS NOT NULL AND NOT live AND ap <> 'approved' THEN 'refused_unapproved' WHEN lid IS NOT NULL AND NOT live THEN 'reactivated' WHEN lid IS NOT NULL THEN 'already_connected' ELSE 'connected' END AS raw FROM h""")


@query("confirm_candidates", _CONFIRM + "SELECT id, CASE WHEN raw IN ('connected', 'reactivated') AND row_number() OVER (PARTITION BY company_id, platform, canonical_url, raw ORDER BY id) > 1 THEN 'already_connected' ELSE raw END AS outcome FROM o")
def _confirm_candidates(t):
    rows = _candidates(t)
    return ca.confirm_candidates(rows, t.sql(TENANT_SOURCES), rows.select(F.col("id").alias("candidate_id")))[0].select("id", "outcome")


@query("revalidate_candidates", wrap(c=CANDIDATES) + "SELECT id, CASE WHEN decision = 'rejected' THEN supported ELSE platform IN ('lever', 'jazzhr') END AS supported, CASE WHEN decision = 'rejected' OR platform NOT IN ('lever', 'jazzhr') THEN decision ELSE 'selected' END AS decision FROM c")
def _revalidate(t):
    return ca.revalidate(_candidates(t)).select("id", "supported", "decision")


@query("ignore_candidates", wrap(c=CANDIDATES) + "SELECT id, CASE WHEN p_size <= 12 THEN is_ignored WHEN p_size <= 30 THEN true ELSE is_ignored END AS is_ignored FROM c")
def _ignore(t):
    size = t.part.select(F.col("p_partkey").alias("id"), "p_size")
    rows = _candidates(t).join(size, "id").withColumn("company_source_id", F.when(F.col("p_size") <= 12, F.lit(1)))
    choices = size.where("p_size <= 30").select("id", F.lit(True).alias("ignored"), F.lit(1).alias("seq"))
    return ca.ignore_candidates(rows, choices).select("id", "is_ignored")


@query("audit_candidates", wrap(c=CANDIDATES) + "SELECT run_id || '/' || kind || '/' || platform || '/' || canonical_url AS subject, 'candidate_unique' AS rule FROM c GROUP BY run_id, kind, platform, canonical_url HAVING count(*) > 1")
def _audit(t):
    return au.audit_candidates(_candidates(t))


@query("source_candidates_best", wrap(c=CANDIDATES) + "SELECT run_id, arg_min(id, (-confidence, id)) AS id FROM c GROUP BY run_id")
def _best(t):
    return _candidates(t).groupBy("run_id").agg(F.min_by("id", F.struct(-F.col("confidence"), F.col("id"))).alias("id"))
