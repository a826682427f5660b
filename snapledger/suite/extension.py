"""Queries for the state write, identity tests, unions and the user-supplied hooks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from snapledger.operators import candidates as ca
from snapledger.operators import classify as cl
from snapledger.operators import pages as pg
from snapledger.operators import platforms as pf
from snapledger.sources.store import PostingStore
from snapledger.staging import staging_dir
from snapledger.suite.pages import _LINK, _WANTED
from snapledger.suite.registry import query
from snapledger.suite.roles import ADDRESSES, CANDIDATES, CAREER_PAGES, SNAP_STATE, TENANT_SOURCES, wrap
from snapledger.suite.snapshots import _state


@query("write_postings_state", wrap(s=SNAP_STATE) + "SELECT id, company_source_id, status, title FROM s")
def _write(t):
    store = PostingStore(t.spark, f"{staging_dir(t.spark)}/state-{uuid.uuid4().hex}", buckets=8)
    rows = _state(t)
    store.write(rows, store.touched(rows), 1)
    return store.read().select("id", "company_source_id", "status", "title")


@query("short_url", r"SELECT page_id, CASE WHEN len(s) > 60 THEN s[1:57] || '…' ELSE s END AS short_url FROM (SELECT page_id, rtrim(regexp_replace(regexp_extract(url || '/' || repeat('x', 40), '://([^?#]*)', 1), '^www\.', ''), '/') AS s FROM pages)")
def _short(t):
    long = t.pages.select("page_id", F.concat("url", F.lit("/"), F.repeat(F.lit("x"), 40)).alias("long"))
    return ca.with_url(long, "long", "u_").select("page_id", ca.short_url("u_", F.col("long")).alias("short_url"))


@query("identity_match", "SELECT c_custkey, c_nationkey < 12 AS matched FROM customer")
def _match(t):
    name = F.lower(F.regexp_replace("c_name", "#", "-"))
    url = F.when(F.col("c_nationkey") < 12, F.concat(F.lit("https://"), name, F.lit(".example.net/x"))).otherwise(F.lit("https://stranger.example.net/x"))
    parts = ca.with_url(t.customer.withColumn("url", url), "url", "u_")
    needles = cl.identity_needles(F.regexp_replace("c_name", "#", ""), F.lit("home.invalid"))
    return parts.select("c_custkey", F.arrays_overlap(needles, cl.url_components(pf.Parts("u_"))).alias("matched"))


@query("best_detection", wrap(a=ADDRESSES) + "SELECT p_partkey, platform, 0 AS position FROM a WHERE platform <> ''")
def _best(t):
    pages = t.sql(ADDRESSES).withColumns({"links": F.array("url", "url"), "body": F.lit("")})
    return pf.detect_platforms(pages, ["p_partkey"]).select("p_partkey", "platform", "position")


@query("candidates_sorted", f"SELECT p_partkey, {_LINK} AS link_url FROM part WHERE {_WANTED} ORDER BY link_url")
def _sorted(t):
    return pg.job_link_candidates(t.sql(CAREER_PAGES), ["p_partkey"]).select("p_partkey", "link_url").orderBy("link_url")


@query(
    "candidate_union",
    wrap(c=CANDIDATES, s=TENANT_SOURCES) + """SELECT company_id, count(*) AS identities FROM (SELECT company_id, platform, lower(canonical_url) AS u FROM c
        UNION SELECT company_id, 'lever', 'https://jobs.lever.co/acme' || id FROM s) GROUP BY company_id""",
)
def _union(t):
    fields = ["company_id", "platform", "canonical_url", "supported", "position"]
    found = t.sql(CANDIDATES).withColumn("position", F.col("id")).select(*fields)
    owned = t.sql(TENANT_SOURCES).select(
        "company_id", F.col("source").alias("platform"), F.col("source_jobs_url").alias("canonical_url"), F.lit(True).alias("supported"), F.col("id").alias("position")
    )
    return ca.dedupe_detections(found.unionByName(owned), ["company_id"]).groupBy("company_id").agg(F.count("*").alias("identities"))


@query(
    "pluggable_extractor",
    f"SELECT p_partkey, upper(CASE WHEN p_size <= 10 THEN p_name || ' & Co' WHEN p_size <= 20 THEN 'Apply now' ELSE 'Senior role' END) AS title FROM part WHERE {_WANTED}",
)
def _extractor(t):
    offered = pg.job_link_candidates(t.sql(CAREER_PAGES), ["p_partkey"]).select("p_partkey", "candidate_id", "anchor_text")

    def extract(batches):
        for batch in batches:
            yield batch.assign(title=batch["anchor_text"].str.upper())[["p_partkey", "candidate_id", "title"]]

    extracted = offered.mapInPandas(extract, "p_partkey bigint, candidate_id string, title string")
    wrong = pg.provider_violations(offered, extracted, ["p_partkey"]).select("p_partkey", "candidate_id")
    return extracted.join(wrong, ["p_partkey", "candidate_id"], "left_anti").select("p_partkey", "title")


@query("detector_rules", wrap(a=ADDRESSES) + "SELECT p_partkey, 'dreamjobs' AS platform, 91 AS confidence FROM a WHERE p_size BETWEEN 17 AND 20 OR p_size BETWEEN 21 AND 24 OR p_size BETWEEN 41 AND 44")
def _rules(t):
    own = (pf.Rule("dreamjobs", 91, "Own rule", lambda p: p.seg(1) == "jobs"),)
    pages = t.sql(ADDRESSES).withColumns({"links": F.array().cast("array<string>"), "body": F.lit("")})
    return pf.detect_platforms(pages, ["p_partkey"], rules=own).select("p_partkey", "platform", "confidence")
