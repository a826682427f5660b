"""Queries of page sequences and of the whole way from landed payloads to the state, over several families."""

from __future__ import annotations

from pyspark.sql import functions as F

from snapledger.plans.pipeline import run_pipeline
from snapledger.schemas import BATCHES, POSTINGS
from snapledger.sources import shapers as sh
from snapledger.suite.registry import query


def _landed(df, run, source_id, family, page_no, url, body, kind="listing"):
    return df.select(
        run.alias("run_id"), source_id.alias("company_source_id"), F.lit(family).alias("source"), page_no.cast("int").alias("page_no"),
        F.lit(kind).alias("kind"), url.alias("requested_url"), body.alias("body"),
    )


def _lines(t):
    """Order lines as listed jobs: an order is a run of its customer, two lines a page, in line order."""
    line = F.col("l_linenumber")
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderkey").alias("run"), F.col("o_custkey").alias("cust"), F.floor((line - 1) / 2).cast("int").alias("page"), line.alias("line"),
        F.concat(F.lit("P"), F.col("l_partkey")).alias("job"), F.concat(F.col("l_returnflag"), F.col("l_linestatus")).alias("title"),
    )


# Pages of two jobs: a run ends with its first page of one job, and a page without a new job stalls it.
_PAGES = """
l AS (SELECT o_orderkey AS run, o_custkey AS cust, (l_linenumber - 1) // 2 AS page, l_linenumber AS line, 'P' || l_partkey AS job, l_returnflag || l_linestatus AS title
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
f AS (SELECT run, job, min(page) AS page, min(line) AS line FROM l GROUP BY 1, 2),
a AS (SELECT l.run, l.page, count(*) AS n, (SELECT count(*) FROM f WHERE f.run = l.run AND f.page = l.page) AS new_ids FROM l GROUP BY 1, 2),
d AS (SELECT run, min(CASE WHEN n < 2 THEN page END) AS done FROM a GROUP BY run),
g AS (SELECT a.*, d.done FROM a JOIN d ON d.run = a.run WHERE done IS NULL OR page <= done),
"""


def _array_pages(t):
    item = F.struct("line", F.struct(F.col("job").alias("id"), F.col("title").alias("text")).alias("j"))
    pages = _lines(t).groupBy("run", "cust", "page").agg(F.to_json(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["j"])).alias("body"))
    return _landed(pages, F.col("run"), F.col("cust"), "lever", F.col("page"), F.lit("https://api.lever.co/v0/postings/a"), F.col("body"))


@query("page_sequence", "WITH " + _PAGES + """
r AS (SELECT run, any_value(done) AS done, min(CASE WHEN new_ids = 0 THEN page END) AS stalled FROM g GROUP BY run)
SELECT run AS run_id, NULL AS job, NULL AS page_no, CASE WHEN stalled IS NOT NULL THEN 'no_new_ids' ELSE 'unfinished' END AS fetch_error FROM r WHERE stalled IS NOT NULL OR done IS NULL
UNION ALL SELECT f.run, f.job, f.page::INT, NULL FROM f JOIN d ON d.run = f.run WHERE done IS NULL OR f.page <= done""")
def _sequence(t):
    records, errors = sh.shape_lever(_array_pages(t), page_size=2)
    none = F.lit(None).cast("string")
    return records.select("run_id", F.col("source_job_id").alias("job"), "page_no", none.alias("fetch_error")).unionByName(errors, allowMissingColumns=True)


@query("stated_total", """
WITH l AS (SELECT l_orderkey AS run, (l_linenumber - 1) // 2 AS page, l_linenumber AS line, 'P' || l_partkey AS job, l_linenumber = 7 AS shifts FROM lineitem),
o AS (SELECT run, count(DISTINCT job) AS jobs, count(*) AS n FROM l GROUP BY run),
p AS (SELECT l.run, page, bool_or(shifts) AS shifts, CASE WHEN l.run % 5 = 0 THEN jobs + 1 WHEN l.run % 5 = 1 THEN greatest(jobs - 1, 0) ELSE jobs END AS total FROM l JOIN o ON o.run = l.run GROUP BY ALL),
f AS (SELECT run, job, min(page) AS page FROM l GROUP BY 1, 2),
g AS (SELECT p.run, p.page, p.total + CASE WHEN shifts THEN 1 ELSE 0 END AS total, (SELECT count(*) FROM f WHERE f.run = p.run AND f.page = p.page) AS new_ids FROM p),
h AS (SELECT *, coalesce(sum(new_ids) OVER (PARTITION BY run ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, first(total) OVER (PARTITION BY run ORDER BY page) AS stated FROM g),
e AS (SELECT *, min(CASE WHEN before + new_ids = total THEN page END) OVER (PARTITION BY run) AS done FROM h),
v AS (SELECT *, CASE WHEN total <> stated THEN 'total_changed' WHEN new_ids = 0 AND before < total THEN 'no_new_ids' WHEN before + new_ids > total THEN 'total_exceeded' END AS error FROM e WHERE done IS NULL OR page <= done),
x AS (SELECT run, coalesce(arg_min(error, page) FILTER (WHERE error IS NOT NULL), CASE WHEN max(done) IS NULL THEN 'short' END) AS error, max(page) AS last FROM v GROUP BY run)
SELECT x.run AS run_id, error AS fetch_error, (SELECT count(*) FROM f WHERE f.run = x.run AND f.page <= x.last) AS jobs FROM x""")
def _stated(t):
    lines = t.lineitem.select(F.col("l_orderkey").alias("run"), F.floor((F.col("l_linenumber") - 1) / 2).cast("int").alias("page"), F.col("l_linenumber").alias("line"), F.concat(F.lit("P"), F.col("l_partkey")).alias("job"))
    stated = lines.groupBy("run").agg(F.count_distinct("job").alias("jobs"))
    item = F.struct("line", F.struct(F.col("job").alias("id"), F.lit("t").alias("title"), F.lit("d").alias("jd")).alias("j"))
    pages = lines.groupBy("run", "page").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["j"]).alias("data"), F.max((F.col("line") == 7).cast("int")).alias("shift")).join(stated, "run")
    total = F.when(F.col("run") % 5 == 0, F.col("jobs") + 1).when(F.col("run") % 5 == 1, F.greatest(F.col("jobs") - 1, F.lit(0))).otherwise(F.col("jobs")) + F.col("shift")
    body = F.to_json(F.struct(F.lit("success").alias("status"), total.alias("job_counts"), "data"))
    raw = _landed(pages, F.col("run"), F.col("run"), "darwinbox", F.col("page"), F.lit("https://t.darwinbox.com/ms/candidatev2/C1/careers"), body)
    records, errors = sh.shape_darwinbox(raw)
    counted = records.groupBy("run_id").agg(F.count("*").alias("jobs"))
    return stated.select(F.col("run").alias("run_id")).join(errors, "run_id", "left").join(counted, "run_id", "left").na.fill(0, ["jobs"]).select("run_id", "fetch_error", "jobs")


# Customers with two sources: array pages (one run per order) and record arrays (one run per order, all lines).
@query("run_pipeline", "WITH " + _PAGES + """
r AS (SELECT g.run, any_value(o_custkey) AS cust, any_value(o_orderdate) AS at_, bool_or(new_ids = 0) OR any_value(done) IS NULL AS bad, row_number() OVER (PARTITION BY any_value(o_custkey) ORDER BY any_value(o_orderdate), g.run) AS wave
      FROM g JOIN orders ON o_orderkey = g.run GROUP BY g.run),
both_ AS (SELECT cust * 2 AS src, run, wave, bad FROM r UNION ALL SELECT cust * 2 + 1, -run, wave, (SELECT o_totalprice > 300000 FROM orders WHERE o_orderkey = run) FROM r),
ok AS (SELECT *, count(*) FILTER (WHERE NOT bad) OVER (PARTITION BY src ORDER BY wave) AS s FROM both_),
total AS (SELECT src, count(*) FILTER (WHERE NOT bad) AS s FROM both_ GROUP BY src),
seen AS (SELECT ok.src, f.job, ok.wave, ok.s, f.run, f.line FROM ok JOIN f ON f.run = abs(ok.run) JOIN d ON d.run = f.run WHERE NOT bad AND (ok.src % 2 = 1 OR f.page <= done)),
last_ AS (SELECT src, job, max(s) AS s, max(wave) AS wave, arg_max(run, wave) AS run FROM seen GROUP BY 1, 2),
-- array pages keep the first line of a job, record arrays end with the last one
named AS (SELECT z.src, z.job, z.s, CASE WHEN z.src % 2 = 0 THEN (SELECT arg_min(title, (line, title)) FROM l WHERE l.run = z.run AND l.job = z.job) ELSE (SELECT arg_max(title, (line, title)) FROM l WHERE l.run = z.run AND l.job = z.job) END AS title FROM last_ z)
SELECT n.src AS company_source_id, n.job, n.title, CASE WHEN total.s - n.s >= 2 THEN 'not_found' ELSE 'active' END AS status, least(2, total.s - n.s)::INT AS misses FROM named n JOIN total ON total.src = n.src""")
def _pipeline(t):
    lines = _lines(t)
    item = F.struct("line", F.struct(F.lit("fixture").alias("source"), F.col("job").alias("source_job_id"), F.col("title").alias("title")).alias("j"))
    arrays = lines.groupBy("run", "cust").agg(F.to_json(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["j"])).alias("body"))
    broken = t.orders.select(F.col("o_orderkey").alias("run"), (F.col("o_totalprice") > 300000).alias("_broken"))
    whole = arrays.join(broken, "run").withColumn("body", F.when(F.col("_broken"), F.expr("left(body, length(body) - 1)")).otherwise(F.col("body")))
    pages = _array_pages(t).withColumns({"run_id": F.col("run_id") * 2, "company_source_id": F.col("company_source_id") * 2})
    raw = pages.unionByName(_landed(whole, F.col("run") * 2 + 1, F.col("cust") * 2 + 1, "fixture", F.lit(0), F.lit("file"), F.col("body")))
    landed = t.orders.join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")).distinct(), "o_orderkey")
    each = landed.select(
        F.explode(F.array(F.struct((F.col("o_orderkey") * 2).alias("run_id"), (F.col("o_custkey") * 2).alias("src")), F.struct((F.col("o_orderkey") * 2 + 1).alias("run_id"), (F.col("o_custkey") * 2 + 1).alias("src")))).alias("_r"),
        F.col("o_orderdate").cast("timestamp").alias("at"),
    )
    batches = each.select(
        F.col("_r.run_id").alias("run_id"), F.col("_r.src").alias("company_source_id"), F.col("at").alias("started_at"), F.col("at").alias("finished_at"),
        F.lit(1).cast("bigint").alias("requests_made"), F.lit(None).cast("string").alias("fetch_error"),
    ).select([F.col(f.name).cast(f.dataType) for f in BATCHES.fields])
    pair = F.array(F.struct(F.lit(0).alias("n"), F.lit("lever").alias("source")), F.struct(F.lit(1).alias("n"), F.lit("fixture").alias("source")))
    sources = t.customer.select("c_custkey", F.explode(pair).alias("_p")).select(
        (F.col("c_custkey") * 2 + F.col("_p.n")).alias("id"), F.col("c_custkey").alias("company_id"), F.col("_p.source").alias("source"),
        F.lit(None).cast("string").alias("source_jobs_url"), F.lit("approved").alias("approval_status"), F.lit(True).alias("is_active"),
    )
    small = {"lever": lambda rows: sh.shape_lever(rows, page_size=2), "fixture": sh.shape_fixture}
    out = run_pipeline(raw, batches, sources, t.spark.createDataFrame([], POSTINGS), shapers=small)
    return out.postings.select("company_source_id", F.col("source_job_id").alias("job"), "title", "status", F.col("consecutive_successful_misses").alias("misses"))
