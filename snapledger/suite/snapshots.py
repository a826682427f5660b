"""Queries for validation, identity, merge, reconciliation and the whole snapshot plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from snapledger.operators import merge as mg
from snapledger.operators import reconcile as rc
from snapledger.operators import validate as va
from snapledger.plans.ingest import run_snapshots
from snapledger.staging import stage
from snapledger.suite.registry import query
from snapledger.suite.roles import HISTORY, OBSERVATIONS, POSTINGS, SNAP_BATCH, SNAP_RUNS, SNAP_STATE, SOURCES, wrap



def _null():
    return F.lit(None).cast("string")


def _when():
    return F.timestamp_seconds(F.lit(1_700_000_000))


def _full(df):
    """Fill the record fields a role does not set."""
    missing = {c: _null() for c in va.RECORD_FIELDS if c not in df.columns}
    return df.withColumns(missing)


def _state(t):
    rows = _full(t.sql(SNAP_STATE)).withColumn("published_at", F.lit(None).cast("timestamp"))
    keyed = va.with_keys(rows)
    return keyed.withColumns(
        {
            "last_reviewed_content_hash": _null(), "first_seen_at": _when(), "last_seen_at": _when(),
            "created_at": _when(), "updated_at": _when(), "consecutive_successful_misses": F.col("misses").cast("int"),
        }
    ).select(*mg.POSTING_COLUMNS)


def _batch(t):
    return _full(t.sql(SNAP_BATCH))


def _sources(t):
    pair = F.array(
        F.struct(F.lit(0).alias("n"), F.lit("lever").alias("source")), F.struct(F.lit(1).alias("n"), F.lit("generic").alias("source"))
    )
    return t.customer.select("c_custkey", F.explode(pair).alias("_p")).select(
        (F.col("c_custkey") * 2 + F.col("_p.n")).alias("id"), F.col("c_custkey").alias("company_id"),
        F.col("_p.source").alias("source"), _null().alias("source_jobs_url"), F.lit("approved").alias("approval_status"),
        F.lit(True).alias("is_active"),
    )


def _run(t, recover=True):
    batches = t.sql(SNAP_RUNS).select(
        "run_id", "company_source_id", (_when() + F.expr("INTERVAL 1 DAY")).alias("started_at"),
        (_when() + F.expr("INTERVAL 1 DAY 2 SECOND")).alias("finished_at"), F.lit(1).cast("bigint").alias("requests_made"), "fetch_error",
    )
    return run_snapshots(_batch(t), batches, _sources(t), _state(t), recover=recover)


# What the batch must do, stated row by row on the SQL side.
_STEPS = {
    "s": SNAP_STATE, "b": SNAP_BATCH, "r": SNAP_RUNS,
    "j": """SELECT coalesce(s.company_source_id, b.company_source_id) AS src, s.id, s.status, s.misses, s.title AS old_title,
        s.source_job_id AS old_job, b.record_index, trim(b.source_job_id) AS new_job, regexp_replace(b.title, ' +', ' ', 'g') AS new_title,
        s.compensation_text AS old_pay, b.compensation_text AS new_pay,
        b.record_index IS NOT NULL AND b.workplace_type IS NULL AS good, coalesce(b.workplace_type = 'moon', false) AS bad
        FROM s FULL JOIN b ON s.company_source_id = b.company_source_id AND s.id = b.record_index""",
    "o": """SELECT *, CASE WHEN NOT good THEN NULL WHEN id IS NULL THEN 'created'
        WHEN (old_job IS NULL AND new_job IS NOT NULL) OR old_title <> new_title OR status = 'not_found' THEN 'updated' ELSE 'unchanged' END AS outcome FROM j""",
    "c": """SELECT r.company_source_id AS src, r.fetch_error, count(*) FILTER (WHERE outcome = 'created') AS created, count(*) FILTER (WHERE outcome = 'updated') AS updated,
        count(*) FILTER (WHERE outcome = 'unchanged') AS unchanged, count(*) FILTER (WHERE bad) AS failed FROM r LEFT JOIN o ON r.company_source_id = o.src GROUP BY 1, 2""",
    "v": """SELECT *, CASE WHEN fetch_error IS NOT NULL THEN 'failed' WHEN failed > 0 AND created + updated + unchanged = 0 THEN 'failed'
        WHEN failed > 0 THEN 'partial' ELSE 'success' END AS run_status FROM c""",
    "f": """SELECT o.*, v.run_status, CASE WHEN run_status = 'failed' THEN NULL ELSE outcome END AS done FROM o JOIN v ON o.src = v.src""",
    "e": """SELECT src, coalesce(id, record_index) AS n, CASE WHEN done IS NULL THEN old_job WHEN done = 'created' THEN new_job ELSE coalesce(old_job, new_job) END AS job,
        CASE WHEN done IS NULL OR done = 'unchanged' OR old_title = new_title THEN coalesce(old_title, new_title) ELSE new_title END AS title,
        CASE WHEN done IS NULL OR old_title = new_title THEN CASE WHEN id IS NULL THEN new_pay ELSE old_pay END ELSE new_pay END AS pay,
        CASE WHEN done IS NOT NULL THEN CASE WHEN status = 'closed' THEN 'closed' ELSE 'active' END
             WHEN run_status = 'success' AND status = 'active' AND misses + 1 >= 2 THEN 'not_found' ELSE status END AS status,
        CASE WHEN done IS NOT NULL THEN 0 WHEN run_status <> 'success' OR status = 'closed' THEN misses
             WHEN status = 'not_found' THEN 2 ELSE least(misses + 1, 2) END AS misses, id, done, status AS old_status, misses AS old_misses, run_status
        FROM f WHERE id IS NOT NULL OR done IS NOT NULL""",
}


@query(
    "validate_record",
    wrap(b=SNAP_BATCH) + """SELECT record_index, CASE WHEN workplace_type = 'moon' THEN 'bad_workplace_type' END AS reject_reason,
        lower(trim(source)) AS source, trim(source_job_id) AS job, regexp_replace(title, ' +', ' ', 'g') AS title,
        regexp_replace(replace(replace(source_job_url, 'HTTPS://C', 'https://c'), ':443', ''), '#x$', '') AS url FROM b""",
)
def _validate(t):
    done = va.normalize(_batch(t))
    return done.select("record_index", "reject_reason", "source", F.col("source_job_id").alias("job"), "title", F.col("source_job_url").alias("url"))


_PAYLOADS = """
SELECT o_orderkey AS record_index, CASE o_orderpriority
  WHEN '1-URGENT' THEN concat('{"source":"lever","source_job_id":"', o_orderkey, '","title":"x"}')
  WHEN '2-HIGH' THEN concat('{"source":"lever","source_job_id":', o_orderkey, '}')
  WHEN '3-MEDIUM' THEN concat('{"source":"lever","source_job_id":"', o_orderkey, '","extra":1}')
  WHEN '4-NOT SPECIFIED' THEN CASE o_orderstatus WHEN 'F' THEN '{"source":"lever","title":"x"}' WHEN 'O' THEN '{"title":"x","source_job_id":"1"}'
       ELSE '{"source":"lever","source_job_id":"1","published_at":"soon"}' END
  ELSE CASE o_orderstatus WHEN 'F' THEN '[1]' WHEN 'O' THEN '{"source":' ELSE '{"source":"lever","source_job_url":"ftp://x/y","source_job_id":"1"}' END END AS payload
FROM {orders}"""


@query(
    "validate_payload",
    """SELECT o_orderkey AS record_index, CASE o_orderpriority WHEN '1-URGENT' THEN NULL WHEN '2-HIGH' THEN 'bad_type:source_job_id'
         WHEN '3-MEDIUM' THEN 'unsupported_fields'
         WHEN '4-NOT SPECIFIED' THEN CASE o_orderstatus WHEN 'F' THEN 'identity_required' WHEN 'O' THEN 'source_required' ELSE 'bad_published_at' END
         ELSE CASE o_orderstatus WHEN 'P' THEN 'bad_url' ELSE 'not_an_object' END END AS reject_reason FROM orders""",
)
def _payload(t):
    return va.normalize(va.parse_records(t.sql(_PAYLOADS))).select("record_index", "reject_reason")


@query(
    "validate_for_merge",
    wrap(b=SNAP_BATCH, s=SOURCES) + """SELECT record_index, CASE WHEN s.id IS NULL THEN 'unknown_owner' WHEN s.source <> lower(trim(b.source)) THEN 'source_mismatch' END AS owner_reason
        FROM b LEFT JOIN (SELECT * FROM s WHERE approval_status <> 'pending') s ON s.id = b.company_source_id""",
)
def _owner(t):
    keyed = va.with_keys(va.normalize(_batch(t)))
    return va.owner_check(keyed, t.sql(SOURCES).where("approval_status <> 'pending'")).select("record_index", "owner_reason")


def _keyed(t):
    return va.with_keys(va.normalize(_batch(t))).where(F.col("reject_reason").isNull())


@query("match_by_id", wrap(s=SNAP_STATE, b=SNAP_BATCH) + "SELECT b.record_index, s.id AS matched_id FROM b LEFT JOIN s ON b.company_source_id = s.company_source_id AND trim(b.source_job_id) = s.source_job_id WHERE b.workplace_type IS NULL")
def _by_id(t):
    return mg.match_by_id(_keyed(t), _state(t)).select("record_index", "matched_id")


@query("match_by_url", wrap(s=SNAP_STATE, b=SNAP_BATCH) + "SELECT b.record_index, s.id AS matched_url_id, count(s.id) AS url_matches FROM b LEFT JOIN s ON b.company_source_id = s.company_source_id AND b.record_index = s.id AND s.source_job_id IS NULL WHERE b.workplace_type IS NULL GROUP BY 1, 2")
def _by_url(t):
    return mg.match_by_url(_keyed(t), _state(t)).select("record_index", "matched_url_id", "url_matches")


@query("match_by_key", wrap(s=SNAP_STATE, b=SNAP_BATCH) + "SELECT b.record_index, s.id AS matched_key_id FROM b LEFT JOIN s ON b.company_source_id = s.company_source_id AND b.record_index = s.id AND s.source_job_id IS NULL WHERE b.workplace_type IS NULL AND b.source_job_id IS NULL")
def _by_key(t):
    return mg.match_by_key(_keyed(t), _state(t)).select("record_index", "matched_key_id")


@query("resolve_identity", wrap(**_STEPS) + "SELECT record_index, old_job IS NULL AND id IS NOT NULL AND new_job IS NOT NULL AS is_upgrade, false AS conflict, new_job IS NULL AS by_url FROM o WHERE good")
def _resolve(t):
    done = mg.resolve_identity(_keyed(t), _state(t))
    return done.select("record_index", "is_upgrade", "conflict", (F.col("source_job_id").isNull() & (F.col("row_key") == F.col("dedupe_key"))).alias("by_url"))


@query("sequential_outcome", """WITH x AS (SELECT user_id AS k, event_id AS i, event_type AS v FROM events),
   y AS (SELECT *, lag(v) OVER (PARTITION BY k ORDER BY i) AS p FROM x)
   SELECT k, i, p AS previous, CASE WHEN p IS NULL THEN 'created' WHEN p <> v THEN 'updated' ELSE 'unchanged' END AS outcome FROM y""")
def _sequence(t):
    from snapledger.operators.scan import carry_last

    rows = t.events.select(F.col("user_id").alias("k"), F.col("event_id").alias("i"), F.col("event_type").alias("v"))
    done = carry_last(rows, ["k"], F.col("i"), F.col("v"), "previous", block=2000)
    outcome = F.when(F.col("previous").isNull(), F.lit("created")).when(F.col("previous") != F.col("v"), F.lit("updated")).otherwise(F.lit("unchanged"))
    return done.select("k", "i", "previous", outcome.alias("outcome"))


@query("merge_postings", wrap(**_STEPS) + """SELECT src AS company_source_id, coalesce(id, record_index) AS n, outcome IS NOT NULL AS seen,
    (outcome = 'created') IS TRUE AS created, (outcome = 'updated') IS TRUE AS updated, (outcome = 'unchanged') IS TRUE AS unchanged FROM o WHERE id IS NOT NULL OR good""")
def _merge(t):
    incoming = va.owner_check(_keyed(t).withColumn("seen_at", _when()), _sources(t)).drop("owner_reason", "reject_reason")
    merged, _resolved = mg.merge_postings(stage(incoming, "incoming"), _state(t))
    n = F.regexp_extract("source_job_url", r"/(\d+)$", 1).cast("bigint")
    flag = lambda c: (F.col(c) == 1).alias(c)
    return merged.select("company_source_id", n.alias("n"), "seen", flag("created"), flag("updated"), flag("unchanged"))


@query("state_union", wrap(**_STEPS) + "SELECT company_source_id, count(*) AS rows FROM (SELECT src AS company_source_id FROM o WHERE id IS NOT NULL OR good) GROUP BY 1")
def _union(t):
    incoming = va.owner_check(_keyed(t).withColumn("seen_at", _when()), _sources(t)).drop("owner_reason", "reject_reason")
    merged, _resolved = mg.merge_postings(stage(incoming, "incoming"), _state(t))
    return merged.groupBy("company_source_id").agg(F.count("*").alias("rows"))


@query(
    "run_snapshots",
    wrap(**_STEPS) + "SELECT src AS company_source_id, n, job, title, pay, status, misses FROM e",
)
def _snapshots(t):
    n = F.regexp_extract("source_job_url", r"/(\d+)$", 1).cast("bigint")
    return _run(t).postings.select(
        "company_source_id", n.alias("n"), F.col("source_job_id").alias("job"), "title", F.col("compensation_text").alias("pay"), "status",
        F.col("consecutive_successful_misses").alias("misses"),
    )


@query(
    "write_run_ledger",
    wrap(**_STEPS) + """SELECT src AS id, run_status AS status, CASE WHEN run_status = 'failed' THEN 0 ELSE created + updated + unchanged + failed END AS jobs_found,
        CASE WHEN run_status = 'failed' THEN 0 ELSE created END AS jobs_created, CASE WHEN run_status = 'failed' THEN 0 ELSE updated END AS jobs_updated,
        '2.000' AS duration, CASE WHEN fetch_error IS NOT NULL THEN 'Source pipeline failed: ' || fetch_error WHEN run_status = 'failed' THEN 'Source pipeline failed: AllJobRecordsFailedError'
          WHEN run_status = 'partial' THEN failed || ' of ' || (created + updated + unchanged + failed) || ' job records failed processing' ELSE '' END AS error_message FROM v""",
)
def _ledger(t):
    return _run(t).runs.select("id", "status", "jobs_found", "jobs_created", "jobs_updated", F.col("duration_seconds").cast("string").alias("duration"), "error_message")


@query(
    "run_strict",
    wrap(**_STEPS) + """SELECT src AS id, CASE WHEN fetch_error IS NOT NULL OR failed > 0 THEN 'failed' ELSE 'success' END AS status,
        CASE WHEN fetch_error IS NOT NULL OR failed > 0 THEN 0 ELSE created + updated + unchanged END AS jobs_found FROM c""",
)
def _strict(t):
    return _run(t, recover=False).runs.select("id", "status", "jobs_found")


@query(
    "write_rejects",
    wrap(**_STEPS) + """SELECT src AS run_id, record_index, 'normalization' AS stage, 'ValueError' AS error_type, 'bad_workplace_type' AS reason,
        'Job record failed during normalization.' AS message FROM o JOIN r ON r.run_id = o.src WHERE bad AND fetch_error IS NULL""",
)
def _rejects(t):
    return _run(t).rejects


@query(
    "reconcile_counts",
    wrap(**_STEPS) + """SELECT src AS company_source_id, count(*) AS total_source_jobs, count(*) FILTER (WHERE done IS NOT NULL) AS seen_jobs, count(*) FILTER (WHERE done IS NULL) AS unseen_jobs,
        0 AS miss_counters_reset, count(*) FILTER (WHERE done IS NULL AND misses > old_misses) AS miss_counters_incremented,
        count(*) FILTER (WHERE done IS NULL AND old_status = 'active' AND status = 'not_found') AS jobs_marked_not_found, count(*) FILTER (WHERE old_status = 'closed') AS closed_jobs_unchanged
        FROM e WHERE run_status = 'success' GROUP BY src""",
)
def _reconcile_counts(t):
    return _run(t).reconciliation.drop("run_id")


@query(
    "reconcile",
    wrap(s=SNAP_STATE, b="SELECT DISTINCT record_index FROM (" + SNAP_BATCH + ") AS q") + """SELECT id, record_index IS NOT NULL AS seen,
        CASE WHEN record_index IS NOT NULL THEN 0 WHEN status = 'active' THEN least(misses + 1, 3) WHEN status = 'not_found' THEN 3 ELSE misses END AS misses,
        CASE WHEN record_index IS NULL AND status = 'active' AND misses + 1 >= 3 THEN 'not_found' ELSE status END AS status
        FROM s LEFT JOIN b ON s.id = b.record_index""",
)
def _reconcile(t):
    seen = t.sql(SNAP_BATCH).select(F.col("record_index").alias("posting_id"))
    done = rc.reconcile(rc.seen_split(_state(t), seen), threshold=3)
    return done.select("id", "seen", F.col("consecutive_successful_misses").alias("misses"), "status")


@query("seen_split", wrap(s=SNAP_STATE, b=SNAP_BATCH) + "SELECT s.company_source_id, count(*) FILTER (WHERE b.record_index IS NOT NULL) AS seen, count(*) FILTER (WHERE b.record_index IS NULL) AS unseen FROM s LEFT JOIN b ON s.id = b.record_index GROUP BY 1")
def _seen(t):
    seen = t.sql(SNAP_BATCH).select(F.col("record_index").alias("posting_id"))
    return rc.seen_split(_state(t), seen).groupBy("company_source_id").agg(F.count_if("seen").alias("seen"), F.count_if(~F.col("seen")).alias("unseen"))


@query(
    "unknown_seen_ids",
    wrap(p=POSTINGS) + """SELECT o_custkey * 2 AS company_source_id, o_orderkey AS posting_id, 'foreign' AS kind FROM orders WHERE o_orderpriority >= '3'
        UNION ALL SELECT o_custkey * 2, -o_orderkey - 1, 'missing' FROM orders WHERE o_orderpriority < '3'""",
)
def _unknown(t):
    o = t.orders
    own = o.select((F.col("o_custkey") * 2).alias("company_source_id"), F.col("o_orderkey").alias("posting_id"))
    gone = o.where("o_orderpriority < '3'").select((F.col("o_custkey") * 2).alias("company_source_id"), (-F.col("o_orderkey") - 1).alias("posting_id"))
    return rc.unknown_seen_ids(own.unionByName(gone), t.sql(POSTINGS))


_MISS = {
    "o": OBSERVATIONS, "h": HISTORY,
    "k": "SELECT o.company_source_id, o.key, max(o.run_seq) AS last_seen_seq FROM o JOIN h ON o.company_source_id = h.company_source_id AND o.run_seq = h.run_seq WHERE h.status <> 'failed' GROUP BY 1, 2",
}


@query(
    "miss_counter",
    wrap(**_MISS, m="SELECT k.*, count(h.run_seq) AS later FROM k LEFT JOIN h ON h.company_source_id = k.company_source_id AND h.run_seq > k.last_seen_seq AND h.status = 'success' GROUP BY ALL")
    + "SELECT company_source_id, key, last_seen_seq, least(2, later) AS misses, CASE WHEN later >= 2 THEN 'not_found' ELSE 'active' END AS status FROM m",
)
def _misses(t):
    return rc.replay(t.sql(OBSERVATIONS), t.sql(HISTORY))


@query(
    "miss_timeline",
    wrap(o="SELECT DISTINCT * FROM (" + OBSERVATIONS + ") AS q", h=HISTORY,
         s="SELECT o.* FROM o JOIN h ON o.company_source_id = h.company_source_id AND o.run_seq = h.run_seq WHERE h.status <> 'failed'",
         g="SELECT k.company_source_id, k.key, h.run_seq, h.status AS rs FROM (SELECT company_source_id, key, min(run_seq) AS f FROM s GROUP BY 1, 2) k JOIN h ON h.company_source_id = k.company_source_id AND h.run_seq >= k.f AND h.status <> 'failed'",
         m="SELECT g.company_source_id, g.key, g.run_seq, (SELECT count(*) FROM h WHERE h.company_source_id = g.company_source_id AND h.status = 'success' AND h.run_seq <= g.run_seq AND h.run_seq > (SELECT max(s.run_seq) FROM s WHERE s.company_source_id = g.company_source_id AND s.key = g.key AND s.run_seq <= g.run_seq)) AS n FROM g")
    + "SELECT company_source_id, key, run_seq, least(2, n) AS misses, CASE WHEN n >= 2 THEN 'not_found' ELSE 'active' END AS status FROM m",
)
def _timeline(t):
    return rc.miss_timeline(t.sql(OBSERVATIONS), t.sql(HISTORY))


@query(
    "enrichment_overlay",
    wrap(s=SNAP_STATE, b=SNAP_BATCH) + """SELECT b.record_index, s.id IS NOT NULL AS overlaid, coalesce(s.title || ' text', 'fresh') AS description,
        CASE WHEN s.id IS NULL THEN 'fresh pay' ELSE coalesce(s.compensation_text, 'fresh pay') END AS pay
        FROM b LEFT JOIN s ON s.id = b.record_index AND s.company_source_id = b.company_source_id AND s.source = 'generic' AND (s.compensation_text IS NOT NULL OR s.status = 'active')""",
)
def _overlay(t):
    stored = _state(t).withColumns(
        {"description": F.concat(F.col("title"), F.lit(" text")), "location": F.when(F.col("status") == "active", F.lit("Vienna"))}
    )
    fresh = _batch(t).withColumns(
        {"description": F.lit("fresh"), "compensation_text": F.lit("fresh pay"),
         "source_job_url": F.regexp_replace(F.replace(F.replace("source_job_url", F.lit("HTTPS://C"), F.lit("https://c")), F.lit(":443"), F.lit("")), "#x$", "")}
    )
    return va.overlay_details(fresh, stored, _sources(t)).select("record_index", "overlaid", "description", F.col("compensation_text").alias("pay"))


@query("read_snapshot_records", """SELECT o_custkey AS batch, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS record_index,
    CASE WHEN o_custkey BETWEEN 100 AND 199 THEN 'root_not_array' END AS fetch_error FROM orders WHERE o_custkey NOT BETWEEN 100 AND 199
    UNION ALL SELECT o_custkey, NULL, NULL, 'root_not_array' FROM orders WHERE o_custkey BETWEEN 100 AND 199 GROUP BY o_custkey""")
def _read(t):
    from snapledger.sources.payloads import read_snapshot_records

    item = F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("source_job_id"), F.lit("lever").alias("source")))
    bodies = t.orders.groupBy("o_custkey").agg(
        F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", item.alias("j")))), lambda s: s["j"]), ","), F.lit("]")).alias("list")
    ).select(F.col("o_custkey").alias("batch"), F.when(F.col("o_custkey").between(100, 199), F.concat(F.lit('{"a":'), F.col("list"), F.lit("}"))).otherwise(F.col("list")).alias("body"))
    records, verdicts = read_snapshot_records(bodies, ["batch"])
    ids = F.try_variant_get(F.try_parse_json("payload"), "$.source_job_id", "string").cast("bigint")
    return records.select("batch", ids.alias("id"), "record_index", F.lit(None).cast("string").alias("fetch_error")).unionByName(
        verdicts.where(F.col("fetch_error").isNotNull()).select("batch", F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("bigint").alias("record_index"), "fetch_error")
    )
