"""Queries for the text, date, list and hash functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from snapledger.functions import text as tx
from snapledger.functions.hashing import CONTENT_FIELDS, content_hash, dedupe_key
from snapledger.suite.registry import query
from snapledger.suite.roles import POSTINGS, RUNS, wrap

_WS = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_WSL = _WS.replace(r"\x09-\x0d", r"\x09\x0b-\x0d")


def _sql_text(column: str) -> str:
    return f"nullif(trim(regexp_replace({column}, '{_WS}+', ' ', 'g'), ' '), '')"


def _labels(column: str, sep: str) -> str:
    return f"array_to_string(regexp_extract_all(replace(lower({column}), 'ß', 'ss'), '[a-z0-9]+'), '{sep}')"


@query("norm_text", f"SELECT doc_id, {_sql_text('text')} AS norm FROM documents")
def _norm_text(t):
    return t.documents.select("doc_id", tx.norm_text(F.col("text")).alias("norm"))


@query(
    "norm_description",
    rf"""SELECT doc_id, nullif(regexp_replace(regexp_replace(regexp_replace(
           replace(text, chr(10), chr(13) || chr(10)), '\r\n?', chr(10), 'g'),
           '{_WSL}*\n{_WSL}*', chr(10), 'g'), '\A{_WS}+|{_WS}+\z', '', 'g'), '') AS norm FROM documents""",
)
def _norm_description(t):
    crlf = F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n"))
    return t.documents.select("doc_id", tx.norm_description(crlf).alias("norm"))


@query("norm_timestamp", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END || '+00:00' AS iso FROM events")
def _norm_timestamp(t):
    return t.events.select("event_id", tx.iso_format(tx.norm_timestamp(F.col("ts"))).alias("iso"))


_ISO_INPUT = """
SELECT o_orderkey, CASE o_orderpriority
    WHEN '1-URGENT' THEN concat(CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)), 'T10:20:30Z')
    WHEN '2-HIGH' THEN concat(CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)), ' 01:30:00.250+02:00')
    WHEN '3-MEDIUM' THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10))
    WHEN '5-LOW' THEN concat(CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)), 'T99')
    ELSE 'soon' END AS raw, o_orderpriority, o_orderdate FROM {orders}"""


@query(
    "parse_iso_ts",
    f"""WITH x AS ({_ISO_INPUT}) SELECT o_orderkey, raw IS NOT NULL AND p IS NULL AS rejected, p AS iso FROM (
        SELECT o_orderkey, raw, CASE o_orderpriority
          WHEN '1-URGENT' THEN strftime(o_orderdate, '%Y-%m-%dT10:20:30+00:00')
          WHEN '2-HIGH' THEN strftime(o_orderdate - INTERVAL 1 DAY, '%Y-%m-%dT23:30:00.250000+00:00')
          WHEN '3-MEDIUM' THEN strftime(o_orderdate, '%Y-%m-%dT00:00:00+00:00') END AS p FROM x)""",
)
def _parse_iso_ts(t):
    parsed = tx.parse_iso_ts(F.col("raw"))
    return t.sql(_ISO_INPUT).select(
        "o_orderkey", (F.col("raw").isNotNull() & parsed.isNull()).alias("rejected"), tx.iso_format(parsed).alias("iso")
    )


@query(
    "epoch_ts",
    """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS from_seconds,
              strftime(date_trunc('milliseconds', ts), '%Y-%m-%d %H:%M:%S.%g') AS from_millis FROM events""",
)
def _epoch_ts(t):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    seconds, millis = F.floor(micros / 1_000_000), F.floor(micros / 1000)
    return t.events.select(
        "event_id",
        F.date_format(tx.epoch_ts(seconds), "yyyy-MM-dd HH:mm:ss").alias("from_seconds"),
        F.date_format(tx.epoch_ts(millis), "yyyy-MM-dd HH:mm:ss.SSS").alias("from_millis"),
    )


@query(
    "duration_seconds",
    wrap(r=RUNS) + """SELECT id, CAST(round(CAST(date_diff('microsecond', started_at, finished_at) AS DECIMAL(20,0)) / 1000000.0, 3)
        AS DECIMAL(12,3)) AS duration_seconds FROM r""",
)
def _duration(t):
    r = t.sql(RUNS)
    return r.select("id", tx.duration_seconds(F.col("started_at").cast("timestamp"), F.col("finished_at").cast("timestamp")).alias("duration_seconds"))


@query("label_norm", f"SELECT doc_id, {_labels('text', ' ')} AS label FROM documents")
def _label_norm(t):
    return t.documents.select("doc_id", tx.label_norm(F.col("text")).alias("label"))


@query(
    "identity_norm",
    f"""SELECT c_custkey, regexp_replace(lower(c_name), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS norm,
        len(regexp_extract_all(lower(c_name), '[a-z0-9]+')) AS tokens FROM customer""",
)
def _identity_norm(t):
    return t.customer.select(
        "c_custkey", tx.identity_norm(F.col("c_name")).alias("norm"), F.size(tx.identity_tokens(F.col("c_name"))).alias("tokens")
    )


@query(
    "identity_phrase",
    f"""SELECT doc_id, contains(' ' || {_labels('text', ' ')} || ' ', ' the ' || lang || ' ') AS hit_lang,
        contains(' ' || {_labels('text', ' ')} || ' ', ' de la ') AS hit_phrase FROM documents""",
)
def _identity_phrase(t):
    return t.documents.select(
        "doc_id",
        tx.identity_phrase(F.col("text"), F.concat(F.lit("The-"), F.upper("lang"))).alias("hit_lang"),
        tx.identity_phrase(F.col("text"), F.lit("De, la!")).alias("hit_phrase"),
    )


_WORKPLACE = """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN ' Remote ' WHEN '2-HIGH' THEN 'ON-SITE'
    WHEN '3-MEDIUM' THEN 'hybrid' WHEN '4-NOT SPECIFIED' THEN 'office' END AS raw FROM {orders}"""


@query(
    "workplace_map",
    f"""WITH x AS ({_WORKPLACE}) SELECT o_orderkey, CASE lower(trim(raw)) WHEN 'remote' THEN 'remote'
        WHEN 'on-site' THEN 'onsite' WHEN 'hybrid' THEN 'hybrid' END AS mapped FROM x""",
)
def _workplace_map(t):
    return t.sql(_WORKPLACE).select("o_orderkey", tx.workplace_map(F.col("raw")).alias("mapped"))


@query(
    "workplace_check",
    f"""WITH x AS ({_WORKPLACE}) SELECT o_orderkey, raw IS NULL OR lower(trim(raw)) IN ('remote', 'hybrid', 'onsite') AS ok FROM x""",
)
def _workplace_check(t):
    from snapledger.operators.validate import workplace_check

    return t.sql(_WORKPLACE).select("o_orderkey", workplace_check(F.lower(tx.norm_text(F.col("raw")))).alias("ok"))


@query(
    "join_locations",
    """SELECT p_partkey, CASE WHEN lower(p_type) = lower(p_brand) THEN p_type
        ELSE p_type || ', ' || p_brand END AS location FROM part""",
)
def _join_locations(t):
    values = F.array(F.col("p_type"), F.concat(F.lit(" "), F.lower("p_type")), F.lit("  "), F.col("p_brand"), F.upper("p_brand"))
    return t.part.select("p_partkey", tx.join_locations(values).alias("location"))


@query(
    "employment_list",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Full Time, Part-Time' WHEN 'O' THEN 'Contract' END AS employment
       FROM orders""",
)
def _employment(t):
    values = F.when(F.col("o_orderstatus") == "F", F.array(F.lit("FULL_TIME"), F.lit("part-time"))).when(
        F.col("o_orderstatus") == "O", F.array(F.lit("contract"))
    ).otherwise(F.array(F.lit(" ")))
    return t.orders.select("o_orderkey", tx.employment_list(values).alias("employment"))


@query(
    "salary_text",
    """SELECT p_partkey, CASE WHEN p_size > 40 THEN NULL WHEN p_size > 20 THEN p_size || ' EUR'
        ELSE p_size || '-' || (p_size * 2) || ' EUR' END AS salary FROM part""",
)
def _salary(t):
    size = F.col("p_size")
    low = F.when(size <= 40, size.cast("double"))
    high = F.when(size > 40, None).when(size > 20, size).otherwise(size * 2)
    return t.part.select("p_partkey", tx.salary_text(low, high, F.lit(" EUR ")).alias("salary"))


@query(
    "concat_description",
    """SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN role ELSE role || chr(10) || chr(10)
        || regexp_replace(text, '\\A\\s+|\\s+\\z', '', 'g') END AS description FROM conversations""",
)
def _concat_description(t):
    return t.conversations.select(
        "conv_id", "turn", tx.concat_description([F.col("role"), F.lit("  "), F.col("text"), F.lit(None).cast("string")]).alias("description")
    )


@query(
    "bounded_query",
    f"""SELECT doc_id, substr(array_to_string(list_slice(string_split({_sql_text('text')}, ' '), 1, 50), ' '), 1, 400)
        AS bounded FROM documents""",
)
def _bounded(t):
    return t.documents.select("doc_id", tx.bounded_query(F.col("text")).alias("bounded"))


@query(
    "embedded_urls",
    """SELECT page_id, list_sort(list_distinct(list_transform(list_slice(regexp_extract_all(substr(doc, 1, 4000),
        '(?i)https?://[^\\s<>"'']+'), 1, 10), lambda x: regexp_replace(x, '[.,;:!?)\\]}]+\\z', '')))) AS urls
       FROM (SELECT page_id, 'see ' || url || '. or (' || replace(url, 'http', 'HTTP') || ') and ' || url || ',' AS doc FROM pages)""",
)
def _embedded(t):
    url = F.col("url")
    doc = F.concat(F.lit("see "), url, F.lit(". or ("), F.replace(url, F.lit("http"), F.lit("HTTP")), F.lit(") and "), url, F.lit(","))
    return t.pages.select("page_id", F.array_sort(tx.embedded_urls(doc)).alias("urls"))




@query(
    "content_hash",
    wrap(p=POSTINGS)
    + "SELECT id, sha256('{' || '\"city\":null,' || '\"country\":' || to_json(country)::VARCHAR || ',\"description\":null,'"
    " || '\"employment_type\":' || coalesce(to_json(employment_type)::VARCHAR, 'null')"
    " || ',\"industry\":null,\"job_function\":null,\"location\":' || to_json(location)::VARCHAR"
    " || ',\"published_at\":\"' || strftime(published_at, '%Y-%m-%dT%H:%M:%S+00:00') || '\"'"
    " || ',\"seniority_level\":null,\"source_job_url\":' || to_json(source_job_url)::VARCHAR"
    " || ',\"title\":' || to_json(title)::VARCHAR || ',\"workplace_type\":' || to_json(workplace_type)::VARCHAR || '}') AS content_hash FROM p",
)
def _content_hash(t):
    missing = {c: F.lit(None).cast("string") for c in ("city", "description", "industry", "job_function", "seniority_level")}
    return t.sql(POSTINGS).withColumns({**missing, "published_at": F.col("published_at").cast("timestamp")}).select(
        "id", content_hash().alias("content_hash")
    )


@query(
    "content_hash_documents",
    """SELECT doc_id, sha256('{"city":null,"country":null,"description":' || to_json(text)::VARCHAR ||
       ',"employment_type":null,"industry":null,"job_function":null,"location":null,"published_at":null,"seniority_level":null,"source_job_url":null,"title":'
       || to_json(source)::VARCHAR || ',"workplace_type":null}') AS content_hash FROM documents""",
)
def _content_hash_documents(t):
    none = {c: F.lit(None).cast("string") for c in CONTENT_FIELDS if c not in ("published_at",)}
    docs = t.documents.withColumns({**none, "description": F.col("text"), "title": F.col("source"), "published_at": F.lit(None).cast("timestamp")})
    return docs.select("doc_id", content_hash().alias("content_hash"))


@query(
    "dedupe_key",
    wrap(p=POSTINGS) + """SELECT id, CASE WHEN source_job_id IS NOT NULL
        THEN sha256('id' || chr(0) || source || chr(0) || source_job_id)
        ELSE sha256('url' || chr(0) || source || chr(0) || source_job_url) END AS dedupe_key FROM p""",
)
def _dedupe_key(t):
    return t.sql(POSTINGS).select("id", dedupe_key(F.col("source"), F.col("source_job_id"), F.col("source_job_url")).alias("dedupe_key"))


@query("candidate_id", "SELECT page_id, substr(sha256(url), 1, 32) AS candidate_id FROM pages")
def _candidate_id(t):
    from snapledger.functions.urls import candidate_id

    return t.pages.select("page_id", candidate_id(F.col("url")).alias("candidate_id"))
