"""Input roles: the given tables read as companies, sources, postings, runs, pages and records.

The texts are plain SQL that both Spark and the checking engine accept, so a query and its check
start from the same rows. They only rename and derive columns; every row of a table takes part.
"""

from __future__ import annotations

COMPANIES = """
SELECT c_custkey AS id, c_name AS name,
       CASE c_mktsegment WHEN 'MACHINERY' THEN 'product' WHEN 'BUILDING' THEN 'service'
            WHEN 'AUTOMOBILE' THEN 'product' ELSE 'other' END AS company_type,
       c_acctbal >= 0 AS is_active
FROM {customer}"""

SOURCES = """
SELECT c_custkey * 2 AS id, c_custkey AS company_id, 'lever' AS source,
       concat('https://jobs.lever.co/t', c_custkey) AS source_jobs_url,
       CASE WHEN c_nationkey = 7 THEN 'pending' ELSE 'approved' END AS approval_status,
       c_acctbal > 500 AS is_active
FROM {customer}
UNION ALL
SELECT c_custkey * 2 + 1 AS id, c_custkey AS company_id,
       CASE WHEN c_nationkey = 3 THEN 'linkedin' ELSE 'generic' END AS source,
       concat('https://c', c_custkey, '.example.com/jobs') AS source_jobs_url,
       CASE WHEN c_nationkey = 9 THEN 'rejected' ELSE 'approved' END AS approval_status,
       c_acctbal > -500 AS is_active
FROM {customer}"""

# Orders as postings. The first letter of the priority picks the source of the customer.
POSTINGS = """
SELECT o_orderkey AS id, o_custkey AS company_id,
       o_custkey * 2 + CASE WHEN o_orderpriority < '3' THEN 0 ELSE 1 END AS company_source_id,
       CASE WHEN o_orderpriority < '3' THEN 'lever' ELSE 'generic' END AS source,
       CASE WHEN o_orderpriority < '5' THEN concat('J', o_orderkey) END AS source_job_id,
       concat('Role ', o_orderpriority, ' ', o_orderstatus) AS title,
       n_name AS country,
       concat('City ', o_custkey, ', ', n_name) AS location,
       CASE o_orderstatus WHEN 'F' THEN 'remote' WHEN 'O' THEN 'hybrid' ELSE 'onsite' END AS workplace_type,
       CASE WHEN o_totalprice > 300000 THEN 'Full-Time' END AS employment_type,
       CASE WHEN o_totalprice > 350000 THEN concat('c', o_custkey) END AS compensation_text,
       o_orderdate AS published_at,
       concat('https://c', o_custkey, '.example.com/jobs/', o_orderkey) AS source_job_url,
       concat('h', o_orderstatus, CAST(o_orderdate AS DATE)) AS content_hash,
       CASE WHEN o_totalprice < 150000 THEN NULL
            WHEN o_totalprice < 300000 THEN concat('h', o_orderstatus, CAST(o_orderdate AS DATE))
            ELSE 'hX' END AS last_reviewed_content_hash,
       CASE WHEN o_orderstatus = 'F' THEN 'not_found' WHEN o_totalprice > 450000 THEN 'closed'
            ELSE 'active' END AS status,
       o_orderdate AS first_seen_at, o_orderdate AS last_seen_at
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey"""

# Events as run ledger: the user is the source, five sources per company.
RUNS = """
SELECT event_id AS id, CAST(floor(user_id / 5) AS BIGINT) AS company_id, user_id AS company_source_id,
       ts AS started_at,
       CASE WHEN event_type = 'signup' AND value > 150 THEN NULL
            ELSE ts + CAST(floor(value) AS INT) * INTERVAL '1' SECOND END AS finished_at,
       CASE WHEN event_type = 'signup' AND value > 150 THEN 'running'
            WHEN event_type = 'error' THEN 'failed'
            WHEN event_type = 'purchase' THEN 'partial' ELSE 'success' END AS status,
       CASE WHEN event_type = 'error' THEN 0 ELSE CAST(floor(value) AS BIGINT) END AS jobs_found,
       CASE WHEN event_type = 'error' THEN 0 ELSE CAST(floor(value / 2) AS BIGINT) END AS jobs_created,
       CASE WHEN event_type = 'view' THEN CAST(floor(value) AS BIGINT) + 1 ELSE 0 END AS jobs_updated,
       CAST(1 AS BIGINT) AS requests_made,
       CASE WHEN event_type IN ('error', 'purchase') AND value > 10 THEN 'broken' ELSE '' END AS error_message
FROM {events}"""

# Run owners matching RUNS.
RUN_SOURCES = """
SELECT DISTINCT user_id AS id, CAST(floor(user_id / 5) AS BIGINT) AS company_id,
       CASE WHEN user_id < 30 THEN 'lever' WHEN user_id < 60 THEN 'linkedin' ELSE 'generic' END AS source,
       CASE WHEN user_id < 90 THEN 'approved' ELSE CASE WHEN user_id < 100 THEN 'pending' ELSE 'approved' END END
           AS approval_status,
       user_id < 120 AS is_active
FROM {events}"""
RUN_COMPANIES = """
SELECT DISTINCT CAST(floor(user_id / 5) AS BIGINT) AS id,
       concat('Company ', CAST(floor(user_id / 5) AS BIGINT)) AS name, 'product' AS company_type,
       user_id < 145 AS is_active
FROM {events}"""

# Observation history: source = event type, run = day, key = user; some days failed or partial.
OBSERVATIONS = """
SELECT event_type AS company_source_id, CAST(user_id AS VARCHAR(20)) AS key,
       CAST(day(ts) AS BIGINT) AS run_seq FROM {events}"""
HISTORY = """
SELECT event_type AS company_source_id, CAST(day(ts) AS BIGINT) AS run_seq,
       CASE WHEN max(value) > 300 THEN 'failed' WHEN max(value) > 250 THEN 'partial' ELSE 'success' END AS status
FROM {events} GROUP BY event_type, day(ts)"""


def wrap(**ctes: str) -> str:
    """``WITH a AS (...), b AS (...)`` prefix."""
    return "WITH " + ", ".join(f"{name} AS ({text})" for name, text in ctes.items()) + " "


# Parts as addresses on many platforms; the size of the part picks the shape.
ADDRESSES = """
SELECT p_partkey, p_size, p_name, CASE
  WHEN p_size <= 4 THEN concat('https://jobs.lever.co/Acme', p_partkey, '/x-1?utm_source=a')
  WHEN p_size <= 8 THEN concat('https://t', p_partkey, '.darwinbox.com/ms/candidate/careers/')
  WHEN p_size <= 12 THEN concat('https://t', p_partkey, '.darwinbox.com/ms/candidatev2/C', p_partkey, '/careers/list?page=2')
  WHEN p_size <= 16 THEN concat('https://t', p_partkey, '.applytojob.com/apply/jobs/')
  WHEN p_size <= 20 THEN concat('https://T', p_partkey, '.dream.jobs/jobs?page=3')
  WHEN p_size <= 24 THEN concat('https://t', p_partkey, '.zohorecruit.com/jobs/Careers/', p_partkey)
  WHEN p_size <= 28 THEN concat('https://t', p_partkey, '.myworkdayjobs.com/en/Site')
  WHEN p_size <= 32 THEN concat('https://boards.greenhouse.io/Org', p_partkey, '/jobs/1')
  WHEN p_size <= 36 THEN concat('https://t', p_partkey, '.jobs.personio.de/job/', p_partkey)
  WHEN p_size <= 40 THEN concat('https://apply.workable.com/Org', p_partkey, '/')
  WHEN p_size <= 44 THEN concat('https://t', p_partkey, '.teamtailor.com/jobs')
  ELSE concat('https://www.c', p_partkey, '.example.com/careers?utm_medium=x') END AS url,
  CASE WHEN p_size <= 4 THEN 'lever' WHEN p_size <= 12 THEN 'darwinbox' WHEN p_size <= 16 THEN 'jazzhr'
  WHEN p_size <= 20 THEN 'dreamjobs' WHEN p_size <= 24 THEN 'zoho_recruit' WHEN p_size <= 28 THEN 'workday'
  WHEN p_size <= 32 THEN 'greenhouse' WHEN p_size <= 36 THEN 'personio' WHEN p_size <= 40 THEN 'workable'
  WHEN p_size <= 44 THEN 'teamtailor' ELSE '' END AS platform
FROM {part}"""

# Page addresses with words of the trade mixed into host, path and query.
CAREER_URLS = """
SELECT page_id, url, CASE
  WHEN url LIKE '%utm_source%' THEN replace(url, 'example', 'linkedin')
  WHEN url LIKE '%page=2%' THEN replace(url, '/en/', '/careers/page/')
  WHEN url LIKE '%#top' THEN replace(url, '/en/', '/news/')
  WHEN url LIKE '%.html' THEN replace(url, '.html', '/apply')
  WHEN url LIKE '%/' THEN replace(url, '://', '://careers.')
  ELSE replace(url, '/en/', '/jobs/') END AS link FROM {pages}"""


# Line items as fetched page items: order = run, line number = page, supplier = item.
ITEMS = """
SELECT l_orderkey AS run_id, l_linenumber AS page_no, l_partkey AS position, l_suppkey AS item_id,
       CASE WHEN l_returnflag = 'R' THEN concat('t', l_suppkey) ELSE 'same' END AS title,
       CASE WHEN l_tax > 0.07 THEN 3 ELSE 4 END AS advertised_total
FROM {lineitem}"""
# One row per fetched page, pages numbered without gaps.
FETCHED = """
SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY page_no) AS INT) AS page_no, raw_page,
       concat('https://x.example.com/list/', target) AS requested_url,
       concat('https://x.example.com/list/', target) AS final_url,
       CASE WHEN discount > 0.08 THEN concat('body ', quantity) ELSE concat('body ', raw_page, ' ', quantity) END AS body,
       CASE WHEN tax < 0.02 THEN NULL ELSE 'next' END AS next_url, quantity, discount, tax
FROM (SELECT l_orderkey AS run_id, l_linenumber AS page_no, l_linenumber AS raw_page, max(l_suppkey) AS target,
             max(l_discount) AS discount, min(l_tax) AS tax, CAST(max(l_quantity) AS INT) AS quantity
      FROM {lineitem} GROUP BY l_orderkey, l_linenumber) AS p"""


# Two snapshots of one world: stored rows (before 2000) and a new batch (from 1998 on).
SNAP_STATE = """
SELECT o_orderkey AS id, o_custkey AS company_id,
       o_custkey * 2 + CASE WHEN o_orderpriority < '3' THEN 0 ELSE 1 END AS company_source_id,
       CASE WHEN o_orderpriority < '3' THEN 'lever' ELSE 'generic' END AS source,
       CASE WHEN o_orderpriority < '5' THEN concat('J', o_orderkey) END AS source_job_id,
       concat('Role ', o_orderpriority) AS title,
       concat('https://c', o_custkey, '.example.com/jobs/', o_orderkey) AS source_job_url,
       CASE WHEN o_totalprice > 350000 THEN 'old pay' END AS compensation_text,
       CASE WHEN o_orderstatus = 'F' AND o_totalprice < 100000 THEN 'not_found'
            WHEN o_orderstatus = 'P' AND o_totalprice > 480000 THEN 'closed' ELSE 'active' END AS status,
       CASE WHEN o_orderstatus = 'F' AND o_totalprice < 100000 THEN 2
            WHEN o_orderstatus = 'O' AND o_totalprice < 150000 THEN 1 ELSE 0 END AS misses
FROM {orders} WHERE o_orderdate < TIMESTAMP '2000-01-01 00:00:00'"""
SNAP_BATCH = """
SELECT o_orderkey AS record_index, o_custkey * 2 + CASE WHEN o_orderpriority < '3' THEN 0 ELSE 1 END AS company_source_id,
       o_custkey * 2 + CASE WHEN o_orderpriority < '3' THEN 0 ELSE 1 END AS run_id,
       CASE WHEN o_orderpriority < '3' THEN ' Lever ' ELSE 'GENERIC' END AS source,
       CASE WHEN o_orderpriority < '5' OR o_totalprice >= 250000 THEN concat(' J', o_orderkey) END AS source_job_id,
       concat('Role  ', o_orderpriority, CASE WHEN o_totalprice > 300000 THEN ' senior' ELSE '' END) AS title,
       concat('HTTPS://C', o_custkey, '.example.com:443/jobs/', o_orderkey, '#x') AS source_job_url,
       CASE WHEN o_totalprice > 350000 THEN 'new pay' END AS compensation_text,
       CASE WHEN o_totalprice BETWEEN 400000 AND 420000 THEN 'moon' ELSE NULL END AS workplace_type
FROM {orders} WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00'"""
SNAP_RUNS = """
SELECT id AS run_id, id AS company_source_id, CASE WHEN company_id IN (SELECT c_custkey FROM {customer} WHERE c_nationkey = 11)
       THEN 'incomplete' END AS fetch_error FROM (SELECT c_custkey * 2 AS id, c_custkey AS company_id FROM {customer}
       UNION ALL SELECT c_custkey * 2 + 1 AS id, c_custkey AS company_id FROM {customer}) AS s"""


# Parts as careers pages; the size picks what the page contains.
CAREER_PAGES = """
SELECT p_partkey, p_size, p_name, concat('https://c', p_partkey, '.example.com/jobs') AS url,
  concat('<html><head><title>T</title></head><body class="page-footer"><header><a href="/jobs/head-1">Head</a></header>',
  CASE WHEN p_size <= 10 THEN concat('<ul><li class="job-item"><a href="/jobs/', replace(p_name, ' ', '-'), '-', p_partkey,
         '"><span class="job-title">', p_name, '  &amp; Co</span><b>x</b></a></li></ul>')
       WHEN p_size <= 20 THEN concat('<p><a href="jobs/', replace(p_name, ' ', '-'), '-', p_partkey, '?v=1">Apply now</a></p>')
       WHEN p_size <= 30 THEN concat('<div id="main-nav"><a href="/jobs/', replace(p_name, ' ', '-'), '">', p_name, '</a></div>')
       WHEN p_size <= 40 THEN concat('<div class="filters"><a href="/jobs/x-', p_partkey, '">', p_name, '</a></div><ul class="pagination"><li><a href="/jobs/list/3">3</a></li></ul>')
       ELSE concat('<p><a href="/open/vacancy/', p_partkey, '">Senior role</a> <a href="/open/vacancy/', p_partkey, '#x">Again</a></p>') END,
  '<a href="/jobs?page=2">2</a><a href="mailto:x@y.z">m</a><a href="#top">t</a></body></html>') AS html
FROM {part}"""

# Parts as posting pages, in the forms details come in.
DETAIL_PAGES = """
SELECT p_partkey, p_size, p_name, p_brand, p_type, CASE
  WHEN p_size <= 10 THEN concat('<html><head><script type="application/ld+json">{"@graph":[{"@type":"Organization"},{"@type":"JobPosting","title":" ', p_name,
       '  role","jobLocation":{"address":{"addressLocality":"', p_type, '","addressCountry":"AT"}},"jobLocationType":"TELECOMMUTE","employmentType":"FULL_TIME","datePosted":"2024-01-02","description":"d ', p_brand,
       '","industry":"IT","baseSalary":{"value":', p_partkey, ',"currency":"EUR"}}]}</script></head><body><h1>Old</h1></body></html>')
  WHEN p_size <= 20 THEN concat('<html><body><nav><dl><dt>Country</dt><dd>Nowhere</dd></dl></nav><h1>', p_name, '</h1><dl><dt>Location:</dt><dd>', p_type, '</dd><dt>Salary</dt><dd>', p_partkey, ' EUR</dd></dl><div itemprop="description">Text ', p_brand, '</div></body></html>')
  WHEN p_size <= 30 THEN concat('<html><body><h1>', p_name, '</h1><table><tr><th>Employment type</th><td>', p_type, '</td></tr><tr><th>Country</th><td>AT</td></tr></table></body></html>')
  WHEN p_size <= 40 THEN concat('<html><body><h1> </h1><h1>', p_name, '</h1><p><strong>Salary:</strong> - ', p_partkey, '</p><p>Work model: ', p_type, '</p><li>Location: ', p_brand, '</li></body></html>')
  ELSE concat('<html><body><h2 itemprop="headline">', p_name, '</h2><span class="job_locations">', p_type, '|', p_brand, '</span><em id="seniority-x">Lead</em></body></html>') END AS html
FROM {part}"""


# Orders as search results of their customer; the priority picks the kind of result.
RESULTS = """
SELECT o_custkey AS company_id, c_name AS name, o_orderkey AS seq, o_orderpriority AS kind,
  concat(CASE WHEN o_orderstatus = 'F' THEN concat('"', c_name, '" official website') ELSE concat('site:x', c_custkey, ' careers') END) AS query,
  CASE o_orderpriority
    WHEN '1-URGENT' THEN concat('https://www.', lower(replace(c_name, '#', '')), '.example.com/about?x=1')
    WHEN '2-HIGH' THEN 'https://www.linkedin.com/company/acme'
    WHEN '3-MEDIUM' THEN concat('https://careers.', lower(replace(c_name, '#', '')), '.example.com/')
    WHEN '4-NOT SPECIFIED' THEN concat('https://', lower(replace(c_name, '#', '')), '.example.org/')
    ELSE 'https://other.example.net/' END AS url,
  CASE o_orderpriority WHEN '1-URGENT' THEN c_name WHEN '4-NOT SPECIFIED' THEN 'Home'
    WHEN '3-MEDIUM' THEN concat(c_name, ' Labs ', o_orderkey, ' | A customer success story') ELSE concat(c_name, ' profile') END AS title,
  CASE o_orderpriority WHEN '1-URGENT' THEN concat('x ', c_name, ' (trading name of Alias ', o_orderkey, ') y')
    WHEN '2-HIGH' THEN concat(c_name, ', formerly known as  Old ', o_orderkey, '; z') ELSE 'none' END AS description,
  CAST(0.5 AS DOUBLE) AS score, false AS manual
FROM {orders} JOIN {customer} ON o_custkey = c_custkey"""

# Parts as discovery candidates: brand = tenant, five brands per company, part type picks the run.
CANDIDATES = """
SELECT p_partkey AS id, b * 10 + CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'SMALL' THEN 2 WHEN 'STANDARD' THEN 3 ELSE 4 END AS run_id,
  CAST(floor(b / 5) AS BIGINT) AS company_id, CASE WHEN p_size > 44 THEN 'careers' ELSE 'source' END AS kind,
  CASE WHEN p_size <= 12 THEN 'lever' WHEN p_size <= 24 THEN 'jazzhr' WHEN p_size <= 34 THEN 'workday' WHEN p_size <= 44 THEN 'teamtailor' ELSE '' END AS platform,
  CASE WHEN p_size <= 12 THEN concat('https://jobs.lever.co/Acme', b) WHEN p_size <= 24 THEN concat('https://t', b, '.applytojob.com/apply')
       WHEN p_size <= 34 THEN concat('https://t', b, '.myworkdayjobs.com/') WHEN p_size <= 44 THEN concat('https://t', b, '.teamtailor.com/')
       ELSE concat('https://www.c', b, '.example.com/careers') END AS canonical_url, p_size, p_retailprice,
  CAST(p_size + 40 AS INT) AS confidence, CASE WHEN p_size > 34 THEN 72 ELSE 90 END AS job_source_confidence,
  p_size <= 24 AS supported, p_retailprice > 990 AS is_ignored,
  CASE WHEN p_retailprice < 905 THEN 'rejected' WHEN p_size < 8 THEN 'selected' ELSE 'needs_review' END AS decision,
  CASE WHEN p_size > 44 THEN 'company_jobs_page' WHEN p_size > 24 THEN 'unsupported_ats' ELSE 'supported_ats' END AS job_source_eligibility,
  CASE WHEN p_size > 47 THEN 'Confirmed careers listing candidate with individual job links' WHEN p_size > 44 THEN 'Search result'
       WHEN p_size > 34 THEN 'public careers host' ELSE 'Workday public jobs host' END AS note,
  '' AS reason, 'current_discovery' AS origin
FROM (SELECT *, CAST(replace(p_brand, 'Brand#', '') AS BIGINT) AS b FROM {part}) AS p"""
DISCOVERY_RUNS = """
SELECT DISTINCT run_id AS id, company_id, CASE WHEN run_id BETWEEN 60 AND 69 THEN 'failed' WHEN run_id = 83 THEN 'running' ELSE 'needs_review' END AS status,
  CASE WHEN run_id IN (12, 24, 33) THEN TIMESTAMP '2024-02-01 00:00:00' ELSE TIMESTAMP '2024-01-01 00:00:00' END AS started_at
FROM (""" + CANDIDATES + ") AS c"
CHECKS = """
SELECT DISTINCT run_id, p AS platform, CASE WHEN run_id BETWEEN 90 AND 99 AND p = 'lever' THEN 'search_failed' WHEN run_id BETWEEN 40 AND 45 AND p = 'jazzhr' THEN 'not_checked'
  WHEN p = 'lever' THEN 'already_connected' ELSE 'not_found' END AS status
FROM (SELECT run_id, 'lever' AS p FROM (""" + CANDIDATES + """) AS a UNION ALL SELECT run_id, 'jazzhr' AS p FROM (""" + CANDIDATES + """) AS b) AS u"""
# Connected sources: some of the tenants of CANDIDATES.
TENANT_SOURCES = """
SELECT DISTINCT b AS id, CAST(floor(b / 5) AS BIGINT) AS company_id, 'lever' AS source, concat('https://jobs.lever.co/acme', b, '/?utm_source=x') AS source_jobs_url,
  CASE WHEN b = 7 THEN 'blocked' WHEN b = 9 THEN 'pending' ELSE 'approved' END AS approval_status, b <> 11 AS is_active
FROM (SELECT CAST(replace(p_brand, 'Brand#', '') AS BIGINT) AS b FROM {part}) AS p WHERE b <= 12"""
