"""Queries for the payload shapers: Spark builds the payloads from the tables, then reads them."""

from __future__ import annotations

from pyspark.sql import functions as F

from snapledger.sources import payloads as pl
from snapledger.sources import shapers as sh
from snapledger.suite.registry import query


def _raw(df, url, body, kind="listing", source="x"):
    key = F.col("p_partkey")
    return df.select(
        key.alias("run_id"), key.alias("company_source_id"), F.lit(source).alias("source"), F.lit(1).alias("page_no"), F.lit(kind).alias("kind"),
        url.alias("requested_url"), body.alias("body"),
    )


def _lever(t):
    name, brand, key, size = F.col("p_name"), F.col("p_brand"), F.col("p_partkey"), F.col("p_size")
    item = F.to_json(F.struct(
        F.when(size <= 45, F.concat(F.lit(" L"), key)).alias("id"), F.concat(F.lit("https://jobs.lever.co/a/"), key).alias("hostedUrl"), name.alias("text"),
        F.lit(" On-Site").alias("workplaceType"), (F.lit(1_700_000_000_000) + key * 1000).alias("createdAt"), F.lit(" one ").alias("descriptionPlain"), F.lit("two").alias("additionalPlain"),
        F.array(F.lit("Wien"), F.lit(""), F.col("p_type")).alias("allLocations"),
        F.struct(F.when(size <= 20, brand).alias("location"), F.lit("Full").alias("commitment"), F.lit("").alias("department"), F.lit("Team").alias("team")).alias("categories"),
    ))
    second = F.concat(F.lit('{"id":"X'), key, F.lit('"}'))
    body = F.when(size > 48, F.lit('{"a":1}')).otherwise(F.concat(F.lit("["), item, F.lit(","), second, F.lit("]")))
    return _raw(t.part, F.lit("https://api.lever.co/v0/postings/a"), body, source="lever")


@query(
    "shape_lever",
    """SELECT p_partkey AS run_id, 'L' || p_partkey AS job, p_name AS title, CASE WHEN p_size <= 20 THEN p_brand ELSE 'Wien, ' || p_type END AS location, 'onsite' AS workplace, 'Full' AS employment,
        strftime(make_timestamp((1700000000 + p_partkey) * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') AS published, 'one' || chr(10) || chr(10) || 'two' AS description, 'Team' AS job_function, NULL AS fetch_error FROM part WHERE p_size <= 45
       UNION ALL SELECT p_partkey, 'X' || p_partkey, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM part WHERE p_size <= 48
       UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN p_size > 48 THEN 'root_not_array' ELSE 'id_missing' END FROM part WHERE p_size > 45""",
)
def _shape_lever(t):
    records, errors = sh.shape_lever(_lever(t))
    none = F.lit(None).cast("string")
    return records.select(
        "run_id", F.col("source_job_id").alias("job"), "title", "location", F.col("workplace_type").alias("workplace"), F.col("employment_type").alias("employment"),
        F.col("published_at").alias("published"), "description", "job_function", none.alias("fetch_error"),
    ).unionByName(errors, allowMissingColumns=True)


def _darwinbox(t):
    key, size, name = F.col("p_partkey"), F.col("p_size"), F.col("p_name")
    job = F.struct(
        F.concat(F.lit("D"), key).alias("id"), F.when(size <= 25, name).alias("title"), F.concat(name, F.lit(" alt")).alias("designation_name"),
        F.when(size <= 10, F.lit("a &amp; b")).alias("jd"), F.array(F.lit(" Wien "), F.lit("Graz")).alias("officelocations_without_area"),
        F.lit("2024-05-06").alias("posted_on"), F.lit("Perm").alias("emp_type"),
    )
    listing = F.to_json(F.struct(F.when(size > 45, F.lit("error")).otherwise(F.lit("success")).alias("status"), F.lit(1).alias("job_counts"), F.array(job).alias("data")))
    answered = F.when(size > 40, F.lit("other")).otherwise(F.concat(F.lit("D"), key))
    detail = F.to_json(F.struct(F.lit("success").alias("status"), F.struct(F.array(F.struct(answered.alias("id"), F.lit("&lt;p&gt;full").alias("jd"), F.lit("100").alias("salary"))).alias("job")).alias("message")))
    url = F.concat(F.lit("https://t"), key, F.lit(".darwinbox.com/ms/candidatev2/C1/careers"))
    return _raw(t.part, url, listing, source="darwinbox").unionByName(_raw(t.part.where("p_size > 10"), url, detail, "detail", "darwinbox"))


@query(
    "shape_darwinbox",
    """SELECT p_partkey AS run_id, 'D' || p_partkey AS job, CASE WHEN p_size <= 25 THEN p_name ELSE p_name || ' alt' END AS title, 'Wien, Graz' AS location, CASE WHEN p_size <= 10 THEN 'a & b' ELSE '<p>full' END AS description,
        CASE WHEN p_size > 10 THEN '100' END AS pay, '2024-05-06T00:00:00+00:00' AS published, 'https://t' || p_partkey || '.darwinbox.com/ms/candidatev2/C1/careers/jobDetails/D' || p_partkey || '?from=all' AS url, NULL AS fetch_error FROM part WHERE p_size <= 40
       UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN p_size > 45 THEN 'bad_envelope' ELSE 'detail_mismatch' END FROM part WHERE p_size > 40""",
)
def _shape_darwinbox(t):
    records, errors = sh.shape_darwinbox(_darwinbox(t))
    return records.select(
        "run_id", F.col("source_job_id").alias("job"), "title", "location", "description", F.col("compensation_text").alias("pay"), F.col("published_at").alias("published"),
        F.col("source_job_url").alias("url"), F.lit(None).cast("string").alias("fetch_error"),
    ).unionByName(errors, allowMissingColumns=True)


def _zoho(t):
    key, size = F.col("p_partkey"), F.col("p_size")
    url = F.concat(F.lit("https://t"), key, F.lit(".zohorecruit.com/jobs/Careers"))
    quoted = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
    job = F.struct(
        F.lpad(key.cast("string"), 12, "7").alias("id"), (size <= 45).alias("Publish"), F.lit(" ").alias("Posting_Title"), F.col("p_name").alias("Job_Opening_Name"), F.lit("Wien").alias("City"), F.lit("WIEN").alias("State"),
        F.lit("Austria").alias("Country"), (size <= 10).alias("Remote_Job"), F.lit("2024-01-02").alias("Date_Opened"),
    )
    jobs = F.to_json(F.when(size == 40, F.array(job, job)).otherwise(F.array(job)))
    meta = F.to_json(F.struct(F.lit("CareerSite").alias("source"), F.lit("zohorecruit").alias("chatbotName"), F.lit("https://www.zoho.com/recruit/").alias("recruit_home"), url.alias("list_url"), F.struct((size == 30).alias("is_loggedin")).alias("portal_user")))
    html = F.concat(
        F.lit('<html><body><script src="https://static.zohocdn.com/recruit/x.js"></script><div id="career-website-main"></div><input type="hidden" id="jobs" value="'), quoted(jobs), F.lit('"><input id="meta" value="'), quoted(meta),
        F.lit('"><input id="pageJson" value="{&quot;detail&quot;:{&quot;section&quot;:{&quot;data&quot;:[{&quot;blocktype&quot;:&quot;jobs&quot;,&quot;isenabled&quot;:true}]}}}"><input id="moduleMeta" value="[{&quot;api_name&quot;:&quot;Job_Openings&quot;,&quot;id&quot;:&quot;1&quot;}]">'),
        F.when(size == 35, F.lit('<a href="?page=2">2</a>')).otherwise(F.lit("")),
    )
    return _raw(t.part, url, html, source="zoho_recruit")


@query(
    "shape_zoho",
    """SELECT p_partkey AS run_id, lpad(p_partkey::VARCHAR, 12, '7') AS job, p_name AS title, 'Wien, Austria' AS location, CASE WHEN p_size <= 10 THEN 'Remote' END AS workplace, '2024-01-02' AS published, NULL AS fetch_error FROM part WHERE p_size <= 45 AND p_size NOT IN (30, 35, 40)
       UNION ALL SELECT p_partkey, lpad(p_partkey::VARCHAR, 12, '7'), p_name, 'Wien, Austria', NULL, '2024-01-02', NULL FROM part, (SELECT unnest([1, 2])) d WHERE p_size = 40
       UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL, NULL, CASE WHEN p_size > 45 THEN 'not_published' WHEN p_size = 30 THEN 'contract' WHEN p_size = 35 THEN 'pagination' ELSE 'duplicate_id' END FROM part WHERE p_size > 45 OR p_size IN (30, 35, 40)""",
)
def _shape_zoho(t):
    records, errors = sh.shape_zoho(_zoho(t))
    return records.select(
        "run_id", F.col("source_job_id").alias("job"), "title", "location", F.col("workplace_type").alias("workplace"), F.col("published_at").alias("published"), F.lit(None).cast("string").alias("fetch_error")
    ).unionByName(errors, allowMissingColumns=True)


def _jazz(t):
    key, size, name = F.col("p_partkey"), F.col("p_size"), F.col("p_name")
    host = F.concat(F.lit("https://t"), key, F.lit(".applytojob.com"))
    ident = F.concat(F.lit("Key"), F.lpad(key.cast("string"), 8, "0"))
    path = F.concat(F.lit("/apply/"), ident, F.lit("/Some-Role"))
    listing = F.concat(F.lit('<ul class="list-group jobs-list"><li><a href="'), path, F.lit('"> '), name, F.lit(' </a></li><li><a href="'), path, F.lit('#x">'), F.when(size > 45, F.lit("Other")).otherwise(name), F.lit('</a></li></ul><a href="/about">About</a>'))
    posting = F.to_json(F.struct(
        F.lit("JobPosting").alias("@type"), F.concat(host, path).alias("url"), F.when(size > 40, F.lit("Changed")).otherwise(name).alias("title"), F.lit("&lt;p&gt;One&lt;/p&gt;&lt;p&gt;Two&lt;/p&gt;").alias("description"),
        F.array(F.lit("FULL_TIME"), F.lit("part-time")).alias("employmentType"), F.lit("2024-03-04").alias("datePosted"),
        F.array(F.struct(F.struct(F.lit("Wien").alias("addressLocality"), F.lit("wien").alias("addressRegion"), F.lit("AT").alias("addressCountry")).alias("address"))).alias("jobLocation"),
    ))
    rich = F.concat(F.lit('<html><script type="application/ld+json">{"@graph":['), posting, F.lit("]}</script></html>"))
    plain = F.concat(F.lit('<div class="job-header"><h2>'), name, F.lit('</h2><div class="job-attributes-container"><span id="resumator-job-location">Ref: 1, Graz</span><span id="resumator-job-employment">Full</span></div></div><div id="job-description"><p>Plain</p></div>'))
    return _raw(t.part, F.concat(host, F.lit("/apply")), listing, source="jazzhr").unionByName(
        _raw(t.part, F.concat(host, path), F.when(size <= 20, rich).when(size <= 40, plain).otherwise(rich), "detail", "jazzhr")
    )


@query(
    "shape_jazzhr",
    """SELECT p_partkey AS run_id, 'Key' || lpad(p_partkey::VARCHAR, 8, '0') AS job, p_name AS title, CASE WHEN p_size <= 20 THEN 'Wien, AT' ELSE 'Graz' END AS location, CASE WHEN p_size <= 20 THEN 'Full Time, Part-Time' ELSE 'Full' END AS employment,
        CASE WHEN p_size <= 20 THEN 'One' || chr(10) || 'Two' ELSE 'Plain' END AS description, NULL AS fetch_error FROM part WHERE p_size <= 40
       UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL, NULL, CASE WHEN p_size > 45 THEN 'conflicting_titles' ELSE 'title_conflict' END FROM part WHERE p_size > 40""",
)
def _shape_jazz(t):
    records, errors = sh.shape_jazzhr(_jazz(t))
    return records.select(
        "run_id", F.col("source_job_id").alias("job"), "title", "location", F.col("employment_type").alias("employment"), "description", F.lit(None).cast("string").alias("fetch_error")
    ).unionByName(errors, allowMissingColumns=True)


@query("listing_detail", "SELECT p_partkey, CASE WHEN p_size > 40 THEN 'detail_missing' WHEN p_size > 30 THEN 'detail_id_mismatch' END AS detail_error FROM part")
def _listing_detail(t):
    rows = t.part.select("p_partkey", F.col("p_partkey").alias("asked"))
    answers = t.part.where("p_size <= 40").select("p_partkey", F.when(F.col("p_size") > 30, F.lit(-1)).otherwise(F.col("p_partkey")).alias("answered"))
    return sh.listing_detail(rows, answers, ["p_partkey"], "asked", "answered").select("p_partkey", "detail_error")


def _dream(t):
    key, size = F.col("p_partkey"), F.col("p_size")
    url = F.concat(F.lit("https://t"), key, F.lit(".dream.jobs/jobs"))
    data = F.struct(F.struct(F.struct(F.when(size > 45, 2).otherwise(1).alias("itemsTotalCount")).alias("paginationInfo"), F.array(F.struct(F.concat(F.lit("O"), key).alias("id"))).alias("opportunities")).alias("opportunities"))
    state = F.to_json(F.struct(F.struct(F.struct(F.struct(F.array(F.struct(F.array(F.lit("opportunitiesList")).alias("queryKey"), F.struct(data.alias("data")).alias("state"))).alias("queries")).alias("dehydratedState")).alias("pageProps")).alias("props")))
    page = F.when(size <= 25, F.concat(F.lit('<html><script id="__NEXT_DATA__">'), state, F.lit("</script></html>"))).otherwise(F.to_json(F.struct(data.alias("data"))))
    answer = F.to_json(F.struct(F.struct(F.struct(
        F.concat(F.lit("O"), key).alias("id"), F.col("p_name").alias("title"), F.array(F.lit("FULL_TIME")).alias("type"), F.array(F.struct(F.lit("Wien").alias("city"), F.lit("AT").alias("country")), F.struct(F.lit("WIEN").alias("city"), F.lit("at").alias("country"))).alias("locations"),
        F.struct(size.alias("min"), (size * 2).alias("max"), F.lit("EUR").alias("currency")).alias("salary"), F.lit("ON_SITE").alias("workEnvironment"), F.lit("<p>One</p><ul><li>Two</li></ul>").alias("rawDescription"),
    ).alias("opportunity")).alias("data")))
    return _raw(t.part, url, page, source="dreamjobs").unionByName(
        _raw(t.part.where("p_size <= 40 OR p_size > 45"), F.concat(F.lit("https://api.dream.jobs/x?id=O"), key), answer, "detail", "dreamjobs")
    )


@query(
    "shape_dreamjobs",
    """SELECT p_partkey AS run_id, 'O' || p_partkey AS job, p_name AS title, 'Wien, AT' AS location, 'Full Time' AS employment, p_size || '-' || (p_size * 2) || ' EUR' AS pay, 'onsite' AS workplace, 'One' || chr(10) || 'Two' AS description,
        'https://t' || p_partkey || '.dream.jobs/jobs?activeOpportunityId=O' || p_partkey AS url, NULL AS fetch_error FROM part WHERE p_size <= 40 OR p_size > 45
       UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN p_size > 45 THEN 'incomplete' ELSE 'detail_missing' END FROM part WHERE p_size > 40""",
)
def _shape_dream(t):
    records, errors = sh.shape_dreamjobs(_dream(t))
    return records.select(
        "run_id", F.col("source_job_id").alias("job"), "title", "location", F.col("employment_type").alias("employment"), F.col("compensation_text").alias("pay"), F.col("workplace_type").alias("workplace"), "description",
        F.col("source_job_url").alias("url"), F.lit(None).cast("string").alias("fetch_error"),
    ).unionByName(errors, allowMissingColumns=True)


@query(
    "shape_job_cards",
    """SELECT p_partkey AS run_id, (p_partkey + 1000)::VARCHAR AS job, p_name AS title, p_brand AS company, 'Wien' AS location, '2024-01-02' AS published FROM part WHERE p_size <= 45
       UNION ALL SELECT p_partkey, (p_partkey + 9000000)::VARCHAR, 'Second', NULL, NULL, NULL FROM part""",
)
def _cards(t):
    key = F.col("p_partkey")
    first = F.concat(
        F.lit('<div class="base-card job-search-card" data-entity-urn="urn:li:jobPosting:'), key + 1000, F.lit('"><a class="base-card__full-link" href="/jobs/view/x-'), key + 1000, F.lit('?t=1"></a>'),
        F.when(F.col("p_size") <= 45, F.concat(F.lit('<h3 class="base-search-card__title">'), F.col("p_name"), F.lit("</h3>"))).otherwise(F.lit("")),
        F.lit('<h4 class="base-search-card__subtitle">'), F.col("p_brand"), F.lit('</h4><span class="job-search-card__location">Wien</span><time class="job-search-card__listdate" datetime="2024-01-02">x</time></div>'),
    )
    second = F.concat(F.lit('<div class="job-search-card"><a class="base-card__full-link" href="https://at.linkedin.com/jobs/view/'), key + 9_000_000, F.lit('"><span class="sr-only">Second</span></a></div>'))
    records, _errors = sh.shape_job_cards(_raw(t.part, F.lit("https://www.linkedin.com/jobs/acme-jobs-worldwide?f_C=1"), F.concat(F.lit("<ul>"), first, second, F.lit("</ul>"))))
    return records.select("run_id", F.col("source_job_id").alias("job"), "title", F.col("company_name").alias("company"), "location", F.col("published_at").alias("published"))


@query("shape_job_criteria", "SELECT p_partkey, p_type AS seniority_level, 'Full' AS employment_type, NULL AS job_function, p_brand AS industry, 'About ' || p_name AS description FROM part")
def _criteria(t):
    item = lambda label, value: F.concat(F.lit('<li class="description__job-criteria-item"><h3 class="description__job-criteria-subheader">'), F.lit(label), F.lit('</h3><span class="description__job-criteria-text"> '), value, F.lit("</span></li>"))
    html = F.concat(F.lit('<div class="show-more-less-html__markup">About '), F.col("p_name"), F.lit("</div><ul>"), item("Seniority level", F.col("p_type")), item("Employment Type", F.lit("Full")), item("Industries", F.col("p_brand")), F.lit("</ul>"))
    return sh.shape_job_criteria(t.part.select("p_partkey", html.alias("body")), ["p_partkey"])


@query("shaper_registry", "SELECT 'unknown_source' AS kind, count(*) AS n FROM part UNION ALL SELECT 'lever', (SELECT count(*) FROM part WHERE p_size <= 45) + (SELECT count(*) FROM part WHERE p_size <= 48) UNION ALL SELECT 'darwinbox', count(*) FROM part WHERE p_size <= 40")
def _registry(t):
    stray = _raw(t.part, F.lit("https://x.example.com"), F.lit(""), source="nobody").withColumn("run_id", -F.col("run_id") - 1)
    records, errors = sh.shape(_lever(t).unionByName(_darwinbox(t)).unionByName(stray), {k: sh.SHAPERS[k] for k in ("lever", "darwinbox")})
    return records.groupBy(F.col("source").alias("kind")).agg(F.count("*").alias("n")).unionByName(
        errors.where("fetch_error = 'unknown_source'").groupBy(F.col("fetch_error").alias("kind")).agg(F.count("*").alias("n"))
    )


@query(
    "read_search_results",
    """SELECT c_custkey, 0 AS position, c_name AS title, 'https://a.example/' || c_custkey AS url, 'text' AS description, 0.5 AS score FROM customer
       UNION ALL SELECT c_custkey, 3, '', 'https://b.example/', '', NULL FROM customer WHERE c_acctbal > 0""",
)
def _search(t):
    first = F.to_json(F.struct(F.col("c_name").alias("title"), F.concat(F.lit("https://a.example/"), F.col("c_custkey")).alias("url"), F.lit("text").alias("content"), F.lit(0.5).alias("score")))
    body = F.concat(F.lit('{"results":['), first, F.lit(',7,{"url":5},'), F.when(F.col("c_acctbal") > 0, F.lit('{"url":"https://b.example/","score":"high"}')).otherwise(F.lit("null")), F.lit(',{"url":"https://late.example/"}]}'))
    return pl.read_search_results(t.customer.select("c_custkey", body.alias("body")), ["c_custkey"], limit=4)
