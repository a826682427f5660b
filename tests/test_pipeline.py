"""Page sequences, families and the whole way from landed payloads to the state."""

from __future__ import annotations

import json
from datetime import UTC, datetime, timedelta

from snapledger.plans.pipeline import landed_records, run_pipeline
from snapledger.schemas import BATCHES, POSTINGS, SOURCES
from snapledger.sources import shapers as sh

T0 = datetime(2024, 1, 1, tzinfo=UTC)
RAW = "run_id bigint, company_source_id bigint, source string, page_no int, kind string, requested_url string, body string"
LEVER, BOX = "https://api.lever.co/v0/postings/a", "https://t.darwinbox.com/ms/candidatev2/C1/careers"


def shaped(spark, shaper, pages, url, **options):
    rows = [(run, run, "x", no, kind, at, body) for run, no, kind, at, body in [(p[0], p[1], "listing", url, p[2]) if len(p) == 3 else p for p in pages]]
    records, errors = shaper(spark.createDataFrame(rows, RAW), **options)
    jobs = {}
    for r in records.orderBy("page_no", "position").collect():
        jobs.setdefault(r.run_id, []).append(r.source_job_id)
    return jobs, {r.run_id: r.fetch_error for r in errors.collect()}


def test_array_pages(spark):
    page = lambda *ids: json.dumps([{"id": i, "text": "t"} for i in ids])
    pages = [
        (1, 0, page("a", "b")), (1, 1, page("b", "c")), (1, 2, page("d")),  # complete, one id twice
        (2, 0, page("a", "b")), (2, 1, page("b", "a")), (2, 2, page()),  # stalled
        (3, 0, page("a", "b")), (3, 1, page("c", "d")),  # never ends
        (4, 0, page("a", "b")), (4, 1, page()), (4, 2, "broken"),  # what comes behind the end was not asked for
        (5, 0, page("a", "b")), (5, 1, "[1"), (6, 0, "{}"), (7, 0, page()), (8, 0, page("a", " ")),
        (9, 0, page("a", "a")), (9, 1, page("a")),
    ]
    jobs, errors = shaped(spark, sh.shape_lever, pages, LEVER, page_size=2)
    assert errors == {2: "no_new_ids", 3: "unfinished", 5: "bad_json", 6: "root_not_array", 8: "id_missing", 9: "no_new_ids"}
    assert (jobs[1], jobs[4]) == (["a", "b", "c", "d"], ["a", "b"]) and 7 not in jobs


def test_envelope_pages(spark):
    page = lambda total, *ids: json.dumps({"status": "success", "job_counts": total, "data": [{"id": i, "title": "t", "jd": "d"} for i in ids]})
    pages = [
        (1, 1, page(3, "a", "b")), (1, 2, page(3, "b", "c")), (2, 1, page(500, "a", "b")), (3, 1, page(3, "a", "b")), (3, 2, page(4, "c", "d")),
        (4, 1, page(3, "a", "b")), (4, 2, page(3, "a", "b")), (5, 1, page(1, "a", "b")), (6, 1, page(0)), (7, 1, page(2)),
        (8, 1, page(2, "a", "b")), (8, 2, page(9, "z")), (9, 1, page(-1, "a")), (10, 1, page(True, "a")),
    ]
    jobs, errors = shaped(spark, sh.shape_darwinbox, pages, BOX)
    assert errors == {2: "short", 3: "total_changed", 4: "no_new_ids", 5: "total_exceeded", 7: "no_new_ids", 9: "bad_total", 10: "bad_total"}
    assert (jobs[1], jobs[8]) == (["a", "b", "c"], ["a", "b"])


def test_broken_json_ld_fails_the_run(spark):
    host = "https://t.applytojob.com"
    rows = []
    for run, script in ((1, '{"@type":"JobPosting","title":"A"'), (2, "")):
        rows.append((run, 1, "listing", f"{host}/apply", '<ul class="list-group"><li><a href="/apply/KeyAbCdEf12/Role">A</a></li></ul>'))
        rows.append((run, 1, "detail", f"{host}/apply/KeyAbCdEf12/Role", f'<script type="application/ld+json">{script}</script><div class="job-header"><h2>A</h2></div><div id="job-description">D</div>'))
    jobs, errors = shaped(spark, sh.shape_jazzhr, rows, host)
    assert errors == {1: "malformed_jsonld"} and len(jobs[2]) == 1


def test_generic_pages(spark):
    html = lambda *names: "".join(f'<ul><li class="job-item"><a href="/jobs/{n}-10{k}">{n} engineer role</a></li></ul>' for k, n in enumerate(names))
    base = "https://a.example.com/jobs"
    rows = [
        (1, 1, "listing", base, html("data", "cloud")), (1, 2, "listing", base + "?page=2", html("data", "cloud") + '<li class="job-item"><a href="/jobs/web-777">web engineer role</a></li>'),
        (1, 1, "detail", "https://a.example.com/jobs/data-100", "<h1>Data lead</h1><dl><dt>Location</dt><dd>Wien</dd></dl>"),
        (2, 1, "listing", base, html("data")), (2, 2, "listing", base + "?page=2", html("data")),
    ]
    raw = spark.createDataFrame([(r, r, "generic", no, kind, url, body) for r, no, kind, url, body in rows], RAW)
    records, errors = sh.shape_generic(raw)
    got = {(r.run_id, r.title): r.location for r in records.collect()}
    assert got[1, "Data lead"] == "Wien" and sum(run == 1 for run, _ in got) == 3
    assert {r.run_id: r.fetch_error for r in errors.collect()} == {2: "no_new_jobs"}


def test_incomplete_runs_age_nothing(spark):
    page = lambda *ids: json.dumps([{"id": i, "text": f"title {i}"} for i in ids])
    file = lambda *ids: json.dumps([{"source": "fixture", "source_job_id": i, "title": "t"} for i in ids])
    sources = spark.createDataFrame([(1, 1, "lever", None, "approved", True), (2, 1, "fixture", None, "approved", True), (3, 1, "nobody", None, "approved", True)], SOURCES)
    landed = {  # run: (source, family, pages); runs 1x are source 1, 2x source 2
        10: (1, "lever", [page("a", "b"), page("c")]), 11: (1, "lever", [page("a", "b")]), 12: (1, "lever", [page("a", "b"), page("a", "b"), page()]),
        13: (1, "lever", []), 14: (1, "lever", [page("a")]),
        20: (2, "fixture", [file("x", "y")]), 21: (2, "fixture", [file("x")[:-2]]), 22: (2, "fixture", ['[{"source": "fixture", "source_job_id": 5}, ' + file("x")[1:]]),
        30: (3, "nobody", [page("a")]),
    }
    raw = [(run, src, fam, k, "listing", LEVER, body) for run, (src, fam, bodies) in landed.items() for k, body in enumerate(bodies)]
    batches = [(run, src, T0 + timedelta(days=run), T0 + timedelta(days=run), 1, None) for run, (src, _f, _b) in landed.items()]
    frames = spark.createDataFrame(raw, RAW), spark.createDataFrame(batches, BATCHES)
    shapers = {**sh.SHAPERS, "lever": lambda rows: sh.shape_lever(rows, page_size=2)}
    judged = {r.run_id: r.fetch_error for r in landed_records(*frames, shapers)[1].collect()}
    assert judged == {10: None, 11: "unfinished", 12: "no_new_ids", 13: "no_pages", 14: None, 20: None, 21: "bad_json", 22: None, 30: "unknown_source"}
    out = run_pipeline(*frames, sources, spark.createDataFrame([], POSTINGS), shapers=shapers)
    state = {r.source_job_id: (r.status, r.consecutive_successful_misses) for r in out.postings.collect()}
    # Only run 14 is a later success of source 1; run 22 is partial, so y keeps its row.
    assert state == {"a": ("active", 0), "b": ("active", 1), "c": ("active", 1), "x": ("active", 0), "y": ("active", 0)}
    assert {r.id: r.status for r in out.runs.collect()} == {
        10: "success", 11: "failed", 12: "failed", 13: "failed", 14: "success", 20: "success", 21: "failed", 22: "partial", 30: "failed"}


def test_bodies_of_any_size_and_broken_tails(spark):
    from pyspark.sql import functions as F

    from snapledger.sources.payloads import read_snapshot_records

    whole = ['[{"a":1},{"a":"x"}]', "  [ ] ", '\n[{"a":{"b":[1,2]}}]\n']
    bad = ["[1] [2]", "[1]}", '[1],"b":2', '[{"a":1},', "", '[{"a":1}] x', "[{'a':1}]", "[NaN]", "[01]", "[1,2}", '[1],"a":[2]', '[1]],"z":[1', None]
    other = ['{"a":1}', "null", "5", '"x"']
    bodies = spark.createDataFrame(list(enumerate([*whole, *bad, *other, '[{"a":1},7]'])), "n int, body string")
    got = {r.n: r.fetch_error for r in read_snapshot_records(bodies, ["n"])[1].collect()}
    assert list(got.values()) == [None] * 3 + ["bad_json"] * len(bad) + ["root_not_array"] * 4 + ["item_not_object"]
    # 160 MB in one body: more than one variant may hold.
    item = F.concat(F.lit('{"id":"'), F.col("i").cast("string"), F.lit('","text":"' + "x" * 2000 + '"}'))
    large = spark.range(80_000).select(F.col("id").alias("i")).agg(F.array_join(F.collect_list(item), ",").alias("items"))
    large = large.select(F.explode(F.array(F.lit(1), F.lit(2))).alias("run_id"), "items").select(
        "run_id", F.col("run_id").alias("company_source_id"), F.lit(0).alias("page_no"), F.lit("listing").alias("kind"), F.lit(LEVER).alias("requested_url"),
        F.concat(F.lit("["), "items", F.when(F.col("run_id") == 1, F.lit("]")).otherwise(F.lit(",{"))).alias("body"),
    )
    records, errors = sh.shape_lever(large, page_size=100_000)
    assert {(r.run_id, r["count"]) for r in records.groupBy("run_id").count().collect()} == {(1, 80_000)}
    assert [tuple(r) for r in errors.collect()] == [(2, "bad_json")]
