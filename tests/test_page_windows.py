"""Stop reasons of pages that are dealt by run need no second move of the pages, and odd pages count as before."""

from __future__ import annotations

import random

from snapledger.operators import complete as co

PAGES = "run_id int, page_no int, requested_url string, final_url string, body string, next_url string"
ITEMS = "run_id int, page_no int, position int, item_id string"


def _rows(seed: int) -> list[tuple]:
    """Pages and items with repeated addresses and bodies, nulls and pages listed twice."""
    rng = random.Random(seed)
    odd = lambda values: rng.choice([*values, *values, None])
    pages = [(odd([1, 2, 3]), odd([1, 2, 3, 4]), odd("abcd"), odd("abcd"), odd(["x", "y", "z", " "]), odd(["n"])) for _ in range(60)]
    return pages, [(odd([1, 2, 3]), odd([1, 2, 3, 4]), k, odd("pqrs")) for k in range(40)]


def _expected(pages: list[tuple], items: list[tuple]) -> list[tuple]:
    first = {}
    for run, page, _at, item in items:
        if page is not None:
            first[run, item] = min(first.get((run, item), page), page)
    out = []
    for run, page, asked, final, body, after in pages:
        if None in (run, page, asked, final, body):
            continue
        earlier = [p for p in pages if p[0] == run and p[1] is not None and p[1] < page]
        seen = {p[2] for p in earlier} | {p[3] for p in earlier}
        if page > 3:
            reason = "max_pages"
        elif asked in seen or (final != asked and final in seen):
            reason = "repeated_url"
        elif body in {p[4] for p in earlier}:
            reason = "repeated_content"
        elif not any(at == page and key[0] == run for key, at in first.items()):
            reason = "no_new_job_ids"
        else:
            reason = "no_next_page" if after is None else None
        out.append((run, page, reason))
    return sorted(out, key=repr)


def test_odd_pages_as_counted_by_hand(spark):
    for seed in range(4):
        pages, items = _rows(seed)
        got = co.page_reasons(spark.createDataFrame(pages, PAGES), spark.createDataFrame(items, ITEMS), max_pages=3, max_requests=9)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == _expected(pages, items)


def test_pages_dealt_by_run_stay(spark):
    pages, items = (spark.createDataFrame(rows, schema) for rows, schema in zip(_rows(9), (PAGES, ITEMS), strict=True))
    for live in (False, True):
        more = {"live": True} if live else {}
        dealt = pages.selectExpr("*", "200 AS status", "string(null) AS redirect_path", "string(null) AS block_reason").repartition("run_id")
        plan = co.stop_reason(co.page_reasons(dealt, items, max_pages=9, max_requests=9, **more))._jdf.queryExecution().executedPlan().toString()
        # Pages by run, then slim pages and first places by page; ids by item and by page, reasons by run.
        assert plan.count("Exchange hashpartitioning") <= 5, plan


def test_queries_deal_pages_by_run(spark):
    from snapledger.suite import load

    for name, most in (("stop_reason", 9), ("stop_reason_live", 19)):
        plan = load()[0][name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= most, (name, plan.count("Exchange hashpartitioning"))
