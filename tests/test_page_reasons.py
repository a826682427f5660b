"""Stop reasons read the two addresses of a page in one pass."""

from __future__ import annotations

from snapledger.operators import complete as co


def test_addresses_in_one_pass(spark):
    rows = [(1, 1, "a", "b", "x", "n"), (1, 2, "c", "c", "y", "n"), (1, 3, "b", "d", "z", "n"), (2, 1, "a", "a", "x", "n"), (2, 2, "e", "a", "y", "n")]
    pages = spark.createDataFrame(rows, "run_id int, page_no int, requested_url string, final_url string, body string, next_url string")
    items = spark.createDataFrame([(r[0], r[1], k, f"{r[0]}-{r[1]}") for k, r in enumerate(rows)], "run_id int, page_no int, position int, item_id string")
    found = co.stop_reason(co.page_reasons(pages, items, max_pages=9, max_requests=9))
    assert "Union" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in found.collect()} == {(1, 3, "repeated_url"), (2, 2, "repeated_url")}
