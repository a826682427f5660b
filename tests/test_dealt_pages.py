"""Pages of one small file are parsed by many tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from snapledger.sources.html_elements import html_elements


def test_pages_are_dealt_anew_before_parsing(spark):
    pages = spark.range(8).coalesce(1).select("id", F.lit("<p>x</p>").alias("html"))
    rows = html_elements(pages, ["id"])
    assert "REPARTITION_BY_COL" in rows._jdf.queryExecution().executedPlan().toString()
    assert rows.count() == 8
