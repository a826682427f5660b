"""Completeness of landed page sequences: what a run says about its own end, from counts per page.

``firsts``: run_id, item_id, page_no and position where an id is listed first; ``pages``: run_id, page_no, ``n_items`` and, where the
family states one, ``total``. Ids are compared by aggregates per (run, id); only one row per page passes a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapledger.staging import stage


def first_places(items: DataFrame) -> DataFrame:
    """(run_id, item_id, page_no, position): where each id of a run is listed first."""
    place = F.min(F.struct("page_no", "position")).alias("_p")
    return items.where(F.col("item_id").isNotNull()).groupBy("run_id", "item_id").agg(place).select("run_id", "item_id", "_p.*")


def page_progress(pages: DataFrame, firsts: DataFrame) -> DataFrame:
    """``pages`` with ``new_ids`` (listed there first) and ``seen_before``, the distinct ids of the pages before."""
    new = firsts.groupBy("run_id", "page_no").agg(F.count("*").alias("new_ids"))
    counted = pages.join(new, ["run_id", "page_no"], "left").na.fill(0, ["new_ids"])
    before = Window.partitionBy("run_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn("seen_before", F.coalesce(F.sum("new_ids").over(before), F.lit(0)))


def _with_end(progress: DataFrame, ends: Column) -> DataFrame:
    """Pages up to the first one that ends its run (``end_page``, null where none does); later ones were not asked for."""
    whole = Window.partitionBy("run_id")
    found = progress.withColumn("end_page", F.min(F.when(ends, F.col("page_no"))).over(whole))
    return found.where(F.col("end_page").isNull() | (F.col("page_no") <= F.col("end_page")))


def _verdict(pages: DataFrame, error: Column, unfinished: str) -> tuple[DataFrame, DataFrame]:
    """(ends, errors): the page that ends each run that has an end; the error of its first bad page, or ``unfinished`` without an end."""
    per_run = pages.groupBy("run_id").agg(
        F.min(F.when(error.isNotNull(), F.struct("page_no", error.alias("e")))).alias("_bad"), F.max("end_page").alias("_end")
    )
    found = F.coalesce(F.col("_bad.e"), F.when(F.col("_end").isNull(), F.lit(unfinished)))
    judged = stage(per_run.select("run_id", F.col("_end").alias("end_page"), found.alias("fetch_error")), "run-ends")
    errors = judged.where("fetch_error IS NOT NULL").select("run_id", "fetch_error")
    return judged.where("end_page IS NOT NULL").select("run_id", "end_page"), errors


def until_end(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """Rows of pages up to the end of their run; what lies behind it was not asked for."""
    return rows.join(ends, "run_id", "left").where(F.col("end_page").isNull() | (F.col("page_no") <= F.col("end_page"))).drop("end_page")


def short_page_ends(pages: DataFrame, firsts: DataFrame, page_size: int) -> tuple[DataFrame, DataFrame]:
    """A sequence ends with an empty page or one of fewer than ``page_size`` items; every page but an empty one must
    list an id the pages before didn't."""
    progress = _with_end(page_progress(pages, firsts), F.col("n_items") < page_size)
    stalled = (F.col("n_items") > 0) & (F.col("new_ids") == 0)
    return _verdict(progress, F.when(stalled, F.lit("no_new_ids")), "unfinished")


def stated_total_ends(pages: DataFrame, firsts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A sequence ends when as many distinct ids are listed as its pages state; they must all state the same number."""
    progress = page_progress(pages, firsts)
    seen = F.col("seen_before") + F.col("new_ids")
    read = _with_end(progress, seen == F.col("total"))
    first_total = F.first("total").over(Window.partitionBy("run_id").orderBy("page_no"))
    error = (
        F.when(F.col("total") != F.col("_stated"), F.lit("total_changed"))
        .when((F.col("new_ids") == 0) & (F.col("seen_before") < F.col("total")), F.lit("no_new_ids"))
        .when(seen > F.col("total"), F.lit("total_exceeded"))
    )
    return _verdict(read.withColumn("_stated", first_total), error, "short")
