"""From landed payloads to the state in one plan: shape every family, judge each run's completeness, merge the runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapledger.operators.validate import RECORD_FIELDS
from snapledger.plans.history import merge_history
from snapledger.plans.ingest import SnapshotResult
from snapledger.sources.shapers import Shaped, shape
from snapledger.staging import stage

#: A record's index is its page, then its place on the page (below 2^26).
PLACE_BITS = 26


def landed_records(raw: DataFrame, batches: DataFrame, shapers: dict[str, Callable[[DataFrame], Shaped]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, batches) for a merge: every run with the error its pages show, in ``fetch_error``.

    An error that the batch states comes first, then one of its payloads or of its page sequence; a run without any landed
    page is ``no_pages``. Records of a run with an error stay out.
    """
    raw = stage(raw, "landed-pages")
    records, errors = shape(raw, shapers)
    found = errors.groupBy("run_id").agg(F.min("fetch_error").alias("_error"))
    landed = raw.groupBy("run_id").agg(F.lit(True).alias("_landed"))
    judged = batches.join(found, "run_id", "left").join(landed, "run_id", "left").withColumn(
        "fetch_error", F.coalesce("fetch_error", "_error", F.when(F.col("_landed").isNull(), F.lit("no_pages")))
    )
    judged = stage(judged.select(*batches.columns), "judged-runs")
    whole = records.join(judged.where("fetch_error IS NULL").select("run_id"), "run_id", "left_semi")
    index = F.shiftleft(F.col("page_no").cast("bigint"), PLACE_BITS) + F.col("position")
    kept = ["type_error"] if "type_error" in whole.columns else []
    return whole.select("run_id", "company_source_id", index.alias("record_index"), *RECORD_FIELDS, *kept), judged


def run_pipeline(
    raw: DataFrame, batches: DataFrame, sources: DataFrame, postings: DataFrame, *,
    shapers: dict[str, Callable[[DataFrame], Shaped]] | None = None, **options,
) -> SnapshotResult:
    """Merge landed pages of any number of runs and families into ``postings``.

    ``raw``: run_id, company_source_id, source, page_no, kind, requested_url, body. ``batches`` as for ``run_snapshots``, any
    number per source. A run whose pages are broken, stalled, short or contradict each other fails: it
    changes no row and ages none.
    """
    records, judged = landed_records(raw, batches, shapers)
    return merge_history(records, judged, sources, postings, **options)
