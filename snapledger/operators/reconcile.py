"""Miss reconciliation after a run, and the replay of a whole run history in closed form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_MISS_THRESHOLD = 2


def seen_split(postings: DataFrame, seen: DataFrame) -> DataFrame:
    """State rows flagged by membership in the seen set (posting ids)."""
    marks = seen.select(F.col("posting_id").alias("id")).distinct().withColumn("_seen", F.lit(True))
    return postings.join(marks, "id", "left").withColumn(
        "seen", F.coalesce("_seen", F.lit(False))
    ).drop("_seen")


def unknown_seen_ids(seen: DataFrame, postings: DataFrame) -> DataFrame:
    """Seen ids that are not rows of their source: ``foreign`` (another source's) or ``missing``."""
    own = postings.select("company_source_id", F.col("id").alias("posting_id"))
    stray = seen.distinct().join(own, ["company_source_id", "posting_id"], "left_anti")
    every = postings.select(F.col("id").alias("posting_id")).distinct().withColumn("_any", F.lit(True))
    return stray.join(every, "posting_id", "left").select(
        "company_source_id",
        "posting_id",
        F.when(F.col("_any"), F.lit("foreign")).otherwise(F.lit("missing")).alias("kind"),
    )


def miss_step(status: Column, misses: Column, threshold: int) -> tuple[Column, Column]:
    """(misses, status) of an unseen row after one more successful run."""
    bumped = F.least(misses + 1, F.lit(threshold))
    next_misses = F.when(status == "active", bumped).when(
        status == "not_found", F.lit(threshold)
    ).otherwise(misses)
    next_status = F.when((status == "active") & (misses + 1 >= threshold), F.lit("not_found")).otherwise(status)
    return next_misses, next_status


def reconcile(flagged: DataFrame, threshold: int = DEFAULT_MISS_THRESHOLD) -> DataFrame:
    """Rows of successfully run sources (with ``seen``): new misses and status, plus the old ones."""
    status, misses = F.col("status"), F.col("consecutive_successful_misses")
    next_misses, next_status = miss_step(status, misses, threshold)
    return flagged.withColumns(
        {
            "old_status": status,
            "old_misses": misses,
            "consecutive_successful_misses": F.when(F.col("seen"), F.lit(0)).otherwise(next_misses),
            "status": F.when(F.col("seen"), status).otherwise(next_status),
        }
    )


def reconcile_counts(reconciled: DataFrame, by: str = "company_source_id") -> DataFrame:
    seen, old, new = F.col("seen"), F.col("old_misses"), F.col("consecutive_successful_misses")
    return reconciled.groupBy(by).agg(
        F.count("*").alias("total_source_jobs"),
        F.count_if(seen).alias("seen_jobs"),
        F.count_if(~seen).alias("unseen_jobs"),
        F.count_if(seen & (old != 0)).alias("miss_counters_reset"),
        F.count_if(~seen & (new > old)).alias("miss_counters_incremented"),
        F.count_if((F.col("old_status") == "active") & (F.col("status") == "not_found")).alias(
            "jobs_marked_not_found"
        ),
        F.count_if(F.col("old_status") == "closed").alias("closed_jobs_unchanged"),
    )


def replay(observations: DataFrame, runs: DataFrame, threshold: int = DEFAULT_MISS_THRESHOLD) -> DataFrame:
    """Final status and misses per (source, key) from a run history, without runs x keys.

    ``observations``: company_source_id, key, run_seq. ``runs``: company_source_id, run_seq, status.
    A key is seen by SUCCESS and PARTIAL runs; only SUCCESS runs after that count as misses.
    """
    by_source = Window.partitionBy("company_source_id").orderBy("run_seq")
    whole = Window.partitionBy("company_source_id")
    success = (F.col("status") == "success").cast("bigint")
    counted = runs.where(F.col("status").isin("success", "partial")).select(
        "company_source_id",
        "run_seq",
        (F.sum(success).over(whole) - F.sum(success).over(by_source)).alias("_later_success"),
    )
    # The latest run that saw the key has the fewest successful runs after it.
    last = (
        observations.groupBy("company_source_id", "key", "run_seq")
        .agg(F.lit(1).alias("_one"))
        .join(counted, ["company_source_id", "run_seq"])
        .groupBy("company_source_id", "key")
        .agg(F.max("run_seq").alias("last_seen_seq"), F.min("_later_success").alias("_later"))
    )
    misses = F.least(F.lit(threshold), F.col("_later"))
    return last.select(
        "company_source_id",
        "key",
        "last_seen_seq",
        misses.cast("bigint").alias("misses"),
        F.when(misses >= threshold, F.lit("not_found")).otherwise(F.lit("active")).alias("status"),
    )


def miss_timeline(observations: DataFrame, runs: DataFrame, threshold: int = DEFAULT_MISS_THRESHOLD) -> DataFrame:
    """Misses of every key after every SUCCESS or PARTIAL run since its first sighting.

    The output itself has one row per (key, run): it is the timeline. Work per key is one window.
    """
    ok_runs = runs.where(F.col("status").isin("success", "partial"))
    seen = observations.distinct().join(
        ok_runs.select("company_source_id", "run_seq"), ["company_source_id", "run_seq"]
    ).withColumn("_seen", F.lit(True))
    first = seen.groupBy("company_source_id", "key").agg(F.min("run_seq").alias("_first"))
    grid = first.join(
        ok_runs.select("company_source_id", "run_seq", F.col("status").alias("run_status")),
        "company_source_id",
    ).where(F.col("run_seq") >= F.col("_first"))
    marked = grid.join(seen, ["company_source_id", "key", "run_seq"], "left")
    so_far = (
        Window.partitionBy("company_source_id", "key").orderBy("run_seq")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    success = F.sum((F.col("run_status") == "success").cast("bigint")).over(so_far)
    stepped = marked.withColumn("_success", success).withColumn(
        "_at_seen", F.max(F.when(F.col("_seen"), F.col("_success"))).over(so_far)
    )
    misses = F.least(F.lit(threshold), F.col("_success") - F.col("_at_seen"))
    return stepped.select(
        "company_source_id",
        "key",
        "run_seq",
        misses.cast("bigint").alias("misses"),
        F.when(misses >= threshold, F.lit("not_found")).otherwise(F.lit("active")).alias("status"),
    )
