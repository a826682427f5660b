"""Run ledger: outcomes, status rules, latest-per-key and owner roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapledger.functions.text import duration_seconds, strip_ws
from snapledger.operators.registry import EXECUTION_BLOCKED, executable, source_key


def run_outcome_counts(outcomes: DataFrame, by: str = "run_id") -> DataFrame:
    """``outcomes`` has one row per record with outcome created/updated/unchanged/failed."""
    is_ = lambda name: F.count_if(F.col("outcome") == name)
    return outcomes.groupBy(by).agg(
        F.count("*").alias("jobs_found"),
        is_("created").alias("jobs_created"),
        is_("updated").alias("jobs_updated"),
        is_("unchanged").alias("jobs_unchanged"),
        is_("failed").alias("jobs_failed"),
    )


def run_status(failed: Column, succeeded: Column, recover: Column, fetch_error: Column) -> Column:
    return (
        F.when(fetch_error.isNotNull(), F.lit("failed"))
        .when((failed > 0) & ((succeeded == 0) | ~recover), F.lit("failed"))
        .when(failed > 0, F.lit("partial"))
        .otherwise(F.lit("success"))
    )


def finish_runs(counted: DataFrame) -> DataFrame:
    """Terminal ledger rows from counts; a FAILED run stores zero counters.

    Input columns: run_id, company_id, company_source_id, started_at, finished_at, requests_made,
    fetch_error, recover, jobs_found/created/updated/unchanged/failed, first_error_type.
    """
    succeeded = F.col("jobs_created") + F.col("jobs_updated") + F.col("jobs_unchanged")
    status = run_status(F.col("jobs_failed"), succeeded, F.col("recover"), F.col("fetch_error"))
    failed = F.col("status") == "failed"
    zero = lambda name: F.when(failed, F.lit(0).cast("bigint")).otherwise(F.col(name))
    message = (
        F.when(
            F.col("fetch_error").isNotNull(),
            F.concat(F.lit("Source pipeline failed: "), F.col("fetch_error")),
        )
        .when(
            failed & F.col("recover"), F.lit("Source pipeline failed: AllJobRecordsFailedError")
        )
        .when(failed, F.concat(F.lit("Source pipeline failed: "), F.col("first_error_type")))
        .when(
            F.col("status") == "partial",
            F.concat(
                F.col("jobs_failed"), F.lit(" of "), F.col("jobs_found"),
                F.lit(" job records failed processing"),
            ),
        )
        .otherwise(F.lit(""))
    )
    return counted.withColumn("status", status).select(
        F.col("run_id").alias("id"),
        "company_id",
        "company_source_id",
        "started_at",
        "finished_at",
        "status",
        zero("jobs_found").alias("jobs_found"),
        zero("jobs_created").alias("jobs_created"),
        zero("jobs_updated").alias("jobs_updated"),
        F.col("requests_made"),
        duration_seconds(F.col("started_at"), F.col("finished_at")).alias("duration_seconds"),
        message.alias("error_message"),
    )


def latest_by(runs: DataFrame, keys: list[str], columns: tuple[str, ...] = ()) -> DataFrame:
    """Latest run per key by (started_at, id), as a partial aggregate rather than a window."""
    keep = columns or tuple(c for c in runs.columns if c not in keys)
    best = F.max_by(F.struct(*keep), F.struct("started_at", "id")).alias("_run")
    return runs.groupBy(*keys).agg(best).select(*keys, "_run.*")


def first_run_after(runs: DataFrame, baseline: int) -> DataFrame:
    return (
        runs.where((F.col("id") > baseline) & F.col("company_source_id").isNotNull())
        .groupBy("company_source_id")
        .agg(F.min("id").alias("first_run_id"), F.min_by("status", "id").alias("first_status"))
    )


def batch_progress(expected: DataFrame, runs: DataFrame, baseline: int) -> DataFrame:
    """One row: expected sources, how many are terminal, whether the batch is complete."""
    joined = expected.select("company_source_id").distinct().join(
        first_run_after(runs, baseline), "company_source_id", "left"
    )
    terminal = F.coalesce(F.col("first_status") != "running", F.lit(False))
    return joined.agg(
        F.count("*").alias("expected_sources"),
        F.count_if(terminal).alias("terminal_sources"),
        F.coalesce(F.bool_and(terminal), F.lit(True)).alias("batch_complete"),
    )


def submission_complete(expected: DataFrame, runs: DataFrame, after_id: int) -> DataFrame:
    """Per company: latest run after the baseline of every expected source, all terminal or not."""
    latest = latest_by(
        runs.where(F.col("id") > after_id), ["company_id", "company_source_id"], ("id", "status")
    )
    joined = expected.join(latest, ["company_id", "company_source_id"], "left")
    terminal = F.coalesce(F.col("status") != "running", F.lit(False))
    return joined.groupBy("company_id").agg(
        F.count("*").alias("expected_sources"),
        F.bool_and(terminal).alias("submission_complete"),
    )


def executable_sources(sources: DataFrame, companies: DataFrame) -> DataFrame:
    """Every source with its disposition: run, skipped, failed (unregistered) or inactive owner."""
    owners = companies.select(F.col("id").alias("company_id"), F.col("is_active").alias("_owner_active"))
    blocked = (
        source_key(F.col("source")).isin(*EXECUTION_BLOCKED) if EXECUTION_BLOCKED else F.lit(False)
    )
    return (
        sources.join(owners, "company_id")
        .withColumn(
            "disposition",
            F.when(~F.col("_owner_active"), F.lit("inactive_company"))
            .when(
                ~F.col("is_active") | (F.col("approval_status") != "approved") | blocked,
                F.lit("skipped"),
            )
            .when(~executable(F.col("source")), F.lit("failed"))
            .otherwise(F.lit("run")),
        )
        .drop("_owner_active")
    )


def submission_summary(sources: DataFrame, companies: DataFrame, runs: DataFrame) -> DataFrame:
    """Started, already running, skipped and failed source counts per active company.

    A company without a source to execute counts as one failure.
    """
    running = (
        runs.where(F.col("status") == "running")
        .select(F.col("company_source_id").alias("id"))
        .distinct()
        .withColumn("_running", F.lit(True))
    )
    marked = executable_sources(sources, companies).where(F.col("disposition") != "inactive_company").join(
        running, "id", "left"
    )
    ready = F.col("disposition") == "run"
    busy = F.coalesce("_running", F.lit(False))
    counts = marked.groupBy("company_id").agg(
        F.count_if(ready & ~busy).alias("started"),
        F.count_if(ready & busy).alias("already_running"),
        F.count_if(F.col("disposition") == "skipped").alias("skipped"),
        F.count_if(F.col("disposition") == "failed").alias("failed"),
    )
    names = ("started", "already_running", "skipped", "failed")
    active = companies.where("is_active").select(F.col("id").alias("company_id"))
    filled = active.join(counts, "company_id", "left").na.fill(0, list(names))
    candidates = F.col("started") + F.col("already_running") + F.col("failed")
    return filled.withColumn("no_executable_source", candidates == 0)


def company_status(companies: DataFrame, sources: DataFrame, runs: DataFrame) -> DataFrame:
    """Owner status over the latest run of each approved active source, and last finish time."""
    ready = sources.where((F.col("approval_status") == "approved") & F.col("is_active")).select(
        "company_id", F.col("id").alias("company_source_id")
    )
    per_source = runs.where(F.col("company_source_id").isNotNull()).groupBy("company_source_id").agg(
        F.max_by("status", F.struct("started_at", "id")).alias("_status"),
        F.max("finished_at").alias("_finished"),
    )
    is_ = lambda name: F.coalesce(F.bool_or(F.col("_status") == name), F.lit(False))
    rolled = ready.join(per_source, "company_source_id", "left").groupBy("company_id").agg(
        is_("running").alias("_running"),
        is_("failed").alias("_failed"),
        is_("partial").alias("_partial"),
        (F.count("_status") == F.count("*")).alias("_all_ran"),
        F.max("_finished").alias("last_scraped_at"),
    )
    status = (
        F.when(F.col("_running"), F.lit("running"))
        .when(F.col("_failed"), F.lit("failed"))
        .when(F.col("_partial"), F.lit("partial"))
        .when(F.col("_all_ran"), F.lit("success"))
        .otherwise(F.lit("never"))
    )
    return companies.select(F.col("id").alias("company_id")).join(rolled, "company_id", "left").select(
        "company_id", status.alias("last_scrape_status"), "last_scraped_at"
    )


def latest_failure(runs: DataFrame) -> DataFrame:
    return runs.where(F.col("status") == "failed").agg(
        F.max(F.struct("finished_at", "id")).alias("boundary")
    )


def unread_failures(runs: DataFrame, seen: Column | None = None) -> DataFrame:
    """Count of FAILED runs up to the newest one and after the ``seen`` boundary struct."""
    mark = F.struct("finished_at", "id")
    failed = runs.where(F.col("status") == "failed")
    fresh = failed if seen is None else failed.where(mark > seen)
    return fresh.agg(F.count("*").alias("unread"))


def acknowledge(markers: DataFrame, acks: DataFrame, runs: DataFrame) -> DataFrame:
    """Advance each viewer's marker through real failed runs; it never moves back."""
    failed = runs.where(F.col("status") == "failed").select(
        F.col("id").alias("run_id"), F.struct("finished_at", "id").alias("_mark")
    )
    moved = acks.join(failed, "run_id").groupBy("viewer").agg(F.max("_mark").alias("_mark"))
    return markers.join(moved, "viewer", "full_outer").select(
        "viewer", F.greatest("seen", "_mark").alias("seen")
    )


def rule_violations(runs: DataFrame) -> DataFrame:
    """Ledger rows that break a run rule, with the first broken rule."""
    terminal = F.col("status").isin("success", "partial", "failed")
    negative = F.least("jobs_found", "jobs_created", "jobs_updated", "requests_made") < 0
    broken = (
        F.when(~F.col("status").isin("running", "success", "partial", "failed"), F.lit("status"))
        .when(negative, F.lit("negative_counter"))
        .when(F.col("jobs_created") > F.col("jobs_found"), F.lit("created_exceeds_found"))
        .when(F.col("jobs_updated") > F.col("jobs_found"), F.lit("updated_exceeds_found"))
        .when(terminal != F.col("finished_at").isNotNull(), F.lit("terminal_without_finish"))
        .when(F.col("finished_at") < F.col("started_at"), F.lit("finish_before_start"))
        .when((F.col("status") == "success") & (F.col("error_message") != ""), F.lit("message_on_success"))
        .when(
            F.col("status").isin("partial", "failed") & (strip_ws(F.col("error_message")) == ""),
            F.lit("message_required"),
        )
    )
    return runs.withColumn("rule", broken).where(F.col("rule").isNotNull())


def run_filter(runs: DataFrame, ids: list[int], company_id: int | None = None) -> DataFrame:
    wanted = F.col("id").isin(*ids) | (F.col("status") == "running") if ids else F.col("status") == "running"
    chosen = runs.where(wanted)
    return chosen if company_id is None else chosen.where(F.col("company_id") == company_id)


def parse_id_list(value: Column, limit: int = 100) -> Column:
    """Positive integers among the first ``limit`` comma-separated tokens, ordered and distinct."""
    tokens = F.slice(F.split(value, ","), 1, limit)
    numbers = F.transform(tokens, lambda t: strip_ws(t).try_cast("bigint"))
    return F.array_distinct(F.filter(numbers, lambda n: n > 0))


def run_history(runs: DataFrame, page: int, page_size: int = 25, total: int | None = None) -> DataFrame:
    """One page, newest first; out-of-range pages clamp to the nearest one."""
    rows = runs.count() if total is None else total
    last = max(1, -(-rows // page_size))
    chosen = min(max(page, 1), last)
    return (
        runs.orderBy(F.desc("started_at"), F.desc("id")).offset((chosen - 1) * page_size).limit(page_size)
    )
