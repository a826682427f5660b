"""Constraint audits: one query per rule, each returning the rows (or keys) that break it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapledger.functions.text import strip_ws

# Allowed codes.
POSTING_STATUSES = ("active", "not_found", "closed")


def _repeated(df: DataFrame, keys: list[str], rule: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(
        F.concat_ws("/", *[F.col(k).cast("string") for k in keys]).alias("subject"), F.lit(rule).alias("rule")
    )


def audit_postings(postings: DataFrame) -> DataFrame:
    scope = F.coalesce(F.col("company_source_id").cast("string"), F.concat_ws(":", F.lit("legacy"), "company_id", "source"))
    scoped = postings.withColumn("scope", scope)
    has_id = F.col("source_job_id").isNotNull() & (F.col("source_job_id") != "")
    has_url = F.col("source_job_url").isNotNull() & (F.col("source_job_url") != "")
    single = lambda cond, rule: postings.where(cond).select(
        F.col("id").cast("string").alias("subject"), F.lit(rule).alias("rule")
    )
    return (
        _repeated(scoped, ["scope", "dedupe_key"], "dedupe_key_unique")
        .unionByName(_repeated(scoped.where(has_id), ["scope", "source_job_id"], "source_job_id_unique"))
        .unionByName(_repeated(postings, ["id"], "id_unique"))
        .unionByName(single(~(has_id | has_url), "identity_present"))
        .unionByName(single(~F.col("status").isin(*POSTING_STATUSES), "status_allowed"))
        .unionByName(single(F.col("consecutive_successful_misses") < 0, "misses_not_negative"))
    )


def audit_runs(runs: DataFrame) -> DataFrame:
    """One RUNNING run per source (per company without a source); terminal iff finished."""
    scope = F.coalesce(F.concat(F.lit("s"), F.col("company_source_id")), F.concat(F.lit("c"), F.col("company_id")))
    running = _repeated(
        runs.where("status = 'running'").withColumn("scope", scope), ["scope"], "one_running_run"
    )
    half = runs.where((F.col("status") == "running") != F.col("finished_at").isNull()).select(
        F.col("id").cast("string").alias("subject"), F.lit("terminal_iff_finished").alias("rule")
    )
    return running.unionByName(half)


def audit_sources(sources: DataFrame) -> DataFrame:
    url = F.coalesce("source_jobs_url", F.lit(""))
    unique = _repeated(sources.withColumn("url", url), ["company_id", "source", "url"], "source_config_unique")
    single = lambda cond, rule: sources.where(cond).select(
        F.col("id").cast("string").alias("subject"), F.lit(rule).alias("rule")
    )
    return unique.unionByName(
        single(F.col("is_active") & (F.col("approval_status") != "approved"), "active_requires_approval")
    ).unionByName(
        single((F.col("approval_status") == "approved") & (strip_ws(F.col("source")) == ""), "approved_requires_source")
    )


def audit_candidates(candidates: DataFrame) -> DataFrame:
    unique = _repeated(candidates, ["run_id", "kind", "platform", "canonical_url"], "candidate_unique")
    ranged = candidates.where(
        ~F.col("confidence").between(0, 100) | ~F.col("job_source_confidence").between(0, 100)
    ).select(F.col("id").cast("string").alias("subject"), F.lit("confidence_range").alias("rule"))
    return unique.unionByName(ranged)


def ownership_audit(children: DataFrame, sources: DataFrame) -> DataFrame:
    """Child rows without their source, or whose company or source key disagrees with it."""
    owner = sources.select(
        F.col("id").alias("company_source_id"), F.col("company_id").alias("_company"),
        F.lower(strip_ws(F.col("source"))).alias("_source"),
    )
    joined = children.where(F.col("company_source_id").isNotNull()).join(owner, "company_source_id", "left")
    source_differs = (
        F.lower(strip_ws(F.col("source"))) != F.col("_source") if "source" in children.columns else F.lit(False)
    )
    problem = (
        F.when(F.col("_company").isNull(), F.lit("orphan"))
        .when(F.col("_company") != F.col("company_id"), F.lit("company_mismatch"))
        .when(source_differs, F.lit("source_mismatch"))
    )
    return joined.withColumn("problem", problem).where(F.col("problem").isNotNull()).select("id", "problem")


def provenance_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows whose owner or source changed between two versions."""
    old = before.select(
        "id", F.col("source").alias("_s"), F.col("company_id").alias("_c"), F.col("company_source_id").alias("_o")
    )
    return after.join(old, "id").where(
        (F.col("source") != F.col("_s")) | (F.col("company_id") != F.col("_c"))
        | ~F.col("company_source_id").eqNullSafe(F.col("_o"))
    ).select("id")
