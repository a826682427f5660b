"""State changes outside the merge: review marks, deletes, backfills. Tables in, tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapledger.functions.text import blank_to_null, strip_ws
from snapledger.operators.registry import USER_DELETABLE, source_key


def mark_reviewed(postings: DataFrame, acks: DataFrame) -> DataFrame:
    """Acknowledge the exact content version that was viewed (id, content_hash)."""
    seen = acks.select("id", "content_hash").distinct().withColumn("_ack", F.lit(True))
    return postings.join(seen, ["id", "content_hash"], "left").withColumn(
        "last_reviewed_content_hash",
        F.when(F.col("_ack"), F.col("content_hash")).otherwise(F.col("last_reviewed_content_hash")),
    ).drop("_ack")


def backfill_reviewed_hash(postings: DataFrame) -> DataFrame:
    return postings.withColumn("last_reviewed_content_hash", F.col("content_hash"))


def deletable_sources(sources: DataFrame, runs: DataFrame, requested: DataFrame) -> DataFrame:
    """Requested source ids with a verdict: ok, running, not_allowed."""
    busy = runs.where("status = 'running'").select(F.col("company_source_id").alias("id")).distinct().withColumn(
        "_busy", F.lit(True)
    )
    return sources.join(requested.select("id").distinct(), "id", "left_semi").join(busy, "id", "left").select(
        "id", "company_id",
        F.when(~source_key(F.col("source")).isin(*USER_DELETABLE), F.lit("not_allowed"))
        .when(F.coalesce("_busy", F.lit(False)), F.lit("running"))
        .otherwise(F.lit("ok")).alias("verdict"),
    )


def delete_sources(
    sources: DataFrame, postings: DataFrame, runs: DataFrame, requested: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(sources, postings, runs, counts): postings go, runs stay with their source cleared."""
    verdicts = deletable_sources(sources, runs, requested)
    gone = verdicts.where("verdict = 'ok'").select(F.col("id").alias("company_source_id"))
    marked = gone.withColumn("_gone", F.lit(True))
    kept_runs = runs.join(marked, "company_source_id", "left").withColumn(
        "company_source_id", F.when(F.col("_gone"), None).otherwise(F.col("company_source_id"))
    ).drop("_gone")
    dropped = postings.join(gone, "company_source_id", "left_semi").groupBy("company_source_id").agg(
        F.count("*").alias("jobs_deleted")
    )
    preserved = runs.join(gone, "company_source_id", "left_semi").groupBy("company_source_id").agg(
        F.count("*").alias("runs_preserved")
    )
    counts = verdicts.withColumnRenamed("id", "company_source_id").join(dropped, "company_source_id", "left").join(
        preserved, "company_source_id", "left"
    ).na.fill(0, ["jobs_deleted", "runs_preserved"])
    return (
        sources.join(gone.withColumnRenamed("company_source_id", "id"), "id", "left_anti"),
        postings.join(gone, "company_source_id", "left_anti"),
        kept_runs,
        counts,
    )


def delete_companies(
    companies: DataFrame, sources: DataFrame, postings: DataFrame, runs: DataFrame, requested: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(companies, sources, postings, runs, counts); companies with a RUNNING run are refused."""
    by = "company_id"
    busy = runs.where("status = 'running'").select(by).distinct()
    asked = companies.join(requested.select("id").distinct(), "id", "left_semi").select(F.col("id").alias(by))
    gone = asked.join(busy, by, "left_anti")
    count = lambda df, name: df.join(gone, by, "left_semi").groupBy(by).agg(F.count("*").alias(name))
    counts = (
        gone.join(count(sources, "sources_deleted"), by, "left").join(count(postings, "jobs_deleted"), by, "left")
        .join(count(runs, "runs_deleted"), by, "left").na.fill(0)
    )
    keep = lambda df: df.join(gone, by, "left_anti")
    return (
        companies.join(gone.withColumnRenamed(by, "id"), "id", "left_anti"),
        keep(sources), keep(postings), keep(runs), counts,
    )


def backfill_sources(legacy: DataFrame, postings: DataFrame, runs: DataFrame) -> tuple[DataFrame, ...]:
    """(sources, postings, runs, problems) from companies with legacy ``source``/``source_jobs_url``.

    Problems: rows without a company, and postings whose source differs from their company's.
    """
    source = F.lower(strip_ws(F.col("source")))
    made = legacy.select(
        F.xxhash64("id", source).alias("id"), F.col("id").alias("company_id"), source.alias("source"),
        blank_to_null(strip_ws(F.col("source_jobs_url"))).alias("source_jobs_url"),
        F.lit("approved").alias("approval_status"), F.col("is_active"),
    )
    owner = made.select("company_id", F.col("id").alias("_owner"), F.col("source").alias("_source"))
    orphan = lambda df, name: df.join(owner, "company_id", "left_anti").select(
        "id", F.lit(name).alias("problem")
    )
    mismatch = postings.join(owner, "company_id").where(F.lower(strip_ws(F.col("source"))) != F.col("_source")).select(
        "id", F.lit("posting_source_mismatch").alias("problem")
    )
    problems = orphan(postings, "orphan_posting").unionByName(orphan(runs, "orphan_run")).unionByName(mismatch)
    stamp = lambda df: df.drop("company_source_id").join(
        owner.select("company_id", F.col("_owner").alias("company_source_id")), "company_id", "left"
    )
    return made, stamp(postings), stamp(runs), problems


def reverse_backfill(sources: DataFrame, postings: DataFrame, runs: DataFrame) -> tuple[DataFrame, ...]:
    """Undo: owner stamps cleared, generated sources removed."""
    clear = lambda df: df.withColumn("company_source_id", F.lit(None).cast("bigint"))
    return sources.limit(0), clear(postings), clear(runs)
