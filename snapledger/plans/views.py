"""Serving views: filtered lists, review state, dashboard, per-company counts, fetch planning."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapledger.functions.text import casefold, strip_ws


@dataclass(frozen=True)
class PostingFilter:
    """Optional, combined with AND. Dates are local dates in ``time_zone``."""

    company_id: int | None = None
    company_type: str | None = None
    country: str | None = None
    location: str | None = None
    title: str | None = None
    status: str | None = None
    workplace_type: str | None = None
    review_state: str | None = None
    published_from: date | None = None
    published_to: date | None = None
    first_seen_from: date | None = None
    first_seen_to: date | None = None
    time_zone: str = "Europe/Vienna"


def review_state() -> Column:
    reviewed = F.col("last_reviewed_content_hash")
    return (
        F.when(reviewed.isNull(), F.lit("new"))
        .when(reviewed == F.col("content_hash"), F.lit("reviewed"))
        .otherwise(F.lit("updated"))
    )


def in_review_state(wanted: str | None) -> Column:
    reviewed = F.col("last_reviewed_content_hash")
    changed = reviewed.isNotNull() & (reviewed != F.col("content_hash"))
    return {
        "new": reviewed.isNull(),
        "updated": changed,
        "unreviewed": reviewed.isNull() | changed,
    }.get(wanted or "", F.lit(True))


def filter_postings(postings: DataFrame, companies: DataFrame, spec: PostingFilter) -> DataFrame:
    """Postings that satisfy every given filter, with the company name and the review state.

    Plain equality and date bounds are stated on stored columns, so they reach the scan.
    """
    rows = postings
    if spec.company_id is not None:
        rows = rows.where(F.col("company_id") == spec.company_id)
    if spec.status:
        rows = rows.where(F.col("status") == spec.status)
    if spec.workplace_type:
        rows = rows.where(F.col("workplace_type") == spec.workplace_type)
    if spec.country:
        rows = rows.where(F.lower("country") == spec.country.strip().lower())
    if spec.location:
        rows = rows.where(F.lower("location").contains(spec.location.strip().lower()))
    if spec.title:
        rows = rows.where(F.lower("title").contains(spec.title.strip().lower()))
    if spec.review_state:
        rows = rows.where(in_review_state(spec.review_state))
    for column, low, high in (
        ("published_at", spec.published_from, spec.published_to),
        ("first_seen_at", spec.first_seen_from, spec.first_seen_to),
    ):
        # A local date is a half-open UTC interval: the stored column itself is compared.
        day = lambda d, shift: F.to_utc_timestamp(
            F.date_add(F.lit(d), shift).cast("timestamp"), spec.time_zone
        )
        if low is not None:
            rows = rows.where(F.col(column) >= day(low, 0))
        if high is not None:
            rows = rows.where(F.col(column) < day(high, 1))
    owners = companies.select(
        F.col("id").alias("company_id"), F.col("name").alias("company_name"), F.col("company_type").alias("_type")
    )
    joined = rows.join(owners, "company_id")
    if spec.company_type:
        joined = joined.where(F.col("_type") == spec.company_type)
    return joined.drop("_type").withColumn("review_state", review_state())


def list_postings(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc_nulls_last("published_at"), F.desc("first_seen_at"), F.desc("id"))


def list_company_postings(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("last_seen_at"), F.desc("id"))


def list_companies(companies: DataFrame) -> DataFrame:
    return companies.orderBy("name", "id")


def postings_with_company(postings: DataFrame, companies: DataFrame) -> DataFrame:
    """The join strategy is left to the optimizer, which broadcasts only below its size limit."""
    return postings.join(
        companies.select(F.col("id").alias("company_id"), F.col("name").alias("company_name")), "company_id"
    )


def distinct_countries(postings: DataFrame) -> DataFrame:
    return postings.select("country").where(
        F.col("country").isNotNull() & (strip_ws(F.col("country")) != "")
    ).distinct().orderBy(casefold(F.col("country")))


def has_running_run(sources: DataFrame, runs: DataFrame) -> DataFrame:
    busy = (
        runs.where(F.col("status") == "running").select(F.col("company_source_id").alias("id")).distinct()
        .withColumn("_busy", F.lit(True))
    )
    return sources.join(busy, "id", "left").withColumn("has_running_run", F.coalesce("_busy", F.lit(False))).drop("_busy")


def company_counts(companies: DataFrame, sources: DataFrame, postings: DataFrame, runs: DataFrame) -> DataFrame:
    """Counts per company; each table is aggregated first and the small results are joined."""
    by = "company_id"
    jobs = postings.groupBy(by).agg(
        F.count("*").alias("jobs"), F.count_if(F.col("status") == "active").alias("active_jobs")
    )
    owned = sources.groupBy(by).agg(
        F.count("*").alias("sources"),
        F.count_if(F.col("is_active") & (F.col("approval_status") == "approved")).alias("active_sources"),
    )
    ran = runs.groupBy(by).agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "running").alias("running_runs"))
    names = ["jobs", "active_jobs", "sources", "active_sources", "runs", "running_runs"]
    return (
        companies.select(F.col("id").alias(by)).join(jobs, by, "left").join(owned, by, "left").join(ran, by, "left")
        .na.fill(0, names)
    )


def dashboard(companies: DataFrame, postings: DataFrame, runs: DataFrame) -> DataFrame:
    """One row of dashboard figures; one aggregate per table, combined through their one-row results."""
    jobs = postings.agg(
        F.count_if(in_review_state("new")).alias("new_jobs"),
        F.count_if(in_review_state("updated")).alias("updated_jobs"),
        F.count_if(in_review_state("unreviewed")).alias("unreviewed_jobs"),
        F.count_if(F.col("status") == "active").alias("active_jobs"),
    )
    owners = companies.agg(F.count_if("is_active").alias("monitored_companies"))
    ran = runs.agg(
        F.count_if(F.col("status") == "running").alias("running_runs"),
        F.count_if(F.col("status") == "failed").alias("failed_runs"),
        F.max(F.when(F.col("status") == "success", F.col("finished_at"))).alias("latest_successful_run"),
    )
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(jobs).join(one(owners), "_one").join(one(ran), "_one").drop("_one")


def detail_fetch_plan(candidates: DataFrame, postings: DataFrame, limit: int = 50) -> DataFrame:
    """First ``limit`` not yet enriched detail URLs of a source, on the host of its listing.

    Columns: company_source_id, url, host, listing_host, position. The rank filter is pushed below
    the shuffle by the optimizer, so a huge source is cut to ``limit`` rows per task first.
    """
    done = postings.where(F.col("enriched")).select("company_source_id", F.col("source_job_url").alias("url"))
    fresh = candidates.where(F.col("host") == F.col("listing_host")).join(done, ["company_source_id", "url"], "left_anti")
    order = Window.partitionBy("company_source_id").orderBy("position", "url")
    return fresh.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def top_per_key(rows: DataFrame, key: list[str], order: list[Column], limit: int) -> DataFrame:
    """Ranked top rows per key (frontier, seeds)."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return ranked.where(F.col("rank") <= limit)


