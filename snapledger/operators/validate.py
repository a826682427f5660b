"""Record validation and normalization: one projection, rejects by predicate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapledger.functions import text as tx
from snapledger.functions.hashing import content_hash, dedupe_key
from snapledger.functions.urls import add_source_url

# The closed set of record fields.
RECORD_FIELDS = (
    "source", "source_job_id", "title", "country", "city", "location", "workplace_type",
    "employment_type", "compensation_text", "seniority_level", "job_function", "industry",
    "published_at", "description", "source_job_url",
)
_PLAIN_TEXT = (
    "title", "country", "city", "location", "employment_type", "compensation_text",
    "seniority_level", "job_function", "industry",
)


def parse_records(records: DataFrame, payload: str = "payload") -> DataFrame:
    """JSON object text to raw string fields plus ``type_error``; other columns pass through."""
    variant = records.withColumn("_v", F.try_parse_json(payload))
    field = lambda name: F.try_variant_get("_v", f"$.{name}", "variant")
    wrong = [
        F.when(
            field(name).isNotNull()
            & ~F.coalesce(F.schema_of_variant(field(name)), F.lit("VOID")).isin("STRING", "VOID"),
            F.lit(name),
        )
        for name in RECORD_FIELDS
    ]
    extra = F.array_except(F.json_object_keys(payload), F.array(*map(F.lit, RECORD_FIELDS)))
    error = (
        F.when(F.col("_v").isNull() | F.json_object_keys(payload).isNull(), F.lit("not_an_object"))
        .when(F.size(extra) > 0, F.lit("unsupported_fields"))
        .when(F.coalesce(*wrong).isNotNull(), F.concat(F.lit("bad_type:"), F.coalesce(*wrong)))
    )
    values = {name: F.try_variant_get("_v", f"$.{name}", "string") for name in RECORD_FIELDS}
    return variant.withColumns({"type_error": error, **values}).drop("_v", payload)


def normalize(records: DataFrame) -> DataFrame:
    """Typed raw fields to normalized fields plus ``reject_reason`` (null when valid)."""
    checked = records if "type_error" in records.columns else records.withColumn(
        "type_error", F.lit(None).cast("string")
    )
    given_ts = F.col("published_at").cast("string")
    parsed_ts = tx.parse_iso_ts(given_ts)
    staged = add_source_url(
        checked.withColumns(
            {
                "_source_given": F.col("source").isNotNull(),
                "source": F.lower(tx.strip_ws(F.col("source"))),
                "source_job_id": tx.blank_to_null(tx.strip_ws(F.col("source_job_id"))),
                "_bad_ts": given_ts.isNotNull() & parsed_ts.isNull(),
                "published_at": parsed_ts,
                "workplace_type": F.lower(tx.norm_text(F.col("workplace_type"))),
                "description": tx.norm_description(F.col("description")),
                **{name: tx.norm_text(F.col(name)) for name in _PLAIN_TEXT},
            }
        ),
        "source_job_url",
        "source_job_url",
    )
    reason = (
        F.when(F.col("type_error").isNotNull(), F.col("type_error"))
        .when(~F.col("_source_given"), F.lit("source_required"))
        .when(F.col("_bad_ts"), F.lit("bad_published_at"))
        .when(F.col("source") == "", F.lit("source_empty"))
        .when(F.col("source_job_url_bad"), F.lit("bad_url"))
        .when(
            F.col("source_job_id").isNull() & F.col("source_job_url").isNull(),
            F.lit("identity_required"),
        )
        .when(~workplace_check(F.col("workplace_type")), F.lit("bad_workplace_type"))
    )
    return tx.bind(staged, "reject_reason", reason).drop(
        "_source_given", "_bad_ts", "type_error", "source_job_url_bad"
    )


def workplace_check(value: Column) -> Column:
    return value.isNull() | value.isin(*tx.WORKPLACE_TYPES)


def with_keys(normalized: DataFrame) -> DataFrame:
    """Add ``content_hash`` and ``dedupe_key`` to valid rows; rejected rows keep nulls."""
    valid = F.col("reject_reason").isNull() if "reject_reason" in normalized.columns else F.lit(True)
    return normalized.withColumns(
        {
            "content_hash": F.when(valid, content_hash()),
            "dedupe_key": F.when(
                valid, dedupe_key(F.col("source"), F.col("source_job_id"), F.col("source_job_url"))
            ),
        }
    )


def owner_check(keyed: DataFrame, sources: DataFrame) -> DataFrame:
    """Records whose owner is unknown or whose source differs from the owner's get a reason."""
    owners = sources.select(
        F.col("id").alias("company_source_id"),
        F.col("company_id"),
        F.lower(tx.strip_ws(F.col("source"))).alias("_owner_source"),
    )
    joined = keyed.join(owners, "company_source_id", "left")
    reason = F.when(F.col("_owner_source").isNull(), F.lit("unknown_owner")).when(
        F.col("source") != F.col("_owner_source"), F.lit("source_mismatch")
    )
    return joined.withColumn("owner_reason", reason).drop("_owner_source")


def overlay_details(records: DataFrame, postings: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Stored detail fields win over fresh ones, matched on the raw record URL.

    Only rows stored with a description and at least one more detail field count as enriched.
    ``sources`` limits the overlay to sources that can skip details (the generic one).
    """
    details = ("description", "location", "published_at", "employment_type", "seniority_level", "compensation_text")
    filled = lambda name: (F.col(name).isNotNull()) & (F.col(name).cast("string") != "")
    some = filled(details[1])
    for name in details[2:]:
        some = some | filled(name)
    stored = postings.where(filled("source_job_url") & filled("description") & some)
    if sources is not None:
        generic = sources.where(F.lower("source") == "generic").select(F.col("id").alias("company_source_id"))
        stored = stored.join(generic, "company_source_id", "left_semi")
    # One row per URL; several stored rows with one URL: the highest id is the one that stays.
    stored = stored.groupBy("company_source_id", "source_job_url").agg(
        F.max_by(F.struct(*[F.col(n).alias(n) for n in details]), "id").alias("_stored")
    )
    joined = records.join(stored, ["company_source_id", "source_job_url"], "left")
    merged = {
        name: F.coalesce(
            tx.blank_to_null(tx.iso_format(F.col("_stored.published_at")))
            if name == "published_at"
            else tx.blank_to_null(F.col(f"_stored.{name}")),
            F.col(name).cast("string"),
        )
        for name in details
    }
    return joined.withColumns({**merged, "overlaid": F.col("_stored").isNotNull()}).drop("_stored")
