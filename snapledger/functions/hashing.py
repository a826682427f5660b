"""Content hash and source-scoped identity key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from snapledger.functions.text import iso_format

# Hashed fields. Compensation is stored but deliberately not hashed.
CONTENT_FIELDS = (
    "title", "country", "city", "location", "workplace_type", "employment_type",
    "seniority_level", "job_function", "industry", "published_at", "description",
    "source_job_url",
)
# Control characters whose JSON escape Spark writes with upper-case hex digits.
_UPPER_ESCAPES = ("0B", "0E", "0F", "1A", "1B", "1C", "1D", "1E", "1F")


def canonical_json(columns: dict[str, Column]) -> Column:
    """Key-sorted compact JSON with explicit nulls and lower-case control escapes."""
    payload = F.to_json(
        F.struct(*[columns[name].alias(name) for name in sorted(columns)]),
        {"ignoreNullFields": "false"},
    )
    lowered = payload
    for code in _UPPER_ESCAPES:
        lowered = F.regexp_replace(
            lowered, rf"(?<!\\)((?:\\\\)*)\\u00{code}", rf"$1\\u00{code.lower()}"
        )
    return F.when(payload.rlike(r"\\u00(0[BEF]|1[A-F])"), lowered).otherwise(payload)


def content_hash() -> Column:
    """SHA-256 over the normalized content columns of the row."""
    columns = {
        name: iso_format(F.col(name)) if name == "published_at" else F.col(name)
        for name in CONTENT_FIELDS
    }
    return F.sha2(canonical_json(columns), 256)


def identity_key(kind: str, source: Column, value: Column) -> Column:
    nul = F.char(F.lit(0))
    return F.sha2(F.concat(F.lit(kind), nul, source, nul, value), 256)


def dedupe_key(source: Column, job_id: Column, job_url: Column) -> Column:
    """By source id when there is one, otherwise by canonical URL."""
    return F.when(job_id.isNotNull(), identity_key("id", source, job_id)).otherwise(
        identity_key("url", source, job_url)
    )


def packed_hex(value: Column) -> Column:
    """A SHA-256 in lower-case hex as its 32 bytes behind a 1, any other string as its UTF-8 behind a 0.

    Half the bytes of the text, which is what moving and staging rows of hashes costs. ``unpacked_hex`` gives the text back.
    """
    is_hash = (F.octet_length(value) == 64) & (F.translate(value, "0123456789abcdef", "") == "")
    return F.when(is_hash, packed_sha(value)).otherwise(F.concat(F.unhex(F.lit("00")), F.encode(value, "UTF-8")))


def packed_sha(value: Column) -> Column:
    """``packed_hex`` of a value that ``sha2`` has just made, so nothing is left to check."""
    return F.concat(F.unhex(F.lit("01")), F.unhex(value))


def unpacked_hex(value: Column) -> Column:
    hashed = F.lower(F.hex(F.substring(value, 2, 32)))
    return F.when(F.hex(F.substring(value, 1, 1)) == "01", hashed).otherwise(F.decode(F.substr(value, F.lit(2)), "UTF-8"))
