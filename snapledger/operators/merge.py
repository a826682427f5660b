"""Identity resolution and snapshot merge for all sources at once.

The rules are sequential (a record sees what earlier records of its batch did), but they have a
closed form. Within one source:

* an id has a row after its first record, so "id exists" is "in state, or an earlier record";
* a URL-only row exists for a URL iff the last *event* on that URL was a URL-only record; the first
  record of a new id is the event that removes it (the row is upgraded to that id).

So identity needs two running-last scans over the URLs that have URL-only rows at all, and
outcomes need the previous hash on the same row. Everything else is joins and aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snapledger.functions.hashing import identity_key
from snapledger.operators.scan import BLOCK_ROWS, carry_last
from snapledger.staging import stage

# Columns a content change overwrites.
CONTENT_COLUMNS = (
    "title", "country", "city", "location", "workplace_type", "employment_type",
    "compensation_text", "seniority_level", "job_function", "industry", "published_at",
    "description", "source_job_url",
)
SOURCE_KEY = "company_source_id"
POSTING_COLUMNS = (
    "id", "company_id", "company_source_id", "source", "source_job_id", *CONTENT_COLUMNS,
    "content_hash", "last_reviewed_content_hash", "status", "first_seen_at", "last_seen_at",
    "created_at", "updated_at", "dedupe_key", "consecutive_successful_misses",
)


def match_by_id(incoming: DataFrame, postings: DataFrame) -> DataFrame:
    """Incoming records with the state row of the same source id (``matched_id``)."""
    state = postings.where(F.col("source_job_id").isNotNull()).select(
        SOURCE_KEY, "source_job_id", F.col("id").alias("matched_id")
    )
    return incoming.join(state, [SOURCE_KEY, "source_job_id"], "left")


def match_by_url(incoming: DataFrame, postings: DataFrame) -> DataFrame:
    """Incoming records with the id-less state row of the same URL; two such rows conflict."""
    state = (
        postings.where(F.col("source_job_id").isNull() & F.col("source_job_url").isNotNull())
        .groupBy(SOURCE_KEY, "source_job_url")
        .agg(F.min("id").alias("matched_url_id"), F.count("*").alias("url_matches"))
    )
    return incoming.join(state, [SOURCE_KEY, "source_job_url"], "left").withColumn(
        "url_matches", F.coalesce("url_matches", F.lit(0))
    )


def match_by_key(incoming: DataFrame, postings: DataFrame) -> DataFrame:
    """URL-only records with the state row of the same identity key."""
    state = postings.select(SOURCE_KEY, "dedupe_key", F.col("id").alias("matched_key_id"))
    return incoming.where(F.col("source_job_id").isNull()).join(
        state, [SOURCE_KEY, "dedupe_key"], "left"
    )


def _loose(postings: DataFrame) -> DataFrame:
    return postings.where(F.col("source_job_id").isNull() & F.col("source_job_url").isNotNull())


def _by_own_key(incoming: DataFrame) -> DataFrame:
    return incoming.withColumns(
        {"row_key": F.col("dedupe_key"), "is_upgrade": F.lit(False), "conflict": F.lit(False)}
    )


def resolve_identity(incoming: DataFrame, postings: DataFrame, block: int = BLOCK_ROWS) -> DataFrame:
    """Add ``row_key``, ``is_upgrade`` and ``conflict`` to every record.

    ``incoming`` has company_source_id, record_index (unique per source), source, source_job_id,
    source_job_url and dedupe_key; it is read several times, so pass a table or a staged frame.
    Sources without any URL-only row, in state or in the batch, need no resolution at all.
    """
    mixed = stage(
        incoming.where(F.col("source_job_id").isNull()).select(SOURCE_KEY)
        .unionByName(_loose(postings).select(SOURCE_KEY)).distinct(),
        "mixed-sources",
    )
    if mixed.isEmpty():
        return _by_own_key(incoming)
    return _by_own_key(incoming.join(mixed, SOURCE_KEY, "left_anti")).unionByName(
        _resolve_mixed(
            incoming.join(mixed, SOURCE_KEY, "left_semi"),
            postings.join(mixed, SOURCE_KEY, "left_semi"),
            block,
        )
    )


def _resolve_mixed(incoming: DataFrame, postings: DataFrame, block: int) -> DataFrame:
    keys = [SOURCE_KEY, "source_job_url"]
    has_id = F.col("source_job_id").isNotNull()
    # URLs on which a URL-only row can exist, with the number of such rows in state.
    watched = (
        _loose(postings).select(*keys, F.lit(1).alias("_n"))
        .unionByName(incoming.where(~has_id).select(*keys, F.lit(0).alias("_n")))
        .groupBy(*keys)
        .agg(F.sum("_n").alias("_state_rows"))
    )
    tagged = stage(incoming.join(watched, keys, "left"), "tagged")
    # Two URL-only rows on one URL: every id record on it conflicts.
    blocked = has_id & F.coalesce(F.col("_state_rows") > 1, F.lit(False))
    known_ids = postings.where(has_id).select(SOURCE_KEY, "source_job_id")
    firsts = (
        tagged.where(has_id & ~blocked)
        .groupBy(SOURCE_KEY, "source_job_id")
        .agg(F.min("record_index").alias("record_index"))
        .join(known_ids, [SOURCE_KEY, "source_job_id"], "left_anti")
        .withColumn("_new_id", F.lit(True))
    )
    outside = tagged.where(F.col("_state_rows").isNull() | blocked)
    settled = _by_own_key(outside.withColumn("_refused", blocked)).select(
        *incoming.columns, "row_key", "is_upgrade", F.col("_refused").alias("conflict")
    )
    inside = stage(
        tagged.where(F.col("_state_rows").isNotNull() & ~blocked)
        .join(firsts, [SOURCE_KEY, "source_job_id", "record_index"], "left")
        .withColumn("_new_id", F.coalesce("_new_id", F.lit(False))),
        "watched",
    )
    slim = inside.select(*keys, "record_index", "dedupe_key", "source_job_id", "_new_id")
    event = F.when(~has_id, F.lit("set")).when(F.col("_new_id"), F.lit("clear"))
    before = carry_last(slim, keys, F.col("record_index"), event, "_before", block)
    upgraded_to = F.when(F.col("_new_id"), F.col("dedupe_key"))
    after = carry_last(slim, keys, -F.col("record_index"), upgraded_to, "_upgraded_to", block)
    scanned = before.select(*keys, "record_index", "_before").join(
        after.select(*keys, "record_index", "_upgraded_to"), [*keys, "record_index"]
    )
    present = F.coalesce(F.col("_before") == "set", F.col("_state_rows") > 0)
    resolved = inside.join(scanned, [*keys, "record_index"]).select(
        *incoming.columns,
        F.when(has_id, F.col("dedupe_key"))
        .otherwise(F.coalesce("_upgraded_to", F.col("dedupe_key")))
        .alias("row_key"),
        (has_id & F.col("_new_id") & present).alias("is_upgrade"),
        (has_id & ~F.col("_new_id") & present).alias("conflict"),
    )
    return stage(settled.unionByName(resolved), "resolved")


def state_row_keys(postings: DataFrame, resolved: DataFrame) -> DataFrame:
    """State rows with the key they carry after the batch (upgraded rows move to the id key)."""
    moved = (
        resolved.where(F.col("is_upgrade"))
        .groupBy(SOURCE_KEY, "source", "source_job_url")
        .agg(
            F.min_by("row_key", "record_index").alias("_new_key"),
            F.min_by("source_job_id", "record_index").alias("_new_job_id"),
        )
        .select(
            SOURCE_KEY,
            identity_key("url", F.col("source"), F.col("source_job_url")).alias("dedupe_key"),
            "_new_key",
            "_new_job_id",
        )
    )
    return postings.join(moved, [SOURCE_KEY, "dedupe_key"], "left").withColumn(
        "row_key", F.coalesce("_new_key", "dedupe_key")
    )


def fold_records(resolved: DataFrame, block: int = BLOCK_ROWS) -> DataFrame:
    """One row per (source, row_key): counts, first and last hash, content of the last change."""
    content = F.struct(*CONTENT_COLUMNS)
    keys = [SOURCE_KEY, "row_key"]
    inside = Window.partitionBy(*keys, "_blk").orderBy("record_index")
    stepped = (
        resolved.where(~F.col("conflict"))
        .withColumn("_blk", F.floor(F.col("record_index") / F.lit(block)))
        .withColumn("_prev", F.lag("content_hash").over(inside))
    )
    changed = F.col("_prev").isNotNull() & (F.col("content_hash") != F.col("_prev"))
    blocks = stepped.groupBy(*keys, "_blk").agg(
        F.count("*").alias("_n"),
        F.min_by(
            F.struct(
                F.col("content_hash").alias("hash"), "is_upgrade", content.alias("content"),
                "source", "company_id", "run_id", "record_index", "seen_at", "dedupe_key",
            ),
            "record_index",
        ).alias("_first"),
        F.max_by(F.struct("content_hash", "source_job_id", "seen_at"), "record_index").alias("_last"),
        F.count_if(F.col("_prev").isNotNull() & (F.col("is_upgrade") | changed)).alias("_inner_updates"),
        F.max_by(content, F.when(changed, F.col("record_index"))).alias("_inner_content"),
        F.bool_or("is_upgrade").alias("_upgraded"),
        F.max("source_job_id").alias("_job_id"),
    )
    across = Window.partitionBy(*keys).orderBy("_blk")
    linked = blocks.withColumn("_prev_last", F.lag("_last.content_hash").over(across))
    first_changed = F.col("_prev_last").isNotNull() & (F.col("_first.hash") != F.col("_prev_last"))
    block_content = F.coalesce("_inner_content", F.when(first_changed, F.col("_first.content")))
    return linked.groupBy(*keys).agg(
        F.sum("_n").alias("n_records"),
        F.min_by("_first", "_blk").alias("first"),
        F.max_by("_last", "_blk").alias("last"),
        F.sum(
            F.col("_inner_updates")
            + F.when(
                F.col("_prev_last").isNotNull() & (F.col("_first.is_upgrade") | first_changed), 1
            ).otherwise(0)
        ).alias("later_updates"),
        F.max_by(block_content, F.when(block_content.isNotNull(), F.col("_blk"))).alias("later_content"),
        F.max("_job_id").alias("job_id"),
    )


def merge_rows(folded: DataFrame, state: DataFrame) -> DataFrame:
    """Full outer join of folded records and state: every row with its outcome counts.

    Output: posting columns after the merge, ``old`` (the state row before it), ``seen`` and the
    counts ``created``, ``updated``, ``unchanged`` of the records that hit the row.
    """
    old = F.struct(*[F.col(f"s.{name}").alias(name) for name in POSTING_COLUMNS])
    joined = folded.alias("r").join(
        state.alias("s"),
        (F.col(f"r.{SOURCE_KEY}") == F.col(f"s.{SOURCE_KEY}")) & (F.col("r.row_key") == F.col("s.row_key")),
        "full_outer",
    )
    seen = F.col("r.n_records").isNotNull()
    known = F.col("s.id").isNotNull()
    first_updates = known & (
        F.col("r.first.is_upgrade")
        | (F.col("r.first.hash") != F.col("s.content_hash"))
        | (F.col("s.status") == "not_found")
    )
    content = F.coalesce(
        F.col("r.later_content"),
        F.when(~known | (F.col("r.first.hash") != F.col("s.content_hash")), F.col("r.first.content")),
        F.struct(*[F.col(f"s.{name}").alias(name) for name in CONTENT_COLUMNS]),
    )
    created = F.when(seen & ~known, 1).otherwise(0)
    updated = F.when(seen, F.col("r.later_updates") + first_updates.cast("int")).otherwise(0)
    job_id = F.coalesce(F.col("s._new_job_id"), F.col("s.source_job_id"), F.col("r.job_id"))
    source_key = F.coalesce(F.col(f"s.{SOURCE_KEY}"), F.col(f"r.{SOURCE_KEY}"))
    row = joined.select(
        # A new row is named by the record that created it: its URL key may come back after an
        # upgrade, so the key alone would not be unique over time.
        F.coalesce(
            F.col("s.id"),
            F.xxhash64(
                source_key, F.col("r.first.dedupe_key"), F.col("r.first.run_id"),
                F.col("r.first.record_index"),
            ),
        ).alias("id"),
        F.coalesce(F.col("s.company_id"), F.col("r.first.company_id")).alias("company_id"),
        source_key.alias(SOURCE_KEY),
        F.coalesce(F.col("s.source"), F.col("r.first.source")).alias("source"),
        job_id.alias("source_job_id"),
        content.alias("_content"),
        F.when(seen, F.col("r.last.content_hash")).otherwise(F.col("s.content_hash")).alias("content_hash"),
        F.col("s.last_reviewed_content_hash").alias("last_reviewed_content_hash"),
        F.when(~known, F.lit("active"))
        .when(seen & (F.col("s.status") == "not_found"), F.lit("active"))
        .otherwise(F.col("s.status"))
        .alias("status"),
        F.coalesce(F.col("s.first_seen_at"), F.col("r.first.seen_at")).alias("first_seen_at"),
        F.coalesce(F.col("r.last.seen_at"), F.col("s.last_seen_at")).alias("last_seen_at"),
        F.coalesce(F.col("s.created_at"), F.col("r.first.seen_at")).alias("created_at"),
        # A merge never touches updated_at of a stored row; reconciliation does.
        F.coalesce(F.col("s.updated_at"), F.col("r.last.seen_at")).alias("updated_at"),
        F.coalesce(F.col("s.row_key"), F.col("r.row_key")).alias("dedupe_key"),
        F.when(seen, F.lit(0)).otherwise(F.col("s.consecutive_successful_misses")).alias(
            "consecutive_successful_misses"
        ),
        F.when(known, old).alias("old"),
        seen.alias("seen"),
        created.cast("bigint").alias("created"),
        updated.cast("bigint").alias("updated"),
        F.when(seen, F.col("r.n_records") - created - updated).otherwise(0).cast("bigint").alias("unchanged"),
    )
    return row.select(
        *[F.col(f"_content.{c}").alias(c) if c in CONTENT_COLUMNS else F.col(c) for c in POSTING_COLUMNS],
        "old", "seen", "created", "updated", "unchanged",
    )


def merge_postings(incoming: DataFrame, postings: DataFrame, block: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(merged rows, resolved records). ``incoming`` also has run_id, company_id and seen_at."""
    resolved = resolve_identity(incoming, postings, block)
    return merge_rows(fold_records(resolved, block), state_row_keys(postings, resolved)), resolved

