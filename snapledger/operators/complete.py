"""Completeness gates: is the fetched page sequence of a run provably a whole snapshot?

Inputs are page items (run_id, page_no, position, item_id ...) and pages (run_id, page_no, urls,
body). Everything is an aggregate on (run, id), (run, page) or (run, signature), so a run that
holds a third of all items still spreads over its ids and pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapledger.operators.scan import carry_last
from snapledger.staging import stage

# Public career-site row limit, and response codes that mean "blocked".
ROW_CAP = 750
BLOCKING_STATUSES = (401, 403, 429)


def snapshot_complete(items: DataFrame) -> DataFrame:
    """Advertised total against distinct ids. Columns: run_id, item_id, advertised_total."""
    return (
        items.groupBy("run_id")
        .agg(
            F.min("advertised_total").alias("total"),
            F.max("advertised_total").alias("_max"),
            F.countDistinct("item_id").alias("distinct_ids"),
        )
        .select(
            "run_id", "total", "distinct_ids",
            F.when(F.col("total") != F.col("_max"), F.lit("total_changed"))
            .when(F.col("distinct_ids") > F.col("total"), F.lit("exceeds_total"))
            .when(F.col("distinct_ids") < F.col("total"), F.lit("incomplete"))
            .otherwise(F.lit("complete"))
            .alias("verdict"),
        )
    )


def first_seen(items: DataFrame) -> DataFrame:
    """First page of every id of a run."""
    return items.groupBy("run_id", "item_id").agg(F.min("page_no").alias("first_page"))


def page_progress(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Per page: number of new ids and distinct ids seen before it."""
    return _with_new_ids(pages.select("run_id", "page_no").distinct(), items)


def _with_new_ids(pages: DataFrame, items: DataFrame) -> DataFrame:
    fresh = first_seen(items).groupBy("run_id", F.col("first_page").alias("page_no")).agg(
        F.count("*").alias("new_ids")
    )
    return pages.join(fresh, ["run_id", "page_no"], "left").na.fill(0, ["new_ids"])


def repeats(df: DataFrame, keys: list[str], order: str = "page_no", out: str = "repeated") -> DataFrame:
    """Flag rows whose key values already occurred at a smaller ``order``."""
    first = df.groupBy(*keys).agg(F.min(order).alias("_first"))
    return df.join(first, keys).withColumn(out, F.col(order) > F.col("_first")).drop("_first")


def page_signatures(items: DataFrame) -> DataFrame:
    """Order-sensitive id signature of each page (two independent 64-bit sums and the length)."""
    entry = F.xxhash64("position", "item_id")
    other = F.conv(F.substring(F.sha2(F.concat_ws(":", "position", "item_id"), 256), 1, 14), 16, 10).cast("decimal(38,0)")
    return items.groupBy("run_id", "page_no").agg(
        F.concat_ws(":", F.count("*"), F.bit_xor(entry), F.sum(other)).alias("signature")
    )


def page_repeat(items: DataFrame) -> DataFrame:
    """Pages that list the same ids in the same order as an earlier page of the run."""
    return repeats(page_signatures(items), ["run_id", "signature"])


def content_repeat(pages: DataFrame, body: str = "body") -> DataFrame:
    hashed = pages.withColumn("body_hash", F.sha2(F.col(body), 256)).drop(body)
    return repeats(hashed, ["run_id", "body_hash"])


def url_repeat(pages: DataFrame, url: str = "requested_url") -> DataFrame:
    return repeats(pages, ["run_id", url])


def no_progress(progress: DataFrame, from_page: int = 1) -> DataFrame:
    """Pages at or after ``from_page`` without a new id."""
    return progress.where((F.col("page_no") >= from_page) & (F.col("new_ids") == 0))


def overlap_streak(progress: DataFrame, limit: int) -> DataFrame:
    """Length of the zero-new run of pages ending at each page; over the limit it fails.

    ``page_no`` counts pages of a run without gaps.
    """
    last_new = F.when(F.col("new_ids") > 0, F.col("page_no"))
    carried = carry_last(progress, ["run_id"], F.col("page_no"), last_new, "_last_new")
    first = progress.groupBy("run_id").agg((F.min("page_no") - 1).alias("_before"))
    streak = F.when(F.col("new_ids") > 0, 0).otherwise(
        F.col("page_no") - F.coalesce("_last_new", "_before")
    )
    return carried.join(first, "run_id").select(
        *progress.columns, streak.cast("int").alias("streak"), (streak > limit).alias("exhausted")
    )


def terminal_page(page_sizes: DataFrame, page_size: int, max_pages: int) -> DataFrame:
    """How the sequence ended: empty page, short page, advertised total reached, or the cap."""
    last = page_sizes.groupBy("run_id").agg(
        F.max("page_no").alias("last_page"),
        F.max_by("page_len", "page_no").alias("last_len"),
        F.max("advertised_total").alias("total"),
    )
    return last.select(
        "run_id", "last_page", "last_len",
        F.when(F.col("last_len") == 0, F.lit("empty"))
        .when(F.col("last_len") < page_size, F.lit("short"))
        .when(F.col("last_page") >= F.ceil(F.col("total") / page_size), F.lit("total_reached"))
        .when(F.col("last_page") >= max_pages, F.lit("cap_reached"))
        .otherwise(F.lit("unfinished"))
        .alias("ending"),
    )


def row_cap(items: DataFrame, cap: int = ROW_CAP) -> DataFrame:
    """Runs whose row count makes completeness unknown."""
    return items.groupBy("run_id").agg(F.count("*").alias("rows")).select(
        "run_id", "rows",
        F.when(F.col("rows") == 0, F.lit("empty")).when(F.col("rows") >= cap, F.lit("cap_reached"))
        .otherwise(F.lit("ok")).alias("verdict"),
    )


def duplicate_policy(items: DataFrame, policy: str) -> DataFrame:
    """Verdict per run: ``keep_first`` never fails, ``fail`` on any duplicate id,
    ``same_title`` only on one id with different titles."""
    ids = items.groupBy("run_id", "item_id").agg(
        F.count("*").alias("_n"), F.min("title").alias("_a"), F.max("title").alias("_b")
    )
    bad = {
        "keep_first": F.lit(False),
        "fail": F.col("_n") > 1,
        "same_title": F.col("_a") != F.col("_b"),
    }[policy]
    return ids.groupBy("run_id").agg(
        F.sum(F.col("_n") - 1).alias("duplicates"), F.count_if(bad).alias("bad_ids")
    ).withColumn("ok", F.col("bad_ids") == 0)


def keep_first(items: DataFrame, order: list[str]) -> DataFrame:
    """One row per (run, id): the first in ``order``. A partial aggregate, not a window."""
    names = [c for c in items.columns if c not in ("run_id", "item_id")]
    return items.groupBy("run_id", "item_id").agg(
        F.min_by(F.struct(*names), F.struct(*order)).alias("_r")
    ).select("run_id", "item_id", "_r.*")


#: Runs of at most so many rows are settled inside one row each; longer ones in rounds over all their keys.
SHORT_RUN = 200


def unique_cards(cards: DataFrame) -> DataFrame:
    """Keep a card only if no kept earlier card has its id or its URL.

    Columns: run_id, seq, card_id, url. Rows of one run and seq are one card; rows without run or seq can't be told apart
    and are left out. Short runs are settled card by card inside the run, after one shuffle; only runs of
    more than ``SHORT_RUN`` rows go through rounds that spread over their keys.
    """
    cards = cards.where(F.col("run_id").isNotNull() & F.col("seq").isNotNull())
    sizes = cards.groupBy("run_id").agg(F.count("*").alias("_n"))
    long_runs = stage(sizes.where(F.col("_n") > SHORT_RUN).select("run_id"), "long-runs")
    if long_runs.isEmpty():
        return _settled_inside(cards)
    rest = cards.join(long_runs, "run_id", "left_semi")
    return _settled_inside(cards.join(long_runs, "run_id", "left_anti")).unionByName(_settled_in_rounds(rest))


def _card_keys(card_id: Column, url: Column) -> Column:
    """The keys of a card, null ones left out."""
    return F.array_compact(F.array(F.concat(F.lit("id:"), card_id), F.concat(F.lit("url:"), url)))


def _settled_inside(cards: DataFrame) -> DataFrame:
    """Cards of short runs, by one fold over the cards of a run in order."""
    rows = F.array_sort(F.collect_list(F.struct("seq", *[c for c in cards.columns if c not in ("run_id", "seq")])))
    runs = cards.groupBy("run_id").agg(rows.alias("_rows"))
    nothing = F.array().cast("array<string>")

    def keys_of(row: Column) -> Column:
        return _card_keys(row["card_id"], row["url"])

    def step(a: Column, row: Column) -> Column:
        # ``own`` are the keys of the rows of one card so far, ``taken`` those of the cards kept before it.
        same = a["seq"].eqNullSafe(row["seq"])
        taken = F.when(same | F.arrays_overlap(a["taken"], a["own"]), a["taken"]).otherwise(F.concat(a["taken"], a["own"]))
        own = F.when(same, F.concat(a["own"], keys_of(row))).otherwise(keys_of(row))
        bare = (F.size(keys_of(row)) == 0) | (same & a["bare"])
        wins = bare | ~F.arrays_overlap(taken, own)
        lost = F.when(same, F.slice(a["kept"], 1, F.size(a["kept"]) - a["last"].cast("int"))).otherwise(a["kept"])
        kept = F.when(wins, F.array_append(lost, row["seq"])).otherwise(lost)
        return F.struct(
            row["seq"].alias("seq"), taken.alias("taken"), own.alias("own"), bare.alias("bare"), wins.alias("last"), kept.alias("kept")
        )

    seq = cards.schema["seq"].dataType
    first = F.struct(
        F.lit(None).cast(seq).alias("seq"), nothing.alias("taken"), nothing.alias("own"), F.lit(False).alias("bare"),
        F.lit(False).alias("last"), F.array().cast(T.ArrayType(seq)).alias("kept"),
    )
    kept = runs.select("run_id", "_rows", F.aggregate("_rows", first, step, lambda a: a["kept"]).alias("_kept"))
    left = kept.select("run_id", F.explode(F.filter("_rows", lambda r: F.array_contains("_kept", r["seq"]))).alias("_r"))
    return left.select("run_id", "_r.*").select(*cards.columns)


def _settled_in_rounds(cards: DataFrame) -> DataFrame:
    """Cards of long runs. Rounds settle cards that are first on all their keys, then drop the others that share a key
    with them; the number of rounds is the longest chain of such decisions, and each round is one aggregate and one join.
    """
    keyed = cards.withColumn("_keys", _card_keys(F.col("card_id"), F.col("url")))
    kept = keyed.where(F.size("_keys") == 0).select("run_id", "seq")
    open_cards = stage(
        keyed.where(F.size("_keys") > 0).select("run_id", "seq", F.explode("_keys").alias("_key")), "cards"
    )
    while not open_cards.isEmpty():
        lead = open_cards.groupBy("run_id", "_key").agg(F.min("seq").alias("_lead"))
        winners = stage(
            open_cards.join(lead, ["run_id", "_key"])
            .groupBy("run_id", "seq").agg(F.bool_and(F.col("seq") == F.col("_lead")).alias("_wins"))
            .where("_wins").select("run_id", "seq"),
            "winners",
        )
        taken = open_cards.join(winners, ["run_id", "seq"], "left_semi").select("run_id", "_key").distinct()
        lost = open_cards.join(taken, ["run_id", "_key"], "left_semi").select("run_id", "seq").distinct()
        open_cards = stage(open_cards.join(lost, ["run_id", "seq"], "left_anti"), "cards")
        kept = kept.unionByName(winners)
    return cards.join(kept, ["run_id", "seq"], "left_semi")


def page_reasons(
    pages: DataFrame, items: DataFrame, *, max_pages: int, max_requests: int, live: bool = False,
    overlap_limit: int | None = None,
) -> DataFrame:
    """Stop reason of every page by fixed precedence (null: go on).

    ``pages``: run_id, page_no (1, 2, ...), requested_url, final_url, body, next_url; ``live`` also
    reads status, redirect_path, has_location and block_reason.
    """
    marked = _seen_before(pages)
    if overlap_limit is None:
        joined = _with_new_ids(marked, items)
    else:
        joined = marked.join(overlap_streak(page_progress(items, pages), overlap_limit), ["run_id", "page_no"])
    page = F.col("page_no")
    requested_again = F.col("_requested_at") < page
    final_again = (F.col("final_url") != F.col("requested_url")) & (F.col("_final_at") < page)
    no_new = F.col("new_ids") == 0
    if not live:
        reason = (
            F.when(page > max_pages, F.lit("max_pages"))
            .when(page > max_requests, F.lit("max_requests"))
            .when(requested_again | final_again, F.lit("repeated_url"))
            .when(F.col("repeated"), F.lit("repeated_content"))
            .when(no_new, F.lit("no_new_job_ids"))
            .when(F.col("next_url").isNull(), F.lit("no_next_page"))
        )
    else:
        status, path = F.col("status"), F.lower(F.col("redirect_path"))
        has_redirect = F.col("redirect_path").isNotNull()
        tail = (
            F.when(no_new, F.lit("no_new_job_ids")).when(F.col("next_url").isNull(), F.lit("no_next_page"))
            if overlap_limit is None
            else F.when((page == 1) & no_new, F.lit("no_new_job_ids")).when(
                (page > 1) & F.col("exhausted"), F.lit("overlap_limit")
            )
        )
        reason = (
            F.when(page > max_pages, F.lit("page_limit"))
            .when(page > max_requests, F.lit("request_limit"))
            .when(requested_again, F.lit("repeated_url"))
            .when(status.isin(*BLOCKING_STATUSES), F.concat(F.lit("http_"), status))
            .when(status >= 400, F.concat(F.lit("http_error_"), status))
            .when(path.contains("/login"), F.lit("redirect_login"))
            .when(path.contains("/authwall"), F.lit("redirect_authwall"))
            .when(path.contains("/checkpoint"), F.lit("redirect_checkpoint"))
            .when(
                status.between(300, 399),
                F.when(has_redirect, F.lit("redirect_other")).otherwise(F.lit("redirect_without_location")),
            )
            .when(final_again, F.lit("repeated_url"))
            .when(F.col("_blank"), F.lit("empty_batch"))
            .when(F.col("repeated"), F.lit("repeated_content"))
            .when(F.col("block_reason").isNotNull(), F.col("block_reason"))
            .otherwise(tail)
        )
    return joined.select("run_id", "page_no", reason.alias("reason"))


def _seen_before(pages: DataFrame) -> DataFrame:
    """Pages with ``repeated`` (an earlier one has the same body), ``_requested_at`` and ``_final_at`` (first page with that
    address, asked for or reached), without bodies and without pages that lack an address, a body or a number.

    Only windows within a run: pages that are dealt by run stay where they are, others spread over bodies and addresses.
    """
    over = lambda *names: Window.partitionBy("run_id", *names)
    first = lambda *names: F.min("page_no").over(over(*names))
    known = pages.where(F.col("run_id").isNotNull())
    hashed = known.withColumns({"_body": F.unhex(F.sha2("body", 256)), "_blank": F.trim("body") == ""}).drop("body")
    whole = F.col("_body").isNotNull()
    copies = over("page_no").orderBy("requested_url", "final_url", "_whole")
    told = hashed.withColumns({"repeated": F.col("page_no") > first("_body"), "_whole": whole}).drop("_body").withColumn("_copy", F.row_number().over(copies))
    # Both addresses of a page in one pass, then its two rows become one again.
    each = told.withColumn("_url", F.explode(F.array_distinct(F.array("requested_url", "final_url")))).withColumn("_seen_at", first("_url"))
    final_at = F.max(F.when(F.col("_url") == F.col("final_url"), F.col("_seen_at"))).over(over("page_no", "_copy"))
    asked = each.withColumn("_final_at", final_at).where(F.col("_url") == F.col("requested_url")).withColumnRenamed("_seen_at", "_requested_at")
    return asked.where("_whole AND page_no IS NOT NULL AND final_url IS NOT NULL").drop("_whole", "_copy", "_url")


def stop_reason(reasons: DataFrame) -> DataFrame:
    """First page with a reason, per run."""
    stopped = reasons.where(F.col("reason").isNotNull())
    return stopped.groupBy("run_id").agg(
        F.min("page_no").alias("stopped_at"), F.min_by("reason", "page_no").alias("stop_reason")
    )


def gate(verdicts: DataFrame, error: Column) -> DataFrame:
    """Verdict rows (run_id) to the ``fetch_error`` of a batch: first error by name, or null."""
    return verdicts.withColumn("_e", error).groupBy("run_id").agg(F.min("_e").alias("fetch_error"))


def check_complete(items: DataFrame, pages: DataFrame, *, cap: int | None = None) -> DataFrame:
    """Fetch error per run from the advertised total, page repeats and progress (null: usable)."""
    total = snapshot_complete(items).select(
        "run_id", F.when(F.col("verdict") != "complete", F.col("verdict")).alias("_e")
    )
    stalled = no_progress(page_progress(items, pages), 2).select("run_id", F.lit("no_progress").alias("_e"))
    repeated = page_repeat(items).where("repeated").select("run_id", F.lit("page_repeat").alias("_e"))
    parts = total.unionByName(stalled).unionByName(repeated)
    if cap is not None:
        parts = parts.unionByName(
            row_cap(items, cap).select("run_id", F.when(F.col("verdict") != "ok", F.col("verdict")).alias("_e"))
        )
    found = gate(parts, F.col("_e"))
    return pages.select("run_id").distinct().join(found, "run_id", "left")
