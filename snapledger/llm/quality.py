"""Quality rules: base counts per document, then a hashed n-gram log-likelihood ratio with a held-out threshold.

Two multinomials over ``buckets`` hashed word unigrams and bigrams are counted: the raw corpus (every
document) and the trusted target. A bucket's weight is log p(target) - log p(raw); a document's score is
the mean weight of its n-grams, so that long and short texts compare. It is kept if no base rule
fails and its score reaches the threshold.

The threshold is a low quantile (``missed``) of the scores that trusted documents get from all *other* trusted
documents: each one's own n-grams are taken out of the target first, since a document's own counts lift its
score far above what an equally good document outside the target gets. These scores compare with those of
unlabelled documents, however few labels there are.

The trusted target is every labelled good document of the corpus, however many there are. The counts of the raw corpus
cover every document. Bucket counts are shuffled, and once the texts of trusted documents: a bounded bit filter of their ids
keeps most other texts out of that join, and the n-grams found behind it are staged, so that no text is cut twice for the target. Scoring
is row-local, with the ``buckets`` weights (whole thousandths, so that sums don't depend on their order) as one constant
array. The held-out scores are row-local too, but for rows that share an id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapledger.llm.common import BLANK_RUN, BLANKS, let, packed, stage, table
from snapledger.llm.registry import query

SYMBOLS = "#*$%&|<>"
BUCKETS = 1 << 16
#: The share of trusted documents whose held-out score may lie below the threshold; with fewer than 1 / MISSED of
#: them the lowest held-out score is the threshold.
MISSED = 0.001
#: Added to every bucket count, as a share of the mean count, so that no estimate is zero.
SMOOTHING = 0.05
#: Words of 64 bits in the id filter: the most rows of its broadcast. Beyond some ten million ids it lets most texts pass.
FILTER_WORDS = 1 << 17


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK_RUN), "")


def neighbours(items: Column, of: Callable[[Column, Column], Column]) -> Column:
    """``of`` every item and the next one; ``items`` must be bound. Slices, since places would be worked out per item."""
    short = F.greatest(F.size(items) - 1, F.lit(0))
    return F.zip_with(F.slice(items, 1, short), F.slice(items, 2, short), of)


def word_pairs(words: Column) -> Column:
    """64-bit hashes of all word bigrams; ``words`` must be bound."""
    return neighbours(words, lambda a, b: F.xxhash64(a, b))


def in_bucket(hashed: Column, buckets: int) -> Column:
    return F.pmod(hashed, F.lit(buckets))


def gram_buckets(words: Column, pairs: Column, buckets: int = BUCKETS) -> Column:
    """Hash buckets of all word unigrams and bigrams."""
    singles = F.transform(words, lambda w: in_bucket(F.xxhash64(w), buckets).cast("int"))
    return F.concat(singles, F.transform(pairs, lambda p: in_bucket(p, buckets).cast("int")))


def repeated_window_words(pairs: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text (windows compared by 64-bit hash).

    A window is told by the hashes of its two ``pairs``, which must be bound.
    """

    def covered(starts: Column) -> Column:
        """Length of the union of [p, p + 3) over ascending p."""
        first = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(
            starts,
            first,
            lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")),
            lambda a: a["n"],
        )

    def repeats(hashes: Column) -> Column:
        """Starts of repeated windows: equal neighbours after sorting (hash, position)."""
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(
            placed,
            lambda s: F.sort_array(
                F.transform(
                    F.filter(
                        s,
                        lambda x, k: (F.get(s, k - 1)["h"] == x["h"]).eqNullSafe(True)
                        | (F.get(s, k + 1)["h"] == x["h"]).eqNullSafe(True),
                    ),
                    lambda x: x["i"],
                )
            ),
        )

    def count(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered(repeats(hashes)))

    return let(neighbours(pairs, lambda a, b: F.xxhash64(a, b)), count)


def base_counts(text: Column, words: Column, pairs: Column) -> dict[str, Column]:
    """The base columns, as the rule set defines them; null text counts as empty."""
    full = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(full, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    return {
        "n_words": F.size(words),
        "word_chars": F.char_length(F.array_join(words, "")),
        "n_symbols": F.size(F.split(full, f"[{SYMBOLS}]", -1)) - 1,
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": repeated_window_words(pairs),
    }


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of all documents labelled good and not toxic."""
    good = labels.filter((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0) & F.col("doc_id").isNotNull())
    return good.select("doc_id").distinct()


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def likely_trusted(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` of all trusted documents and of some others, by one bit per hash value of a trusted id."""
    docs, kind = docs.select("doc_id", "text"), docs.schema["doc_id"].dataType
    if kind != trusted.schema["doc_id"].dataType or not isinstance(kind, (T.IntegralType, T.StringType)):
        return docs  # equal ids of other types need not have equal hashes
    place, bit = F.pmod(F.xxhash64("doc_id"), F.lit(64 * FILTER_WORDS)), F.expr("CAST(_place % 64 AS INT)")
    word = F.shiftright("_place", 6).alias("_word")
    ids = trusted.select(place.alias("_place")).select(word, F.expr("shiftleft(1L, CAST(_place % 64 AS INT))").alias("_bit"))
    words = ids.groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    placed = docs.withColumn("_place", place).withColumn("_word", word)
    return placed.join(F.broadcast(words), "_word").where(F.getbit("_bits", bit) == 1).select("doc_id", "text")


def trusted_grams(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Rows of trusted documents: doc_id, ``rows`` with that id, ``failed`` by the base rules, sorted ``grams``."""
    rows = F.count("*").over(Window.partitionBy("doc_id"))
    # An inner join: a semi join would be pushed below the filter and move every text.
    texts = likely_trusted(docs, trusted).join(trusted.distinct(), "doc_id").withColumn("rows", rows)

    def measured(ws: Column) -> Column:
        return let(
            word_pairs(ws),
            lambda pairs: F.struct(
                base_failed(F.size(ws), repeated_window_words(pairs)).alias("failed"), gram_buckets(ws, pairs, buckets).alias("grams")
            ),
        )

    found = texts.select("doc_id", "rows", let(words_of(F.col("text")), measured).alias("m"))
    return stage(found.select("doc_id", "rows", F.col("m.failed"), F.sort_array("m.grams").alias("grams")), "trusted-grams")


def raw_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, raw): n-grams of all documents by bucket. Each word is a row beside the next word, so that no lambda runs per n-gram."""
    words = docs.select(words_of(F.col("text")).alias("words"))
    rows = words.select(F.inline(F.arrays_zip(F.col("words").alias("word"), F.slice("words", 2, F.greatest(F.size("words"), F.lit(0))).alias("next"))))
    both = in_bucket(F.xxhash64("word"), buckets), F.when(F.col("next").isNotNull(), in_bucket(F.xxhash64("word", "next"), buckets))
    grams = rows.select(F.stack(F.lit(2), *both).alias("bucket")).where(F.col("bucket").isNotNull())
    return grams.groupBy(F.col("bucket").cast("int").alias("bucket")).agg(F.count("*").alias("raw"))


def bucket_weights(
    docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, target: DataFrame | None = None
) -> tuple[list[int], list[int], list[int]]:
    """Log-likelihood ratio in thousandths, raw count and target count of every bucket, in bucket order: ``buckets`` numbers each.

    ``target`` may give the ``trusted_grams``, where a caller has them already.
    """
    target = trusted_grams(docs, trusted, buckets) if target is None else target
    raw = raw_counts(docs, buckets)
    good = target.select(F.explode("grams").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("good"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    counts = stage(every.join(raw, "bucket", "left").join(good, "bucket", "left").fillna(0, ["raw", "good"]), "bucket-counts")
    total = counts.agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).first()

    def share(count: str) -> Column:
        extra = SMOOTHING * total[count] / buckets + 1e-9
        return (F.col(count) + extra) / (total[count] + buckets * extra)

    ratio = F.rint(1000 * F.log(share("good") / share("raw"))).cast("int")
    rows = sorted(counts.select("bucket", ratio.alias("weight"), "raw", "good").collect())  # ``buckets`` rows
    return [row["weight"] for row in rows], [row["raw"] for row in rows], [row["good"] for row in rows]


def constants(numbers: list[int], kind: str) -> Column:
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast(f"array<{kind}>")


def mean_weight(words: Column, weights: list[int], pairs: Column | None = None) -> Column:
    """Mean log-likelihood ratio of a document's n-grams; 0 without any. ``pairs`` may give the ``word_pairs`` of bound words."""
    if pairs is None:
        return let(words, lambda ws: let(word_pairs(ws), lambda ps: mean_weight(ws, weights, ps)))
    listed, none = constants(weights, "bigint"), F.lit(0).cast("bigint")

    def add(total: Column, hashed: Column) -> Column:
        return total + F.get(listed, in_bucket(hashed, len(weights)))

    total = F.aggregate(pairs, F.aggregate(words, none, lambda a, w: add(a, F.xxhash64(w))), add)
    return total / (1000 * F.greatest(F.size(words) + F.size(pairs), F.lit(1)))


def held_out_scores(docs: DataFrame, trusted: DataFrame, raw: list[int], good: list[int], target: DataFrame | None = None) -> DataFrame:
    """(doc_id, score): scores of the trusted documents, each without its own n-grams in the target.

    An id with one row is scored inside that row: its n-gram counts are the run lengths of its sorted buckets. Rows that share
    a ``doc_id`` are left out together, their counts added up by a shuffle. The score is null for a document that fails the
    base rules; one that is the whole target has none. ``target`` may give the ``trusted_grams``.
    """
    buckets, raw_total, good_total = len(raw), sum(raw), sum(good)

    def smoothed(total: Column) -> Column:
        """What is added to every count, and what the sum is divided by."""
        extra = SMOOTHING * total / buckets + 1e-9
        return F.struct(extra.alias("extra"), (total + buckets * extra).alias("whole"))

    def log_share(count: Column, by: Column) -> Column:
        return F.log((count + by["extra"]) / by["whole"])

    def ratio(a: Column, by: Column, known: Column) -> Column:
        """What the ``n`` n-grams of a bucket add to the sum of a document; ``by`` smooths the target without that document."""
        target = log_share(F.get(known["good"], a["bucket"]) - a["n"], by)
        each = F.rint(1000 * (target - log_share(F.get(known["raw"], a["bucket"]), every)))
        return F.when(a["n"] > 0, a["n"] * each.cast("bigint")).otherwise(F.lit(0).cast("bigint"))

    # Bound once per expression: every copy of these arrays would be kept, and printed, with each plan on the driver.
    known = F.struct(constants(good, "bigint").alias("good"), constants(raw, "bigint").alias("raw"))
    every = smoothed(F.lit(raw_total))

    def score(grams: Column, known: Column) -> Column:
        size, none, one = F.size(grams), F.lit(0).cast("bigint"), F.lit(1).cast("bigint")

        def summed(by: Column) -> Column:
            def step(a: Column, bucket: Column) -> Column:
                same = a["bucket"] == bucket
                total = F.when(same, a["total"]).otherwise(a["total"] + ratio(a, by, known))
                return F.struct(bucket.alias("bucket"), F.when(same, a["n"] + one).otherwise(one).alias("n"), total.alias("total"))

            first = F.struct(F.lit(-1).alias("bucket"), none.alias("n"), none.alias("total"))
            return F.aggregate(grams, first, step, lambda a: (a["total"] + ratio(a, by, known)) / (1000 * size))

        return F.when(size < good_total, let(smoothed(good_total - size), summed))

    texts = trusted_grams(docs, trusted, buckets) if target is None else target
    grams = F.when(~F.col("failed"), F.col("grams"))
    alone = texts.filter("rows = 1").select("doc_id", let(grams, lambda g: let(known, lambda k: score(g, k))).alias("score"))
    split = texts.filter("rows > 1").select("doc_id", F.explode(grams).alias("bucket"))
    own = split.groupBy("doc_id", "bucket").agg(F.count("*").alias("n"))
    sizes = own.groupBy("doc_id").agg(F.sum("n").alias("size")).filter(F.col("size") < good_total)
    part = let(known, lambda k: let(smoothed(good_total - F.col("size")), lambda by: ratio(F.struct("bucket", "n"), by, k)))
    parts = own.join(sizes, "doc_id").select("doc_id", "size", part.alias("part"))
    shared = parts.groupBy("doc_id").agg((F.sum("part") / (1000 * F.first("size"))).alias("score"))
    return alone.unionByName(shared)


def threshold_of(scores: DataFrame, missed: float) -> float:
    """The score that a share ``missed`` of the held-out scores lies below, the lowest of few; all pass if there are none.

    Null scores don't count; the aggregate leaves them out.
    """
    at = scores.agg(F.expr(f"percentile_disc({missed!r}D) WITHIN GROUP (ORDER BY score)").alias("t")).first()["t"]
    return float("-inf") if at is None else at


def judge(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, missed: float = MISSED) -> DataFrame:
    """``docs`` with the base counts, ``score``, ``base_failed`` and ``kept`` as further columns.

    ``docs`` needs ``doc_id`` and ``text``; ``labels`` needs ``doc_id``, ``quality``, ``toxic``. Added columns
    replace columns of the same name. Null text is empty: no words, so it fails the base rules. With
    fewer than two trusted documents there is no held-out score, and only the base rules decide. Repeated rows are judged alike,
    each counted in the corpus; a null id can't be trusted but is judged.
    """
    trusted = trusted_ids(labels)
    target = trusted_grams(docs, trusted, buckets)
    weights, raw, good = bucket_weights(docs, trusted, buckets, target)
    threshold = threshold_of(held_out_scores(docs, trusted, raw, good, target), missed)
    added = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "base_failed", "kept")
    own = [c for c in docs.columns if c not in added]

    def measured(ws: Column, pairs: Column) -> Column:
        counts = [v.cast("bigint").alias(k) for k, v in base_counts(F.col("text"), ws, pairs).items()]
        return F.struct(*counts, mean_weight(ws, weights, pairs).alias("score"))

    row, m = F.col("_row"), F.col("_measured")  # the caller's columns travel as one struct, so that no name clashes
    words = let(words_of(F.col("text")), lambda ws: let(word_pairs(ws), lambda pairs: measured(ws, pairs)))
    judged = docs.select(packed(docs.select(*[f"`{c}`" for c in own])), words.alias("_measured"))
    failed = base_failed(m["n_words"], m["n_repeat_words"])
    return judged.select(
        *[row[c].alias(c) for c in own],
        *[m[k].alias(k) for k in added[:6]],
        failed.alias("base_failed"),
        (~failed & (m["score"] >= threshold)).alias("kept"),
    )


@query("op6_quality_rules")
def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = judge(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    )
