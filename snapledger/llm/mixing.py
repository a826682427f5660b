"""Mixing sources to target weights by temperature.

A source's share of the corpus tokens is raised to an exponent and normalised. The exponent is bisected in
[0, 1] (0: all sources alike, 1: as they are) so that the mixture is as even as the limits allow: no source
is repeated more than ``max_epochs`` times, and the entropy need not exceed ``target_entropy``, if given.
The budget is the smallest number of tokens at which every document of every source appears at least once,
so nothing is dropped.

A source's budget is realised by whole epochs and one part of an epoch. An epoch deals the source's
documents by hash into blocks and permutes the blocks and the documents in them; the part takes blocks in
that order while the budget lasts, and of the last block the documents that still begin within the budget.
Only block totals pass a window per source, and only one block of a source is read row by row, so a source
may hold any share of all rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from snapledger.llm.common import BLANK_RUN, packed, pair_hash, stage, table
from snapledger.llm.registry import query

MAX_EPOCHS, BLOCK_TOKENS = 2.0, 1_000_000


def shares_at(tokens: list[int], exponent: float) -> list[float]:
    """Normalised token shares to the power of ``exponent``."""
    largest = max(tokens)
    powers = [(n / largest) ** exponent if n else 0.0 for n in tokens]
    return [p / math.fsum(powers) for p in powers]


def entropy(weights: list[float]) -> float:
    return -math.fsum(w * math.log(w) for w in weights if w > 0)


def epochs_at(tokens: list[int], exponent: float) -> list[float]:
    """Times that each source is read if the least repeated one is read once."""
    weights = shares_at(tokens, exponent)
    budget = max(n / w for n, w in zip(tokens, weights, strict=True) if n)
    return [w * budget / n if n else 1.0 for n, w in zip(tokens, weights, strict=True)]


def temperature(tokens: list[int], max_epochs: float = MAX_EPOCHS, target_entropy: float | None = None) -> float:
    """Smallest exponent within both limits, by bisection; both fall as the exponent rises."""

    def fits(exponent: float) -> bool:
        even = target_entropy is None or entropy(shares_at(tokens, exponent)) <= target_entropy + 1e-12
        return even and max(epochs_at(tokens, exponent)) <= max_epochs + 1e-12

    low, high = 0.0, 1.0
    if not any(tokens) or fits(low):
        return low
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if fits(middle) else (middle, high)
    return high


def n_tokens(text: Column) -> Column:
    """Tokens for the budget: runs of non-blanks."""
    full = F.coalesce(text, F.lit(""))
    return F.size(F.filter(F.split(full, BLANK_RUN), lambda w: w != "")).cast("bigint")


def mix(
    docs: DataFrame, max_epochs: float = MAX_EPOCHS, target_entropy: float | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 1
) -> DataFrame:
    """One row per document and time it is read: the columns of ``docs`` and ``epoch``, ``mix_key``.

    ``epoch`` counts a document's readings from 0; ascending ``mix_key`` (ties by ``doc_id``) is the order of the
    mixture within an epoch of its source. Both replace columns of the same name. A null ``source`` is a
    source of its own; documents without words cost no tokens and are read once in every whole epoch; repeated rows are
    documents of their own, permuted alike. An empty table gives no rows.
    """
    columns = [c for c in docs.columns if c not in ("epoch", "mix_key")]
    k1, k2 = pair_hash(F.col("doc_id"), F.col("text"))
    facts = stage(docs.select(F.col("source"), F.col("doc_id"), k1.alias("k1"), k2.alias("k2"), n_tokens(F.col("text")).alias("tokens")), "mix-facts")
    sizes = facts.groupBy("source").agg(F.sum("tokens").alias("tokens")).orderBy("source").collect()  # a row per source
    tokens = [row["tokens"] for row in sizes]
    exponent = temperature(tokens, max_epochs, target_entropy) if tokens else 1.0
    plan = [
        (row["source"], int(e + 1e-9), int(round((e - int(e + 1e-9)) * row["tokens"])), -(-row["tokens"] // block_tokens) or 1)
        for row, e in zip(sizes, epochs_at(tokens, exponent) if any(tokens) else [1.0] * len(tokens), strict=True)
    ]
    budgets = docs.sparkSession.createDataFrame(plan, f"source {docs.schema['source'].dataType.simpleString()}, whole int, part bigint, blocks bigint")

    def order(salt: str) -> Column:
        return F.xxhash64(F.lit(seed), F.lit(salt), "source", "k1", "k2")

    known = facts.join(budgets, facts["source"].eqNullSafe(budgets["source"])).drop(budgets["source"])
    dealt = known.withColumn("block", F.pmod(order("block"), F.col("blocks"))).withColumn("place", order("place"))
    totals = dealt.groupBy("source", "part", "block").agg(F.sum("tokens").alias("tokens"))
    ahead = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed), "source", "block"), "block")
    begin = F.sum("tokens").over(ahead) - F.col("tokens")
    at = stage(totals.withColumn("begin", begin).select("source", "block", "begin", (F.col("part") - F.col("begin")).alias("room"), "tokens"), "mix-blocks")
    full = at.filter("room >= tokens AND room > 0").select("source", "block")
    cut = at.filter("room > 0 AND room < tokens").select("source", "block", "room")
    by_block = lambda right: (dealt["source"].eqNullSafe(right["source"])) & (dealt["block"] == right["block"])
    inside = dealt.join(cut, by_block(cut)).select(dealt["source"], "k1", "k2", "doc_id", "place", "tokens", "room")
    rank = Window.partitionBy("source").orderBy("place", "k1", "k2")
    some = inside.withColumn("before", F.sum("tokens").over(rank) - F.col("tokens")).filter("before < room AND tokens > 0")
    extra = dealt.join(full, by_block(full), "left_semi").select("k1", "k2").union(some.select("k1", "k2")).distinct()
    whole = F.broadcast(budgets.select("source", "whole"))
    row = docs.select(packed(docs), F.col("source"), k1.alias("k1"), k2.alias("k2"))
    marked = (
        row.join(whole, row["source"].eqNullSafe(whole["source"])).drop(whole["source"])
        .join(extra.withColumn("more", F.lit(1)), ["k1", "k2"], "left")
    )
    times = F.explode(F.sequence(F.lit(0), F.col("whole") + F.coalesce("more", F.lit(0)) - 1))
    out = marked.select("_row", "k1", "k2", times.alias("epoch"))
    return out.select(*[F.col("_row")[c].alias(c) for c in columns], "epoch", F.xxhash64(F.lit(seed), "epoch", "k1", "k2").alias("mix_key"))


@query("op7_mixing")
def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mix(table(spark, folder, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "source", "epoch", "mix_key", n_tokens(F.col("text")).alias("n_tokens"))
