"""Running "last value so far" over very long keys.

A plain window puts a whole key in one task. Here every key is cut into blocks of the order
column, blocks are summarised with a partial aggregate, and only the block summaries go through a
window over the key. No task holds more than one block of a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 100_000


def carry_last(
    df: DataFrame, keys: list[str], order: Column, value: Column, out: str, block: int = BLOCK_ROWS
) -> DataFrame:
    """Add the last non-null ``value`` of strictly earlier rows (by ``order``) within ``keys``."""
    staged = df.withColumns(
        {"_ord": order.cast("bigint"), "_val": value}
    ).withColumn("_blk", F.floor(F.col("_ord") / F.lit(block)))
    summary = staged.groupBy(*keys, "_blk").agg(
        F.max_by("_val", F.when(F.col("_val").isNotNull(), F.col("_ord"))).alias("_blk_last")
    )
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        *keys, "_blk", F.last("_blk_last", ignorenulls=True).over(before).alias("_carry")
    )
    inside = (
        Window.partitionBy(*keys, "_blk").orderBy("_ord").rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        staged.withColumn("_prev", F.last("_val", ignorenulls=True).over(inside))
        .join(carried, [*keys, "_blk"], "left")
        .withColumn(out, F.coalesce("_prev", "_carry"))
        .drop("_ord", "_val", "_blk", "_prev", "_carry")
    )
