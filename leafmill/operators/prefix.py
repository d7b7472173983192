"""Running totals within a key that do not put a whole key into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def block_prefix_sum(df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[str | Column], value: Column, out: str, total: str | None = None) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the rows before this one within ``keys``; with ``total`` also the sum over all rows of the key.

    ``block`` must be non-decreasing in ``order`` and split a key into pieces of bounded size. Totals per
    block are added up first (one narrow row a block), then each block is summed on its own, so the
    largest task holds one block of rows, or one row per block of a key, and never a whole key.
    Rows with NULL in ``keys`` form a key of their own. NULL values count as 0.
    """
    tagged = df.withColumn("_block", block).withColumn("_value", F.coalesce(value.cast("long"), F.lit(0)))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        tagged.groupBy(*keys, "_block")
        .agg(F.sum("_value").alias("_total"))
        .withColumn("_base", F.coalesce(F.sum("_total").over(before), F.lit(0)))
        .select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_block").alias("_k_block"), "_base", *([F.sum("_total").over(Window.partitionBy(*keys)).alias(total)] if total else []))
    )
    match = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_block").eqNullSafe(F.col("_k_block"))]
    condition = match[0]
    for m in match[1:]:
        condition = condition & m
    within = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        tagged.join(totals, condition, "left")
        .withColumn(out, F.col("_base") + F.coalesce(F.sum("_value").over(within), F.lit(0)))
        .drop("_block", "_value", "_base", "_k_block", *[f"_k_{k}" for k in keys])
    )
