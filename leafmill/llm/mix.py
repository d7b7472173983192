"""Mixing sources to target weights (problem 9)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.tokens import TOKENIZERS, VOCABULARY, token_counts
from leafmill.operators.prefix import block_prefix_sum
from leafmill.session import cut

#: Rows of one source in a block of its prefix sums, about.
BLOCK_ROWS = 20_000


def budgets(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """What each source of ``targets`` has and is to give: ``source``, ``target_share``, ``max_repeats``, ``available``, ``rows``, ``budget``.

    A source named several times has its shares added and its greatest ``max_repeats``. Shares are scaled to those
    sources that have tokens, so that the rest keep their proportions; a source without any gets a budget of 0. ``total`` is the
    size of the mixture in tokens; None stands for the greatest at which every source can still give its share within its repeats.
    """
    clean = targets.filter("source IS NOT NULL").groupBy("source").agg(F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    have = sizes.filter("source IS NOT NULL AND tokens > 0").groupBy("source").agg(F.sum("tokens").alias("available"), F.count("*").alias("rows"))
    plan = cut(clean.join(have, "source", "left").fillna(0, ["available", "rows"]))
    usable = (F.col("available") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    whole = plan.filter(usable).agg(F.sum("target_share").alias("s"), F.min(F.col("available") * F.col("max_repeats") / F.col("target_share")).alias("m")).first()
    if not whole.s:
        return plan.withColumn("budget", F.lit(0).cast("long"))
    size = float(total) if total is not None else whole.m * whole.s
    want = F.round(F.col("target_share") / whole.s * size).cast("long")
    return plan.withColumn("budget", F.when(usable, F.least(want, F.col("available") * F.col("max_repeats"))).otherwise(0).cast("long"))


def _fitting(rows: pd.DataFrame) -> pd.DataFrame:
    """Of the rows of one source next after the cut, in order, those that still fit into what is left of its budget."""
    rows = rows.sort_values(["_key", "doc_id", "tokens"], na_position="first")
    left, keep = int(rows["_left"].iloc[0]), []
    for n in rows["tokens"]:
        keep.append(n <= left)
        left -= n if n <= left else 0
    return rows[keep]


def mix(sizes: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows of the mixture: ``source``, ``doc_id``, ``epoch`` (0 for the first use), ``tokens``.

    ``sizes`` has ``source``, ``doc_id`` and ``tokens``. Every row draws a random key by hash; a source is ordered by it, and
    the running sum of its tokens tells where its budget ends: after as many whole passes over the source as go into the budget, rows are
    used up to the last that ends within it. The row across the cut is passed over, and of the next ones, about ``block_rows``, those are
    used that still fit. So a source never exceeds its budget and misses it by less than the smallest row passed over. No row is used more than ``max_repeats`` times. Rows without tokens, and of
    sources that have no target, are not used. Ties of the key are broken by ``doc_id`` and size, repeated rows count each.

    Running sums are made per block of keys, so a source that has a third of all rows is spread over many tasks; only the rows next after the cut meet in one. Texts are not
    moved; only ids and sizes are.
    """
    plan = budgets(sizes, targets, total)
    most = plan.agg(F.max("rows")).first()[0] or 0
    bits = max(0, min(30, (max(1, most) // block_rows).bit_length()))
    keyed = sizes.filter("tokens > 0").join(plan.filter("budget > 0").select("source", "available", "rows", "budget"), "source")
    # repeated rows are told apart by a number that has no meaning but makes the order total
    keyed = keyed.withColumn("_key", F.xxhash64("doc_id", "tokens", F.lit(seed)))
    summed = block_prefix_sum(keyed, ["source"], F.shiftrightunsigned("_key", 64 - bits) if bits else F.lit(0), [F.col("_key") < 0, "_key", "doc_id", "tokens"], F.col("tokens"), "_before")
    # 64-bit keys are ordered as unsigned ones; a number that sorts alike goes to Python
    summed = summed.withColumns({"_passes": F.floor(F.col("budget") / F.col("available")), "_rest": F.pmod("budget", "available"), "_key": F.col("_key").bitwiseXOR(F.lit(-(1 << 63)))})
    summed = cut(summed.select("source", "doc_id", "tokens", "_key", "_before", "_passes", "_rest", "available", "rows"))
    inside = F.col("_before") + F.col("tokens") <= F.col("_rest")
    left = summed.groupBy("source").agg((F.first("_rest") - F.coalesce(F.sum(F.when(inside, F.col("tokens"))), F.lit(0))).alias("_left"))
    after = summed.filter(~inside & (F.col("_before") <= F.col("_rest") + block_rows * F.col("available") / F.col("rows"))).join(left.filter("_left > 0"), "source").filter("tokens <= _left")
    fitting = after.select("source", "doc_id", "tokens", "_key", "_passes", "_left").groupBy("source").applyInPandas(_fitting, "source string, doc_id long, tokens long, _key long, _passes long, _left long")
    whole = summed.filter("_passes > 0").select("source", "doc_id", F.explode(F.sequence(F.lit(0), (F.col("_passes") - 1).cast("int"))).alias("epoch"), "tokens")
    last = lambda df: df.select("source", "doc_id", F.col("_passes").cast("int").alias("epoch"), "tokens")
    return whole.unionByName(last(summed.filter(inside))).unionByName(last(fitting))


def reached(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """Shares of the mixture: ``source``, ``target_share``, ``tokens``, ``share``, ``rows``, ``epochs``; a row for every target, used or not."""
    by = mixture.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows"), (F.max("epoch") + 1).alias("epochs"))
    aim = targets.filter("source IS NOT NULL").groupBy("source").agg(F.sum("target_share").alias("target_share"))
    all_ = aim.join(by, "source", "left").fillna(0, ["tokens", "rows", "epochs"])
    whole = by.agg(F.coalesce(F.sum("tokens"), F.lit(0))).scalar()
    return all_.withColumn("share", F.when(whole > 0, F.col("tokens") / whole).otherwise(F.lit(0.0)))


def source_sizes(documents: DataFrame, vocabulary: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """``source``, ``doc_id`` and ``tokens`` of every document, written once so that later steps do not encode again."""
    return cut(token_counts(documents, ["source", "doc_id"], "text", vocabulary, folder))
