"""Filling containers of fixed capacity with texts by a grouping genetic algorithm (problem 8)."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.tokens import TOKENIZERS, VOCABULARY, token_counts
from leafmill.session import cut

CAPACITY = 2048
#: Items of a group (about), islands that evolve each group, individuals of an island, crossovers of a round.
GROUP_ITEMS, ISLANDS, POPULATION, CROSSOVERS = 1500, 2, 6, 24
#: Bins at least this full are final after the first stage; the others' items are regrouped.
WELL_FILLED = 0.995

#: An individual: bins as lists of item numbers.
Bins = list[list[int]]


def best_fit(sizes: list[int], items: list[int], bins: Bins, capacity: int) -> None:
    """Put each of ``items``, largest first, into the fullest bin of ``bins`` that has room, or a new one."""
    free = sorted((capacity - sum(sizes[i] for i in b), k) for k, b in enumerate(bins))
    for i in sorted(items, key=lambda i: -sizes[i]):
        at = bisect_left(free, (sizes[i], -1))
        if at == len(free):
            bins.append([i])
            insort(free, (capacity - sizes[i], len(bins) - 1))
        else:
            room, k = free.pop(at)
            bins[k].append(i)
            insort(free, (room - sizes[i], k))


def fitness(sizes: list[int], bins: Bins, capacity: int) -> float:
    """Mean squared fill: of two packings the one with fewer, fuller bins is higher."""
    return sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def crossover(sizes: list[int], a: Bins, b: Bins, capacity: int, rng: np.random.Generator) -> Bins:
    """Child of ``a`` with whole well-filled bins of ``b``.

    Bins of ``a`` that share an item with an injected bin are dissolved, so no item is held twice; their other items, and those of a few ill-filled
    bins, are displaced and put back by best fit.
    """
    fill = [sum(sizes[i] for i in x) for x in b]
    good = [k for k, f in enumerate(fill) if f >= 0.97 * capacity]
    if not good:
        good = [int(np.argmax(fill))]
    take = [k for k in good if rng.random() < rng.uniform(0.2, 0.8)] or [good[0]]
    child = [list(b[k]) for k in take]
    held = {i for x in child for i in x}
    displaced: list[int] = []
    for x in a:
        room = capacity - sum(sizes[i] for i in x)
        if held.isdisjoint(x) and not (room > 0.02 * capacity and rng.random() < 0.5):
            child.append(list(x))
        else:
            displaced += [i for i in x if i not in held]
    best_fit(sizes, displaced, child, capacity)
    return child


def evolve(sizes: list[int], population: list[Bins], capacity: int, crossovers: int, rng: np.random.Generator) -> list[Bins]:
    """``population`` after some crossovers, best first; a child replaces the worst if it is better."""
    ranked = sorted(((fitness(sizes, p, capacity), k, p) for k, p in enumerate(population)), key=lambda t: -t[0])
    least = -(-sum(sizes) // capacity)
    for step in range(crossovers):
        if len(ranked) < 2 or len(ranked[0][2]) == least and ranked[0][0] > 0.999:
            break
        x, y = sorted(rng.choice(len(ranked), 2, replace=False))
        child = crossover(sizes, ranked[y][2], ranked[x][2], capacity, rng)
        value = fitness(sizes, child, capacity)
        if value > ranked[-1][0]:
            ranked[-1] = (value, len(population) + step, child)
            ranked.sort(key=lambda t: -t[0])
    return [p for _, _, p in ranked]


def beginners(sizes: list[int], capacity: int, n: int, rng: np.random.Generator) -> list[Bins]:
    """Best-fit-decreasing, and best fit by sizes that are a little disturbed."""
    out = []
    for k in range(n):
        bins: Bins = []
        if k == 0:
            best_fit(sizes, list(range(len(sizes))), bins, capacity)
        else:
            noisy = np.array(sizes) * rng.uniform(0.7, 1.3, len(sizes))
            # a random part goes first, in disturbed order, the rest by best fit
            for i in np.argsort(-noisy)[: len(sizes) // 2]:
                best_fit_one(sizes, int(i), bins, capacity)
            put = {i for b in bins for i in b}
            best_fit(sizes, [i for i in range(len(sizes)) if i not in put], bins, capacity)
        out.append(bins)
    return out


def best_fit_one(sizes: list[int], i: int, bins: Bins, capacity: int) -> None:
    """First bin among the newest that has room; keeps beginners different from one another."""
    for b in reversed(bins[-8:]):
        if sum(sizes[j] for j in b) + sizes[i] <= capacity:
            b.append(i)
            return
    bins.append([i])


def _as_bins(column: np.ndarray) -> Bins:
    order = np.argsort(column, kind="stable")
    edges = np.flatnonzero(np.diff(column[order])) + 1
    return [x.tolist() for x in np.split(order, edges)] if len(column) else []


def _seed(*parts: int) -> np.random.Generator:
    return np.random.default_rng([abs(int(p)) for p in parts])


_ITEM = "doc_id long, piece int, start long, tokens long, copy int, grp long"


def _island(capacity: int, crossovers: int, population: int):
    """One island's first epoch: evolves a group from scratch, hands on its elite."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "copy"], na_position="first").reset_index(drop=True)
        sizes, rng = rows["tokens"].astype(int).tolist(), _seed(*key, 1)
        best = evolve(sizes, beginners(sizes, capacity, population, rng), capacity, crossovers, rng)[0]
        rows["bin"] = _numbers(best, len(sizes))
        return rows

    return run


def _numbers(bins: Bins, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for k, b in enumerate(bins):
        out[b] = k
    return out


def _meeting(capacity: int, crossovers: int, population: int):
    """A group's second epoch: the elites that migrated from its islands meet, with new beginners, and evolve on."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rng = _seed(*key, 2)
        rows = rows.sort_values(["island", "doc_id", "piece", "copy"], na_position="first")
        islands = [x.reset_index(drop=True) for _, x in rows.groupby("island", sort=True)]
        first = islands[0]
        sizes = first["tokens"].astype(int).tolist()
        elites = [_as_bins(x["bin"].to_numpy()) for x in islands]
        fresh = beginners(sizes, capacity, max(1, population - len(elites)), rng)
        best = evolve(sizes, elites + fresh, capacity, crossovers, rng)[0]
        first["bin"] = _numbers(best, len(sizes))
        fill = first.groupby("bin")["tokens"].transform("sum")
        first["fill"] = fill
        return first.drop(columns="island")

    return run


def _stage(items: DataFrame, stage: int, groups: int, capacity: int, crossovers: int, population: int) -> DataFrame:
    """Packs ``items`` in ``groups`` groups; adds ``grp``, ``bin`` and the ``fill`` of the bin."""
    grouped = items.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "copy", F.lit(stage)), F.lit(groups)))
    spread = grouped.withColumn("island", F.explode(F.array(*[F.lit(k) for k in range(ISLANDS)])))
    evolved = spread.groupBy("grp", "island").applyInPandas(_island(capacity, crossovers, population), f"{_ITEM}, island int, bin long")
    return evolved.groupBy("grp").applyInPandas(_meeting(capacity, crossovers, population), f"{_ITEM}, bin long, fill long")


def pack(sizes: DataFrame, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS, crossovers: int = CROSSOVERS, population: int = POPULATION) -> DataFrame:
    """Containers for the texts of ``sizes`` (``doc_id``, ``tokens``): ``container``, ``doc_id``, ``piece``, ``start``, ``tokens``.

    A text above ``capacity`` is divided into full containers and a remainder; no other is divided. Texts of no
    tokens (NULL and empty too) take no room and come out with a NULL ``container``. A ``doc_id`` that stands in several rows, or NULL,
    is packed as often as it stands there.

    Items are spread by hash over groups of about ``group_items``. Each group evolves on several islands
    by a grouping genetic algorithm; the islands' elites migrate to one meeting of the group and evolve on. Bins that are then
    well filled are final; the items of all others are regrouped and evolve once more, so that room left in one group
    is filled from another. Only numbers are shuffled, and no task sees more than a group.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    one = sizes.select("doc_id", F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("tokens")).groupBy("doc_id", "tokens").agg(F.count("*").alias("n"))
    rows = one.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("n")
    empty = rows.filter("tokens <= 0").select(F.lit(None).cast("string").alias("container"), "doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("tokens"))
    whole = F.floor((F.col("tokens") - 1) / capacity).cast("int")
    pieces = rows.filter("tokens > 0").withColumn("piece", F.explode(F.sequence(F.lit(0), whole)))
    start = F.col("piece").cast("long") * capacity
    pieces = pieces.select("doc_id", "piece", start.alias("start"), F.least(F.col("tokens") - start, F.lit(capacity)).cast("long").alias("tokens"), "copy", F.col("tokens").alias("_of"))
    full = pieces.filter(F.col("tokens") == capacity).select(F.concat_ws("-", F.lit("full"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "_of", "piece", "copy").alias("container"), "doc_id", "piece", "start", "tokens")
    # rows of one doc_id with different sizes must stay apart: the copy number is made unique by the size
    items = pieces.filter(F.col("tokens") < capacity).withColumn("copy", F.pmod(F.xxhash64("_of", "copy"), F.lit(1 << 31)).cast("int")).drop("_of")
    items = cut(items)
    groups = max(1, round(items.count() / group_items))
    first = cut(_stage(items, 1, groups, capacity, crossovers, population))
    final = first.filter(F.col("fill") >= WELL_FILLED * capacity)
    again = first.filter(F.col("fill") < WELL_FILLED * capacity).drop("grp", "bin", "fill")
    left = again.count()
    second = _stage(again, 2, max(1, round(left / group_items)), capacity, crossovers, population)
    name = lambda stage: F.concat_ws("-", F.lit(stage), F.col("grp"), F.col("bin")).alias("container")
    columns = ("doc_id", "piece", "start", "tokens")
    return full.unionByName(final.select(name("a"), *columns)).unionByName(second.select(name("b"), *columns)).unionByName(empty)


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, folder: str = TOKENIZERS, **options: int) -> DataFrame:
    """:func:`pack` for the texts of ``documents``, sized by a public tokenizer."""
    # written once, since the items, the full and the empty containers are all made from the sizes
    return pack(cut(token_counts(documents, ["doc_id"], "text", vocabulary, folder)), capacity, **options)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: ``containers``, ``tokens``, the least possible number of containers and the mean fill."""
    used = packed.filter("container IS NOT NULL").groupBy("container").agg(F.sum("tokens").alias("t"))
    return used.agg(
        F.count("*").alias("containers"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"),
        F.ceil(F.coalesce(F.sum("t"), F.lit(0)) / capacity).alias("least_containers"), F.max("t").alias("fullest"),
        F.when(F.count("*") > 0, F.sum("t") / (F.count("*") * capacity)).otherwise(F.lit(0.0)).alias("fill"),
    )
