"""Repetition inside a single document by suffix arrays (problem 4)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.operators.prefix import block_prefix_sum
from leafmill.session import cut

RUN_WORDS, RUN_CHARS = 10, 20
#: Documents up to this many characters are handled in memory by one task; larger ones go the distributed way.
WHOLE_CHARS = 4_000_000
#: Characters of documents whose suffixes are sorted together.
PACK_CHARS = 2_000_000

_HAN = re.compile(r"[㐀-䶿一-鿿豈-﫿぀-ヿ]")
_OUTER = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”„‘’«»‹›¿¡…–—·•、，。！？；：（）《》「」『』【】"


def tokens(text: str) -> tuple[list[str], bool]:
    """The units that repetition is counted in, and whether they are characters.

    A text whose Chinese or Japanese characters outnumber its other blank-separated words is counted by
    its characters, blanks aside. Any other is split at blanks, in lower case, without outer punctuation;
    words of punctuation only are left out.
    """
    words = text.lower().split()
    han = 0 if text.isascii() else len(_HAN.findall(text))
    if han and han > sum(1 for w in words if not _HAN.search(w)):
        return list("".join(words)), True
    return [w for w in (x.strip(_OUTER) for x in words) if w], False


def suffix_ranks(symbols: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix order within groups by prefix doubling.

    ``symbols`` are ints, ``group`` (non-decreasing) says which text each stands in; the last symbol of
    each group must occur once in it. Returns the suffix array, and for each power 2^k of two the class of
    each position by its first 2^k symbols. Only positions still tied are sorted again, so unrepetitive text
    costs a few sorts.
    """
    n = len(symbols)
    order = np.lexsort((symbols, group))
    fresh = np.empty(n, bool)
    fresh[:1] = True
    fresh[1:] = (np.diff(group[order]) != 0) | (np.diff(symbols[order]) != 0)
    rank = np.empty(n, np.int64)
    # a class is named by the place of its first member, so refining it never renames the others
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    levels, k = [rank.copy()], 1
    while True:
        last = np.empty(n, bool)
        last[-1:], last[:-1] = True, fresh[1:]
        tied = np.flatnonzero(~(fresh & last))
        if not len(tied):
            return order, levels
        at = order[tied]
        follower = rank[np.minimum(at + k, n - 1)]
        own = rank[at]
        by = np.lexsort((follower, own))
        at, own, follower = at[by], own[by], follower[by]
        order[tied] = at
        new = np.empty(len(tied), bool)
        new[:1] = True
        new[1:] = (np.diff(own) != 0) | (np.diff(follower) != 0)
        fresh[tied] = new
        rank[at] = np.maximum.accumulate(np.where(new, tied, 0))
        levels.append(rank.copy())
        k *= 2


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Length of the prefix that each suffix of the array shares with the one before it (0 for the first)."""
    n = len(order)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    pair = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
    a, b, length = order[pair - 1].copy(), order[pair].copy(), np.zeros(len(pair), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)]
        step = np.where(same & (np.maximum(a, b) < n), 1 << k, 0)
        a, b, length = a + step, b + step, length + step
    out[pair] = length
    return out


def measure(texts: list[list[str]], run: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text the number of repeated units and the length of its longest repeat.

    A longest-common-prefix interval of at least ``run`` holds all places where one substring stands; all
    but the first place repeat it. The union of their spans is what is repeated.
    """
    docs = len(texts)
    ids: dict[str, int] = {}
    fresh = ids.setdefault
    symbols = np.fromiter((fresh(w, len(ids) + 1) for t in texts for w in (*t, "\0")), np.int64)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, docs)
    group = np.repeat(np.arange(docs), sizes)
    order, levels = suffix_ranks(symbols, group)
    shared = common_prefixes(order, levels)
    longest = np.zeros(docs, np.int64)
    np.maximum.at(longest, group[order], shared)
    n = len(symbols)
    part_of = shared >= run
    starts = np.flatnonzero(~part_of)
    first = np.minimum.reduceat(order, starts) if len(starts) else order[:0]
    width = np.diff(np.append(starts, n))
    repeat = order[np.repeat(first, width) != order]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, repeat, 1)
    np.add.at(edge, np.minimum(repeat + run, n), -1)
    covered = np.cumsum(edge[:n]) > 0
    return np.bincount(group[covered], minlength=docs), np.where(longest >= run, longest, 0)


_SCHEMA = pa.schema([("document_id", pa.int64()), ("units", pa.int64()), ("repeated", pa.int64()), ("longest", pa.int64())])


def _measured(ids: list[int], texts: list[str], run_words: int, run_chars: int) -> pa.RecordBatch:
    split = [tokens(t) for t in texts]
    total = np.array([len(t) for t, _ in split], np.int64)
    repeated, longest = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    for by_chars, run in ((False, run_words), (True, run_chars)):
        mine = [i for i, (t, c) in enumerate(split) if c == by_chars and len(t) > run]
        if mine:
            repeated[mine], longest[mine] = measure([split[i][0] for i in mine], run)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, (total, repeated, longest))], schema=_SCHEMA)


def _kernel(run_words: int, run_chars: int, pack: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        texts: list[str] = []
        parts: list[str] = []
        doc = place = None
        size = 0
        for batch in batches:
            for d, i, text in zip(*(c.to_pylist() for c in batch.columns)):
                if d != doc:
                    if doc is not None:
                        ids.append(doc)
                        texts.append("\n\n".join(parts))
                        size += len(texts[-1])
                        if size >= pack:
                            yield _measured(ids, texts, run_words, run_chars)
                            ids, texts, size = [], [], 0
                    doc, place, parts = d, None, []
                if (i, text) != place:
                    parts.append(text)
                    place = (i, text)
        if doc is not None:
            ids.append(doc)
            texts.append("\n\n".join(parts))
        if ids:
            yield _measured(ids, texts, run_words, run_chars)

    return run


def repetition(chunks: DataFrame, run_words: int = RUN_WORDS, run_chars: int = RUN_CHARS, whole_chars: int = WHOLE_CHARS, pack_chars: int = PACK_CHARS, longest: bool = True) -> DataFrame:
    """Repeated content of each document: ``document_id``, ``units``, ``repeated``, ``share``, ``longest``.

    Units are words, or characters in Chinese text (:func:`tokens`). Repeated are those within any run of
    ``run_words`` words (``run_chars`` characters) that stood earlier in the document; ``longest`` is the length of
    its longest repeated run, which may overlap itself. A chunk stored more than once
    (same place, same content) counts once. Chunks with NULL or empty content are skipped; a document
    with nothing else is absent. NULL ids are skipped.

    One shuffle brings a document's chunks together in order; Python reads that stream and sorts the
    suffixes of many documents at once. A document above ``whole_chars`` would make one task too large
    and is counted from hashed runs instead (:func:`_distributed`), spread by run over all tasks; the values are the same.
    Callers that do not use ``longest`` can leave that column out.
    """
    used = chunks.filter("document_id IS NOT NULL AND content IS NOT NULL AND content <> ''").select("document_id", "chunk_index", "content")
    # written once, a handful of ids at most; where there are none, neither the join nor the other way is planned
    big = cut(used.groupBy("document_id").agg(F.sum(F.length("content")).alias("_size")).filter(F.col("_size") > whole_chars).select("document_id"))
    none = big.isEmpty()
    normal = used if none else used.join(big, "document_id", "left_anti")
    ordered = normal.repartition("document_id").sortWithinPartitions("document_id", "chunk_index", "content")
    out = ordered.mapInArrow(_kernel(run_words, run_chars, pack_chars), "document_id long, units long, repeated long, longest long")
    if not longest:
        out = out.drop("longest")
    if not none:
        out = out.unionByName(_distributed(used.join(big, "document_id", "left_semi"), run_words, run_chars, longest))
    return out.withColumn("share", F.when(F.col("units") > 0, F.col("repeated") / F.col("units")).otherwise(F.lit(0.0)))


def _han_surplus(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By how much the Chinese characters of a chunk outnumber its other words."""
    for batch in batches:
        texts = batch.column(1).to_pylist()
        surplus = [(0 if t.isascii() else len(_HAN.findall(t))) - sum(1 for w in t.lower().split() if not _HAN.search(w)) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(surplus, pa.int64())], names=["document_id", "han"])


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The units of a chunk: hashes of its words, or, if its document is counted by characters, all its characters."""
    import xxhash

    h = xxhash.xxh64_intdigest
    for batch in batches:
        units = []
        for t, by_char in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
            low = t.lower().split()
            units.append([ord(c) for c in "".join(low)] if by_char else [h(w) - (1 << 63) for w in (x.strip(_OUTER) for x in low) if w])
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], batch.column(4), pa.array(units, pa.list_(pa.int64()))], names=["document_id", "chunk_index", "_n", "by_char", "units"])


def _runs(run_words: int, run_chars: int, block: int):
    """Hash of the run that starts at each unit of a block, from the block's units and those after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = (1 << 64) - 1
        for batch in batches:
            out: list[tuple] = []
            for doc, at, by_char, parts in zip(*(c.to_pylist() for c in batch.columns)):
                parts.sort(key=lambda p: p["from"])
                units = np.array([u for p in parts for u in p["units"]], np.int64).view(np.uint64)
                first = parts[0]["from"]
                k = run_chars if by_char else run_words
                n = min(len(units) - k + 1, (at + 1) * block - first)
                if n < 1:
                    continue
                code = np.zeros(n, np.uint64)
                for j in range(k):
                    code = code * np.uint64(0x9E3779B97F4A7C15 & mask) + (units[j : j + n] ^ (units[j : j + n] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                    code ^= code >> np.uint64(32)
                out.append((np.full(n, doc), code.view(np.int64), np.arange(first, first + n), np.full(n, k)))
            cols = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64)] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["document_id", "code", "at", "run"])

    return run


def _longest(repeats: DataFrame) -> DataFrame:
    """``document_id``, ``longest``: length of the longest repeated run of each document of ``repeats``.

    ``repeats`` has the places ``at`` whose run of ``run`` units stands elsewhere too, with the run's hash ``code``. Two runs of n
    units are equal if their halves are, so joining places n apart doubles the length as long as a document has any repeat left;
    two overlapping runs of n cover any length up to 2n, among which a binary search finds the last that is still
    repeated. A longer repeat starts and goes on at repeated places only, so no other place is kept. Lengths (a number a
    document) are held by the driver, places never.
    """
    spark = repeats.sparkSession
    key = ["document_id", "code"]
    level = repeats.select("document_id", "code", "at", F.col("run").cast("long").alias("size"))
    size = {r.document_id: r.size for r in level.groupBy("document_id").agg(F.max("size").alias("size")).collect()}
    kept: DataFrame | None = None
    active = set(size)
    while active:
        later = level.select("document_id", (F.col("at") - F.col("size")).alias("at"), F.col("code").alias("_next"))
        twice = level.join(later, ["document_id", "at"]).select("document_id", F.xxhash64("code", "_next").alias("code"), "at", (F.col("size") * 2).alias("size")).repartition(*key)
        longer = cut(twice.join(twice.groupBy(*key).count().filter("count > 1").select(*key), key))
        more = {r.document_id for r in longer.select("document_id").distinct().collect()}
        if active - more:
            last = level.filter(F.col("document_id").isin(sorted(active - more)))
            kept = last if kept is None else kept.unionByName(last)
        size |= {d: size[d] * 2 for d in more}
        active, level = more, longer
    # a repeat of size + low units exists, none of size + high does
    low, high = dict.fromkeys(size, 0), dict(size)
    while ask := [(d, (low[d] + high[d]) // 2) for d in size if high[d] - low[d] > 1]:
        steps = spark.createDataFrame(ask, "document_id long, step long")
        asked = kept.join(F.broadcast(steps), "document_id")
        later = kept.select("document_id", F.col("at").alias("_at"), F.col("code").alias("_next"))
        pairs = asked.withColumn("_at", F.col("at") + F.col("step")).join(later, ["document_id", "_at"]).groupBy(*key, "_next").count()
        found = {r.document_id for r in pairs.filter("count > 1").select("document_id").distinct().collect()}
        for d, step in ask:
            (low if d in found else high)[d] = step
    return spark.createDataFrame([(d, size[d] + low[d]) for d in size], "document_id long, longest long")


def _distributed(chunks: DataFrame, run_words: int, run_chars: int, longest: bool = True, block: int = 8192) -> DataFrame:
    """Repeated units of very large documents, and with ``longest`` their longest repeat, without bringing one together.

    Units get their place by block prefix sums over chunks; blocks of units, with the first units of the
    next block, hash the run at each place (64 bits); the least place of each hash is its first stand, all others repeat
    it; and the union of their spans is counted block by block.
    """
    place = Window.partitionBy("document_id", "chunk_index").orderBy("content")
    numbered = chunks.withColumns({"_n": F.row_number().over(place), "_before": F.lag("content").over(place)})
    once = numbered.filter("_before IS NULL OR _before <> content").select("document_id", "chunk_index", "_n", "content")
    kind = once.select("document_id", "content").mapInArrow(_han_surplus, "document_id long, han long").groupBy("document_id").agg((F.sum("han") > 0).alias("by_char"))
    known = once.join(kind, "document_id").select("document_id", "chunk_index", "_n", "content", "by_char")
    units = known.mapInArrow(_units, "document_id long, chunk_index int, _n int, by_char boolean, units array<long>")
    placed = block_prefix_sum(units, ["document_id"], F.floor(F.col("chunk_index") / 1024), ["chunk_index", "_n"], F.size("units"), "from")
    placed = cut(placed)
    total = placed.groupBy("document_id").agg(F.sum(F.size("units")).alias("units"))
    most = max(run_words, run_chars)
    low, high = F.col("from"), F.col("from") + F.size("units")
    # a chunk goes to each block it overlaps, and to the block before for its run-over
    spread = placed.filter(F.size("units") > 0).withColumn("block", F.explode(F.sequence(F.greatest(F.lit(0), F.floor((low - most) / block)), F.floor((high - 1) / block))))
    left = F.greatest(low, F.col("block") * block)
    right = F.least(high, (F.col("block") + 1) * block + most)
    sliced = spread.withColumn("part", F.struct(left.alias("from"), F.slice("units", (left - low + 1).cast("int"), F.greatest(F.lit(0), (right - left).cast("int"))).alias("units"))).filter(right > left)
    blocks = sliced.groupBy("document_id", "block").agg(F.first("by_char").alias("by_char"), F.collect_list("part").alias("parts")).select("document_id", "block", "by_char", "parts")
    runs = blocks.mapInArrow(_runs(run_words, run_chars, block), "document_id long, code long, at long, run long")
    # one shuffle serves the counts and the join with them
    runs = runs.repartition("document_id", "code")
    first = runs.groupBy("document_id", "code").agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    repeats = cut(runs.join(first, ["document_id", "code"]))
    again = repeats.filter("at > first").select("document_id", "at", "run")
    # within a block, a repeat covers up to the next repeat or its own run, whichever is nearer
    near = Window.partitionBy("document_id", F.floor(F.col("at") / block)).orderBy("at")
    edge = again.withColumn("next", F.lead("at").over(near)).withColumn("block", F.floor(F.col("at") / block))
    heads = edge.groupBy("document_id", "block").agg(F.min("at").alias("head"))
    order = Window.partitionBy("document_id").orderBy("block")
    heads = heads.withColumn("after", F.lead("head").over(order)).drop("head")
    edge = edge.join(heads, ["document_id", "block"]).withColumn("next", F.coalesce("next", "after"))
    covered = edge.groupBy("document_id").agg(F.sum(F.least("run", F.coalesce(F.col("next") - F.col("at"), "run"))).alias("repeated"))
    out = total.join(covered, "document_id", "left").select("document_id", F.col("units").cast("long").alias("units"), F.coalesce("repeated", F.lit(0)).cast("long").alias("repeated"))
    return out.join(_longest(repeats), "document_id", "left").withColumn("longest", F.coalesce("longest", F.lit(0).cast("long"))) if longest else out
