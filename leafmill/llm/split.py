"""Splitting oversized items at natural boundaries (problem 2)."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.operators.prefix import block_prefix_sum

LIMIT, OVERLAP = 1500, 150

#: Where a text may be cut, best first; a cut comes after the match.
BREAKS = tuple(
    re.compile(p)
    for p in (
        r"\n[ \t\r]*\n\s*",
        r"\n+",
        r"[.!?…]+[\"'”’»)\]]*\s+|[。！？][”’」』）]*\s*",
        r"[;:；：]\s*|,\s+|[，、]",
        r"\s+",
    )
)
#: A combining mark, variation selector or joiner must stay with what stands before it.
_JOINED = re.compile(r"[̀-ͯ‌‍︀-️\U0001f3fb-\U0001f3ff]")


def boundaries(text: str) -> list[list[int]]:
    """Sorted end offsets of the breaks in ``text``, one list per rank of :data:`BREAKS`."""
    return [[m.end() for m in p.finditer(text)] for p in BREAKS]


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Spans [start, end) that cover ``text`` in order, each at most ``limit`` characters long.

    Offsets are prefix sums of character counts, so the end of a piece is found by binary search: the
    last boundary at or below start + limit, of the best rank that leaves the piece at least half full,
    else of any rank, else a hard cut (which never parts a combining mark from its base). The next piece starts at the earliest boundary among the last ``overlap`` characters of the
    piece, or, where there is none, exactly ``overlap`` characters back. Texts within the limit stay whole; an empty
    text has no piece. Pieces always advance. ``limit`` must exceed twice the ``overlap``.
    """
    if limit <= 2 * overlap or overlap < 0:
        raise ValueError("limit must be more than twice the overlap")
    n = len(text)
    if n <= limit:
        return [(0, n)] if n else []
    ranks = boundaries(text)
    every = sorted({b for r in ranks for b in r})
    out, start, done = [], 0, 0
    while True:
        if n - start <= limit:
            out.append((start, n))
            return out
        most, least = start + limit, max(start + limit // 2, done + 1)
        for r in ranks:
            k = bisect_right(r, most) - 1
            if k >= 0 and r[k] >= least:
                end = r[k]
                break
        else:
            k = bisect_right(every, most) - 1
            end = every[k] if k >= 0 and every[k] > max(done, start + overlap) else most
            if end == most:
                while end > done + 1 and _JOINED.match(text, end):
                    end -= 1
        out.append((start, end))
        done = end
        k = bisect_left(every, end - overlap)
        start = every[k] if k < len(every) and every[k] < end else end - overlap


_SCHEMA = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int32()), ("content", pa.string())])


def _cut(limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k, (a, b) in enumerate(pieces(text, limit, overlap)):
                    for column, value in zip(out, (i, k, a, text[a:b])):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _SCHEMA)], schema=_SCHEMA)

    return run


def split_oversized(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of every chunk above ``limit`` characters: ``id``, ``piece``, ``start``, ``content``.

    Rows delivered twice count once. NULL and empty texts have no piece. Only oversized rows reach
    Python; the filter and the two columns are evaluated at the scan. Needs no shuffle but the one that
    removes doubled rows, which moves oversized rows only.
    """
    over = chunks.filter(F.length("content") > limit).select("id", "content")
    once = over.groupBy("id").agg(F.max("content").alias("content"))
    return once.mapInArrow(_cut(limit, overlap), "id long, piece int, start int, content string")


_KEYS = ("_k1", "_k2")


def _pieces(limit: int, overlap: int, counted: bool):
    """Kernel over (key, key, content): the pieces of each text, or only their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            cuts = [pieces(t, limit, overlap) for t in texts]
            out = pa.array(list(map(len, cuts)), pa.int32()) if counted else pa.array([[t[a:b] for a, b in c] for t, c in zip(texts, cuts)], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], out], names=[*batch.schema.names[:-1], "n" if counted else "pieces"])

    return run


def rechunk(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, block: int = 4096) -> DataFrame:
    """All chunks with oversized ones cut, numbered anew: ``document_id``, ``chunk_index``, ``total_chunks``, ``id``, ``piece``, ``content``.

    A place (``document_id``, ``chunk_index``) stored several times is kept once, under its least ``id``. NULL
    content counts as an empty piece, so no place is lost. The new ``chunk_index`` is the number of pieces
    before it, from block totals of ``block`` old indexes, so that a document with a third of all rows is
    spread over tasks. Rows without ``document_id`` or ``chunk_index`` have no place that they could share, so each that differs
    in anything is kept: those without ``chunk_index`` come first in their document, those without ``document_id`` are numbered among
    themselves. ``id`` may be NULL or stand at several places.

    Only ids and numbers of pieces are grouped and summed up. Each row has a key of 128 bits made of all its values, by which the texts, cut where they are read, are
    joined at the end; so they are shuffled once.
    """
    values = ("document_id", "chunk_index", "id", "content")
    keyed = chunks.select(F.xxhash64(*values).alias("_k1"), F.xxhash64(F.lit(1), *reversed(values)).alias("_k2"), *values[:3], F.coalesce("content", F.lit("")).alias("content"))
    size = F.length("content")
    few = keyed.filter(size <= limit)
    over = keyed.filter(size > limit).select(*_KEYS, *values)
    ddl = "_k1 long, _k2 long, document_id long, chunk_index int, id long"
    narrow = few.select(*_KEYS, *values[:3], F.lit(1).alias("n")).unionByName(over.mapInArrow(_pieces(limit, overlap, True), f"{ddl}, n int"))
    lost = F.col("document_id").isNull() | F.col("chunk_index").isNull()
    placed = narrow.filter(~lost).groupBy("document_id", "chunk_index").agg(F.min(F.struct("id", *_KEYS, "n")).alias("c")).select(*[f"c.{k}" for k in _KEYS], "document_id", "chunk_index", "c.id", "c.n")
    kept = placed.unionByName(narrow.filter(lost).distinct())
    numbered = block_prefix_sum(kept, ["document_id"], F.floor(F.col("chunk_index") / block), ["chunk_index", "id", *_KEYS], F.col("n"), "base", "total_chunks")
    texts = few.select(*_KEYS, F.array("content").alias("pieces")).unionByName(over.select(*_KEYS, "content").mapInArrow(_pieces(limit, overlap, False), "_k1 long, _k2 long, pieces array<string>"))
    once = texts.groupBy(*_KEYS).agg(F.first("pieces").alias("pieces"))
    each = once.join(numbered, list(_KEYS)).select("document_id", "base", "total_chunks", "id", F.posexplode("pieces").alias("piece", "content"))
    return each.select("document_id", (F.col("base") + F.col("piece")).cast("int").alias("chunk_index"), F.col("total_chunks").cast("int").alias("total_chunks"), "id", "piece", "content")
