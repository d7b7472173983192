"""Queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.encoding import restore_chunks
from leafmill.llm.language import fit, label_segments, mislabelled
from leafmill.llm.markup import cleaned
from leafmill.llm.mix import mix, reached, source_sizes
from leafmill.llm.pack import fill_report, pack_documents
from leafmill.llm.quality import classify, statistics
from leafmill.llm.repetition import repetition
from leafmill.llm.scan import defects, repaired
from leafmill.llm.split import rechunk, split_oversized
from leafmill.sources.tables import load, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@_query()
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with noise of scanned pages, by kind."""
    return defects(spread(load(spark, sf_dir, "chunks")))


@_query()
def p1_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks as continuous paragraphs."""
    return repaired(spread(load(spark, sf_dir, "chunks")))


@_query("SELECT DISTINCT id FROM chunks WHERE length(content) > 1500")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that must be cut, out of the splitter's pieces."""
    return split_oversized(load(spark, sf_dir, "chunks")).filter("piece = 0").select("id")


@_query()
def p2_rechunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks after splitting, numbered anew."""
    return rechunk(load(spark, sf_dir, "chunks"))


# What repetition is counted in: words split at blanks without outer punctuation, or characters where Chinese ones outnumber other words.
_BLANK = "\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
_CHINESE = "[\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}\\x{3040}-\\x{30ff}]"
_PUNCT = "\\x21-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7e“”„‘’«»‹›¿¡…–—·•、，。！？；：（）《》「」『』【】"
_REPEATED = f"""
    WITH once AS (SELECT DISTINCT document_id, chunk_index, content FROM chunks WHERE document_id IS NOT NULL AND content <> ''),
    t AS (SELECT document_id, lower(string_agg(content, chr(10) || chr(10) ORDER BY chunk_index, content)) AS x FROM once GROUP BY document_id),
    w AS (SELECT document_id, list_filter(regexp_split_to_array(x, '[{_BLANK}]+'), lambda s: s <> '') AS words, length(regexp_replace(x, '[^' || '{_CHINESE[1:-1]}' || ']', '', 'g')) AS han FROM t),
    u AS (SELECT document_id, han > len(list_filter(words, lambda s: NOT regexp_matches(s, '{_CHINESE}'))) AS by_char, words FROM w),
    units AS (SELECT document_id, CASE WHEN by_char THEN 20 ELSE 10 END AS k,
      CASE WHEN by_char THEN regexp_extract_all(array_to_string(words, ''), '(?s).') ELSE list_filter(list_transform(words, lambda s: regexp_replace(s, '^[{_PUNCT}]+|[{_PUNCT}]+$', '', 'g')), lambda s: s <> '') END AS u FROM u),
    each AS (SELECT document_id, k, len(u) AS n, unnest(u) AS w, generate_subscripts(u, 1) AS i FROM units),
    runs AS (SELECT document_id, k, i, CASE k WHEN 10 THEN string_agg(w, ' ') OVER ten ELSE string_agg(w, ' ') OVER twenty END AS code, n FROM each
      WINDOW ten AS (PARTITION BY document_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING), twenty AS (PARTITION BY document_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
    again AS (SELECT document_id, k, i FROM (SELECT *, min(i) OVER (PARTITION BY document_id, code) AS head FROM runs WHERE i <= n - k + 1) WHERE i > head),
    covered AS (SELECT document_id, sum(least(k, coalesce(next - i, k))) AS repeated FROM (SELECT *, lead(i) OVER (PARTITION BY document_id ORDER BY i) AS next FROM again) GROUP BY document_id),
    shares AS (SELECT n.document_id, len(n.u) AS units, CAST(coalesce(c.repeated, 0) AS BIGINT) AS repeated, CASE WHEN len(n.u) > 0 THEN coalesce(c.repeated, 0) / len(n.u) ELSE 0.0 END AS share FROM units n LEFT JOIN covered c ON c.document_id = n.document_id)"""


@_query(f"{_REPEATED} SELECT document_id FROM shares WHERE share >= 0.3 AND document_id IN (SELECT doc_id FROM documents)")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which 0.3 or more only repeats earlier text."""
    present = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"))
    chunks = load(spark, sf_dir, "chunks").join(present, "document_id", "left_semi")
    return repetition(chunks, longest=False).filter("share >= 0.3").select("document_id")


@_query(f"{_REPEATED} SELECT document_id, units, repeated, round(share, 9) AS share FROM shares")
def p4_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated units of every document with chunks, catalogued or not."""
    return repetition(load(spark, sf_dir, "chunks"), longest=False).withColumn("share", F.round("share", 9))


@_query()
def p4_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated share and longest repeat of every document with chunks, catalogued or not."""
    return repetition(load(spark, sf_dir, "chunks"))


@_query()
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that hold markup, by kind."""
    return cleaned(spread(load(spark, sf_dir, "chunks"))).select("id", F.explode("markup").alias("markup"))


@_query()
def p5_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that hold markup as clean text."""
    return cleaned(spread(load(spark, sf_dir, "chunks")))


@_query()
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with garbled characters, restorable or not."""
    return restore_chunks(spread(load(spark, sf_dir, "chunks")), rare=False).select("id")


@_query()
def p6_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The garbled chunks with their text restored as far as possible."""
    return restore_chunks(spread(load(spark, sf_dir, "chunks")))


@_query()
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are mostly lists, tables or junk, by the learned rules."""
    present = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"))
    kinds = classify(statistics(spread(load(spark, sf_dir, "chunks")))).filter("text_kind IN ('list', 'table', 'junk')")
    return kinds.join(present, "document_id", "left_semi").select("document_id", "text_kind")


@_query()
def p7_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text statistics and kind of every document with chunks."""
    return classify(statistics(spread(load(spark, sf_dir, "chunks"))))


@_query()
def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers of 2,048 tokens filled with the texts of all documents."""
    return pack_documents(spread(load(spark, sf_dir, "documents")))


@_query()
def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    return fill_report(pack_documents(spread(load(spark, sf_dir, "documents"))))


@_query()
def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest mixture of the sources at their target shares."""
    return mix(source_sizes(spread(load(spark, sf_dir, "documents"))), load(spark, sf_dir, "mix_targets"))


@_query()
def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that the mixture reaches."""
    targets = load(spark, sf_dir, "mix_targets")
    return reached(mix(source_sizes(spread(load(spark, sf_dir, "documents"))), targets), targets)


@_query()
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of the documents whose label is missing, wrong or too narrow."""
    return mislabelled(spread(load(spark, sf_dir, "documents"))).select("doc_id", "lang_code")


@_query()
def p10_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of one language in every document, with confidence."""
    documents = spread(load(spark, sf_dir, "documents"))
    return label_segments(documents, fit(documents)).drop("claimed")
