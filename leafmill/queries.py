"""Core queries over the catalogue tables, each with the SQL that must give the same rows.

Timestamps come out as microseconds and lists as joined text, so that two engines can be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import catalog as C
from leafmill.operators import search as S
from leafmill.operators.chunking import BLANK, SEPARATORS, STRATEGIES, Chunking, chunk, word_chunks
from leafmill.operators.incremental import due
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


_US = ("created_at", "updated_at", "loaded_at")


def _plain(df: DataFrame) -> DataFrame:
    """Timestamps as microseconds."""
    return df.select(*[F.unix_micros(c).alias(f"{c}_us") if c in _US else F.col(c) for c in df.columns])


#: Current state of each catalogued document.
_CURRENT = """current_docs AS (
  SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(updated_at, created_at) DESC NULLS LAST, loaded_at DESC NULLS LAST,
    kb_id DESC NULLS LAST, filename DESC NULLS LAST, original_name DESC NULLS LAST, file_type DESC NULLS LAST, file_size DESC NULLS LAST, file_path DESC NULLS LAST,
    total_chunks DESC NULLS LAST, status DESC NULLS LAST, error_message DESC NULLS LAST, created_at DESC NULLS LAST, updated_at DESC NULLS LAST) AS r
  FROM catalog_documents WHERE id IS NOT NULL) WHERE r = 1)"""
_LINKS = """links AS (SELECT DISTINCT document_id, kb_id FROM document_knowledge_bases),
named AS (SELECT l.document_id, string_agg(CAST(k.id AS VARCHAR), ',' ORDER BY k.id) AS kb_ids, string_agg(k.name, ', ' ORDER BY k.id) AS kb_names
  FROM links l JOIN knowledge_bases k ON k.id = l.kb_id GROUP BY l.document_id)"""
_DOC_COLUMNS = "d.id, d.kb_id, d.original_name, d.file_type, d.file_size, d.total_chunks, d.status, epoch_us(d.created_at) AS created_at_us, n.kb_ids, n.kb_names"


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return C.current_documents(load(spark, d, "catalog_documents"))


def _shown(df: DataFrame, *more: str) -> DataFrame:
    return _plain(df.select("id", "kb_id", "original_name", "file_type", "file_size", "total_chunks", "status", "created_at", "kb_ids", "kb_names", *more))


# ------------------------------------------------------------------ incremental processing


@_query(
    """
    WITH states AS (
      SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(updated_at, created_at) DESC NULLS LAST, loaded_at DESC NULLS LAST) AS r
      FROM catalog_documents WHERE id IS NOT NULL)
    SELECT id FROM states s
    WHERE r = 1 AND lower(trim(status)) = 'completed'
      AND NOT EXISTS (SELECT 1 FROM index_run_items i WHERE i.document_id = s.id AND i.updated_at = s.updated_at AND i.outcome = 'done')
    """
)
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue ids whose current finished state no run has processed."""
    return due(spark, load(spark, sf_dir, "catalog_documents"), load(spark, sf_dir, "index_run_items")).select("id")


# ------------------------------------------------------------------ catalogue: lookups, lists, joins


@_query(f"WITH {_CURRENT} SELECT * EXCLUDE (created_at, updated_at, loaded_at), epoch_us(created_at) AS created_at_us, epoch_us(updated_at) AS updated_at_us, epoch_us(loaded_at) AS loaded_at_us FROM current_docs")
def cat_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current state of every document."""
    return _plain(_documents(spark, sf_dir))


@_query(f"WITH {_CURRENT} SELECT id, original_name, status FROM current_docs WHERE id = 100")
def flt_get_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document by id."""
    return _documents(spark, sf_dir).filter("id = 100").select("id", "original_name", "status")


@_query(f"WITH {_CURRENT}, {_LINKS} SELECT {_DOC_COLUMNS} FROM current_docs d LEFT JOIN named n ON n.document_id = d.id")
def lst_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their collections."""
    return _shown(C.list_documents(_documents(spark, sf_dir), load(spark, sf_dir, "document_knowledge_bases"), load(spark, sf_dir, "knowledge_bases")))


@_query(f"WITH {_CURRENT}, {_LINKS} SELECT {_DOC_COLUMNS} FROM current_docs d LEFT JOIN named n ON n.document_id = d.id WHERE d.status = 'completed'")
def lst_documents_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one status with their collections."""
    return _shown(C.list_documents(_documents(spark, sf_dir), load(spark, sf_dir, "document_knowledge_bases"), load(spark, sf_dir, "knowledge_bases"), "completed"))


@_query(f"WITH {_CURRENT}, {_LINKS} SELECT {_DOC_COLUMNS} FROM current_docs d LEFT JOIN named n ON n.document_id = d.id WHERE d.id IN (SELECT document_id FROM links WHERE kb_id = 4)")
def lst_documents_by_kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked to one collection, with all their collections."""
    return _shown(C.list_documents_by_knowledge_base(_documents(spark, sf_dir), load(spark, sf_dir, "document_knowledge_bases"), load(spark, sf_dir, "knowledge_bases"), 4))


@_query("SELECT id, name, description, epoch_us(created_at) AS created_at_us FROM knowledge_bases")
def lst_knowledge_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All collections, newest first."""
    return _plain(C.list_knowledge_bases(load(spark, sf_dir, "knowledge_bases")))


@_query("SELECT id, document_id, chunk_index, content, token_count FROM chunks WHERE document_id = 7")
def lst_chunks_of_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of one document in order; document 7 holds a tenth of all."""
    return load(spark, sf_dir, "chunks").filter("document_id = 7").orderBy("chunk_index").select("id", "document_id", "chunk_index", "content", "token_count")


@_query(f"WITH {_CURRENT} SELECT id, original_name FROM current_docs WHERE contains(lower(original_name), 'report')")
def flt_documents_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose name contains a keyword."""
    return C.filter_documents(_documents(spark, sf_dir), "Report").select("id", "original_name")


@_query(
    f"""WITH {_CURRENT}, {_LINKS}
    SELECT d.id, d.original_name, upper(d.file_type) AS file_type, coalesce(n.kb_names, '未关联') AS kb_names, printf('%.2f', coalesce(d.file_size, 0) / 1048576.0) || ' MB' AS size,
      coalesce(d.total_chunks, 0) AS total_chunks, d.status FROM current_docs d LEFT JOIN named n ON n.document_id = d.id"""
)
def fn_display_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document list as it is shown."""
    return C.display(C.kb_names(_documents(spark, sf_dir), load(spark, sf_dir, "document_knowledge_bases"), load(spark, sf_dir, "knowledge_bases")))


@_query(
    f"""WITH {_CURRENT}, links AS (SELECT DISTINCT document_id, kb_id FROM document_knowledge_bases),
    home AS (SELECT d.id AS document_id, d.kb_id FROM current_docs d JOIN knowledge_bases k ON k.id = d.kb_id WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.document_id = d.id AND l.kb_id = d.kb_id)),
    linked AS (SELECT document_id FROM links UNION SELECT document_id FROM home)
    SELECT * FROM home UNION SELECT id, CAST(1 AS BIGINT) FROM current_docs WHERE id NOT IN (SELECT document_id FROM linked WHERE document_id IS NOT NULL)"""
)
def jn_missing_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that repair adds."""
    return C.missing_home_links(_documents(spark, sf_dir), load(spark, sf_dir, "document_knowledge_bases"), load(spark, sf_dir, "knowledge_bases"))


@_query(f"WITH {_CURRENT} SELECT c.id, c.document_id, c.chunk_index, d.original_name, d.file_type, d.file_path FROM chunks c JOIN current_docs d ON d.id = c.document_id")
def jn_chunks_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with the name, type and path of their document."""
    documents = _documents(spark, sf_dir).select(F.col("id").alias("document_id"), "original_name", "file_type", "file_path")
    return load(spark, sf_dir, "chunks").select("id", "document_id", "chunk_index").join(documents, "document_id")


@_query("SELECT document_id, count(DISTINCT chunk_index) AS total_chunks FROM chunks GROUP BY document_id")
def agg_chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of places each document has chunks in."""
    return C.chunk_counts(load(spark, sf_dir, "chunks"))


@_query(
    """WITH once AS (SELECT document_id, chunk_index, arg_min(content, id) AS content FROM chunks WHERE document_id IS NOT NULL AND content IS NOT NULL GROUP BY ALL)
    SELECT document_id, coalesce(chunk_index // 4096, 0) AS part, string_agg(content, chr(10) || chr(10) ORDER BY chunk_index) AS text FROM once GROUP BY ALL"""
)
def agg_document_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of each document, put together from its chunks."""
    return C.document_text(load(spark, sf_dir, "chunks"))


# ------------------------------------------------------------------ lists in order: their first page


#: Rows of a page.
_PAGE_ROWS = 200


def _placed(listed: DataFrame, *order) -> DataFrame:
    """The first page of a sorted list with the place of each row."""
    return listed.limit(_PAGE_ROWS).withColumn("place", F.row_number().over(Window.orderBy(*order)))


@_query(f"WITH {_CURRENT}, {_LINKS} SELECT {_DOC_COLUMNS}, row_number() OVER (ORDER BY d.created_at DESC NULLS LAST, d.id DESC) AS place FROM current_docs d LEFT JOIN named n ON n.document_id = d.id ORDER BY d.created_at DESC NULLS LAST, d.id DESC LIMIT {_PAGE_ROWS}")
def srt_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest documents, in order."""
    listed = C.list_documents(_documents(spark, sf_dir), load(spark, sf_dir, "document_knowledge_bases"), load(spark, sf_dir, "knowledge_bases"))
    return _shown(_placed(listed, F.col("created_at").desc(), F.col("id").desc()), "place")


@_query(f"WITH {_CURRENT}, {_LINKS} SELECT {_DOC_COLUMNS}, row_number() OVER (ORDER BY d.created_at DESC NULLS LAST, d.id DESC) AS place FROM current_docs d LEFT JOIN named n ON n.document_id = d.id WHERE d.id IN (SELECT document_id FROM links WHERE kb_id = 4) ORDER BY d.created_at DESC NULLS LAST, d.id DESC LIMIT {_PAGE_ROWS}")
def srt_documents_by_kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest documents of one collection, in order."""
    listed = C.list_documents_by_knowledge_base(_documents(spark, sf_dir), load(spark, sf_dir, "document_knowledge_bases"), load(spark, sf_dir, "knowledge_bases"), 4)
    return _shown(_placed(listed, F.col("created_at").desc(), F.col("id").desc()), "place")


@_query("SELECT id, name, row_number() OVER (ORDER BY created_at DESC NULLS LAST, id DESC) AS place FROM knowledge_bases")
def srt_knowledge_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All collections in order."""
    return _placed(C.list_knowledge_bases(load(spark, sf_dir, "knowledge_bases")), F.col("created_at").desc(), F.col("id").desc()).select("id", "name", "place")


@_query(f"SELECT id, chunk_index, row_number() OVER (ORDER BY chunk_index, id) AS place FROM (SELECT DISTINCT id, chunk_index FROM chunks WHERE document_id = 7) ORDER BY chunk_index, id LIMIT {_PAGE_ROWS}")
def srt_chunks_of_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first chunks of one document in order, each id once."""
    chunks = load(spark, sf_dir, "chunks").filter("document_id = 7").select("id", "chunk_index").distinct()
    return _placed(chunks.orderBy("chunk_index", "id"), "chunk_index", "id").select("id", "chunk_index", "place")


@_query(f"""WITH {_CURRENT} SELECT k.id, k.name, CAST(count(DISTINCT l.document_id) AS BIGINT) AS documents FROM knowledge_bases k
    LEFT JOIN (SELECT kb_id, document_id FROM document_knowledge_bases WHERE document_id IN (SELECT id FROM current_docs)) l ON l.kb_id = k.id GROUP BY k.id, k.name""")
def agg_documents_of_kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of documents linked to each collection."""
    return C.with_document_counts(load(spark, sf_dir, "knowledge_bases"), load(spark, sf_dir, "document_knowledge_bases"), _documents(spark, sf_dir)).select("id", "name", "documents")


# ------------------------------------------------------------------ search

_TERMS = ("warranty", "sheet")
_SNIPPET = """CASE WHEN {p} = 0 THEN left(content, 180) || CASE WHEN length(content) > 180 THEN '...' ELSE '' END
  ELSE CASE WHEN {p} - 1 > 90 THEN '...' ELSE '' END
    || regexp_replace(substring(content, greatest({p} - 90, 1), least(length(content), {p} - 1 + 90) - greatest({p} - 91, 0)), '^[\\t-\\r \\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+|[\\t-\\r \\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+$', '', 'g')
    || CASE WHEN {p} - 1 + 90 < length(content) THEN '...' ELSE '' END END"""


def _search_sql(match: str, terms: tuple[str, ...], rows: str = "", extra: str = "") -> str:
    """SQL of a search whose hits satisfy ``match``."""
    first = "coalesce(list_min(list_filter([" + ", ".join(f"strpos(lower(content), '{t.lower()}')" for t in terms) + "], lambda x: x > 0)), 0)"
    matched = " || ".join(f"CASE WHEN contains(lower(content), '{t.lower()}') THEN '{t}|' ELSE '' END" for t in terms)
    return f"""WITH {_CURRENT}, toks AS (
      SELECT *, regexp_extract_all(strip_accents(lower(content)), '[\\p{{L}}\\p{{N}}]+') AS t, ' ' || array_to_string(regexp_extract_all(strip_accents(lower(content)), '[\\p{{L}}\\p{{N}}]+'), ' ') || ' ' AS phrase FROM chunks),
    hits AS (SELECT c.id, c.document_id, c.chunk_index, c.content, d.original_name FROM toks c JOIN current_docs d ON d.id = c.document_id WHERE ({match}) {extra} {rows}),
    placed AS (SELECT *, {first} AS p FROM hits)
    SELECT id, document_id, chunk_index, original_name, rtrim({matched}, '|') AS matched_terms, {_SNIPPET.format(p="p")} AS snippet FROM placed"""


def _found(df: DataFrame) -> DataFrame:
    return df.select("id", "document_id", "chunk_index", "original_name", F.array_join("matched_terms", "|").alias("matched_terms"), "snippet")


def _search(spark: SparkSession, d: str, query: str, **options) -> DataFrame:
    chunks = load(spark, d, "chunks")
    return _found(S.search(chunks, _documents(spark, d), load(spark, d, "document_knowledge_bases"), query, index=S.stored_index(chunks, d), **options))


@_query(_search_sql("list_contains(t, 'warranty') AND list_contains(t, 'sheet')", _TERMS))
def search_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with all terms, through the inverted index."""
    return _search(spark, sf_dir, "warranty，sheet", limit=None)


@_query(_search_sql("list_contains(t, 'warranty') OR list_contains(t, 'pump')", ("Warranty", "PUMP")))
def search_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with one of the terms."""
    return _search(spark, sf_dir, "Warranty; PUMP", match_mode="any", limit=None)


@_query(_search_sql("contains(phrase, ' long term ') OR contains(phrase, ' naive ')", ("long-term", "naïve")))
def search_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A term of two tokens is a phrase; accents do not count."""
    return _search(spark, sf_dir, "long-term naïve", match_mode="any", limit=None)


@_query(_search_sql("list_contains(t, 'warranty')", ("warranty",), extra="AND d.id IN (SELECT document_id FROM document_knowledge_bases WHERE kb_id = 1)"))
def search_in_kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search within one collection."""
    return _search(spark, sf_dir, "warranty", kb_id=1, limit=None)


@_query(_search_sql("contains(translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '保险证')", ("保险证",)))
def search_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part of a Chinese run is no token; the substring branch finds it."""
    return _search(spark, sf_dir, "保险证", limit=None)


@_query(_search_sql("list_contains(t, 'warranty')", ("warranty",), rows="ORDER BY d.original_name, c.chunk_index, c.id LIMIT 500"))
def search_top_500(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 500 hits by document name and place, which is the default."""
    return _search(spark, sf_dir, "warranty")


@_query(
    """WITH w AS (SELECT document_id, id, unnest(regexp_extract_all(translate(lower(content), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďđēĕėęěĝğġģĥĩīĭįıĵķĺļľłńņňōŏőŕŗřśŝşšţťŧũūŭůűųŵŷźżž', 'aaaaaaceeeeiiiinooooouuuuyyaaaccccddeeeeegggghiiiiijkllllnnnooorrrsssstttuuuuuuwyzzz'), '[\\p{L}\\p{N}\\p{Co}]+')) AS token FROM chunks)
    SELECT token, count(*) AS n, count(DISTINCT id) AS chunks FROM w GROUP BY token"""
)
def fts_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often, and in how many chunks, each token of the content stands, out of the stored index."""
    return S.stored_index(load(spark, sf_dir, "chunks"), sf_dir).rows().filter("col = 'content'").groupBy("token").agg(F.count("*").alias("n"), F.count_distinct("chunk_id").alias("chunks"))


@_query(
    """WITH hits AS (SELECT DISTINCT id, document_id, chunk_index FROM chunks WHERE contains(content, 'warranty sheet'))
    SELECT h.id, string_agg(CAST(c.id AS VARCHAR), ',' ORDER BY c.chunk_index, c.id) AS context FROM hits h JOIN (SELECT DISTINCT id, document_id, chunk_index FROM chunks) c
      ON c.document_id = h.document_id AND c.chunk_index BETWEEN h.chunk_index - 1 AND h.chunk_index + 1 GROUP BY h.id"""
)
def win_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with their neighbours in the document."""
    chunks = load(spark, sf_dir, "chunks").dropDuplicates(["id"])
    documents = chunks.select(F.col("document_id").alias("id")).distinct().select("id", *[F.lit(None).cast("string").alias(c) for c in ("original_name", "file_type", "file_path", "total_chunks")])
    hits = chunks.filter(F.contains("content", F.lit("warranty sheet"))).select("id")
    return S.context(chunks, documents, hits).select("id", F.array_join(F.transform("context", lambda c: c["id"].cast("string")), ",").alias("context"))


@_query(
    """WITH c AS (SELECT DISTINCT id, document_id, chunk_index FROM chunks)
    SELECT h.id, string_agg(CAST(c.id AS VARCHAR), ',' ORDER BY c.chunk_index, c.id) AS context FROM c h JOIN c ON c.document_id = h.document_id AND c.chunk_index BETWEEN h.chunk_index - 2 AND h.chunk_index + 2 GROUP BY h.id"""
)
def win_context_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk with two neighbours on either side, by a window."""
    once = load(spark, sf_dir, "chunks").dropDuplicates(["id"])
    return S.context_windows(once, 2).select("id", F.array_join(F.transform("context", lambda c: c["id"].cast("string")), ",").alias("context"))


# ------------------------------------------------------------------ text functions

_WS = "\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
_WS_IN_LINE = _WS.replace("\\t-\\r", "\\t\\x{0b}\\x{0c}\\r")
_STRIP = f"'^[{_WS}]+|[{_WS}]+$', '', 'g'"


@_query(
    f"""SELECT id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'),
      '[\\x{{200b}}-\\x{{200d}}\\x{{feff}}\\x{{2028}}\\x{{2029}}\\x{{ad}}\\x{{202a}}-\\x{{202e}}]', '', 'g'), '[{_WS_IN_LINE}]{{3,}}', ' ', 'g'), '\\n{{4,}}', repeat(chr(10), 3), 'g'), '[{_WS_IN_LINE}]+(\\n|\\z)', '\\1', 'g'), {_STRIP})) AS cleaned FROM chunks"""
)
def fn_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned content of every chunk, as a digest."""
    return load(spark, sf_dir, "chunks").select("id", F.md5(T.clean_text(F.col("content"))).alias("cleaned"))


@_query(
    f"""WITH a AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(content, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g'), '(?i)</(?:p|div|h[1-6]|li|tr|pre|blockquote)\\s*>|<br\\s*/?>', chr(10), 'g'), '<[^>]+>', '', 'g') AS t FROM chunks),
    b AS (SELECT id, replace(replace(replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', chr(160)), '&middot;', '·'), '&copy;', '©'), '&amp;', '&') AS t FROM a)
    SELECT id, md5(array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, {_STRIP})), lambda x: x <> ''), chr(10))) AS plain FROM b"""
)
def fn_html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content of every chunk with HTML taken off, as a digest."""
    return load(spark, sf_dir, "chunks").select("id", F.md5(T.html_to_text(F.col("content"))).alias("plain"))


def _in(types) -> str:
    return "(" + ", ".join(f"'{t}'" for t in sorted(types)) + ")"


@_query(
    f"""WITH d AS (SELECT id, max(lower(trim(file_type))) AS file_type FROM catalog_documents GROUP BY id),
    m AS (SELECT c.id, coalesce(d.file_type, '') AS k, length(regexp_replace(c.content, {_STRIP})) AS n, CASE WHEN length(c.content) > 0 THEN length(regexp_replace(c.content, '[^\\p{{L}}\\p{{Nd}}]', '', 'g')) / length(c.content) ELSE 0 END AS r
      FROM chunks c LEFT JOIN d ON d.id = c.document_id)
    SELECT id, k AS file_type, round(r, 6) AS ratio, CASE WHEN n = 0 THEN 'very_low' WHEN k IN {_in((*T.AUDIO, *T.VIDEO))} THEN CASE WHEN n > 100 AND r > 0.3 THEN 'high' WHEN n > 20 THEN 'medium' ELSE 'low' END
      WHEN k IN {_in(T.CODE)} THEN CASE WHEN n > 100 THEN 'high' ELSE 'medium' END
      WHEN n > 1000 AND r > 0.5 THEN 'high' WHEN n > 200 AND r > 0.3 THEN 'medium' WHEN n > 50 THEN 'low' ELSE 'very_low' END AS level FROM m"""
)
def fn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of letters and grade of every chunk by the type of its document; code, sounds and films have rules of their own."""
    kinds = load(spark, sf_dir, "catalog_documents").groupBy(F.col("id").alias("document_id")).agg(F.max(F.lower(F.trim("file_type"))).alias("file_type"))
    chunks = load(spark, sf_dir, "chunks").join(kinds, "document_id", "left")
    return chunks.select("id", F.coalesce("file_type", F.lit("")).alias("file_type"), F.round(T.meaningful_ratio(F.col("content")), 6).alias("ratio"), T.quality(F.col("content"), F.col("file_type"))["level"].alias("level"))


@_query(f"SELECT id, CAST(nullif(regexp_extract(content, '\\[第[{_WS}]*([0-9]+)[{_WS}]*页\\]', 1), '') AS INTEGER) AS page FROM chunks")
def fn_page_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page that a chunk stands on, by its first marker."""
    return load(spark, sf_dir, "chunks").select("id", T.page_number(F.col("content")).alias("page"))


@_query("""SELECT id, md5(replace(replace(regexp_replace(replace(replace(replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'),
    '(?i)warranty', '<mark>\\0</mark>', 'g'), chr(10), '<br>'), '<mark>', '<span style="color:#1e1e2e; background-color:#f9e2af; font-weight:700; padding:1px 3px;">')) AS html FROM chunks""".replace("'<mark>\\0</mark>'", "'<mark>\\0</span>'"))
def fn_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content as HTML with a term marked, as a digest."""
    return load(spark, sf_dir, "chunks").select("id", F.md5(T.highlight(F.col("content"), ["warranty"])).alias("html"))


@_query(
    f"""WITH {_CURRENT} SELECT id, CASE WHEN file_size < 1024 THEN CAST(file_size AS VARCHAR) || ' B' WHEN file_size < 1048576 THEN printf('%.1f', file_size / 1024.0) || ' KB'
      WHEN file_size < 1073741824 THEN printf('%.1f', file_size / 1048576.0) || ' MB' ELSE printf('%.2f', file_size / 1073741824.0) || ' GB' END AS size,
    CASE WHEN file_size // 3600 > 0 THEN file_size // 3600 || '时' || lpad(CAST(file_size % 3600 // 60 AS VARCHAR), 2, '0') || '分' || lpad(CAST(file_size % 60 AS VARCHAR), 2, '0') || '秒'
      WHEN file_size // 60 > 0 THEN file_size // 60 || '分' || lpad(CAST(file_size % 60 AS VARCHAR), 2, '0') || '秒' ELSE CAST(file_size AS VARCHAR) || '秒' END AS duration,
    lower(regexp_extract(file_path, '\\.([^./]+)$', 1)) AS extension, list_last(string_split(file_path, '/')) AS base_name,
    array_to_string(list_filter(regexp_split_to_array(translate(replace(original_name, '_', ' '), '，,；;', '    '), '[{_WS}]+'), lambda t: t <> ''), '|') AS keywords FROM current_docs"""
)
def fn_display_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, durations, file names and keywords as text."""
    size, path = F.col("file_size"), F.col("file_path")
    return _documents(spark, sf_dir).select(
        "id", T.size_text(size).alias("size"), T.duration_text(size).alias("duration"), T.extension(path).alias("extension"), T.base_name(path).alias("base_name"),
        F.array_join(T.keywords(F.replace("original_name", F.lit("_"), F.lit(" "))), "|").alias("keywords"),
    )


@_query("SELECT o_orderkey, CASE WHEN o_orderkey >= 1 AND o_orderkey < 2958466 THEN CAST(CAST(DATE '1899-12-30' + CAST(o_orderkey + CASE WHEN o_orderkey < 60 THEN 1 ELSE 0 END AS INTEGER) AS DATE) AS VARCHAR) END AS day FROM orders")
def fn_excel_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers read as Excel dates."""
    return load(spark, sf_dir, "orders").select("o_orderkey", T.excel_date(F.col("o_orderkey")).alias("day"))


@_query("SELECT id, CASE WHEN length(content) > 300 THEN left(content, 300) || chr(10) || chr(10) || '... (文本过长，已截断，共 ' || length(content) || ' 字符)' ELSE content END AS short, md5(regexp_replace(regexp_replace(content, '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g')) AS even FROM chunks")
def fn_truncate_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortened content, and the digest of content with even white space."""
    return load(spark, sf_dir, "chunks").select("id", T.truncate_text(F.col("content"), 300).alias("short"), F.md5(T.normalize_whitespace(F.col("content"))).alias("even"))


@_query("SELECT id, coalesce(length(trim(content, ' ')) > 0 AND length(regexp_replace(content, '[^\\p{L}\\p{Nd}]', '', 'g')) >= 0.3 * length(content), false) AS meaningful FROM chunks")
def fn_meaningful(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a chunk has a share of letters and digits."""
    return load(spark, sf_dir, "chunks").select("id", T.is_meaningful(F.col("content")).alias("meaningful"))


@_query(f"""SELECT id, md5(regexp_replace(regexp_replace(content, chr(65533) || '{{3,}}', '', 'g'), '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}\\x{{24b6}}-\\x{{24e9}}\\x{{200c}}\\x{{200d}}{_WS}\\x1c-\\x1f.,;:!?''"()\\-+=/@#%&*，。；：！？、“”‘’（）【】《》]+', '', 'g')) AS plain FROM chunks""")
def fn_remove_garbage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content without signs that text is not written with, as a digest."""
    return load(spark, sf_dir, "chunks").select("id", F.md5(T.remove_garbage(F.col("content"))).alias("plain"))


@_query(
    """WITH g AS (SELECT c_nationkey AS nation, 'k' || c_custkey || ' | ' || c_name AS line, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)
    SELECT nation, 'key | name' || chr(10) || string_agg(line, chr(10) ORDER BY i) FILTER (WHERE i <= 50) || CASE WHEN max(n) > 50 THEN chr(10) || '... 共 ' || max(n) || ' 行数据（已截取前 50 行）' ELSE '' END AS "table" FROM g GROUP BY nation"""
)
def fn_table_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers of each nation as a table in text, shortened to what a table shows."""
    rows = load(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))).alias("r"))
    cells = F.transform("r", lambda c: F.array(F.concat(F.lit("k"), c["c_custkey"].cast("string")), c["c_name"]))
    return rows.select("nation", T.table_text(F.array(F.lit("key"), F.lit("name")), cells, 50).alias("table"))


@_query("SELECT o_orderkey, CAST((o_orderkey % 26 + 1) * 26 + o_orderkey // 26 % 26 AS INTEGER) AS col, CAST(o_orderkey % 1000 AS INTEGER) AS row FROM orders")
def fn_cell_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column and row of cell references made from numbers."""
    k = F.col("o_orderkey")
    ref = F.concat(F.char(k % 26 + 65), F.char(F.floor(k / 26) % 26 + 97), (k % 1000 + 1).cast("string"))
    return load(spark, sf_dir, "orders").select("o_orderkey", T.cell_address(ref).alias("a")).select("o_orderkey", "a.col", "a.row")


@_query(f"""SELECT p_partkey, p_size IN ({", ".join(map(str, T.DATE_FORMATS))}) OR regexp_matches(regexp_replace('"' || p_name || '"0.0[' || p_brand || ']' || CASE WHEN p_partkey % 3 = 0 THEN 'yyyy' ELSE '' END, '"[^"]*"|\\[[^\\]]*\\]|\\\\.|_.', '', 'g'), '[yYmMdDhHsS]') AS dates FROM part""")
def fn_date_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether number formats show dates; quoted and bracketed parts do not count."""
    code = F.concat(F.lit('"'), "p_name", F.lit('"0.0['), "p_brand", F.lit("]"), F.when(F.col("p_partkey") % 3 == 0, "yyyy").otherwise(""))
    return load(spark, sf_dir, "part").select("p_partkey", T.is_date_format(F.col("p_size"), code).alias("dates"))


@_query("""SELECT id, NOT (length(content) > 10 AND length(regexp_replace(content, '[^0-9a-fA-F]', '', 'g')) > 0.8 * length(content)) AND NOT regexp_matches(content, '^\\{?[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-')
    AND length(regexp_replace(content, '[^\\\\/]', '', 'g')) <= length(content) / 4 AS fragment FROM chunks""")
def fn_fragment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a chunk would pass for text among the runs of characters of a binary file."""
    return load(spark, sf_dir, "chunks").select("id", T.is_fragment(F.col("content")).alias("fragment"))


@_query(
    """WITH c AS (SELECT DISTINCT id, document_id, chunk_index, content FROM chunks),
    e AS (SELECT id, document_id, chunk_index, replace(replace(replace(replace(replace(replace(coalesce(content, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;'), chr(10), '<br>') AS body FROM c)
    SELECT h.id, md5(string_agg('[' || CASE WHEN e.id = h.id THEN '命中片段' ELSE '上下文片段' END || ' ' || (e.chunk_index + 1) || ']<br>' || e.body, '<br><br>' ORDER BY e.chunk_index, e.id)) AS page
    FROM c h JOIN e ON e.document_id = h.document_id AND e.chunk_index BETWEEN h.chunk_index - 1 AND h.chunk_index + 1 GROUP BY h.id"""
)
def fn_context_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk with its neighbours as one page, as a digest."""
    once = load(spark, sf_dir, "chunks").dropDuplicates(["id"])
    return S.context_windows(once, 1).select("id", F.md5(T.context_html(F.col("context"), F.col("id"), [])).alias("page"))


# ------------------------------------------------------------------ chunking


@_query(
    """WITH w AS (SELECT doc_id AS document_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS t FROM documents WHERE text IS NOT NULL),
    k AS (SELECT document_id, t, unnest(range(CASE WHEN len(t) = 0 THEN 0 ELSE 1 + greatest(0, CAST(ceil((len(t) - 128) / 112.0) AS BIGINT)) END)) AS i FROM w)
    SELECT document_id, CAST(i AS INTEGER) AS chunk_index, md5(array_to_string(t[i * 112 + 1 : i * 112 + 128], ' ')) AS content, len(t[i * 112 + 1 : i * 112 + 128]) AS token_count FROM k"""
)
def ch_fixed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 128 words with an overlap of 16, natively."""
    cut = word_chunks(load(spark, sf_dir, "documents"), 128, 16, "doc_id")
    return cut.select("document_id", "chunk_index", F.md5("content").alias("content"), "token_count")


def _chunk_query(strategy: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return chunk(spread(load(spark, sf_dir, "documents")), Chunking(512, 64, strategy), "doc_id")

    run.__name__, run.__doc__ = f"ch_{strategy}", f"Chunks of all documents, strategy {strategy}."
    _query()(run)


for _s in STRATEGIES:
    _chunk_query(_s)

# The strategies with words between blanks as tokens, in chunks of 128 with an overlap of 16, as SQL.
_SPACE = _WS.replace("\\t-\\r", "\\t-\\r\\x1c-\\x20")


def _stripped(x: str) -> str:
    return f"regexp_replace({x}, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')"


def _parts(split: str, of: str = "(SELECT doc_id AS d, '' AS path, text AS x FROM documents WHERE text <> '')") -> str:
    """The parts of each text that hold more than blanks: text, words and their number, numbered by ``j``."""
    each = f"SELECT d, path, unnest(a) AS x, generate_subscripts(a, 1) AS o FROM (SELECT d, path, {split} AS a FROM {of})"
    return f"(SELECT *, len(w) AS n, row_number() OVER (PARTITION BY d, path ORDER BY o) AS j FROM (SELECT d, path, o, {_stripped('x')} AS x, list_filter(regexp_split_to_array(x, '[{_SPACE}]+'), lambda v: v <> '') AS w FROM ({each})) WHERE x <> '')"


def _fixed(words: str) -> str:
    """Windows over a list of words, as a list of structs."""
    return f"list_transform(range(0, CAST(1 + greatest(0, ceil((len({words}) - 128) / 112.0)) AS BIGINT)), lambda k: struct_pack(c := array_to_string({words}[k * 112 + 1 : k * 112 + 128], ' '), n := len({words}[k * 112 + 1 : k * 112 + 128])))"


_NUMBERED = "CAST(row_number() OVER (PARTITION BY d ORDER BY {order}) - 1 AS INTEGER) AS chunk_index"
_FULL = "len(held) > 0 AND coalesce(total, 0) + p.n > 128"
_LAST = "JOIN (SELECT d, max(j) AS m FROM p GROUP BY d) USING (d) WHERE r.j = m AND len(held) > 0"

_PARAGRAPH_SQL = f"""WITH RECURSIVE p AS {_parts("string_split(x, chr(10))")},
    r AS (SELECT d, CAST(0 AS BIGINT) AS j, CAST([] AS VARCHAR[]) AS held, CAST(NULL AS VARCHAR[]) AS done FROM p WHERE j = 1 UNION ALL
      SELECT r.d, p.j, CASE WHEN len(held) > 0 AND len(held) + p.n > 128 THEN list_concat(held[greatest(1, len(held) - 15) :], p.w) ELSE list_concat(held, p.w) END, CASE WHEN len(held) > 0 AND len(held) + p.n > 128 THEN held END
      FROM r JOIN p ON p.d = r.d AND p.j = r.j + 1),
    e AS (SELECT d, j, done AS c FROM r WHERE done IS NOT NULL UNION ALL SELECT r.d, m + 1, held FROM r {_LAST})
    SELECT d AS document_id, {_NUMBERED.format(order="j")}, md5(array_to_string(c, ' ')) AS content, len(c) AS token_count FROM e"""
_SENTENCE_SQL = f"""WITH RECURSIVE p AS {_parts(f"string_split(regexp_replace(x, '([。！？.!?])[{_SPACE}]*', '\\1' || chr(57344), 'g'), chr(57344))")},
    r AS (SELECT d, CAST(0 AS BIGINT) AS j, CAST([] AS VARCHAR[]) AS held, CAST([] AS BIGINT[]) AS sizes, CAST(0 AS HUGEINT) AS total, CAST(NULL AS VARCHAR) AS done, CAST(0 AS HUGEINT) AS of FROM p WHERE j = 1 UNION ALL
      SELECT d, j, held, sizes, list_sum(sizes), done, of FROM (
        SELECT r.d, p.j, CASE WHEN {_FULL} THEN list_append(held[len(held) - greatest(1, len(held) // 4) + 1 :], p.x) ELSE list_append(held, p.x) END AS held,
          CASE WHEN {_FULL} THEN list_append(sizes[len(held) - greatest(1, len(held) // 4) + 1 :], p.n) ELSE list_append(sizes, p.n) END AS sizes, CASE WHEN {_FULL} THEN array_to_string(held, ' ') END AS done, total AS of
        FROM r JOIN p ON p.d = r.d AND p.j = r.j + 1)),
    e AS (SELECT d, j, done AS c, of AS n FROM r WHERE done IS NOT NULL UNION ALL SELECT r.d, m + 1, array_to_string(held, ' '), total FROM r {_LAST})
    SELECT d AS document_id, {_NUMBERED.format(order="j")}, md5(c) AS content, CAST(n AS INTEGER) AS token_count FROM e"""
# a heading may begin in the blank that ends the one before, so the mark is set twice
_MARKED = f"regexp_replace({{}}, '\\n(#{{{{1,6}}}}[{_SPACE}]|\\[第?[0-9]+页\\]|\\[表格\\]|\\[工作表)', chr(57344) || '\\1', 'g')".replace(_SPACE, _SPACE.replace("{", "{{").replace("}", "}}"))
_SEMANTIC_SQL = f"""WITH RECURSIVE p AS {_parts(f"string_split({_MARKED.format(_MARKED.format('x'))}, chr(57344))")},
    r AS (SELECT d, CAST(0 AS BIGINT) AS j, CAST([] AS VARCHAR[]) AS held, CAST(0 AS HUGEINT) AS total, CAST([] AS STRUCT(c VARCHAR, n BIGINT)[]) AS done FROM p WHERE j = 1 UNION ALL
      SELECT r.d, p.j, CASE WHEN p.n > 128 THEN CAST([] AS VARCHAR[]) WHEN total + p.n > 128 THEN [p.x] ELSE list_append(held, p.x) END, CASE WHEN p.n > 128 THEN 0 WHEN total + p.n > 128 THEN p.n ELSE total + p.n END,
        list_concat(CASE WHEN len(held) > 0 AND total + p.n > 128 THEN [struct_pack(c := array_to_string(held, chr(10) || chr(10)), n := CAST(total AS BIGINT))] ELSE CAST([] AS STRUCT(c VARCHAR, n BIGINT)[]) END,
          CASE WHEN p.n > 128 THEN {_fixed("p.w")} ELSE CAST([] AS STRUCT(c VARCHAR, n BIGINT)[]) END)
      FROM r JOIN p ON p.d = r.d AND p.j = r.j + 1),
    e AS (SELECT d, j, unnest(done) AS v, generate_subscripts(done, 1) AS o FROM r UNION ALL SELECT r.d, m + 1, struct_pack(c := array_to_string(held, chr(10) || chr(10)), n := CAST(total AS BIGINT)), 1 FROM r {_LAST})
    SELECT d AS document_id, {_NUMBERED.format(order="j, o")}, md5(v.c) AS content, CAST(v.n AS INTEGER) AS token_count FROM e"""


def _recursive_sql() -> str:
    """One level of packing for each separator; groups that are too long go to the next, at last to the windows."""
    levels, done = [], []
    for i, sep in enumerate(SEPARATORS):
        text = "chr(10) || chr(10)" if sep == "\n\n" else "chr(10)" if sep == "\n" else f"'{sep}'"
        source = "(SELECT doc_id AS d, '' AS path, text AS x FROM documents WHERE text <> '')" if i == 0 else f"(SELECT * FROM g{i - 1} WHERE n > 128)"
        levels.append(f"""p{i} AS MATERIALIZED {_parts(f"string_split(x, {text})", source)},
    r{i} AS (SELECT d, path, j, CAST(n AS BIGINT) AS total, CAST(1 AS BIGINT) AS grp FROM p{i} WHERE j = 1 UNION ALL
      SELECT p.d, p.path, p.j, CASE WHEN r.total + p.n > 128 THEN p.n ELSE r.total + p.n END, CASE WHEN r.total + p.n > 128 THEN r.grp + 1 ELSE r.grp END FROM r{i} r JOIN p{i} p ON p.d = r.d AND p.path = r.path AND p.j = r.j + 1),
    g{i} AS MATERIALIZED (SELECT p.d, p.path || lpad(CAST(r.grp AS VARCHAR), 6, '0') AS path, string_agg(p.x, {text} ORDER BY p.j) AS x, CAST(sum(p.n) AS BIGINT) AS n FROM p{i} p JOIN r{i} r USING (d, path, j) GROUP BY p.d, p.path, r.grp)""")
        done.append(f"SELECT d, path, x AS c, n FROM g{i} WHERE n <= 128")
    last = f"g{len(SEPARATORS) - 1}"
    words = f"list_filter(regexp_split_to_array(x, '[{_SPACE}]+'), lambda v: v <> '')"
    done.append(f"SELECT d, path || lpad(CAST(o AS VARCHAR), 6, '0'), v.c, v.n FROM (SELECT d, path, unnest(f) AS v, generate_subscripts(f, 1) AS o FROM (SELECT d, path, {_fixed('w')} AS f FROM (SELECT d, path, {words} AS w FROM {last} WHERE n > 128)))")
    return f"WITH RECURSIVE {', '.join(levels)} SELECT d AS document_id, {_NUMBERED.format(order='path')}, md5(c) AS content, CAST(n AS INTEGER) AS token_count FROM ({' UNION ALL '.join(done)})"


def _word_chunk_query(strategy: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        cut = chunk(load(spark, sf_dir, "documents"), Chunking(128, 16, strategy, BLANK), "doc_id")
        return cut.select("document_id", "chunk_index", F.md5("content").alias("content"), "token_count")

    run.__name__, run.__doc__ = f"ch_{strategy}_blank", f"Chunks of all documents in words between blanks, strategy {strategy}, as digests."
    _query(sql)(run)


for _s, _q in (("paragraph", _PARAGRAPH_SQL), ("sentence", _SENTENCE_SQL), ("semantic", _SEMANTIC_SQL), ("recursive", _recursive_sql())):
    _word_chunk_query(_s, _q)


# ------------------------------------------------------------------ changes, as set operations


@_query(f"WITH {_CURRENT} SELECT c.id, c.chunk_index FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM current_docs d WHERE d.id = c.document_id AND d.status = 'failed')")
def dml_delete_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that are left when all failed documents are deleted."""
    failed = _documents(spark, sf_dir).filter("status = 'failed'").select("id")
    return C.without(load(spark, sf_dir, "chunks").select("id", "document_id", "chunk_index"), failed, "document_id").select("id", "chunk_index")


@_query(f"""WITH {_CURRENT}, gone AS (SELECT id FROM current_docs WHERE status = 'failed')
    SELECT 'documents' AS "table", count(*) AS n FROM current_docs WHERE id NOT IN (SELECT id FROM gone)
    UNION ALL SELECT 'chunks', count(*) FROM chunks WHERE document_id IS NULL OR document_id NOT IN (SELECT id FROM gone)
    UNION ALL SELECT 'document_knowledge_bases', count(*) FROM document_knowledge_bases WHERE document_id IS NULL OR document_id NOT IN (SELECT id FROM gone)""")
def dml_delete_everywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are left in each table when all failed documents are deleted with their links and chunks."""
    documents = _documents(spark, sf_dir)
    gone = documents.filter("status = 'failed'").select("id")
    kept = {"documents": (documents, "id"), "chunks": (load(spark, sf_dir, "chunks"), "document_id"), "document_knowledge_bases": (load(spark, sf_dir, "document_knowledge_bases"), "document_id")}
    counts = [C.without(rows.select(key), gone, key).agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, (rows, key) in kept.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@_query(f"WITH {_CURRENT}, n AS (SELECT document_id, CAST(count(DISTINCT chunk_index) AS INTEGER) AS n FROM chunks GROUP BY document_id) SELECT d.id, coalesce(n.n, 0) AS total_chunks FROM current_docs d LEFT JOIN n ON n.document_id = d.id")
def dml_update_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of chunks of every document, counted anew."""
    counts = C.chunk_counts(load(spark, sf_dir, "chunks")).select(F.col("document_id").alias("id"), F.col("total_chunks").cast("int").alias("n"))
    return _documents(spark, sf_dir).select("id").join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("total_chunks"))


@_query("SELECT document_id, kb_id FROM document_knowledge_bases WHERE kb_id NOT IN (SELECT id FROM knowledge_bases WHERE id % 7 = 4) OR kb_id IS NULL")
def dml_delete_knowledge_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that are left when some collections are deleted."""
    gone = load(spark, sf_dir, "knowledge_bases").filter("id % 7 = 4").select("id")
    return C.without(load(spark, sf_dir, "document_knowledge_bases").select("document_id", "kb_id"), gone, "kb_id")


@_query("SELECT document_id, kb_id FROM document_knowledge_bases UNION SELECT document_id, CAST(2 AS BIGINT) FROM document_knowledge_bases WHERE kb_id = 1")
def dml_copy_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links after the documents of one collection are copied to another."""
    links = load(spark, sf_dir, "document_knowledge_bases")
    return C.with_links(links, links.filter("kb_id = 1").select("document_id", F.lit(2).cast("long").alias("kb_id")))


@_query(
    """WITH m AS (SELECT DISTINCT document_id FROM document_knowledge_bases WHERE kb_id = 1)
    SELECT document_id, kb_id FROM document_knowledge_bases WHERE document_id NOT IN (SELECT document_id FROM m WHERE document_id IS NOT NULL) UNION SELECT document_id, CAST(2 AS BIGINT) FROM m"""
)
def dml_move_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links after the documents of one collection are moved to another."""
    links = load(spark, sf_dir, "document_knowledge_bases")
    return C.moved(links, links.filter("kb_id = 1").select("document_id", F.lit(2).cast("long").alias("kb_id")).distinct())


@_query(
    f"""WITH {_CURRENT}, c AS (SELECT document_id, count(DISTINCT chunk_index) AS n FROM chunks GROUP BY document_id)
    SELECT d.id, CASE WHEN c.n > 0 THEN 'completed' ELSE 'failed' END AS status, CASE WHEN c.n > 0 THEN NULL ELSE 'no chunks' END AS error_message FROM current_docs d LEFT JOIN c ON c.document_id = d.id"""
)
def dml_update_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of every document after a run, from whether it has chunks."""
    documents = _documents(spark, sf_dir)
    counts = C.chunk_counts(load(spark, sf_dir, "chunks")).withColumnRenamed("document_id", "_d")
    changes = documents.select("id").join(counts, F.col("id") == F.col("_d"), "left")
    done = F.coalesce(F.col("total_chunks") > 0, F.lit(False))
    changes = changes.select("id", F.when(done, "completed").otherwise("failed").alias("status"), F.when(~done, "no chunks").alias("error_message"))
    return C.with_status(documents, changes).select("id", "status", "error_message")


@_query(f"WITH {_CURRENT} SELECT d.id, d.kb_id, k.name FROM current_docs d JOIN knowledge_bases k ON k.id = d.kb_id")
def jn_home(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the name of their home collection."""
    return _documents(spark, sf_dir).select("id", "kb_id").join(load(spark, sf_dir, "knowledge_bases").select(F.col("id").alias("kb_id"), "name"), "kb_id")


@_query("SELECT c.id FROM chunks c WHERE EXISTS (SELECT 1 FROM document_knowledge_bases l WHERE l.document_id = c.document_id AND l.kb_id = 1)")
def jn_chunks_in_kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the documents of one collection."""
    members = load(spark, sf_dir, "document_knowledge_bases").filter("kb_id = 1").select("document_id")
    return load(spark, sf_dir, "chunks").select("id", "document_id").join(members, "document_id", "left_semi").select("id")


@_query("SELECT count(*) AS n FROM knowledge_bases WHERE id = 1")
def agg_default_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the collection that must exist does."""
    return load(spark, sf_dir, "knowledge_bases").filter("id = 1").agg(F.count("*").alias("n"))


@_query(
    f"""WITH {_CURRENT} SELECT c.id, (c.chunk_index + 1) || '/' || d.total_chunks AS label,
      d.file_path || CASE WHEN d.file_type = 'pdf' AND regexp_extract(c.content, '\\[第[{_WS}]*([0-9]+)[{_WS}]*页\\]', 1) <> '' THEN '#page=' || CAST(regexp_extract(c.content, '\\[第[{_WS}]*([0-9]+)[{_WS}]*页\\]', 1) AS INTEGER) ELSE '' END AS anchor
    FROM chunks c JOIN current_docs d ON d.id = c.document_id"""
)
def fn_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every chunk in its document, and the path to open it at."""
    documents = _documents(spark, sf_dir).select(F.col("id").alias("document_id"), "total_chunks", "file_type", "file_path")
    rows = load(spark, sf_dir, "chunks").join(documents, "document_id")
    return rows.select("id", T.fragment_label(F.col("chunk_index"), F.col("total_chunks")).alias("label"), T.page_anchor(F.col("file_path"), F.col("file_type"), T.page_number(F.col("content"))).alias("anchor"))
