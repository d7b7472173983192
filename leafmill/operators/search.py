"""Keyword search over chunks: inverted index, substring fallback, snippets, context and previews."""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators.versioned import ADDRESS, VersionedTable, addressed
from leafmill.session import checkpoint_dir, cut
from leafmill.sources.tables import spread

#: What a token of the index is: a run of letters, digits or private-use characters.
TOKEN = r"[\p{L}\p{N}\p{Co}]+"
#: Columns of the document that a search result carries.
DOCUMENT_COLUMNS = ("original_name", "file_type", "file_path", "kb_id", "total_chunks")

_ASCII_UP, _ASCII_LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PLAIN_TOKEN = re.compile(r"[^\W_]+")


def tokens(text: Column) -> Column:
    """Tokens of a text as the index keeps them: folded to lower case without accents."""
    return F.regexp_extract_all(T.fold(text), F.lit(TOKEN), F.lit(0))


def postings(chunks: DataFrame) -> DataFrame:
    """The inverted index: ``token``, ``chunk_id``, ``document_id``, ``col``, ``pos``.

    Both the content and the number of the document are indexed. Chunks with NULL content have only the latter. Rows are made
    at the scan; :func:`write_postings` clusters them by token.
    """
    word = lambda source, name: chunks.select(F.posexplode(source).alias("pos", "token"), F.col("id").alias("chunk_id"), "document_id", F.lit(name).alias("col"))
    content = word(tokens(F.col("content")), "content")
    number = word(tokens(F.col("document_id").cast("string")), "document_id")
    return content.unionByName(number).select("token", "chunk_id", "document_id", "col", "pos")


def write_postings(chunks: DataFrame, table: str, buckets: int = 64) -> None:
    """Store the index as a table bucketed and sorted by token, so that a term reads one bucket."""
    postings(chunks).write.mode("overwrite").bucketBy(buckets, "token").sortBy("token").saveAsTable(table)


class StoredIndex:
    """The inverted index as a versioned table under ``root``: files parted by a hash of the token, so that a term reads one of :data:`BUCKETS` parts, and sorted by token.

    It is kept with the chunks by :meth:`add` and :meth:`remove`; neither reads or writes the index of other chunks.
    """

    BUCKETS = 64

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.table = spark, VersionedTable(spark, root)

    def add(self, chunks: DataFrame) -> None:
        """Index new chunks. Parts are rebalanced: small ones share a task, one that a frequent token makes large is split."""
        rows = postings(chunks).withColumn("bucket", F.pmod(F.crc32("token"), F.lit(self.BUCKETS)))
        self.table.commit(append=rows.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "token"), by="bucket")

    def remove(self, document_ids: DataFrame) -> None:
        """Take out the chunks of documents (one column)."""
        rows = self._addressed(None)
        if rows is not None:
            self.table.commit(delete=rows.join(document_ids.toDF("document_id").distinct(), "document_id", "left_semi").select(*ADDRESS))

    def _addressed(self, buckets: set[int] | None) -> DataFrame | None:
        v = self.table.version()
        files = [f for f in v.files if buckets is None or int(f.rsplit("bucket=", 1)[1].split("/", 1)[0]) in buckets] if v else []
        if not files:
            return None
        rows = addressed(self.spark, files)
        return rows if v.deleted is None else rows.join(v.deleted, list(ADDRESS), "left_anti")

    def rows(self, tokens: list[str] | None = None) -> DataFrame:
        """The postings, or only those of some tokens, read from their parts alone."""
        found = self._addressed(None if tokens is None else {zlib.crc32(t.encode()) % self.BUCKETS for t in tokens})
        if found is None:
            return self.spark.createDataFrame([], "token string, chunk_id long, document_id long, col string, pos int")
        found = found.drop(*ADDRESS)
        return found if tokens is None else found.filter(F.col("token").isin(tokens))


def stored_index(chunks: DataFrame, name: str) -> StoredIndex:
    """The stored index of ``chunks``, in the session's shared folder; made if this state of their files has none."""
    spark = chunks.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    state = hashlib.sha256(name.encode())
    for f in sorted(chunks.inputFiles()):
        status = jvm.org.apache.hadoop.fs.Path(f).getFileSystem(conf).getFileStatus(jvm.org.apache.hadoop.fs.Path(f))
        state.update(f"{f} {status.getLen()} {status.getModificationTime()}".encode())
    index = StoredIndex(spark, f"{checkpoint_dir(spark)}/postings-{state.hexdigest()[:24]}")
    if index.table.latest() == 0:
        try:
            index.add(spread(chunks.select("id", "document_id", "content")))
        except FileExistsError:
            pass  # another session was faster
    return index


def _term_tokens(spark: SparkSession, term: str) -> list[str]:
    """Tokens of a search term, folded as the index is; evaluated on one literal row."""
    return list(spark.range(1).select(tokens(F.lit(term)).alias("t")).first().t)


def index_hits(index: DataFrame | StoredIndex, terms: list[str], match_mode: str = "all") -> DataFrame:
    """Ids of the chunks that match: ``chunk_id``.

    Each term is a phrase of tokens that must follow one another. With ``all`` every term must match, otherwise one.
    A term without tokens matches nothing: it empties an ``all`` search and is passed over in the other.
    Only the postings of the tokens asked for are read; phrases are checked by grouping them by the place the phrase would start.
    """
    spark = index.spark if isinstance(index, StoredIndex) else index.sparkSession
    phrases = [_term_tokens(spark, t) for t in terms]
    if not any(phrases) or match_mode == "all" and not all(phrases):
        return spark.createDataFrame([], "chunk_id long")
    wanted = [(n, p, token, len(phrase)) for n, phrase in enumerate(phrases) for p, token in enumerate(phrase)]
    # as many rows as the query has words
    asked = spark.createDataFrame(wanted, "term int, at int, token string, words int")
    distinct = sorted({w[2] for w in wanted})
    used = index.rows(distinct) if isinstance(index, StoredIndex) else index.filter(F.col("token").isin(distinct))
    starts = used.join(F.broadcast(asked), "token").groupBy("chunk_id", "term", "words", "col", (F.col("pos") - F.col("at")).alias("start")).agg(F.count_distinct("at").alias("got"))
    found = starts.filter(F.col("got") == F.col("words")).select("chunk_id", "term").distinct()
    need = len([p for p in phrases if p]) if match_mode == "all" else 1
    return found.groupBy("chunk_id").agg(F.count("*").alias("n")).filter(F.col("n") >= need).select("chunk_id")


def contains_like(content: Column, term: str) -> Column:
    """Substring match as SQL LIKE has it: case of ASCII letters aside, ``%`` and ``_`` in the term are wildcards."""
    low = lambda c: F.translate(c, _ASCII_UP, _ASCII_LOW)
    pattern = "%" + term.translate(str.maketrans(_ASCII_UP, _ASCII_LOW)).replace("\\", "\\\\") + "%"
    return low(content).like(pattern)


def _in_kb(rows: DataFrame, links: DataFrame, kb_id: int | None) -> DataFrame:
    if not kb_id:
        return rows
    members = links.filter(F.col("kb_id") == kb_id).select("document_id").distinct()
    return rows.join(members, "document_id", "left_semi")


def search(
    chunks: DataFrame, documents: DataFrame, links: DataFrame, query: str, kb_id: int | None = None, match_mode: str = "all", limit: int | None = 500, index: DataFrame | StoredIndex | None = None
) -> DataFrame:
    """Chunks that match ``query``, by name of their document and place: chunk and document columns, ``matched_terms``, ``snippet``.

    The inverted index decides; only if it has no hit at all, a second plan looks for substrings, which reads the content of all chunks. ``kb_id`` (not 0)
    keeps documents linked to that collection. ``limit`` None keeps all. Without ``index`` the postings are
    made from ``chunks`` on the fly, which reads all of them too; give a :class:`StoredIndex` for more than one search. Chunks whose document is not in ``documents`` are left out.

    With a limit the hits are ranked without their content, which is then read for the chosen ids alone.
    """
    terms = T.split_keywords(query)
    info = documents.select(F.col("id").alias("document_id"), *DOCUMENT_COLUMNS)
    if not terms:
        return _finish(chunks.limit(0).join(info, "document_id"), [], limit)
    ids = cut(index_hits(postings(chunks) if index is None else index, terms, match_mode).withColumnRenamed("chunk_id", "id"))
    places = _in_kb(chunks.select("id", "document_id", "chunk_index").join(ids, "id", "left_semi").join(info.select("document_id", "original_name"), "document_id"), links, kb_id)
    if ids.isEmpty() or places.isEmpty():
        join = (lambda a, b: a & b) if match_mode == "all" else (lambda a, b: a | b)
        like = reduce(join, [contains_like(F.col("content"), t) for t in terms])
        return _finish(_in_kb(chunks.filter(like).join(info, "document_id"), links, kb_id), terms, limit)
    if limit is not None:
        first = {r.id for r in places.orderBy("original_name", "chunk_index", "id").limit(limit).collect()}  # at most ``limit`` rows
        hits = chunks.filter(F.col("id").isin(sorted(first)))
    else:
        hits = chunks.join(ids, "id", "left_semi")
    return _finish(_in_kb(hits.join(info, "document_id"), links, kb_id), terms, limit)


def _finish(rows: DataFrame, terms: list[str], limit: int | None) -> DataFrame:
    rows = rows.withColumns({"matched_terms": T.matched_terms(F.col("content"), terms), "snippet": T.snippet(F.col("content"), terms)})
    ordered = rows.orderBy("original_name", "chunk_index", "id")
    return ordered if limit is None else ordered.limit(limit)


def context(chunks: DataFrame, documents: DataFrame, chunk_ids: DataFrame, radius: int = 1) -> DataFrame:
    """Hits with their neighbours: the chunk and document columns of each id in ``chunk_ids`` (``id``), and ``context``, the chunks of
    the same document at most ``radius`` places away, in order, as structs.

    Every hit asks for the places around it, and chunks are joined by document and place, so that many hits in one large document never
    meet all of its chunks; only neighbours of hits are gathered. Unknown ids give no row.
    """
    info = documents.select(F.col("id").alias("document_id"), "original_name", "file_type", "file_path", "total_chunks")
    hits = chunks.join(chunk_ids.select("id").distinct(), "id", "left_semi").join(info, "document_id")
    places = F.sequence(F.col("chunk_index") - radius, F.col("chunk_index") + radius)
    wanted = hits.select(F.col("id").alias("_hit"), F.col("document_id").alias("_d"), F.explode(places).alias("_at")).distinct()
    near = chunks.select("document_id", F.col("chunk_index").alias("_place"), F.struct("chunk_index", "id", "content", "token_count").alias("c"))
    pairs = wanted.join(near, (F.col("document_id") == F.col("_d")) & (F.col("_place") == F.col("_at")))
    gathered = pairs.groupBy("_hit").agg(F.array_sort(F.collect_list("c")).alias("context"))
    return hits.join(gathered, F.col("id") == F.col("_hit")).drop("_hit")


def context_windows(chunks: DataFrame, radius: int = 1, places: int = 1024) -> DataFrame:
    """Every chunk with its neighbours, by a window over the places of its document: for previews of all chunks at once.

    A window spans ``places`` places of a document, so that a document with a third of all chunks is spread over many tasks; chunks within ``radius`` of
    an edge are also sent to the next span. Chunks without ``chunk_index`` have each other as context.
    """
    span = lambda shift: F.floor((F.col("chunk_index") + shift) / places)
    spread = chunks.withColumn("_span", F.explode(F.array_distinct(F.array(span(-radius), span(0), span(radius)))))
    w = Window.partitionBy("document_id", "_span").orderBy("chunk_index").rangeBetween(-radius, radius)
    told = spread.withColumn("context", F.array_sort(F.collect_list(F.struct("chunk_index", "id", "content", "token_count")).over(w)))
    return told.filter(F.col("_span").eqNullSafe(span(0))).drop("_span")


def preview(chunks: DataFrame, documents: DataFrame, chunk_id: int, query: str = "", radius: int = 2) -> DataFrame:
    """One hit as a page: ``id``, ``original_name``, ``label``, ``page``, ``anchor``, ``html``; no row for an unknown id."""
    terms = T.split_keywords(query)
    one = context(chunks, documents, chunks.filter(F.col("id") == chunk_id).select("id"), radius)
    page = T.page_number(F.col("content"), F.transform("context", lambda c: c["content"]))
    return one.dropDuplicates(["id"]).select(
        "id", "original_name", T.fragment_label(F.col("chunk_index"), F.col("total_chunks")).alias("label"), page.alias("page"),
        T.page_anchor(F.col("file_path"), F.col("file_type"), page).alias("anchor"), T.context_html(F.col("context"), F.col("id"), terms).alias("html"),
    )
