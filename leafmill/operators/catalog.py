"""The catalogue: documents, collections, their links and chunks; lists over them, and changes to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions.text import megabytes
from leafmill.operators.search import StoredIndex, search
from leafmill.operators.versioned import ADDRESS, VersionedTable, addressed
from leafmill.session import cut

#: Tables and their columns.
SCHEMAS = {
    "knowledge_bases": "id long, name string, description string, created_at timestamp",
    "documents": (
        "id long, kb_id long, filename string, original_name string, file_type string, file_size long, file_path string, "
        "total_chunks int, status string, error_message string, created_at timestamp, updated_at timestamp"
    ),
    "document_knowledge_bases": "document_id long, kb_id long, created_at timestamp",
    "chunks": "id long, document_id long, chunk_index int, content string, token_count int, created_at timestamp",
}
#: The collection that always exists.
DEFAULT_KB, DEFAULT_KB_NAME = 1, "默认知识库"


def current_documents(states: DataFrame) -> DataFrame:
    """The current state of each document out of a log of states: greatest ``updated_at`` (``created_at`` where NULL), then ``loaded_at``.

    Ties are broken by the row's other values, so the result is the same whatever the order. Rows without ``id`` are left out. Done by an aggregate with partial
    results, not by a window, so that an id with very many states stays cheap.
    """
    others = [c for c in states.columns if c not in ("id", "updated_at", "created_at", "loaded_at")]
    rank = F.struct(F.coalesce("updated_at", "created_at").alias("_u"), F.col("loaded_at").alias("_l"), F.struct(*others, "created_at", "updated_at", "loaded_at").alias("_r"))
    best = states.filter("id IS NOT NULL").groupBy("id").agg(F.max(rank).alias("_m"))
    return best.select("id", "_m._r.*").select(*states.columns)


def kb_names(documents: DataFrame, links: DataFrame, kbs: DataFrame) -> DataFrame:
    """``documents`` with the collections they are linked to: ``kb_ids`` ("1,4") and ``kb_names`` ("a, b"), by id; NULL without a link.

    A link to a collection that is gone adds nothing; a doubled link counts once.
    """
    pairs = links.select("document_id", "kb_id").distinct().join(kbs.select(F.col("id").alias("kb_id"), "name"), "kb_id")
    lists = pairs.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("kb_id", "name"))).alias("_k"))
    named = lists.select("document_id", F.array_join(F.transform("_k", lambda k: k["kb_id"].cast("string")), ",").alias("kb_ids"), F.array_join(F.transform("_k", lambda k: k["name"]), ", ").alias("kb_names"))
    return documents.join(named, documents["id"] == named["document_id"], "left").drop("document_id")


def list_documents(documents: DataFrame, links: DataFrame, kbs: DataFrame, status: str | None = None) -> DataFrame:
    """All documents, or those of one status, with their collections, newest first."""
    chosen = documents if status is None else documents.filter(F.col("status") == status)
    return kb_names(chosen, links, kbs).orderBy(F.col("created_at").desc(), F.col("id").desc())


def list_documents_by_knowledge_base(documents: DataFrame, links: DataFrame, kbs: DataFrame, kb_id: int) -> DataFrame:
    """Documents linked to one collection, with all collections they are linked to, newest first."""
    members = links.filter(F.col("kb_id") == kb_id).select(F.col("document_id").alias("id")).distinct()
    return list_documents(documents.join(members, "id", "left_semi"), links, kbs)


def list_knowledge_bases(kbs: DataFrame) -> DataFrame:
    """All collections, newest first."""
    return kbs.orderBy(F.col("created_at").desc(), F.col("id").desc())


def with_document_counts(kbs: DataFrame, links: DataFrame, documents: DataFrame) -> DataFrame:
    """Collections with the number of documents linked to each in ``documents``; doubled links and links of unknown documents do not count."""
    linked = links.select("document_id", F.col("kb_id").alias("id")).distinct().join(documents.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    return kbs.join(linked.groupBy("id").agg(F.count("*").alias("documents")), "id", "left").fillna(0, ["documents"])


def filter_documents(documents: DataFrame, keyword: str) -> DataFrame:
    """Documents whose name contains ``keyword``, case aside; an empty keyword keeps all."""
    return documents.filter(F.contains(F.lower("original_name"), F.lit(keyword.lower()))) if keyword else documents


def display(listed: DataFrame) -> DataFrame:
    """Columns of a document list as they are shown: missing collections, sizes and counts by their defaults."""
    return listed.select(
        "id", "original_name", F.upper("file_type").alias("file_type"), F.coalesce("kb_names", F.lit("未关联")).alias("kb_names"), megabytes(F.col("file_size")).alias("size"),
        F.coalesce("total_chunks", F.lit(0)).alias("total_chunks"), "status",
    )


#: Places of a document whose text is put together in one row.
TEXT_PLACES = 4096


def document_text(chunks: DataFrame, places: int = TEXT_PLACES) -> DataFrame:
    """Text of each document: its chunks in order, joined by a blank line; ``document_id``, ``part``, ``text``.

    A place stored several times counts once, NULL content not at all. A part holds ``places`` places, so a document with a third of all
    chunks comes out in several rows, put together by several tasks; nearly all others have part 0 alone. The whole text is the parts in order, joined by
    a blank line. Chunks without ``chunk_index`` come first, in part 0.
    """
    part = F.coalesce(F.floor(F.col("chunk_index") / places), F.lit(0)).cast("int")
    once = chunks.filter("document_id IS NOT NULL AND content IS NOT NULL").groupBy("document_id", "chunk_index").agg(F.min(F.struct("id", "content")).alias("c"))
    parts = once.groupBy("document_id", part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("chunk_index", F.col("c.content").alias("content")))).alias("p"))
    return parts.select("document_id", "part", F.array_join(F.transform("p", lambda p: p["content"]), "\n\n").alias("text"))


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """Number of places a document has chunks in: ``document_id``, ``total_chunks``."""
    return chunks.groupBy("document_id").agg(F.count_distinct("chunk_index").alias("total_chunks"))


def missing_home_links(documents: DataFrame, links: DataFrame, kbs: DataFrame) -> DataFrame:
    """Links that repair adds: to the home collection where that exists and is not linked; to the default one for documents left without any.

    ``document_id``, ``kb_id``; each once.
    """
    pairs = links.select("document_id", "kb_id")
    home = documents.select(F.col("id").alias("document_id"), "kb_id").join(kbs.select(F.col("id").alias("kb_id")), "kb_id", "left_semi").join(pairs, ["document_id", "kb_id"], "left_anti")
    linked = pairs.select("document_id").unionByName(home.select("document_id")).distinct()
    orphans = documents.select(F.col("id").alias("document_id")).join(linked, "document_id", "left_anti").select("document_id", F.lit(DEFAULT_KB).cast("long").alias("kb_id"))
    return home.select("document_id", "kb_id").unionByName(orphans).distinct()


def without(rows: DataFrame, gone: DataFrame, column: str) -> DataFrame:
    """``rows`` less those whose ``column`` is one of the values in ``gone`` (one column); NULL stays."""
    return rows.join(gone.select(F.col(gone.columns[0]).alias("_gone")), F.col(column) == F.col("_gone"), "left_anti")


def with_links(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """``document_id``, ``kb_id`` of ``links`` and ``pairs``, each pair once."""
    return links.select("document_id", "kb_id").unionByName(pairs.select("document_id", "kb_id")).distinct()


def moved(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links after the documents of ``pairs`` have been moved to the collections named there: these are their only ones."""
    return with_links(without(links, pairs.select("document_id"), "document_id"), pairs)


def with_status(documents: DataFrame, changes: DataFrame) -> DataFrame:
    """``documents`` with ``status`` and ``error_message`` from ``changes`` (``id``, ``status``, ``error_message``) where they have a row."""
    new = changes.select(F.col("id").alias("_id"), F.col("status").alias("_status"), F.col("error_message").alias("_error"))
    joined = documents.join(new, F.col("id") == F.col("_id"), "left")
    hit = F.col("_id").isNotNull()
    return joined.withColumns({"status": F.when(hit, F.col("_status")).otherwise(F.col("status")), "error_message": F.when(hit, F.col("_error")).otherwise(F.col("error_message"))}).select(*documents.columns)


def with_ids(rows: DataFrame, first: int) -> DataFrame:
    """``rows`` with an ``id`` from ``first`` on, without holes: an offset a partition, plus the place in it."""
    placed = cut(rows.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = {r.p: r.n for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # one row a partition
    offsets, total = {}, first
    for p in sorted(sizes):
        offsets[p], total = total, total + sizes[p]
    base = F.create_map(*[F.lit(x) for p, o in offsets.items() for x in (p, o)]) if offsets else None
    number = F.lit(first) if base is None else F.try_element_at(base, part) + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("id", number.cast("long")).drop("_at")


class Catalog:
    """The four tables, each kept as immutable versions under ``root``, and the inverted index of the chunks.

    Every change is one commit of one table; where several tables change, links and chunks go before documents, so that a failure
    in between leaves rows that no document names and :meth:`repair_links` or a second call puts right.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.tables = {name: VersionedTable(spark, f"{root.rstrip('/')}/{name}") for name in SCHEMAS}
        self.index = StoredIndex(spark, f"{root.rstrip('/')}/postings")
        for name, table in self.tables.items():
            if table.latest() == 0:
                table.commit(append=spark.createDataFrame([], SCHEMAS[name]))
        if self.table("knowledge_bases").filter(F.col("id") == DEFAULT_KB).isEmpty():
            self._append("knowledge_bases", spark.createDataFrame([(DEFAULT_KB, DEFAULT_KB_NAME, "")], "id long, name string, description string").withColumn("created_at", F.current_timestamp()))

    def table(self, name: str) -> DataFrame:
        """Current rows of a table."""
        return self.tables[name].read()

    def _append(self, name: str, rows: DataFrame) -> None:
        self.tables[name].commit(append=self._shaped(name, rows))

    def _shaped(self, name: str, rows: DataFrame) -> DataFrame:
        fields = self.spark.createDataFrame([], SCHEMAS[name]).schema
        return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])

    def _addressed(self, name: str) -> DataFrame:
        v = self.tables[name].version()
        rows = addressed(self.spark, v.files)
        return rows if v.deleted is None else rows.join(v.deleted, list(ADDRESS), "left_anti")

    def _delete(self, name: str, where: Column) -> None:
        self.tables[name].commit(delete=self._addressed(name).filter(where).select(*ADDRESS))

    def _update(self, name: str, where: Column, **values: Column) -> None:
        rows = cut(self._addressed(name).filter(where))
        self.tables[name].commit(append=self._shaped(name, rows.drop(*ADDRESS).withColumns(values)), delete=rows.select(*ADDRESS))

    def replace(self, name: str, rows: DataFrame, key: str) -> None:
        """Put ``rows`` in the place of those with the same ``key``."""
        rows = cut(self._shaped(name, rows))
        gone = self._addressed(name).join(rows.select(key), key, "left_semi").select(*ADDRESS)
        self.tables[name].commit(append=rows, delete=gone)

    def _next(self, name: str) -> int:
        return (self.table(name).agg(F.max("id")).first()[0] or 0) + 1

    def create_documents(self, files: DataFrame, kb_id: int | None = None) -> DataFrame:
        """Register files (``filename``, ``original_name``, ``file_type``, ``file_size``, ``file_path``), linked to ``kb_id`` or the default collection; returns them with ids."""
        kb = kb_id or DEFAULT_KB
        rows = with_ids(files, self._next("documents")).withColumns({"kb_id": F.lit(kb), "total_chunks": F.lit(0), "status": F.lit("pending"), "created_at": F.current_timestamp()})
        rows = cut(self._shaped("documents", rows))
        self.add_links(rows.select(F.col("id").alias("document_id"), "kb_id"))
        self._append("documents", rows)
        return rows

    def update_document_status(self, document_id: int, status: str, error: str | None = None) -> None:
        self._update("documents", F.col("id") == document_id, status=F.lit(status), error_message=F.lit(error), updated_at=F.current_timestamp())

    def update_document_chunks(self, document_id: int, total: int) -> None:
        self._update("documents", F.col("id") == document_id, total_chunks=F.lit(total), updated_at=F.current_timestamp())

    def delete_document_chunks(self, document_id: int) -> None:
        """Remove the chunks of a document, and their part of the index first, so that a search never names a chunk that is gone."""
        self.index.remove(self.spark.createDataFrame([(document_id,)], "document_id long"))
        self._delete("chunks", F.col("document_id") == document_id)

    def delete_document(self, document_id: int) -> None:
        """Remove a document with its links and chunks."""
        self._delete("document_knowledge_bases", F.col("document_id") == document_id)
        self.delete_document_chunks(document_id)
        self._delete("documents", F.col("id") == document_id)

    def create_chunks(self, chunks: DataFrame) -> DataFrame:
        """Store chunks (``document_id``, ``chunk_index``, ``content``, ``token_count``) and index them; a missing count is 0. Returns them with ids."""
        rows = with_ids(chunks, self._next("chunks")).withColumns({"token_count": F.coalesce("token_count", F.lit(0)), "created_at": F.current_timestamp()})
        rows = cut(self._shaped("chunks", rows))
        self._append("chunks", rows)
        self.index.add(rows)
        return rows

    def create_knowledge_base(self, name: str, description: str = "") -> int:
        n = self._next("knowledge_bases")
        self._append("knowledge_bases", self.spark.createDataFrame([(n, name, description)], "id long, name string, description string").withColumn("created_at", F.current_timestamp()))
        return n

    def delete_knowledge_base(self, kb_id: int) -> None:
        """Remove a collection and its links; its documents stay, with their home as it was."""
        self._delete("document_knowledge_bases", F.col("kb_id") == kb_id)
        self._delete("knowledge_bases", F.col("id") == kb_id)

    def add_links(self, pairs: DataFrame) -> None:
        """Links (``document_id``, ``kb_id``) that do not exist yet."""
        new = pairs.select("document_id", "kb_id").distinct().join(self.table("document_knowledge_bases"), ["document_id", "kb_id"], "left_anti")
        self._append("document_knowledge_bases", new.withColumn("created_at", F.current_timestamp()))

    def add_document_to_knowledge_base(self, document_id: int, kb_id: int) -> None:
        self.add_links(self.spark.createDataFrame([(document_id, kb_id)], "document_id long, kb_id long"))

    def move_document_to_knowledge_base(self, document_id: int, kb_id: int) -> None:
        """Make ``kb_id`` the only collection of a document, and its home."""
        gone = self._addressed("document_knowledge_bases").filter(F.col("document_id") == document_id)
        one = self.spark.createDataFrame([(document_id, kb_id)], "document_id long, kb_id long").withColumn("created_at", F.current_timestamp())
        self.tables["document_knowledge_bases"].commit(append=self._shaped("document_knowledge_bases", one), delete=gone.select(*ADDRESS))
        self._update("documents", F.col("id") == document_id, kb_id=F.lit(kb_id), updated_at=F.current_timestamp())

    def repair_links(self) -> None:
        """Add the links that :func:`missing_home_links` finds."""
        self.add_links(missing_home_links(self.table("documents"), self.table("document_knowledge_bases"), self.table("knowledge_bases")))

    def list_documents(self, status: str | None = None) -> DataFrame:
        return list_documents(self.table("documents"), self.table("document_knowledge_bases"), self.table("knowledge_bases"), status)

    def search(self, query: str, kb_id: int | None = None, match_mode: str = "all", limit: int | None = 500) -> DataFrame:
        """:func:`leafmill.operators.search.search` over the catalogue and its index."""
        return search(self.table("chunks"), self.table("documents"), self.table("document_knowledge_bases"), query, kb_id, match_mode, limit, self.index)

    def list_documents_by_knowledge_base(self, kb_id: int) -> DataFrame:
        return list_documents_by_knowledge_base(self.table("documents"), self.table("document_knowledge_bases"), self.table("knowledge_bases"), kb_id)

    def list_knowledge_bases(self) -> DataFrame:
        """All collections, newest first, with the number of documents linked to each in ``documents``."""
        return list_knowledge_bases(with_document_counts(self.table("knowledge_bases"), self.table("document_knowledge_bases"), self.table("documents")))

    def compact(self) -> None:
        """Rewrite the tables whose changes have piled up."""
        for table in self.tables.values():
            table.compact()

    def get_document(self, document_id: int) -> DataFrame:
        return self.table("documents").filter(F.col("id") == document_id)

    def get_chunks_by_document(self, document_id: int) -> DataFrame:
        return self.table("chunks").filter(F.col("document_id") == document_id).orderBy("chunk_index")


def numbered(rows: DataFrame, key: str, order: str, out: str = "chunk_index") -> DataFrame:
    """``rows`` with places from 0 within ``key``, by ``order``."""
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1)
