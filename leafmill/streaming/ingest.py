"""Ingestion of files into a catalogue: in one batch, or as they are dropped into a folder."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafmill.functions import text as T
from leafmill.operators.catalog import Catalog, with_ids
from leafmill.operators.chunking import Chunking, chunk
from leafmill.session import cut
from leafmill.settings import Settings
from leafmill.sources.extract import attach_subtitles, extract, read_files
from leafmill.sources.tools import Tools

#: Largest file that is taken in.
MOST_BYTES = 200 * 1024 * 1024
_FILE = "path string, modificationTime timestamp, length long, content binary"


def _nothing(step: str, n: int) -> None:
    pass


def ingest(
    catalog: Catalog, files: DataFrame, kb_id: int | None = None, options: Chunking = Chunking(), most_bytes: int = MOST_BYTES, tools: Tools = Tools(),
    settings: Settings | None = None, on_step: Callable[[str, int], None] = _nothing,
) -> DataFrame:
    """Extract, grade, chunk and store ``files`` (as :func:`leafmill.sources.extract.read_files` gives them); returns the rejects.

    Files above ``most_bytes`` get no document; they are only in the rejects (``path``, ``error``). Every other file becomes a document, ``completed``
    with its chunks or ``failed`` with the reason. Extraction runs once; chunks are written before the documents that name them. ``settings`` stand for
    ``options``, ``most_bytes`` and the limits of ``tools``. ``on_step`` is told each step that is done, and how many files, chunks or documents it gave.
    """
    if settings is not None:
        options, most_bytes, tools = settings.chunking(), settings.max_bytes, settings.tools(tools)
    read = attach_subtitles(cut(extract(files, most_bytes, tools)))
    # numbered, so that chunks can name their file before it has an id
    keyed = with_ids(read.filter(F.col("length") <= most_bytes), 1).withColumnRenamed("id", "_row")
    on_step("extracted", keyed.count())
    chunked = cut(chunk(keyed, options, "_row", "text"))
    on_step("chunked", chunked.count())
    counts = chunked.groupBy(F.col("document_id").alias("_row")).agg(F.count("*").alias("n"))
    rows = cut(keyed.join(counts, "_row", "left").select("_row", F.col("name").alias("filename"), F.col("name").alias("original_name"), "file_type", F.col("length").alias("file_size"), F.col("path").alias("file_path"), "n", "error"))
    made = catalog.create_documents(rows.select("filename", "original_name", "file_type", "file_size", "file_path"), kb_id)
    ids = made.select(F.col("id").alias("document_id"), "file_path")
    stored = chunked.withColumnRenamed("document_id", "_row").join(rows.select("_row", "file_path"), "_row").join(ids, "file_path").select("document_id", "chunk_index", "content", "token_count")
    catalog.create_chunks(stored)
    done = rows.select("file_path", "n", "error")
    changed = made.join(done, "file_path").withColumns({
        "status": F.when(F.col("n") > 0, "completed").otherwise("failed"), "total_chunks": F.coalesce("n", F.lit(0)).cast("int"),
        "error_message": F.when(F.col("n") > 0, F.lit(None)).otherwise(F.coalesce("error", F.lit("no chunks"))), "updated_at": F.current_timestamp(),
    })
    catalog.replace("documents", changed, "id")
    on_step("stored", rows.count())
    return read.filter(F.col("length") > most_bytes).select("path", "error")


class Ingestion:
    """A batch ingestion beside the caller, which can ask how far it is and end it.

    ``Ingestion(catalog, files, ...)`` takes what :func:`ingest` takes and starts at once. A cancelled one ends at its next job; what it has committed by then stays, documents that
    it had not finished are ``pending``.
    """

    def __init__(self, catalog: Catalog, files: DataFrame, **options):
        self.context, self.tag = catalog.spark.sparkContext, f"ingest-{uuid.uuid4().hex}"
        self.steps: dict[str, int] = {}
        self.rejects: DataFrame | None = None
        self.error: Exception | None = None

        def run() -> None:
            self.context.addJobTag(self.tag)
            try:
                self.rejects = ingest(catalog, files, on_step=self.steps.__setitem__, **options)
            except Exception as e:
                self.error = e

        self._thread = threading.Thread(target=run, daemon=True)
        self._thread.start()

    def progress(self) -> dict[str, int]:
        """Steps done so far and their numbers: ``extracted``, ``chunked``, ``stored``."""
        return dict(self.steps)

    def cancel(self) -> None:
        """End the jobs of this ingestion and no others."""
        self.context.cancelJobsWithTag(self.tag)

    def wait(self, seconds: float | None = None) -> bool:
        """Wait for the end; whether it was reached. An error of the run is raised."""
        self._thread.join(seconds)
        if self.error:
            raise self.error
        return not self._thread.is_alive()


def watch(spark: SparkSession, folder: str, catalog: Catalog, checkpoint: str, kb_id: int | None = None, options: Chunking = Chunking(), on_rejects: Callable[[DataFrame], None] | None = None, tools: Tools = Tools(), settings: Settings | None = None, **trigger) -> StreamingQuery:
    """A streaming query that takes in every file dropped into ``folder``, once.

    The file source keeps what it has seen in ``checkpoint``. A batch that is run again after a failure finds the paths it has already stored and leaves them out. ``trigger`` is passed to
    ``DataStreamWriter.trigger``; by default all files present are taken in and the query ends.
    """
    files = spark.readStream.format("binaryFile").schema(_FILE).option("recursiveFileLookup", "true").load(folder)
    files = files.withColumns({"name": T.base_name(F.col("path")), "file_type": T.extension(F.col("path"))})

    def batch(rows: DataFrame, _number: int) -> None:
        known = catalog.table("documents").select(F.col("file_path").alias("path"))
        rejects = ingest(catalog, rows.join(known, "path", "left_anti"), kb_id, options, tools=tools, settings=settings)
        if on_rejects:
            on_rejects(rejects)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def ingest_paths(catalog: Catalog, *paths: str, kb_id: int | None = None, options: Chunking = Chunking(), tools: Tools = Tools(), settings: Settings | None = None) -> DataFrame:
    """:func:`ingest` of all files below ``paths``."""
    return ingest(catalog, read_files(catalog.spark, *paths), kb_id, options, tools=tools, settings=settings)
