from leafmill.operators.catalog import Catalog
from leafmill.operators.chunking import Chunking
from leafmill.streaming.ingest import ingest_paths, watch


def test_ingest_and_watch(spark, tmp_path):
    drop = tmp_path / "drop"
    drop.mkdir()
    (drop / "a.txt").write_text("One line of text.\n" * 40)
    (drop / "b.bad").write_text("x")
    (drop / "c.txt").write_text("")
    catalog = Catalog(spark, str(tmp_path / "cat"))
    options = Chunking(50, 5, "fixed")
    rejects = ingest_paths(catalog, str(drop), options=options)
    assert rejects.count() == 0
    docs = {r.filename: r for r in catalog.table("documents").collect()}
    assert {n: (d.status, d.total_chunks) for n, d in docs.items()} == {"a.txt": ("completed", docs["a.txt"].total_chunks), "b.bad": ("failed", 0), "c.txt": ("failed", 0)}
    assert docs["b.bad"].error_message == "unsupported type: bad" and docs["a.txt"].total_chunks == catalog.table("chunks").count() > 1
    assert {r.kb_ids for r in catalog.list_documents().collect()} == {"1"}
    (drop / "d.md").write_text("# New\ntext")
    for _ in range(2):
        q = watch(spark, str(drop), catalog, str(tmp_path / "checkpoint"), options=options)
        assert q.awaitTermination(120)
        assert q.exception() is None
    assert sorted(r.filename for r in catalog.table("documents").collect()) == ["a.txt", "b.bad", "c.txt", "d.md"]
    assert catalog.table("chunks").join(catalog.table("documents").filter("filename = 'd.md'").withColumnRenamed("id", "document_id").select("document_id"), "document_id").count() == 1


def test_settings_progress_and_cancel(spark, tmp_path):
    from leafmill.settings import Settings
    from leafmill.sources.extract import read_files
    from leafmill.streaming.ingest import Ingestion

    drop = tmp_path / "drop"
    drop.mkdir()
    (drop / "a.txt").write_text("one two three four five six seven eight. " * 40)
    (drop / "b.txt").write_text("x" * 3000000)
    catalog = Catalog(spark, str(tmp_path / "cat"))
    run = Ingestion(catalog, read_files(spark, str(drop)), settings=Settings(chunk_size=64, chunk_overlap=0, chunk_strategy="fixed", max_file_size_mb=2))
    assert run.wait(300) and [r.path.rsplit("/", 1)[-1] for r in run.rejects.collect()] == ["b.txt"]
    chunks = catalog.table("chunks").count()
    assert run.progress() == {"extracted": 1, "chunked": chunks, "stored": 1} and chunks > 4
    assert sorted(r.document_id for r in catalog.search("seven", limit=None).collect()) == [1] * chunks

    def slow(raw):
        import time

        time.sleep(60)
        return "late"

    from leafmill.sources.tools import Tools

    (drop / "c.png").write_bytes(b"\x89PNG")
    late = Ingestion(catalog, read_files(spark, str(drop / "c.png")), tools=Tools(ocr=slow))
    assert not late.wait(3) and late.progress() == {}
    late.cancel()
    late._thread.join(60)
    assert not late._thread.is_alive() and late.error is not None and catalog.table("documents").count() == 1
