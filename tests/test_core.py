import random
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import catalog as C
from leafmill.operators import search as S
from leafmill.operators.chunking import STRATEGIES, Chunking, Cutter, chunk, word_chunks


def one(spark, column, **values):
    """Value of a column over one row."""
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'long'}" for k, v in values.items()))
    return row.select(column.alias("v")).first().v


def texts(spark, f, *values):
    """``f`` over each of some texts."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.v for r in rows.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]


def test_clean_text(spark):
    got = texts(spark, T.clean_text, "a\0b\x7f", "​﻿x­‮", "a　　　b  c", "a\n\n\nb\n\n\n\nc\n\n\n\n\n\n\nd", "a  \nb \t", "", None)
    assert got == ["ab", "x", "a b  c", "a\n\n\nb\n\n\nc\n\n\nd", "a\nb", "", None]


def test_html_to_text(spark):
    page = "<script>a='</p>'</script><DIV>x<p>y</p>z<br/>w &lt;b&gt; &amp;lt;</DIV><!-- c --><STYLE>q</STYLE>"
    assert texts(spark, T.html_to_text, page, "", None) == ["xy\nz\nw <b> &lt;", "", None]


def test_quality(spark):
    def grade(n, ratio, kind):
        t = "x" * round(n * ratio) + "-" * (n - round(n * ratio))
        return one(spark, T.quality(F.col("t"), F.col("k")), t=t, k=kind).level

    assert [grade(n, 1.0, "pdf") for n in (0, 20, 50, 51, 200, 201, 1000, 1001)] == ["very_low", "very_low", "very_low", "low", "low", "medium", "medium", "high"]
    assert [grade(1001, r, "docx") for r in (0.2, 0.4, 0.6)] == ["low", "medium", "high"]
    assert [grade(n, 0.4, "py") for n in (100, 101)] == ["medium", "high"]
    assert [grade(n, 0.4, "MP3") for n in (20, 21, 100, 101)] == ["low", "medium", "medium", "high"]
    assert one(spark, T.quality(F.col("t"), F.col("k")), t=None, k=None).reason == "解析结果为空"
    assert texts(spark, T.is_meaningful, "ab--", "-----", " ", None) == [True, False, False, False]


def test_small_functions(spark):
    assert texts(spark, lambda t: T.truncate_text(t, 3), "abc", "abcd", None) == ["abc", "abc\n\n... (文本过长，已截断，共 4 字符)", None]
    assert texts(spark, T.normalize_whitespace, "a\r\nb\rc \t d") == ["a\nb\nc d"]
    assert texts(spark, T.remove_garbage, "a���b☃c，d_é") == ["abc，d_é"]
    assert texts(spark, T.keywords, "a，b；c, d;e", ",;", None) == [["a", "b", "c", "d", "e"], [], None]
    assert T.split_keywords("a，b；c, d;e") == ["a", "b", "c", "d", "e"] and T.split_keywords(None) == []
    assert texts(spark, T.extension, "/x/A.PDF", "/x/Dockerfile", "/x/none", "/a.b/c") == ["pdf", "dockerfile", "", ""]
    assert texts(spark, T.is_fragment, "deadbeefcafe0123", "plain words here", "{01234567-89ab-", "/a/b/c") == [False, True, False, False]
    got = texts(spark, lambda t: T.cell_address(t), "A1", "Z9", "AA42", "AB10", "1A")
    assert [tuple(g) if g else None for g in got] == [(0, 0), (25, 8), (26, 41), (27, 9), None]
    assert [one(spark, T.size_text(F.col("n")), n=n) for n in (1023, 1024, 1 << 20, 1 << 30)] == ["1023 B", "1.0 KB", "1.0 MB", "1.00 GB"]
    assert [one(spark, T.duration_text(F.col("n")), n=n) for n in (59.9, 60.0, 3600.0)] == ["59秒", "1分00秒", "1时00分00秒"]
    assert [one(spark, T.excel_date(F.col("n")), n=n) for n in (0.0, 1.0, 59.0, 61.0, 45306.0, 45306.75, 2958466.0)] == [None, "1900-01-01", "1900-02-28", "1900-03-01", "2024-01-15", "2024-01-15 18:00:00", None]
    assert [one(spark, T.is_date_format(F.col("i"), F.col("c")), i=i, c=c) for i, c in ((14, None), (164, "[Red]0"), (165, "yyyy"), (166, '"day" 0'))] == [True, False, True, False]
    table = spark.createDataFrame([(["h", None], [["1", None], ["2", "3"], ["4", "5"]])], "h array<string>, r array<array<string>>")
    assert table.select(T.table_text(F.col("h"), F.col("r"), 2).alias("v")).first().v == "h | \n1 | \n2 | 3\n... 共 3 行数据（已截取前 2 行）"


def test_snippet_and_highlight(spark):
    snip = lambda t, *terms: texts(spark, lambda c: T.snippet(c, list(terms)), t)[0]
    assert snip("x" * 180, "q") == "x" * 180 and snip("x" * 181, "q") == "x" * 180 + "..."
    assert snip("Hit" + "y" * 200, "hit") == "Hit" + "y" * 87 + "..."
    assert snip("y" * 200 + "hit", "HIT") == "..." + "y" * 90 + "hit"
    assert snip("b" * 100 + "two" + "b" * 50 + "one", "one", "two").startswith("..." + "b" * 90 + "two")
    assert snip(None, "a") == "" and snip("", "a") == ""
    assert texts(spark, lambda c: T.matched_terms(c, ["Ab", "x"]), "xxaB", None) == [["Ab", "x"], []]
    got = texts(spark, lambda c: T.highlight(c, ["a<b", "a"]), "A<B\n& a")[0]
    assert got == f'<span style="{T.MARK}">A&lt;B</span><br>&amp; <span style="{T.MARK}">a</span>'.replace("A&lt;B", "A&lt;B") or got.count("<span") >= 2
    assert texts(spark, lambda c: T.page_number(c), "x [第 12 页] [第3页]", "none", None) == [12, None, None]
    nearby = spark.createDataFrame([("hit", ["a", "[第4页]"])], "c string, x array<string>")
    assert nearby.select(T.page_number(F.col("c"), F.col("x")).alias("v")).first().v == 4


CHUNKS = "id long, document_id long, chunk_index int, content string, token_count int, extra string"
DOCS = "id long, original_name string, file_type string, file_path string, kb_id long, total_chunks int, extra string"


@pytest.fixture(scope="module")
def corpus(spark):
    chunks = spark.createDataFrame([
        (1, 10, 0, "Café au lait, foo-bar", 5, ""), (2, 10, 1, "cafe noir snake_case", 4, ""), (3, 10, 2, "foo x bar 50%", 4, ""),
        (4, 20, 0, "北方分部的保险证明", 9, ""), (5, 20, 1, None, 0, ""), (6, 99, 0, "foo bar orphan", 3, ""), (7, 30, 0, "a 100% b", 3, ""), (7, 30, 0, "a 100% b", 3, ""),
    ], CHUNKS)
    documents = spark.createDataFrame([(10, "b.txt", "txt", "/b.txt", 1, 3, ""), (20, "a.pdf", "pdf", "/a.pdf", 2, 2, ""), (30, "c", "md", "/c", 1, 1, "")], DOCS)
    links = spark.createDataFrame([(10, 1), (20, 2), (20, 2), (77, 1)], "document_id long, kb_id long")
    return chunks, documents, links


def found(corpus, query, **k):
    return [r.id for r in S.search(*corpus, query, **k).collect()]


def test_search(corpus):
    assert found(corpus, "cafe") == [1, 2] and found(corpus, "CAFÉ") == [1, 2]
    assert found(corpus, "foo-bar") == [1] and found(corpus, "foo bar") == [1, 3]
    assert found(corpus, "snake_case") == [2] and found(corpus, "case snake", match_mode="any") == [2]
    assert found(corpus, "保险") == [4], "a part of a Chinese run is found as a substring"
    assert found(corpus, "20") == [4, 5], "the document's number is indexed"
    assert found(corpus, "--") == [] and found(corpus, "cafe --", match_mode="any") == [1, 2]
    assert found(corpus, "") == [] and found(corpus, " ,;") == []
    assert found(corpus, "cafe", kb_id=2) == [] and found(corpus, "cafe", kb_id=1) == [1, 2] and found(corpus, "cafe", kb_id=0) == [1, 2]
    assert found(corpus, "foo bar", limit=1) == [1]
    assert found(corpus, "a 1%b") == [7, 7], "wildcards stay wildcards in the substring branch"
    row = S.search(*corpus, "20").first()
    assert row.matched_terms == [] and row.snippet == "北方分部的保险证明"


def test_search_with_stored_index(spark, corpus, tmp_path):
    S.postings(corpus[0]).write.parquet(str(tmp_path / "index"))
    assert found(corpus, "foo-bar", index=spark.read.parquet(str(tmp_path / "index"))) == [1]
    S.write_postings(corpus[0], "index_of_tests", 2)
    assert found(corpus, "cafe", index=spark.table("index_of_tests")) == [1, 2]
    spark.sql("DROP TABLE index_of_tests")


def test_search_empty(corpus):
    chunks, documents, links = corpus
    assert S.search(chunks.limit(0), documents, links, "foo").count() == 0
    assert S.search(chunks, documents.limit(0), links, "foo").count() == 0


def test_context(spark, corpus):
    chunks, documents, _ = corpus
    ids = spark.createDataFrame([(1,), (2,), (404,)], "id long")
    got = {r.id: [c.id for c in r.context] for r in S.context(chunks, documents, ids, 1).collect()}
    assert got == {1: [1, 2], 2: [1, 2, 3]}
    windows = {r.id: [c.id for c in r.context] for r in S.context_windows(chunks, 1).collect()}
    assert windows[2] == [1, 2, 3] and windows[4] == [4, 5]
    page = S.preview(chunks, documents, 2, "noir").first()
    assert page.label == "2/3" and page.page is None and page.anchor == "/b.txt" and "[命中片段 2]<br>cafe <span" in page.html
    assert S.preview(chunks, documents, 404).count() == 0


def test_catalog_lists(spark):
    states = spark.createDataFrame([(1, "a", "2025-01-01", None, "2025-01-02"), (1, "b", "2025-01-01", "2025-01-03", "2025-01-03"), (1, "b", "2025-01-01", "2025-01-03", "2025-01-03"), (None, "x", "2025-01-01", None, None), (2, None, None, None, None)], "id long, original_name string, created_at string, updated_at string, loaded_at string")
    assert sorted((r.id, r.original_name) for r in C.current_documents(states).collect()) == [(1, "b"), (2, None)]
    docs = spark.createDataFrame([(1, 5, "One", 3), (2, 6, "Two", 1), (3, None, None, 2)], "id long, kb_id long, original_name string, created_at long")
    links = spark.createDataFrame([(1, 5), (1, 5), (1, 7), (2, 99)], "document_id long, kb_id long")
    kbs = spark.createDataFrame([(5, "five"), (7, "seven"), (6, "six")], "id long, name string")
    assert [(r.id, r.kb_ids, r.kb_names) for r in C.list_documents(docs.withColumn("status", F.lit("s")), links, kbs).collect()] == [(1, "5,7", "five, seven"), (3, None, None), (2, None, None)]
    assert [r.id for r in C.list_documents_by_knowledge_base(docs, links, kbs, 7).collect()] == [1]
    assert sorted((r.document_id, r.kb_id) for r in C.missing_home_links(docs, links, kbs).collect()) == [(2, 6), (3, 1)]
    assert [r.id for r in C.filter_documents(docs, "ONE").collect()] == [1] and C.filter_documents(docs, "").count() == 3


def test_document_text(spark):
    rows = [(1, 10, 1, "b"), (2, 10, 0, "a"), (3, 10, 0, "again"), (4, 10, 2, None), (5, 11, 0, ""), (6, None, 0, "x")]
    df = spark.createDataFrame(rows, "id long, document_id long, chunk_index int, content string")
    assert {r.document_id: r.text for r in C.document_text(df).collect()} == {10: "a\n\nb", 11: ""}
    assert C.document_text(df.limit(0)).count() == 0


def test_set_changes(spark):
    links = spark.createDataFrame([(1, 5), (1, 5), (2, 6), (None, 7)], "document_id long, kb_id long")
    pairs = spark.createDataFrame([(1, 9), (3, 9)], "document_id long, kb_id long")
    rows = lambda df: sorted(((r.document_id, r.kb_id) for r in df.collect()), key=str)
    assert rows(C.with_links(links, pairs)) == sorted([(1, 5), (1, 9), (2, 6), (3, 9), (None, 7)], key=str)
    assert rows(C.moved(links, pairs)) == sorted([(1, 9), (2, 6), (3, 9), (None, 7)], key=str)
    assert rows(C.without(links, pairs.select("document_id"), "document_id")) == sorted([(2, 6), (None, 7)], key=str)
    docs = spark.createDataFrame([(1, "a", "e"), (2, "b", None)], "id long, status string, error_message string")
    changes = spark.createDataFrame([(1, "done", None), (9, "x", "y")], "id long, status string, error_message string")
    assert sorted(tuple(r) for r in C.with_status(docs, changes).collect()) == [(1, "done", None), (2, "b", None)]
    assert [r.chunk_index for r in C.numbered(spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "d long, t string"), "d", "t").orderBy("d", "t").collect()] == [0, 1, 0]


def test_catalog_changes(spark, tmp_path):
    c = C.Catalog(spark, str(tmp_path / "cat"))
    kb = c.create_knowledge_base("Two", "d")
    files = spark.createDataFrame([(f"f{i}", f"F{i}", "txt", i, f"/f{i}") for i in range(3)], "filename string, original_name string, file_type string, file_size long, file_path string")
    ids = sorted(r.id for r in c.create_documents(files, kb).collect())
    assert ids == [1, 2, 3] and kb == 2
    chunks = spark.createDataFrame([(1, 0, "x", None), (1, 1, "y", 3), (2, 0, "z", 1)], "document_id long, chunk_index int, content string, token_count int")
    assert sorted(r.id for r in c.create_chunks(chunks).collect()) == [1, 2, 3]
    c.update_document_status(1, "completed")
    c.update_document_chunks(1, 2)
    row = c.get_document(1).first()
    assert (row.status, row.total_chunks, row.updated_at is not None) == ("completed", 2, True)
    assert [r.content for r in c.get_chunks_by_document(1).collect()] == ["x", "y"]
    c.add_document_to_knowledge_base(1, 1)
    c.add_document_to_knowledge_base(1, 1)
    assert {r.id: r.kb_ids for r in c.list_documents().collect()} == {1: "1,2", 2: "2", 3: "2"}
    c.move_document_to_knowledge_base(1, 1)
    assert {r.id: r.kb_ids for r in c.list_documents("completed").collect()} == {1: "1"}
    c.delete_document(2)
    assert sorted(r.id for r in c.table("documents").collect()) == [1, 3] and c.table("chunks").count() == 2
    c.delete_knowledge_base(kb)
    assert {r.id: r.kb_ids for r in c.list_documents().collect()} == {1: "1", 3: None}
    c.repair_links()
    assert {r.id: r.kb_ids for r in C.Catalog(spark, str(tmp_path / "cat")).list_documents().collect()} == {1: "1", 3: "1"}
    c.delete_document_chunks(1)
    assert c.table("chunks").count() == 0


def cutter(size, overlap):
    """Tokens are characters."""
    return Cutter(size, overlap, lambda t: list(map(ord, t)), lambda ids: "".join(map(chr, ids)))


def test_fixed_counts():
    s, o = 10, 3
    for n in (0, 1, s, s + 1, 2 * s - o, 2 * s - o + 1, 57):
        text = "".join(random.Random(n).choices("abcdef", k=n))
        got = cutter(s, o).run("fixed", text)
        assert len(got) == (0 if n == 0 else 1 if n <= s else 1 + -(-(n - s) // (s - o)))
        assert "".join(c if i == 0 else c[o:] for i, (c, _) in enumerate(got)) == text
        assert all(a[0][-o:] == b[0][:o] for a, b in pairwise(got))
    assert len(cutter(10, 0).run("fixed", "x" * 20)) == 2
    with pytest.raises(ValueError):
        Chunking(64, 64)


def test_strategies():
    assert cutter(6, 2).run("paragraph", "aaa\n\n bbb \nccc\nlonger than it") == [("aaabbb", 6), ("bbccc", 5), ("cclonger than it", 16)]
    assert cutter(18, 2).run("semantic", "intro\n# one\nx\n####### no\n[第1页]\ny\n[第1页幻灯片]z") == [("intro", 5), ("# one\nx\n####### no", 18), ("[第1页]\ny\n[第1页幻灯片]z", 17)]
    assert cutter(30, 2).run("semantic", "intro\n# one\n[1页]\np") == [("intro\n\n# one\n\n[1页]\np", 5 + 5 + 6)]
    assert [c for c, _ in cutter(5, 1).run("recursive", "ab cd\n\nefghijkl\n\nx")] == ["ab cd", "efghi", "ijkl", "x"]
    assert cutter(12, 2).run("sentence", "One. Two! Three? 四。3.14") == [("One. Two!", 8), ("Two! Three? 四。", 12), ("四。 3. 14", 6)]
    assert cutter(5, 1).run("unknown", "abc") == [("abc", 3)] and cutter(5, 1).run("fixed", None) == []
    assert cutter(3, 1).run("sentence", "Long one. b.")[0] == ("Long one.", 9)


def test_chunk_dataframe(spark):
    df = spark.createDataFrame([(1, "word " * 300, "x"), (2, None, "x"), (3, " ", "x"), (4, "short", "x")], "id long, text string, content string")
    for s in STRATEGIES:
        rows = chunk(df, Chunking(100, 10, s)).collect()
        by = {i: sorted(r.chunk_index for r in rows if r.document_id == i) for i in (1, 2, 4)}
        assert by[2] == [] and by[4] == [0] and by[1] == list(range(len(by[1])))
        assert s == "paragraph" or s == "sentence" or all(r.token_count <= 100 for r in rows)
    native = word_chunks(df, 100, 10).collect()
    assert sorted((r.document_id, r.chunk_index, r.token_count) for r in native) == [(1, 0, 100), (1, 1, 100), (1, 2, 100), (1, 3, 30), (4, 0, 1)]
    assert chunk(df.limit(0)).count() == 0


def test_checkpoints_need_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from leafmill.session import checkpoint_dir

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d: d)))


def test_index_is_kept_with_the_chunks(spark, tmp_path):
    c = C.Catalog(spark, str(tmp_path / "cat"))
    files = spark.createDataFrame([("a.txt", "a.txt", "txt", 1, "/a.txt"), ("b.txt", "b.txt", "txt", 1, "/b.txt")], "filename string, original_name string, file_type string, file_size long, file_path string")
    first, second = (r.id for r in c.create_documents(files).orderBy("filename").collect())
    hits = lambda q, **k: sorted(r.document_id for r in c.search(q, **k).collect())
    assert hits("pump") == []
    c.create_chunks(spark.createDataFrame([(first, 0, "the pump", 2)], "document_id long, chunk_index int, content string, token_count int"))
    c.create_chunks(spark.createDataFrame([(second, 0, "a Pump and a valve", 5), (second, 1, None, 0)], "document_id long, chunk_index int, content string, token_count int"))
    assert hits("pump") == [first, second] and hits("pump valve") == [second] and hits("valv") == [second]
    assert hits("pump", limit=1) == [first]
    c.delete_document_chunks(second)
    assert hits("pump") == [first] and c.index.rows(["valve"]).count() == 0
    c.delete_document(first)
    assert hits("pump") == [] and c.index.rows().count() == 0
    assert [(r.name, r.documents) for r in c.list_knowledge_bases().collect()] == [(C.DEFAULT_KB_NAME, 1)]
    assert [r.id for r in c.list_documents_by_knowledge_base(C.DEFAULT_KB).collect()] == [second]


def test_search_reads_one_part_of_the_index_and_no_other_content(spark, corpus, tmp_path):
    from leafmill.plans.inspect import columns_read, formatted, pushed_filters

    chunks, documents, links = corpus
    for name, df in (("chunks", chunks), ("documents", documents)):
        df.write.parquet(str(tmp_path / name))
    chunks, documents = (spark.read.parquet(str(tmp_path / n)) for n in ("chunks", "documents"))
    index = S.stored_index(chunks, "test")
    assert S.stored_index(chunks, "test").table.latest() == 1
    read = index.rows(["cafe"])
    assert {f.rsplit("bucket=", 1)[1].split("/")[0] for f in read.inputFiles()} == {str(__import__("zlib").crc32(b"cafe") % 64)}
    assert any("In(token" in f or "EqualTo(token,cafe)" in f for f in pushed_filters(read))
    assert found((chunks, documents, links), "foo bar", index=index) == [1, 3] and found((chunks, documents, links), "保险", index=index) == [4]
    plan = S.search(chunks, documents, links, "cafe", index=index)
    assert "LIKE" not in formatted(plan) and any("In(id, [1,2])" in f for f in pushed_filters(plan))
    assert sum("content" in c for c in columns_read(plan)) == 1


def test_large_documents_are_spread(spark):
    rows = [(i, 7, i, f"c{i}", 1, "") for i in range(40)] + [(50, 8, None, "n", 1, "")]
    chunks = spark.createDataFrame(rows, CHUNKS)
    for places in (4, 1000):
        got = {r.id: [c.id for c in r.context] for r in S.context_windows(chunks, 2, places).collect()}
        assert got[50] == [50] and all(got[i] == list(range(max(0, i - 2), min(39, i + 2) + 1)) for i in range(40))
    parts = sorted((r.part, r.text) for r in C.document_text(chunks, 16).filter("document_id = 7").collect())
    assert [p for p, _ in parts] == [0, 1, 2] and "\n\n".join(t for _, t in parts) == "\n\n".join(f"c{i}" for i in range(40))
