from leafmill import queries as Q
from leafmill.plans.inspect import columns_read, exchanges, pushed_filters, python_steps

CHUNKS = "id long, document_id long, chunk_index int, content string, token_count int, created_at timestamp"
STATES = "id long, kb_id long, filename string, original_name string, file_type string, file_size long, file_path string, total_chunks int, status string, error_message string, created_at timestamp, updated_at timestamp, loaded_at timestamp"


def tables(spark, folder):
    spark.createDataFrame([], CHUNKS).write.parquet(f"{folder}/chunks.parquet")
    spark.createDataFrame([], STATES).write.parquet(f"{folder}/catalog_documents.parquet")
    spark.createDataFrame([], "document_id long, kb_id long, created_at timestamp").write.parquet(f"{folder}/document_knowledge_bases.parquet")
    return str(folder)


def test_scans_read_what_they_need(spark, tmp_path):
    d = tables(spark, tmp_path)
    assert columns_read(Q.QUERIES["agg_chunk_counts"](spark, d)) == [{"document_id", "chunk_index"}]
    joined = columns_read(Q.QUERIES["jn_chunks_documents"](spark, d))
    assert {"id", "document_id", "chunk_index"} in joined and all("content" not in c for c in joined)
    one = Q.QUERIES["lst_chunks_of_document"](spark, d)
    assert any("EqualTo(document_id,7)" in f for f in pushed_filters(one))


def test_text_functions_stay_in_the_jvm_and_do_not_shuffle(spark, tmp_path):
    d = tables(spark, tmp_path)
    for name in ("fn_clean_text", "fn_html_to_text", "fn_page_number", "fn_highlight", "fn_truncate_normalize"):
        df = Q.QUERIES[name](spark, d)
        assert exchanges(df) == 0 and python_steps(df) == 0, name


def test_current_state_is_one_shuffle(spark, tmp_path):
    assert exchanges(Q.QUERIES["cat_current"](spark, tables(spark, tmp_path))) == 1
