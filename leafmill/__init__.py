"""leafmill: a Spark-first engine for document catalogues, text chunks and keyword search."""
