"""Queries of the file readers: files are written from the rows of whole tables, read by the readers, and SQL makes the text that must come out from the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators.catalog import Catalog
from leafmill.operators.chunking import BLANK, Chunking
from leafmill.session import checkpoint_dir
from leafmill.sources import extract as E
from leafmill.sources import samples
from leafmill.sources.tables import load
from leafmill.sources.tools import Tools
from leafmill.streaming.ingest import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Customers of each nation, numbered by key.
_ROWS = """g AS (SELECT n.n_name AS t, c.c_custkey AS k, c.c_name AS name, c.c_mktsegment AS s, row_number() OVER (PARTITION BY n.n_nationkey ORDER BY c.c_custkey) AS i,
  count(*) OVER (PARTITION BY n.n_nationkey) AS n FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey)"""
_NL = "chr(10)"


def _rows(spark: SparkSession, d: str) -> DataFrame:
    nations = load(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))
    return load(spark, d, "customer").join(nations, "c_nationkey").select("nation", F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))


def _agg(line: str, between: str = _NL, order: str = "i", where: str = "true") -> str:
    return f"string_agg({line}, {between} ORDER BY {order}) FILTER (WHERE {where})"


#: A number of seconds as the readers show it.
_LASTS = "'时长: ' || CASE WHEN max(n) >= 60 THEN (max(n) // 60) || '分' || lpad(CAST(max(n) % 60 AS VARCHAR), 2, '0') || '秒' ELSE max(n) || '秒' END"


def _media(kind: str, label: str, size: str, told: str, film: bool = False) -> str:
    """The report of a sound or film file."""
    what = "视频" if film else "音频"
    return f"'{what}文件: ' || t || '.{kind}' || chr(10) || '格式: {label}{what}' || chr(10) || '大小: ' || {size} || repeat(chr(10), 2) || '--- 元数据 ---' || chr(10) || {told} || repeat(chr(10), 2) || '--- 提示 ---' || chr(10) || '未找到字幕文件。'"


#: The text of a nation's file by type, as SQL over the rows of the nation.
TEXTS = {
    "csv": f"'[表头] key | name | segment' || {_NL} || {_agg("k || ' | ' || name || ', Ltd | ' || s", where='i <= 1000')} || CASE WHEN max(n) > 1000 THEN {_NL} || '... 共' || max(n) || '行数据（已截取前1000行）' ELSE '' END",
    "tsv": f"'[表头] key | name | segment' || {_NL} || {_agg("k || ' | ' || name || ' | ' || s", where='i <= 1000')} || CASE WHEN max(n) > 1000 THEN {_NL} || '... 共' || max(n) || '行数据（已截取前1000行）' ELSE '' END",
    "json": f"'nation: ' || t || {_NL} || "
    + _agg("'customers[' || (i - 1) || '].key: ' || k || chr(10) || 'customers[' || (i - 1) || '].name: ' || name || chr(10) || 'customers[' || (i - 1) || '].tags[0]: ' || s || chr(10) || 'customers[' || (i - 1) || '].tags[1]: None' || chr(10) || 'customers[' || (i - 1) || '].tags[2]: True'"),
    "xml": f"t || {_NL} || {_agg("name || chr(10) || s || ' & co'")}",
    "yaml": f"'nation: ' || t || {_NL} || {_agg("'c' || k || ': ' || name")}",
    "toml": f"'title: ' || t || {_NL} || {_agg("'customers.c' || k || ': ' || name")}",
    "ini": f"'[节] ' || t || {_NL} || {_agg("'c' || k || ': ' || name")}",
    "properties": _agg("'cust:' || k || ': 中' || name || s"),
    "log": _agg("k || ' ' || name", "repeat(chr(10), 3)"),
    "txt": _agg("'客户 ' || name || ' ' || s"),
    "md": f"'# ' || t || repeat({_NL}, 2) || {_agg("'- ' || name")}",
    "html": f"t || {_NL} || {_agg("name || ' <' || s || '> é'")}",
    "py": f"'[代码文件: ' || t || '.py]' || {_NL} || {_agg("'c' || k || ' = \"' || name || '\"'")}",
    "srt": _agg("name || chr(10) || s"),
    "vtt": _agg("name"),
    "ass": _agg("name || ', ' || s"),
    "rtf": f"'café ' || t || {_NL} || {_agg("k || ' | ' || name")}",
    "docx": f"'[页眉]' || {_NL} || 'Head ' || t || repeat({_NL}, 2) || '## ' || t || repeat({_NL}, 2) || 'Customers' || repeat({_NL}, 2) || '[表格]' || {_NL} || {_agg("k || ' | ' || name || ' | ' || s")} || repeat({_NL}, 2) || '[脚注]' || {_NL} || '[3] ' || max(n) || ' rows'",
    "pptx": f"'[第1页幻灯片]' || {_NL} || t || {_NL} || 'grouped' || repeat({_NL}, 2) || '[第2页幻灯片]' || {_NL} || '[表头] key | name' || {_NL} || {_agg("k || ' | ' || name")} || repeat({_NL}, 2) || '[第1页备注]' || {_NL} || 'remark'",
    "xlsx": f"'[工作表: ' || t || ']' || {_NL} || 'key | name | day' || {_NL} || {_agg("k || ' | ' || name || ' | ' || CAST(DATE '1899-12-30' + CAST(40000 + k % 1000 AS INTEGER) AS DATE)", where='i <= 499')} || CASE WHEN max(n) > 499 THEN {_NL} || '... 共' || (max(n) + 1) || '行数据（已截取前500行）' ELSE '' END",
    "odt": f"'# ' || t || repeat({_NL}, 2) || {_agg("'- ' || name || chr(9) || s", 'repeat(chr(10), 2)')}",
    "ods": f"'[工作表: ' || t || ']' || {_NL} || {_agg("k || ' | ' || name")}",
    "odp": f"'[第1页幻灯片]' || {_NL} || t || repeat({_NL}, 2) || '[第2页幻灯片]' || {_NL} || {_agg('name')}",
    "epub": f"'[书名] ' || t || repeat({_NL}, 2) || {_agg('name', 'repeat(chr(10), 2)', 'i DESC')}",
    "pdf": _agg("CASE WHEN i % 20 = 1 THEN CASE WHEN i > 1 THEN chr(10) ELSE '' END || '[第' || ((i + 19) // 20) || '页]' || chr(10) ELSE '' END || k || ' (' || name || ')'"),
    "mht": f"t || {_NL} || {_agg("name || ' é'")} || repeat({_NL}, 2) || 'plain part'",
    "zip": f"'[文件: long.md]' || {_NL} || repeat('x', 10000) || repeat({_NL}, 2) || '... (10001 字符，已截断)' || repeat({_NL}, 2) || {_agg("'[文件: ' || s || '/' || k || '.txt]' || chr(10) || name", 'repeat(chr(10), 2)')}",
    "wav": _media("wav", "WAV", "'52 B'", "'编码: PCM' || chr(10) || '声道: 2' || chr(10) || '采样率: 8000 Hz' || chr(10) || '位深: 16 bit' || chr(10) || " + _LASTS),
    "flac": _media("flac", "FLAC", "'42 B'", "'采样率: 44100 Hz' || chr(10) || '声道: 2' || chr(10) || '位深: 16 bit' || chr(10) || " + _LASTS),
    "mp3": _media("mp3", "MP3", "printf('%.1f KB', (16021 + length(t)) / 1024.0)", "'标题: ' || t || chr(10) || '比特率: 128 kbps' || chr(10) || '采样率: 44100 Hz' || chr(10) || '声道: 立体声' || chr(10) || '时长: 1秒'"),
    "mp4": _media("mp4", "MP4", "'228 B'", "'品牌: isom' || chr(10) || " + _LASTS + " || chr(10) || '分辨率: 640x360'", film=True),
    "mkv": _media("mkv", "MKV", "'37 B'", "'分辨率: 640x100' || chr(10) || " + _LASTS, film=True),
    "flv": _media("flv", "FLV", "'72 B'", _LASTS, film=True),
    "doc": f"'Customers of ' || t || {_NL} || {_agg("name || ' ' || s")}",
    "ppt": _agg("name || ' 中' || chr(10) || s || ' ' || k"),
    "xls": _agg("name", where="i <= 5000"),
}


def _reader_query(kind: str, text: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        read = E.extract(samples.files(_rows(spark, sf_dir), kind))
        return read.select(F.substring_index("name", ".", 1).alias("nation"), "text", "error")

    run.__name__, run.__doc__ = f"src_{kind}", f"The customers of each nation, written as a {kind} file and read again."
    QUERIES[run.__name__] = run
    SQL[run.__name__] = f"WITH {_ROWS} SELECT t AS nation, {text} AS text, CAST(NULL AS VARCHAR) AS error FROM g GROUP BY t"


TEXTS["dotx"] = f"{TEXTS['docx']} || repeat({_NL}, 2) || '[嵌入资源]' || {_NL} || '[嵌入图片] word/media/i.png (' || (max(n) + 4) || ' bytes)' || {_NL} || '[嵌入音频] word/media/s.mp3 (3 bytes)'"

for _kind, _sql in TEXTS.items():
    _reader_query(_kind, _sql)


def _query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@_query(f"WITH {_ROWS} SELECT t AS nation, CAST((i + 19) // 20 AS INTEGER) AS page, {_agg("k || ' (' || name || ')'")} AS text FROM g GROUP BY t, (i + 19) // 20")
def src_pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PDF files as rows of pages."""
    pages = E.page_rows(samples.files(_rows(spark, sf_dir), "pdf"))
    return pages.select(F.regexp_extract("path", r"([^/]+)\.pdf$", 1).alias("nation"), "page", "text")


@_query(f"WITH {_ROWS} SELECT t AS nation, s || '/' || k || '.txt' AS member, name AS text FROM g UNION ALL SELECT DISTINCT t, 'long.md', repeat('x', 10001) FROM g")
def src_zip_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives as rows of their text members, whole."""
    members = E.member_rows(samples.files(_rows(spark, sf_dir), "zip"))
    return members.select(F.regexp_extract("path", r"([^/]+)\.zip$", 1).alias("nation"), "member", "text")


@_query(f"WITH {_ROWS} SELECT t AS nation, t AS title, CAST((max(n) + 19) // 20 AS VARCHAR) AS pages FROM g GROUP BY t")
def src_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What PDF files tell of themselves."""
    told = E.metadata(samples.files(_rows(spark, sf_dir), "pdf"))
    value = lambda k: F.try_element_at("metadata", F.lit(k))
    return told.select(F.regexp_extract("path", r"([^/]+)\.pdf$", 1).alias("nation"), value("title").alias("title"), value("page_count").alias("pages"))


@_query(f"""WITH {_ROWS} SELECT t || '.wav' AS file, t || '.srt' AS subtitle, left({_agg("name || chr(10) || s")}, 40) AS spoken FROM g GROUP BY t""")
def src_subtitles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sound files with the subtitle files beside them, and how the words begin in the report."""
    rows = _rows(spark, sf_dir)
    read = E.extract(samples.files(rows, "wav").unionByName(samples.files(rows, "srt")))
    base = lambda c: F.substring_index(c, "/", -1)
    pairs = E.sidecar_subtitles(read).select(F.col("path").alias("_path"), base("subtitle_path").alias("subtitle"))
    told = E.attach_subtitles(read).filter("file_type = 'wav'").join(pairs, F.col("path") == F.col("_path"))
    return told.select(base("path").alias("file"), "subtitle", F.substring(F.regexp_extract("text", r"(?s)--- 字幕文本 ---\n(.*)", 1), 1, 40).alias("spoken"))


@_query(f"SELECT id, file_type, list_contains(string_split('{' '.join(sorted(E.TYPES))}', ' '), lower(regexp_replace(file_type, '^\\.', ''))) AS supported FROM catalog_documents")
def flt_supported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the type that each catalogued state claims is registered."""
    return load(spark, sf_dir, "catalog_documents").select("id", "file_type", E.supported(F.col("file_type")).alias("supported"))


@_query(f"WITH {_ROWS} SELECT t AS nation, 'About ' || t AS title, arg_min(name, i) AS author FROM g GROUP BY t")
def src_properties_of_docx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and author that office files tell of themselves."""
    told = E.metadata(samples.files(_rows(spark, sf_dir), "docx"))
    value = lambda k: F.try_element_at("metadata", F.lit(k))
    return told.select(F.regexp_extract("path", r"([^/]+)\.docx$", 1).alias("nation"), value("title").alias("title"), value("author").alias("author"))


def _decoded(raw: bytes, name: str = "") -> str:
    return raw.decode()


@_query(f"WITH {_ROWS} SELECT t AS nation, 'jpg' AS file_type, {_agg('name')} AS text FROM g GROUP BY t UNION ALL SELECT t, 'm4a', {_agg('s')} FROM g GROUP BY t")
def src_with_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures and sounds whose words come from functions that the caller gives."""
    rows = _rows(spark, sf_dir)
    read = E.extract(samples.files(rows, "jpg").unionByName(samples.files(rows, "m4a")), tools=Tools(ocr=_decoded, speech=_decoded))
    return read.select(F.substring_index("name", ".", 1).alias("nation"), "file_type", F.regexp_replace("text", r"(?s)^.*--- 语音转文字 ---\n", "").alias("text"))


@_query(f"""WITH {_ROWS}, w AS (SELECT t, 3 * max(n) AS words FROM g GROUP BY t)
    SELECT t || '.txt' AS name, 'txt' AS file_type, 'completed' AS status, CAST(1 + greatest(0, ceil((words - 128) / 112.0)) AS INTEGER) AS total_chunks, CAST(words + 16 * greatest(0, ceil((words - 128) / 112.0)) AS BIGINT) AS tokens, CAST(1 AS BIGINT) AS kb_id FROM w""")
def dml_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files taken into a new catalogue: the documents with their state, and the words of their chunks."""
    catalog = Catalog(spark, f"{checkpoint_dir(spark)}/ingest-{uuid.uuid4().hex}")
    ingest(catalog, samples.files(_rows(spark, sf_dir), "txt"), options=Chunking(128, 16, "fixed", BLANK))
    tokens = catalog.table("chunks").groupBy(F.col("document_id").alias("id")).agg(F.sum("token_count").alias("tokens"))
    return catalog.table("documents").join(tokens, "id").select(F.col("original_name").alias("name"), "file_type", "status", "total_chunks", "tokens", "kb_id")
