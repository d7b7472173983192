"""Extraction of text from files of any registered type, as a DataFrame over Spark's ``binaryFile`` source."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators.versioned import same_path
from leafmill.sources import formats, legacy, media, office
from leafmill.sources.tools import Tools

#: A reader: bytes and name of a file to text.
Reader = Callable[[bytes, str], str]

# Registered types and what they are called.
TYPES = {
    "pdf": "PDF文档", "docx": "Word文档", "doc": "Word文档(旧版)", "dotx": "Word模板", "dotm": "Word宏模板",
    "pptx": "PowerPoint演示文稿", "ppt": "PowerPoint演示文稿(旧版)", "potx": "PowerPoint模板", "potm": "PowerPoint宏模板",
    "xlsx": "Excel表格", "xls": "Excel表格(旧版)", "xlsm": "Excel宏表格", "xltx": "Excel模板", "xlam": "Excel加载项", "xlsb": "Excel二进制表格",
    "epub": "EPUB电子书", "rtf": "RTF富文本", "odt": "OpenDocument文字", "ods": "OpenDocument表格", "odp": "OpenDocument演示", "mht": "MHTML网页归档", "mhtml": "MHTML网页归档",
    "mp3": "MP3音频", "wav": "WAV音频", "flac": "FLAC音频", "aac": "AAC音频", "m4a": "M4A音频", "ogg": "OGG音频", "wma": "WMA音频", "opus": "Opus音频",
    "mp4": "MP4视频", "mkv": "MKV视频", "avi": "AVI视频", "mov": "MOV视频", "wmv": "WMV视频", "flv": "FLV视频", "webm": "WebM视频", "m4v": "M4V视频", "3gp": "3GP视频",
    "srt": "SRT字幕", "vtt": "WebVTT字幕", "ass": "ASS字幕", "ssa": "SSA字幕", "sub": "SUB字幕",
    "txt": "纯文本", "md": "Markdown", "html": "HTML网页", "htm": "HTML网页", "csv": "CSV表格", "tsv": "TSV表格", "json": "JSON数据", "xml": "XML数据", "yaml": "YAML数据", "yml": "YAML数据",
    "toml": "TOML配置", "ini": "INI配置", "conf": "CONF配置", "cfg": "CFG配置", "properties": "Properties配置", "log": "日志文件",
    "py": "Python代码", "js": "JavaScript代码", "java": "Java代码", "c": "C代码", "cpp": "C++代码", "h": "C头文件", "hpp": "C++头文件", "cs": "C#代码", "go": "Go代码", "rs": "Rust代码",
    "rb": "Ruby代码", "php": "PHP代码", "swift": "Swift代码", "kt": "Kotlin代码", "scala": "Scala代码", "r": "R代码", "m": "Objective-C代码", "mm": "Objective-C++代码", "sql": "SQL脚本",
    "sh": "Shell脚本", "bat": "批处理脚本", "cmd": "CMD脚本", "ps1": "PowerShell脚本", "bash": "Bash脚本", "zsh": "Zsh脚本", "css": "CSS样式", "scss": "SCSS样式", "sass": "Sass样式", "less": "Less样式",
    "vue": "Vue组件", "jsx": "JSX代码", "tsx": "TSX代码", "dockerfile": "Dockerfile", "makefile": "Makefile", "cmake": "CMake配置", "gradle": "Gradle配置",
    "tex": "LaTeX文档", "bib": "BibTeX文献", "rst": "reStructuredText", "adoc": "AsciiDoc", "org": "Org Mode", "zip": "ZIP压缩包",
    "jpg": "JPEG图片(OCR)", "jpeg": "JPEG图片(OCR)", "png": "PNG图片(OCR)", "bmp": "BMP图片(OCR)", "gif": "GIF图片(OCR)", "tiff": "TIFF图片(OCR)", "tif": "TIFF图片(OCR)", "webp": "WebP图片(OCR)",
}
SUBTITLES = ("srt", "vtt", "ass", "ssa", "sub")
#: Suffixes before the type that a subtitle file of the same name may have, by precedence.
SUBTITLE_LANGUAGES = ("", "zh", "en", "chs", "cht", "cn")
IMAGES = ("jpg", "jpeg", "png", "bmp", "gif", "tiff", "tif", "webp")
#: Types that are zip packages and may hold pictures, sounds or films.
PACKAGES = frozenset("docx dotx dotm pptx potx potm xlsx xlsm xltx xlam epub odt ods odp".split())
#: Types of archive members that are text without looking.
TEXT_TYPES = frozenset({"txt", "md", "html", "htm", "xml", "json", "yaml", "yml", "toml", "ini", "conf", "cfg", "properties", "log", "csv", "tsv", *T.CODE})


def _sound(raw: bytes, name: str) -> str:
    return media.report(raw, name, TYPES[name.rsplit(".", 1)[-1].lower()], film=False)


def _film(raw: bytes, name: str) -> str:
    return media.report(raw, name, TYPES[name.rsplit(".", 1)[-1].lower()], film=True)


def _image(raw: bytes, name: str) -> str:
    raise NotImplementedError("no OCR function is registered")


READERS: dict[str, Reader] = (
    {"pdf": legacy.pdf, "doc": legacy.doc, "ppt": legacy.ppt, "xls": legacy.xls, "xlsb": office.xlsb, "epub": office.epub, "rtf": legacy.rtf, "zip": formats.archive}
    | dict.fromkeys(("docx", "dotx", "dotm"), office.docx)
    | dict.fromkeys(("pptx", "potx", "potm"), office.pptx)
    | dict.fromkeys(("xlsx", "xlsm", "xltx", "xlam"), office.xlsx)
    | dict.fromkeys(("odt", "ods", "odp"), office.open_document)
    | dict.fromkeys(("mht", "mhtml"), formats.web_archive)
    | dict.fromkeys(("txt", "md"), formats.text)
    | dict.fromkeys(("html", "htm"), formats.web)
    | {"csv": formats.comma_table, "tsv": formats.tab_table, "json": formats.json_text, "xml": formats.xml_text, "yaml": formats.yaml_text, "yml": formats.yaml_text, "toml": formats.toml_text}
    | dict.fromkeys(("ini", "conf", "cfg"), formats.ini_text)
    | {"properties": formats.properties_text, "log": formats.log}
    | dict.fromkeys(SUBTITLES, formats.subtitles)
    | dict.fromkeys(T.AUDIO, _sound)
    | dict.fromkeys(T.VIDEO, _film)
    | dict.fromkeys(IMAGES, _image)
    | dict.fromkeys(T.CODE, formats.code)
)


def register(file_type: str, reader: Reader, label: str | None = None) -> None:
    """Add or replace the reader of a type, for instance one with OCR or speech recognition. Takes effect for plans made afterwards."""
    READERS[file_type.lower().lstrip(".")] = reader
    TYPES.setdefault(file_type.lower().lstrip("."), label or file_type.upper())


def read_files(spark: SparkSession, *paths: str, pattern: str | None = None) -> DataFrame:
    """Files below ``paths``: ``path``, ``modificationTime``, ``length``, ``content`` (read only where it is used), ``name``, ``file_type``.

    Spark's source passes over empty files; they are added from its own listing, so that they can be reported.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(list(paths))
    listed = spark.createDataFrame([(same_path(p).replace("file:///", "file:/"),) for p in files.inputFiles()], "path string")
    empty = listed.join(files.select(F.regexp_replace("path", "^file:///", "file:/").alias("path")), "path", "left_anti")
    files = files.unionByName(empty.select("path", F.lit(None).cast("timestamp").alias("modificationTime"), F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content")))
    return files.withColumns({"name": T.base_name(F.col("path")), "file_type": T.extension(F.col("path"))})


def supported(file_type) -> F.Column:
    """Whether a type is registered; case and a leading dot aside."""
    return F.lower(F.regexp_replace(file_type, r"^\.", "")).isin(*TYPES)


def extract_one(raw: bytes, name: str, file_type: str, readers: dict[str, Reader] | None = None) -> tuple[str | None, str | None]:
    """Text of one file, or NULL and why there is none. Nothing is raised: one bad file must not end a job."""
    kind = (file_type or "").lower().lstrip(".")
    read = (READERS if readers is None else readers).get(kind)
    if read is None:
        return None, f"unsupported type: {kind}"
    if not raw:
        return None, "empty file"
    try:
        text = read(raw, name)
        if kind in PACKAGES:
            lines = [f"[嵌入{k}] {n} ({size} bytes)" for k, n, size in office.assets(raw)]
            text = "\n\n".join(filter(None, (text, "[嵌入资源]\n" + "\n".join(lines) if lines else "")))
    except Exception as e:
        return None, f"{type(e).__name__}: {e}"[:500]
    return (text, None) if text.strip() else (None, "no text")


def readers_with(tools: Tools) -> dict[str, Reader]:
    """The readers, those of PDF files, pictures, sounds and films with what ``tools`` offers; readers that :func:`register` has put in their place stay."""
    readers = dict(READERS)
    if readers["pdf"] is legacy.pdf:
        readers["pdf"] = lambda raw, name: legacy.pdf(raw, name, tools)
    if tools.ocr:
        readers |= {k: lambda raw, name: tools.ocr(raw) for k in IMAGES if readers[k] is _image}
    if tools.speech:
        said = lambda film: lambda raw, name: media.report(raw, name, TYPES[name.rsplit(".", 1)[-1].lower()], film, transcript=tools.speech(raw, name))
        readers |= {k: said(False) for k in T.AUDIO if readers[k] is _sound} | {k: said(True) for k in T.VIDEO if readers[k] is _film}
    return readers


def extract(files: DataFrame, most_bytes: int = 200 * 1024 * 1024, tools: Tools = Tools()) -> DataFrame:
    """``files`` without their content, with ``text``, ``error``, and the grade of the text in ``quality_level`` and ``quality_reason``.

    Files above ``most_bytes``, of unknown type, empty, broken or without text have NULL text and an error. Every file is read where it lies;
    there is no shuffle. Spark ends a batch of files for Python at ``spark.sql.execution.arrow.maxBytesPerBatch`` (64 MB unless set otherwise). ``tools`` has limits and functions
    for pictures, speech and PDF files.
    """
    readers = readers_with(tools)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [extract_one(raw or b"", name, kind, readers) for name, kind, raw in zip(*(batch.column(c).to_pylist() for c in ("name", "file_type", "_content")))]
            kept = [batch.column(n) for n in batch.schema.names if n != "_content"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([t for t, _ in out], pa.string()), pa.array([e for _, e in out], pa.string())], names=[*(n for n in batch.schema.names if n != "_content"), "text", "error"])

    small = files.filter(F.col("length") <= most_bytes)
    kept = [c for c in files.columns if c != "content"]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields if f.name != "content")
    read = small.select(*kept, F.col("content").alias("_content")).mapInArrow(run, f"{ddl}, text string, error string")
    large = files.filter(F.col("length") > most_bytes).select(*kept, F.lit(None).cast("string").alias("text"), F.lit(f"larger than {most_bytes} bytes").alias("error"))
    grade = T.quality(F.col("text"), F.col("file_type"))
    return read.unionByName(large).withColumns({"quality_level": grade["level"], "quality_reason": grade["reason"]})


def attach_subtitles(extracted: DataFrame) -> DataFrame:
    """``extracted`` with the words of sidecar subtitle files in the reports of their films and sounds, shortened to what a report carries.

    Only texts are joined, never the content of the files. Reports without a sidecar stay as they are.
    """
    spoken = sidecar_subtitles(extracted).join(extracted.select(F.col("path").alias("subtitle_path"), F.col("text").alias("_spoken")), "subtitle_path").select("path", "_spoken")
    most = F.when(F.col("file_type").isin(*T.VIDEO), media.FILM_CHARS).otherwise(media.SOUND_CHARS)
    n = F.length("_spoken")
    note = F.when(n > most, F.concat(F.lit("\n... (共"), n.cast("string"), F.lit("字符，已截断)"))).otherwise("")
    words = F.concat(F.regexp_replace("text", r"(?s)\n*--- (?:提示|语音转文字) ---.*", ""), F.lit("\n\n--- 字幕文本 ---\n"), F.substring(F.col("_spoken"), F.lit(1), most), note)
    joined = extracted.join(spoken, "path", "left")
    return joined.withColumn("text", F.when(F.col("_spoken").isNotNull(), words).otherwise(F.col("text"))).select(*extracted.columns)


def broken_files(files: DataFrame) -> DataFrame:
    """PDF files and zip archives that cannot be opened, of which :func:`page_rows` and :func:`member_rows` have no row: ``path``, ``error``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, kind, raw in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    legacy.Pdf(raw) if kind == "pdf" else formats.archive_members(raw, TEXT_TYPES).__next__()
                except StopIteration:
                    continue
                except Exception as e:
                    rows.append((path, f"{type(e).__name__}: {e}"[:500]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(2)], names=["path", "error"])

    return files.filter("file_type IN ('pdf', 'zip')").select("path", "file_type", "content").mapInArrow(run, "path string, error string")


def page_rows(files: DataFrame, most: int = 0) -> DataFrame:
    """Pages of PDF files, all or the first ``most`` of each: ``path``, ``page``, ``text``; files that cannot be read are in :func:`broken_files`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows += [(path, n, t) for n, t in legacy.pdf_pages(raw, most)]
                except Exception:
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string()))], names=["path", "page", "text"])

    return files.filter("file_type = 'pdf'").select("path", "content").mapInArrow(run, "path string, page int, text string")


def member_rows(files: DataFrame) -> DataFrame:
    """Text members of zip archives: ``path``, ``member``, ``text``; archives that cannot be read are in :func:`broken_files`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows += [(path, n, t) for n, t in formats.archive_members(raw, TEXT_TYPES)]
                except Exception:
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["path", "member", "text"])

    return files.filter("file_type = 'zip'").select("path", "content").mapInArrow(run, "path string, member string, text string")


def metadata(files: DataFrame) -> DataFrame:
    """Properties of each file: ``path`` and a map ``metadata`` with type, size and what the format tells."""

    def one(raw: bytes, kind: str) -> dict[str, str]:
        try:
            if kind == "pdf":
                return legacy.pdf_info(raw)
            if kind in ("docx", "dotx", "dotm", "pptx", "potx", "potm", "xlsx", "xlsm", "xltx", "xlam"):
                return office.core_properties(raw)
            if kind in T.AUDIO or kind in T.VIDEO:
                return media.properties(raw, kind)
        except Exception as e:
            return {"error": f"{type(e).__name__}: {e}"[:200]}
        return {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path, kind, length, raw = (c.to_pylist() for c in batch.columns)
            rows = [list((({"file_type": k, "file_size": str(n)}) | one(r or b"", k)).items()) for k, n, r in zip(kind, length, raw)]
            yield pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(rows, pa.map_(pa.string(), pa.string()))], names=["path", "metadata"])

    return files.select("path", "file_type", "length", "content").mapInArrow(run, "path string, metadata map<string, string>")


def validate_pdfs(files: DataFrame) -> DataFrame:
    """Whether PDF files can be read: ``path``, ``empty``, ``is_pdf`` (by its first bytes), ``page_count``, ``chars_per_page``, ``likely_scanned``, ``error``."""
    pdfs = files.filter("file_type = 'pdf'")
    heads = pdfs.select("path", (F.col("length") == 0).alias("empty"), (F.substring("content", 1, 5) == F.lit(b"%PDF-")).alias("is_pdf"))
    told = metadata(pdfs).withColumnRenamed("path", "_path")
    value = lambda k, t: F.try_element_at("metadata", F.lit(k)).cast(t).alias(k)
    return heads.join(told, F.col("path") == F.col("_path")).select("path", "empty", "is_pdf", value("page_count", "int"), value("chars_per_page", "double"), value("likely_scanned", "boolean"), value("error", "string"))


def sidecar_subtitles(files: DataFrame) -> DataFrame:
    """The subtitle file that goes with each film or sound: ``path``, ``subtitle_path``.

    Same folder and stem, with or without one of :data:`SUBTITLE_LANGUAGES`; the first type wins, then the first language. Files without one are left out.
    """
    stem = F.regexp_replace("path", r"\.[^./]+$", "")
    kinds, languages = list(SUBTITLES), list(SUBTITLE_LANGUAGES)
    wanted = files.filter(F.col("file_type").isin(*T.AUDIO, *T.VIDEO)).select("path", stem.alias("stem"))
    tail = F.regexp_extract(stem, r"\.([a-z]{2,3})$", 1)
    language = F.when(tail.isin(*languages[1:]), tail).otherwise("")
    texts = files.filter(F.col("file_type").isin(*kinds)).select(F.col("path").alias("subtitle_path"), "file_type", stem.alias("own"), language.alias("language"))
    # a name that ends like a language may also be a stem in full
    both = texts.select("subtitle_path", "file_type", F.col("own").alias("stem"), F.lit("").alias("language")).unionByName(
        texts.filter("language <> ''").select("subtitle_path", "file_type", F.regexp_replace("own", r"\.[a-z]{2,3}$", "").alias("stem"), "language")
    )
    rank = F.array_position(F.array(*map(F.lit, kinds)), F.col("file_type")) * 100 + F.array_position(F.array(*map(F.lit, languages)), F.col("language"))
    first = Window.partitionBy("path").orderBy(rank, "subtitle_path")
    return wanted.join(both, "stem").withColumn("_r", F.row_number().over(first)).filter("_r = 1").select("path", "subtitle_path")
