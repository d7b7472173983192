"""Text functions as native Column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Invisible characters that cleaning removes.
INVISIBLE = "​‌‍﻿  ­‪‫‬‭‮"
# Classes of file types with quality rules of their own.
AUDIO = ("mp3", "wav", "flac", "aac", "m4a", "ogg", "wma", "opus")
VIDEO = ("mp4", "mkv", "avi", "mov", "wmv", "flv", "webm", "m4v", "3gp")
CODE = (
    "py js java c cpp h hpp cs go rs rb php swift kt scala r m mm sql sh bat cmd ps1 bash zsh css scss sass less vue jsx tsx "
    "dockerfile makefile cmake gradle tex bib rst adoc org"
).split()


def clean_text(text: Column) -> Column:
    """Without control and invisible characters, wide gaps and more than two blank lines; NULL stays NULL."""
    t = F.regexp_replace(text, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", "")
    t = F.translate(t, INVISIBLE, "")
    t = F.regexp_replace(t, r"(?U)[^\S\n]{3,}", " ")
    t = F.regexp_replace(t, r"\n{4,}", "\n\n\n")
    t = F.regexp_replace(t, r"(?U)[^\S\n]+(?=\n|\z)", "")
    return F.regexp_replace(t, r"(?U)\A\s+|\s+\z", "")


def html_to_text(source: Column) -> Column:
    """Visible text of HTML: scripts and styles dropped, ends of blocks and ``<br>`` as line breaks, entities decoded, blank lines out.

    Named entities beyond the handful below need the Arrow form in :mod:`leafmill.sources.formats`.
    """
    t = F.regexp_replace(source, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", "")
    t = F.regexp_replace(t, r"(?i)</(?:p|div|h[1-6]|li|tr|pre|blockquote)\s*>|<br\s*/?>", "\n")
    t = F.regexp_replace(t, "<[^>]+>", "")
    for name, value in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("apos", "'"), ("nbsp", "\xa0"), ("middot", "·"), ("copy", "©"), ("amp", "&")):
        t = F.replace(t, F.lit(f"&{name};"), F.lit(value))
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.regexp_replace(x, r"(?U)\A\s+|\s+\z", "")), lambda x: x != "")
    return F.array_join(lines, "\n")


def meaningful_ratio(text: Column) -> Column:
    """Share of letters and digits; 0.0 for empty text, NULL for NULL."""
    return F.when(F.length(text) > 0, F.regexp_count(text, F.lit(r"[\p{L}\p{Nd}]")) / F.length(text)).when(text.isNotNull(), F.lit(0.0))


def is_meaningful(text: Column, least: float = 0.3) -> Column:
    """Whether a text that is not blank has ``least`` of letters and digits; False for NULL."""
    return F.coalesce((F.length(F.trim(text)) > 0) & (meaningful_ratio(text) >= least), F.lit(False))


def quality(text: Column, file_type: Column) -> Column:
    """Grade of an extracted text: STRUCT<level, reason>; the rules depend on the class of ``file_type``."""
    n = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\A\s+|\s+\z", ""))
    ratio = F.coalesce(meaningful_ratio(text), F.lit(0.0))
    kind = F.lower(F.coalesce(file_type, F.lit("")))
    grade = lambda level, reason: F.struct(F.lit(level).alias("level"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))
    media = F.when((n > 100) & (ratio > 0.3), grade("high", "元数据完整")).when(n > 20, grade("medium", "元数据部分提取")).otherwise(grade("low", "元数据较少"))
    code = F.when(n > 100, grade("high", "代码文本正常")).otherwise(grade("medium", "代码文件较短"))
    document = (
        F.when((n > 1000) & (ratio > 0.5), grade("high", "文本内容丰富"))
        .when((n > 200) & (ratio > 0.3), grade("medium", "文本内容适中"))
        .when(n > 50, grade("low", "文本内容较少"))
        .otherwise(grade("very_low", F.concat(F.lit("文本内容极少 ("), n.cast("string"), F.lit("字符)"))))
    )
    return F.when(n == 0, grade("very_low", "解析结果为空")).when(kind.isin(*AUDIO, *VIDEO), media).when(kind.isin(*CODE), code).otherwise(document)


def truncate_text(text: Column, most: int = 50_000) -> Column:
    """The first ``most`` characters with a note of the whole length, or the text if it is no longer."""
    note = F.concat(F.lit("\n\n... (文本过长，已截断，共 "), F.length(text).cast("string"), F.lit(" 字符)"))
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), note)).otherwise(text)


def normalize_whitespace(text: Column) -> Column:
    """Line ends as ``\\n``, runs of blanks and tabs as one blank."""
    return F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"[ \t]+", " ")


def remove_garbage(text: Column) -> Column:
    """Without runs of three replacement characters or more, and without signs that text is not written with."""
    t = F.regexp_replace(text, "�{3,}", "")
    return F.regexp_replace(t, r"(?U)[^\w\s.,;:!?'\"()\-+=/@#%&*，。；：！？、“”‘’（）【】《》]+", "")


def table_text(headers: Column, rows: Column, most: int = 500) -> Column:
    """Rows (array of arrays of strings) as lines of cells parted by bars, at most ``most``, with a note of how many there are."""
    cells = lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), " | ")
    note = F.concat(F.lit("... 共 "), F.size(rows).cast("string"), F.lit(f" 行数据（已截取前 {most} 行）"))
    lines = F.concat(
        F.when(F.size(headers) > 0, F.array(cells(headers))).otherwise(F.array().cast("array<string>")),
        F.transform(F.slice(rows, 1, most), cells),
        F.when(F.size(rows) > most, F.array(note)).otherwise(F.array().cast("array<string>")),
    )
    return F.array_join(lines, "\n")


def keywords(query: Column) -> Column:
    """Search terms: parted by blanks, commas and semicolons of either width."""
    return F.filter(F.split(F.translate(query, "，,；;", "    "), r"(?U)\s+"), lambda t: t != "")


def split_keywords(query: str | None) -> list[str]:
    """:func:`keywords` of a plain string."""
    return re.sub("[，,；;]", " ", query or "").split()


def matched_terms(content: Column, terms: Sequence[str]) -> Column:
    """The terms that stand in ``content``, case aside."""
    low = F.lower(content)
    return F.filter(F.array(*[F.lit(t) for t in terms]).cast("array<string>"), lambda t: F.contains(low, F.lower(t)))


def snippet(content: Column, terms: Sequence[str], window: int = 90) -> Column:
    """``window`` characters on either side of the first hit of any term, or the head of the text if there is none."""
    low, n = F.lower(content), F.length(content)
    hits = F.array(*[F.locate(t.lower(), low) for t in terms if t]).cast("array<int>")
    first = F.array_min(F.filter(hits, lambda p: p > 0))
    start = F.greatest(F.lit(0), first - 1 - window)
    end = F.least(n, first - 1 + window)
    body = F.regexp_replace(F.substring(content, start + 1, end - start), r"(?U)\A\s+|\s+\z", "")
    hit = F.concat(F.when(start > 0, "...").otherwise(""), body, F.when(end < n, "...").otherwise(""))
    head = F.concat(F.substring(content, 1, 2 * window), F.when(n > 2 * window, "...").otherwise(""))
    return F.when(first.isNull(), F.coalesce(head, F.lit(""))).otherwise(hit)


def escape_html(text: Column) -> Column:
    """Signs with a meaning in HTML as entities."""
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


#: Style of a highlighted term.
MARK = "color:#1e1e2e; background-color:#f9e2af; font-weight:700; padding:1px 3px;"


def highlight(text: Column, terms: Sequence[str]) -> Column:
    """Escaped text with ``<br>`` for line ends and each term, longest first, in a marked span; case aside."""
    out = F.replace(escape_html(text), F.lit("\n"), F.lit("<br>"))
    for t in sorted((t for t in terms if t), key=len, reverse=True):
        for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
            t = t.replace(sign, entity)
        out = F.regexp_replace(out, f"(?iu){re.escape(t)}", f'<span style="{MARK}">$0</span>')
    return out


def context_html(context: Column, hit: Column, terms: Sequence[str]) -> Column:
    """Neighbouring chunks (array of structs with id, chunk_index, content) as one page, the hit among them named."""
    part = lambda c: highlight(
        F.concat(F.lit("["), F.when(c["id"] == hit, "命中片段").otherwise("上下文片段"), F.lit(" "), (c["chunk_index"] + 1).cast("string"), F.lit("]\n"), F.coalesce(c["content"], F.lit(""))), terms
    )
    return F.array_join(F.transform(context, part), "<br><br>")


_PAGE = r"\[第\s*(\d+)\s*页\]"


def page_number(content: Column, context: Column | None = None) -> Column:
    """The first page marker in the hit, else in its context (array of texts); NULL if there is none."""
    number = lambda c: F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), _PAGE, 1), F.lit(""))
    own = number(content)
    if context is None:
        return own.cast("int")
    return F.coalesce(own, F.get(F.filter(F.transform(context, number), lambda x: x.isNotNull()), F.lit(0))).cast("int")


def fragment_label(chunk_index: Column, total_chunks: Column) -> Column:
    """Place of a chunk as ``3/12``."""
    return F.concat((chunk_index + 1).cast("string"), F.lit("/"), total_chunks.cast("string"))


def page_anchor(file_path: Column, file_type: Column, page: Column) -> Column:
    """The path, with the page as an anchor where the type is PDF and a page is known."""
    return F.concat(file_path, F.when((file_type == "pdf") & page.isNotNull(), F.concat(F.lit("#page="), page.cast("string"))).otherwise(""))


def size_text(size: Column) -> Column:
    """A size in bytes as text with a unit."""
    by = lambda d, digits, unit: F.concat(F.call_function("format_number", size.cast("double") / d, F.lit("0." + "0" * digits)), F.lit(unit))
    return F.when(size < 1 << 10, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1 << 20, by(1 << 10, 1, " KB")).when(size < 1 << 30, by(1 << 20, 1, " MB")).otherwise(by(1 << 30, 2, " GB"))


def megabytes(size: Column) -> Column:
    """A size in bytes as ``x.xx MB``; NULL counts as 0."""
    return F.concat(F.call_function("format_number", F.coalesce(size, F.lit(0)) / float(1 << 20), F.lit("0.00")), F.lit(" MB"))


def duration_text(seconds: Column) -> Column:
    """A duration as hours, minutes and seconds, whole seconds only."""
    s = F.floor(seconds.cast("double")).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(h > 0, F.concat(h.cast("string"), F.lit("时"), two(m), F.lit("分"), two(r), F.lit("秒"))).when(m > 0, F.concat(m.cast("string"), F.lit("分"), two(r), F.lit("秒"))).otherwise(F.concat(r.cast("string"), F.lit("秒")))


def excel_date(serial: Column) -> Column:
    """Text of an Excel serial number (1900 system): a date, with a time of day if it has a fraction; NULL outside 1..2958465."""
    day = F.floor(serial.cast("double"))
    # day 60 is the leap day that 1900 did not have; serials before it start a day later
    date = F.date_add(F.lit("1899-12-30").cast("date"), (day + F.when(day < 60, 1).otherwise(0)).cast("int"))
    s = F.floor((serial.cast("double") - day) * 86400 + 1e-6)
    two = lambda x: F.lpad(x.cast("int").cast("string"), 2, "0")
    clock = F.concat(F.lit(" "), two(F.floor(s / 3600)), F.lit(":"), two(F.floor(s % 3600 / 60)), F.lit(":"), two(s % 60))
    return F.when((serial >= 1) & (serial < 2958466), F.concat(date.cast("string"), F.when(s > 0, clock).otherwise("")))


# Numbers of Excel's built-in date and time formats.
DATE_FORMATS = (14, 15, 16, 17, 18, 19, 20, 21, 22, 27, 28, 29, 30, 31, 32, 33, 34, 35, 36, 45, 46, 47, 50, 51, 52, 53, 54, 55, 56, 57, 58)


def is_date_format(format_id: Column, code: Column) -> Column:
    """Whether an Excel number format shows dates or times; quoted and bracketed parts of its code are no letters of it."""
    plain = F.regexp_replace(F.coalesce(code, F.lit("")), r'"[^"]*"|\[[^\]]*\]|\\.|_.', "")
    return F.coalesce(format_id.isin(*DATE_FORMATS), F.lit(False)) | plain.rlike("[yYmMdDhHsS]")


def cell_address(ref: Column) -> Column:
    """STRUCT<col, row>, counted from 0, of a reference such as ``AA42``; NULL if it is none."""
    letters, digits = F.upper(F.regexp_extract(ref, r"^([A-Za-z]+)(\d+)$", 1)), F.regexp_extract(ref, r"^([A-Za-z]+)(\d+)$", 2)
    col = F.aggregate(F.split(letters, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(a * 26 + F.ascii(c) - 64))
    return F.when(letters != "", F.struct((col - 1).cast("int").alias("col"), (digits.cast("int") - 1).alias("row")))


def is_fragment(text: Column) -> Column:
    """Whether a run of characters found in a binary file is text: no long hex, no GUID, not mostly slashes."""
    n = F.length(text)
    hexed = (n > 10) & (F.regexp_count(text, F.lit("[0-9a-fA-F]")) > 0.8 * n)
    guid = text.rlike(r"^\{?[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-")
    return ~hexed & ~guid & (F.regexp_count(text, F.lit(r"[\\/]")) <= n / 4)


def extension(path: Column) -> Column:
    """File type by name: what follows the last dot in lower case; names without a dot stand for themselves (``dockerfile``, ``makefile``)."""
    name = F.element_at(F.split(path, "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return F.when(ext != "", ext).when(F.lower(name).isin("dockerfile", "makefile"), F.lower(name)).otherwise("")


def base_name(path: Column) -> Column:
    """Last part of a path."""
    return F.element_at(F.split(path, "/"), -1)


def fold(text: Column) -> Column:
    """Lower case without the accents of Latin letters, as the inverted index compares words."""
    plain = "aaaaaaceeeeiiiinooooouuuuyyaaaccccddeeeeegggghiiiiijkllllnnnooorrrsssstttuuuuuuwyzzz"
    accented = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďđēĕėęěĝğġģĥĩīĭįıĵķĺļľłńņňōŏőŕŗřśŝşšţťŧũūŭůűųŵŷźżž"
    return F.translate(F.lower(text), accented, plain)
