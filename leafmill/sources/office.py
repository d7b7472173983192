"""Readers of zip-based office formats: DOCX, PPTX, XLSX, OpenDocument, EPUB. Pure Python over the XML inside."""

from __future__ import annotations

import datetime as dt
import html
import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

from leafmill.functions.text import AUDIO, DATE_FORMATS, VIDEO
from leafmill.sources.formats import clean, decode, strip_html

SHEET_ROWS = 500
_IMAGES = frozenset("jpg jpeg png bmp gif tiff tif webp emf wmf svg".split())


def tag(e: ET.Element) -> str:
    """Name of an element without its namespace."""
    return e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""


def attr(e: ET.Element, name: str, default: str = "") -> str:
    """Value of an attribute, whatever its namespace."""
    for k, v in e.attrib.items():
        if k == name or k.endswith("}" + name):
            return v
    return default


def find_all(e: ET.Element | None, *names: str) -> Iterator[ET.Element]:
    """Descendants by name, in document order."""
    if e is not None:
        for x in e.iter():
            if tag(x) in names:
                yield x


def child(e: ET.Element | None, name: str) -> ET.Element | None:
    return next((x for x in e if tag(x) == name), None) if e is not None else None


class Package:
    """A zip file with XML parts."""

    def __init__(self, raw: bytes, need: str | None = None):
        self.zip = zipfile.ZipFile(io.BytesIO(raw))
        self.names = self.zip.namelist()
        if need and need not in self.names:
            raise ValueError(f"{need} is missing")

    def xml(self, name: str) -> ET.Element | None:
        return ET.fromstring(self.zip.read(name)) if name in self.names else None

    def numbered(self, pattern: str) -> list[tuple[int, str]]:
        """Parts whose name matches, by the number in it."""
        found = ((re.fullmatch(pattern, n), n) for n in self.names)
        return sorted((int(m[1]), n) for m, n in found if m)

    def relations(self, part: str) -> dict[str, str]:
        """Relation id to target, as a name inside the package."""
        folder, base = posixpath.split(part)
        root = self.xml(f"{folder}/_rels/{base}.rels")
        return {attr(r, "Id"): attr(r, "Target").lstrip("/") if attr(r, "Target").startswith("/") else posixpath.normpath(posixpath.join(folder, attr(r, "Target"))) for r in find_all(root, "Relationship")}


def core_properties(raw: bytes) -> dict[str, str]:
    """Title, author, subject and dates of an Office Open XML file."""
    root = Package(raw).xml("docProps/core.xml")
    names = {"title": "title", "creator": "author", "subject": "subject", "created": "created", "modified": "modified", "keywords": "keywords", "lastModifiedBy": "last_modified_by"}
    return {names[tag(e)]: e.text for e in (root if root is not None else []) if tag(e) in names and e.text}


def assets(raw: bytes) -> list[tuple[str, str, int]]:
    """Kind, name and size of the pictures, sounds and films inside a package."""
    out = []
    for info in zipfile.ZipFile(io.BytesIO(raw)).infolist():
        ext = info.filename.rsplit(".", 1)[-1].lower()
        kind = "图片" if ext in _IMAGES else "音频" if ext in AUDIO else "视频" if ext in VIDEO else None
        if kind:
            out.append((kind, info.filename, info.file_size))
    return out


# DOCX


def _runs(p: ET.Element) -> str:
    out = []
    for e in p.iter():
        name = tag(e)
        if name == "t":
            out.append(e.text or "")
        elif name in ("tab", "br", "cr") and tag(e) != "tabs" and not e.attrib.get("val"):
            out.append("\t" if name == "tab" else "\n")
    return "".join(out)


def _docx_heading(p: ET.Element) -> int:
    style = next(find_all(child(p, "pPr"), "pStyle"), None)
    m = re.match(r"(?:heading|标题)\s*([1-9])", attr(style, "val") if style is not None else "", re.I)
    return int(m[1]) if m else 0


def _docx_table(t: ET.Element) -> str:
    rows = []
    for tr in (x for x in t if tag(x) == "tr"):
        cells = []
        for tc in find_all(tr, "tc"):
            props = child(tc, "tcPr")
            merge = child(props, "vMerge")
            follows = merge is not None and attr(merge, "val", "continue") != "restart"
            span = child(props, "gridSpan")
            body = " ".join(filter(None, (_runs(p).strip() for p in find_all(tc, "p"))))
            cells.append("" if follows else body)
            cells += [""] * (int(attr(span, "val", "1")) - 1 if span is not None else 0)
        if any(cells):
            rows.append(" | ".join(cells))
    return "\n".join(rows)


def _docx_blocks(body: ET.Element) -> Iterator[str]:
    for e in body:
        name = tag(e)
        if name == "p":
            s = _runs(e).strip()
            if s:
                level = _docx_heading(e)
                yield f"{'#' * level} {s}" if level else s
        elif name == "tbl":
            s = _docx_table(e)
            if s:
                yield f"[表格]\n{s}"
        elif name in ("sdt", "sdtContent", "ins", "smartTag"):
            yield from _docx_blocks(e)


def _docx_notes(package: Package, part: str, item: str) -> str:
    out = []
    for n in find_all(package.xml(part), item):
        s = " ".join(filter(None, (_runs(p).strip() for p in find_all(n, "p"))))
        if attr(n, "id") not in ("0", "-1", "") and s:
            out.append(f"[{attr(n, 'id')}] {s}")
    return "\n".join(out)


def docx(raw: bytes, name: str) -> str:
    """Headings, paragraphs and tables in order; headers first, footers and notes last."""
    package = Package(raw, "[Content_Types].xml")
    root = package.xml("word/document.xml")
    parts = list(_docx_blocks(child(root, "body"))) if child(root, "body") is not None else []
    margins = {}
    for kind in ("header", "footer"):
        lines = [_runs(p).strip() for _, n in package.numbered(rf"word/{kind}(\d+)\.xml") for p in find_all(package.xml(n), "p")]
        margins[kind] = "\n".join(dict.fromkeys(filter(None, lines)))
    if margins["header"]:
        parts.insert(0, f"[页眉]\n{margins['header']}")
    for title, s in (("页脚", margins["footer"]), ("脚注", _docx_notes(package, "word/footnotes.xml", "footnote")), ("尾注", _docx_notes(package, "word/endnotes.xml", "endnote"))):
        if s:
            parts.append(f"[{title}]\n{s}")
    return clean("\n\n".join(parts))


# PPTX


def _pptx_paragraphs(e: ET.Element | None) -> list[str]:
    return list(filter(None, ("".join(x.text or "" for x in find_all(p, "t")).strip() for p in find_all(e, "p"))))


def _pptx_shapes(tree: ET.Element) -> Iterator[str]:
    for e in tree:
        name = tag(e)
        if name == "sp":
            yield from _pptx_paragraphs(child(e, "txBody"))
        elif name == "grpSp":
            yield from _pptx_shapes(e)
        elif name == "graphicFrame":
            for t in find_all(e, "tbl"):
                rows = [" | ".join(" ".join(_pptx_paragraphs(c)) for c in find_all(r, "tc")) for r in find_all(t, "tr")]
                if len(rows) > 1:
                    rows[0] = "[表头] " + rows[0]
                yield from rows


def _pptx_charts(package: Package, slide: str) -> Iterator[str]:
    for target in package.relations(slide).values():
        if "/charts/" in target and target in package.names:
            root = package.xml(target)
            for title in find_all(root, "title"):
                s = "".join(x.text or "" for x in find_all(title, "t"))
                if s:
                    yield f"[图表标题] {s}"
            for part, label in (("cat", "类别"), ("val", "数值")):
                for group in find_all(root, part):
                    yield from (f"[{label}] {v.text}" for v in find_all(group, "v") if v.text)


def pptx(raw: bytes, name: str) -> str:
    """Slides by number with shapes, groups, tables and charts; then notes; text of the masters first."""
    package = Package(raw, "[Content_Types].xml")
    out = []
    for n, part in package.numbered(r"ppt/slides/slide(\d+)\.xml"):
        tree = next(find_all(package.xml(part), "spTree"), None)
        lines = [*(_pptx_shapes(tree) if tree is not None else ()), *_pptx_charts(package, part)]
        if lines:
            out.append(f"[第{n}页幻灯片]\n" + "\n".join(lines))
    for n, part in package.numbered(r"ppt/notesSlides/notesSlide(\d+)\.xml"):
        lines = [x for x in _pptx_paragraphs(package.xml(part)) if not x.isdigit()]
        if lines:
            out.append(f"[第{n}页备注]\n" + "\n".join(lines))
    master = [x for _, part in package.numbered(r"ppt/slideMasters/slideMaster(\d+)\.xml") for x in _pptx_paragraphs(package.xml(part))]
    if master:
        out.insert(0, "[母版占位符文本]\n" + "\n".join(dict.fromkeys(master)))
    return clean("\n\n".join(out))


# XLSX


def excel_date(serial: float) -> str | None:
    """Arrow-side twin of :func:`leafmill.functions.text.excel_date`."""
    if not 1 <= serial < 2958466:
        return None
    day = int(serial)
    seconds = int((serial - day) * 86400 + 1e-6)
    date = dt.date(1899, 12, 30) + dt.timedelta(days=day + (day < 60))
    return f"{date}" + (f" {seconds // 3600:02d}:{seconds % 3600 // 60:02d}:{seconds % 60:02d}" if seconds else "")


def date_code(format_id: int, code: str) -> bool:
    """Whether a number format shows dates; quoted and bracketed parts are no letters of it."""
    return format_id in DATE_FORMATS or bool(re.search("[yYmMdDhHsS]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.|_.', "", code)))


def cell_address(ref: str) -> tuple[int, int]:
    """Column and row of a reference, from 0."""
    m = re.fullmatch(r"([A-Za-z]+)(\d+)", ref)
    if not m:
        raise ValueError(f"no cell reference: {ref}")
    col = 0
    for c in m[1].upper():
        col = col * 26 + ord(c) - 64
    return col - 1, int(m[2]) - 1


def _xlsx_dates(package: Package) -> set[int]:
    """Styles that show dates."""
    root = package.xml("xl/styles.xml")
    codes = {int(attr(f, "numFmtId", "0")): attr(f, "formatCode") for f in find_all(root, "numFmt")}
    ids = [int(attr(x, "numFmtId", "0")) for x in find_all(next(find_all(root, "cellXfs"), None), "xf")]
    return {i for i, f in enumerate(ids) if date_code(f, codes.get(f, ""))}


def _xlsx_value(c: ET.Element, shared: list[str], dates: set[int]) -> str:
    kind, v = attr(c, "t"), child(c, "v")
    if kind == "inlineStr":
        return "".join(x.text or "" for x in find_all(c, "t"))
    if v is None or v.text is None:
        return ""
    if kind == "s":
        i = int(v.text)
        return shared[i] if i < len(shared) else ""
    if kind == "b":
        return "TRUE" if v.text == "1" else "FALSE"
    if kind in ("", "n") and int(attr(c, "s", "0")) in dates:
        try:
            return excel_date(float(v.text)) or v.text
        except ValueError:
            pass
    return v.text


def _xlsx_rows(sheet: ET.Element, shared: list[str], dates: set[int]) -> list[list[str]]:
    rows: dict[int, dict[int, str]] = {}
    for k, r in enumerate(find_all(sheet, "row")):
        at = int(attr(r, "r", str(k + 1))) - 1
        cells = rows.setdefault(at, {})
        for n, c in enumerate(x for x in r if tag(x) == "c"):
            cells[cell_address(attr(c, "r"))[0] if attr(c, "r") else n] = _xlsx_value(c, shared, dates)
    for m in find_all(sheet, "mergeCell"):
        first, _, last = attr(m, "ref").partition(":")
        if last:
            (c1, r1), (c2, r2) = cell_address(first), cell_address(last)
            value = rows.get(r1, {}).get(c1, "")
            # an area of a whole column has no more rows than the sheet
            for r in (r for r in list(rows) if r1 <= r <= r2):
                for c in range(c1, min(c2, c1 + 256) + 1):
                    if not rows[r].get(c):
                        rows[r][c] = value
    return [[rows[r].get(c, "") for c in range(max(rows[r], default=-1) + 1)] for r in sorted(rows)]


def _xlsx_sheets(raw: bytes) -> str:
    """Sheets in the order of the workbook, a line a row, at most :data:`SHEET_ROWS` each; merged cells repeat their value."""
    package = Package(raw, "[Content_Types].xml")
    shared = ["".join(t.text or "" for t in find_all(s, "t")) for s in find_all(package.xml("xl/sharedStrings.xml"), "si")]
    dates, targets, out = _xlsx_dates(package), package.relations("xl/workbook.xml"), []
    for s in find_all(package.xml("xl/workbook.xml"), "sheet"):
        title, part = attr(s, "name"), targets.get(next((v for k, v in s.attrib.items() if k.endswith("}id")), ""), "")
        root = package.xml(part)
        if root is None:
            continue
        rows = [r for r in _xlsx_rows(root, shared, dates) if any(r)]
        lines = [" | ".join(r) for r in rows[:SHEET_ROWS]]
        if len(rows) > SHEET_ROWS:
            lines.append(f"... 共{len(rows)}行数据（已截取前{SHEET_ROWS}行）")
        if lines:
            out.append(f"[工作表: {title}]\n" + "\n".join(lines))
    return clean("\n\n".join(out))


def xlsx(raw: bytes, name: str) -> str:
    """Sheets as :func:`_xlsx_sheets` gives them; of a workbook whose parts are no sound XML, what :func:`_xlsx_loose` finds."""
    try:
        return _xlsx_sheets(raw)
    except (ET.ParseError, KeyError, ValueError) as e:
        text = _xlsx_loose(raw)
        if not text:
            raise e
        return text


def _xlsx_loose(raw: bytes) -> str:
    """Rows of the sheets of a damaged workbook, found by their marks alone: no dates, no merged cells."""
    z = zipfile.ZipFile(io.BytesIO(raw))
    parts = {n: decode(z.read(n)) for n in z.namelist() if n == "xl/sharedStrings.xml" or re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)}
    plain = lambda x: html.unescape(re.sub(r"<[^>]*>", "", "".join(re.findall(r"<(?:\w+:)?t(?:\s[^>]*)?>(.*?)</(?:\w+:)?t>", x, re.S))))
    shared = [plain(x) for x in re.findall(r"<(?:\w+:)?si>(.*?)</(?:\w+:)?si>", parts.pop("xl/sharedStrings.xml", ""), re.S)]
    out = []
    for n in sorted(parts, key=lambda n: int(re.search(r"\d+", n).group())):
        rows = []
        for row in re.split(r"<(?:\w+:)?row\b", parts[n])[1:]:
            cells = []
            for head, body in re.findall(r"<(?:\w+:)?c\b([^>]*)>(.*?)</(?:\w+:)?c>", row, re.S):
                v = re.search(r"<(?:\w+:)?v>([^<]*)<", body)
                i = int(v[1]) if v and v[1].isdigit() else -1
                cells.append(shared[i] if 't="s"' in head and 0 <= i < len(shared) else plain(body) if 't="inlineStr"' in head else html.unescape(v[1]) if v else "")
            rows += [" | ".join(cells)] if any(cells) else []
        more = [f"... 共{len(rows)}行数据（已截取前{SHEET_ROWS}行）"] if len(rows) > SHEET_ROWS else []
        out += ["\n".join([f"[工作表: {posixpath.basename(n)[:-4]}]", *rows[:SHEET_ROWS], *more])] if rows else []
    return clean("\n\n".join(out))


def xlsb(raw: bytes, name: str) -> str:
    """Readable runs of the binary sheets and strings, each once, at most 200."""
    found: dict[str, None] = {}
    for n in Package(raw).names:
        if n.startswith("xl/") and n.endswith(".bin"):
            body = Package(raw).zip.read(n)
            for m in re.finditer(rb"(?:[\x20-\x7e]\x00){5,}", body):
                found.setdefault(m.group().decode("utf-16-le").strip())
    return clean("\n".join([x for x in found if x][:200]))


# OpenDocument


def _odf_text(e: ET.Element) -> str:
    out = [e.text or ""]
    for c in e:
        name = tag(c)
        out.append({"tab": "\t", "line-break": "\n", "s": " " * int(attr(c, "c", "1") or 1)}.get(name) or ("" if name in ("annotation", "note") else _odf_text(c)))
        out.append(c.tail or "")
    return "".join(out)


def _odf_rows(t: ET.Element) -> list[str]:
    rows = []
    for r in find_all(t, "table-row"):
        cells = [" ".join(filter(None, (_odf_text(p).strip() for p in find_all(c, "p")))) for c in r if tag(c) in ("table-cell", "covered-table-cell")]
        if any(cells):
            rows.append(" | ".join(cells))
    return rows


def _odf_blocks(e: ET.Element, depth: int = 0) -> Iterator[str]:
    for c in e:
        name = tag(c)
        if name == "h":
            yield f"{'#' * int(attr(c, 'outline-level', '1') or 1)} {_odf_text(c).strip()}"
        elif name == "p":
            s = _odf_text(c).strip()
            if s:
                yield "  " * max(0, depth - 1) + ("- " if depth else "") + s
        elif name == "list":
            yield from _odf_blocks(c, depth + 1)
        elif name in ("list-item", "list-header", "section"):
            yield from _odf_blocks(c, depth)
        elif name == "table":
            rows = _odf_rows(c)
            if rows:
                yield "[表格]\n" + "\n".join(rows)


def open_document(raw: bytes, name: str) -> str:
    """ODT, ODS and ODP: properties, then text, sheets or slides."""
    package = Package(raw, "content.xml")
    out = []
    for e in find_all(package.xml("meta.xml"), "title", "creator", "initial-creator", "description"):
        label = {"title": "标题", "creator": "作者", "initial-creator": "作者", "description": "描述"}[tag(e)]
        if e.text and not any(x.startswith(f"[{label}]") for x in out):
            out.append(f"[{label}] {e.text}")
    body = child(package.xml("content.xml"), "body")
    for part in body if body is not None else []:
        kind = tag(part)
        if kind == "spreadsheet":
            for t in find_all(part, "table"):
                rows = _odf_rows(t)
                if rows:
                    out.append(f"[工作表: {attr(t, 'name')}]\n" + "\n".join(rows))
        elif kind == "presentation":
            for i, page in enumerate(find_all(part, "page"), 1):
                lines = list(filter(None, (_odf_text(p).strip() for p in find_all(page, "p", "h"))))
                if lines:
                    out.append(f"[第{i}页幻灯片]\n" + "\n".join(lines))
        elif kind == "text":
            out += _odf_blocks(part)
    return clean("\n\n".join(out))


# EPUB


def epub(raw: bytes, name: str) -> str:
    """Title, author and description, then the pages in the order of the spine."""
    package = Package(raw)
    opf = next((attr(r, "full-path") for r in find_all(package.xml("META-INF/container.xml"), "rootfile")), None) or next((n for n in package.names if n.endswith(".opf")), None)
    if opf is None or package.xml(opf) is None:
        raise ValueError("no package document")
    root, folder = package.xml(opf), posixpath.dirname(opf)
    out = []
    for part, label in (("title", "书名"), ("creator", "作者"), ("description", "简介")):
        e = next(find_all(root, part), None)
        if e is not None and e.text:
            out.append(f"[{label}] {e.text}")
    manifest = {attr(i, "id"): attr(i, "href") for i in find_all(root, "item")}
    for ref in find_all(root, "itemref"):
        href = posixpath.normpath(posixpath.join(folder, manifest.get(attr(ref, "idref"), "")))
        if href in package.names:
            s = strip_html(decode(package.zip.read(href)))
            if s:
                out.append(s)
    return clean("\n\n".join(out))
