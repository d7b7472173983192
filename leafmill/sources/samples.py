"""Writers of small files in many formats out of table rows, so that the readers can be compared with SQL over the same rows."""

from __future__ import annotations

import base64
import io
import json
import struct
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Key, name and segment of a row.
Row = tuple[int, str, str]

_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
_S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_O = 'xmlns:office="urn:o" xmlns:text="urn:t" xmlns:table="urn:b" xmlns:draw="urn:d"'


def _zip(**parts: str | bytes) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def _docx(title: str, rows: list[Row]) -> bytes:
    def p(text: str, style: str = "") -> str:
        return f"<w:p>{f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ''}<w:r><w:t>{text}</w:t></w:r></w:p>"

    table = "".join(f"<w:tr><w:tc>{p(str(k))}</w:tc><w:tc>{p(n)}</w:tc><w:tc>{p(s)}</w:tc></w:tr>" for k, n, s in rows)
    body = f"<w:document {_W}><w:body>{p(title, 'Heading2')}{p('Customers')}<w:tbl>{table}</w:tbl></w:body></w:document>"
    notes = f'<w:footnotes {_W}><w:footnote w:id="0">{p("none")}</w:footnote><w:footnote w:id="3">{p(f"{len(rows)} rows")}</w:footnote></w:footnotes>'
    core = f'<c:p xmlns:c="urn:c" xmlns:d="urn:d"><d:title>About {title}</d:title><d:creator>{rows[0][1]}</d:creator><d:subject></d:subject></c:p>'
    return _zip(**{"[Content_Types].xml": "<x/>", "docProps/core.xml": core, "word/document.xml": body, "word/header1.xml": f"<w:hdr {_W}>{p('Head ' + title)}</w:hdr>", "word/footnotes.xml": notes})


def _dotx(title: str, rows: list[Row]) -> bytes:
    """A template with a picture and a sound."""
    out = io.BytesIO(_docx(title, rows))
    with zipfile.ZipFile(out, "a") as z:
        z.writestr("word/media/i.png", b"\x89PNG" + b"\0" * len(rows))
        z.writestr("word/media/s.mp3", b"ID3")
    return out.getvalue()


def _pptx(title: str, rows: list[Row]) -> bytes:
    shape = lambda t: f"<p:sp><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>"
    cell = lambda t: f"<a:tc><a:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></a:txBody></a:tc>"
    table = "".join(f"<a:tr>{cell(a)}{cell(b)}</a:tr>" for a, b in [("key", "name"), *((str(k), n) for k, n, _ in rows)])
    slide = lambda inner: f"<p:sld {_A}><p:cSld><p:spTree>{inner}</p:spTree></p:cSld></p:sld>"
    return _zip(**{"[Content_Types].xml": "<x/>", "ppt/slides/slide2.xml": slide(f"<p:graphicFrame><a:tbl>{table}</a:tbl></p:graphicFrame>"), "ppt/slides/slide1.xml": slide(shape(title) + f"<p:grpSp>{shape('grouped')}</p:grpSp>"), "ppt/notesSlides/notesSlide1.xml": slide(shape("remark"))})


def _xlsx(title: str, rows: list[Row]) -> bytes:
    lines = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="s"><v>2</v></c></row>'
    lines += "".join(f'<row r="{i}"><c r="A{i}"><v>{k}</v></c><c r="B{i}" t="inlineStr"><is><t>{n}</t></is></c><c r="C{i}" s="1"><v>{40000 + k % 1000}</v></c></row>' for i, (k, n, _) in enumerate(rows, 2))
    return _zip(**{
        "[Content_Types].xml": "<x/>", "xl/workbook.xml": f'<workbook {_S}><sheets><sheet name="{title}" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<R><Relationship Id="r1" Target="worksheets/sheet1.xml"/></R>',
        "xl/sharedStrings.xml": f"<sst {_S}><si><t>key</t></si><si><t>name</t></si><si><t>day</t></si></sst>", "xl/styles.xml": f'<styleSheet {_S}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f"<worksheet {_S}><sheetData>{lines}</sheetData></worksheet>",
    })


def _odf(body: str) -> bytes:
    return _zip(**{"content.xml": f"<office:c {_O}><office:body>{body}</office:body></office:c>"})


def _odt(title: str, rows: list[Row]) -> bytes:
    items = "".join(f"<text:list-item><text:p>{n}<text:tab/>{s}</text:p></text:list-item>" for _, n, s in rows)
    return _odf(f'<office:text><text:h text:outline-level="1">{title}</text:h><text:list>{items}</text:list></office:text>')


def _ods(title: str, rows: list[Row]) -> bytes:
    cell = lambda t: f"<table:table-cell><text:p>{t}</text:p></table:table-cell>"
    return _odf(f'<office:spreadsheet><table:table table:name="{title}">{"".join(f"<table:table-row>{cell(k)}{cell(n)}</table:table-row>" for k, n, _ in rows)}</table:table></office:spreadsheet>')


def _odp(title: str, rows: list[Row]) -> bytes:
    return _odf(f"<office:presentation><draw:page><text:h>{title}</text:h></draw:page><draw:page>{''.join(f'<text:p>{n}</text:p>' for _, n, _ in rows)}</draw:page></office:presentation>")


def _epub(title: str, rows: list[Row]) -> bytes:
    pages = {f"O/p{k}.html": f"<html><body><p>{n}</p></body></html>" for k, n, _ in rows}
    items = "".join(f'<item id="i{k}" href="p{k}.html"/>' for k, _, _ in rows)
    spine = "".join(f'<itemref idref="i{k}"/>' for k, _, _ in reversed(rows))
    return _zip(**{"META-INF/container.xml": '<c><rootfile full-path="O/b.opf"/></c>', "O/b.opf": f"<p><title>{title}</title><manifest>{items}</manifest><spine>{spine}</spine></p>"}, **pages)


#: Rows that stand on a page of a PDF file.
PAGE_ROWS = 20


def _pdf(title: str, rows: list[Row]) -> bytes:
    pages = [rows[i : i + PAGE_ROWS] for i in range(0, len(rows), PAGE_ROWS)]
    objects = [b"<</Type /Catalog /Pages 2 0 R>>", b"<</Type /Pages /Kids [%s]>>" % b" ".join(b"%d 0 R" % (4 + 2 * i) for i in range(len(pages))), b"<</Title (%s)>>" % title.encode()]
    for i, page in enumerate(pages):
        lines = b" 0 -14 Td ".join(b"(%d \\(%s\\)) Tj" % (k, n.encode()) for k, n, _ in page)
        stream = b"BT /F1 12 Tf " + lines + b" ET"
        objects += [b"<</Type /Page /Parent 2 0 R /Contents %d 0 R>>" % (5 + 2 * i), b"<</Length %d>>\nstream\n%s\nendstream" % (len(stream), stream)]
    body = b"".join(b"%d 0 obj %s endobj\n" % (i, o) for i, o in enumerate(objects, 1))
    return b"%PDF-1.4\n" + body + b"trailer <</Root 1 0 R /Info 3 0 R>>"


def _mht(title: str, rows: list[Row]) -> bytes:
    page = base64.encodebytes(f"<h1>{title}</h1>{''.join(f'<p>{n} é</p>' for _, n, _ in rows)}".encode())
    return b"MIME-Version: 1.0\r\nContent-Type: multipart/related; boundary=B\r\n\r\n--B\r\nContent-Type: text/plain\r\n\r\nplain part\r\n--B\r\nContent-Type: text/html; charset=utf-8\r\nContent-Transfer-Encoding: base64\r\n\r\n" + page + b"\r\n--B--\r\n"


def _archive(title: str, rows: list[Row]) -> bytes:
    return _zip(**{"tool.exe": "MZ", "long.md": "x" * 10_001, **{f"{s}/{k}.txt": n for k, n, s in rows}})


def _wav(title: str, rows: list[Row]) -> bytes:
    return b"RIFF\0\0\0\0WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, 8000, 32000, 4, 16) + b"data" + struct.pack("<I", 32000 * len(rows)) + b"\0" * 8


def _text(line: str, head: str = "", tail: str = "", encoding: str = "utf-8", between: str = "\n") -> Callable[[str, list[Row]], bytes]:
    """A writer of lines; ``{t}``, ``{i}``, ``{k}``, ``{n}`` and ``{s}`` stand for title, place, key, name and segment."""
    put = lambda form, **v: "".join([form := form.replace("{" + a + "}", str(b)) for a, b in v.items()][-1:])
    return lambda title, rows: (put(head, t=title) + between.join(put(line, t=title, i=i, k=k, n=n, s=s) for i, (k, n, s) in enumerate(rows, 1)) + tail).encode(encoding)


def _compound(**streams: bytes) -> bytes:
    """A compound file with all streams in the regular chain of sectors."""
    size, end = 512, 0xFFFFFFFE
    data = {n.replace("_", " "): d.ljust(max(4096, -(-len(d) // size) * size), b"\0") for n, d in streams.items()}
    sectors = sum(len(d) // size for d in data.values()) + 1
    tables = -(-sectors // 127)
    fat, entries, at = [0xFFFFFFFD] * tables, [("Root Entry", 5, end, 0)], tables
    for name, d in data.items():
        n = len(d) // size
        entries.append((name, 2, at, len(d)))
        fat += [*range(at + 1, at + n), end]
        at += n
    fat.append(end)
    directory = b"".join(n.encode("utf-16-le").ljust(64, b"\0") + (struct.pack("<HBB", 2 * len(n) + 2, kind, 1) + b"\xff" * 12).ljust(52, b"\0") + struct.pack("<II", first, length) + b"\0" * 4 for n, kind, first, length in entries)
    head = bytearray(512)
    head[:8] = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
    struct.pack_into("<HH", head, 30, 9, 6)
    struct.pack_into("<I", head, 44, tables)
    struct.pack_into("<I4xIIIII", head, 48, at, 4096, end, 0, end, 0)
    struct.pack_into("<109I", head, 76, *range(tables), *[0xFFFFFFFF] * (109 - tables))
    return bytes(head) + struct.pack(f"<{len(fat)}I", *fat).ljust(size * tables, b"\xff") + b"".join(data.values()) + directory.ljust(size, b"\0")


def _doc(title: str, rows: list[Row]) -> bytes:
    text = "\r".join([f"Customers of {title}", *(f"{n} {s}" for _, n, s in rows)])
    word = struct.pack("<H", 0xA5EC).ljust(24, b"\0") + struct.pack("<II", 512, 512 + len(text))
    return _compound(WordDocument=word.ljust(512, b"\0") + text.encode())


def _ppt(title: str, rows: list[Row]) -> bytes:
    record = lambda kind, body: struct.pack("<HHI", 0, kind, len(body)) + body
    inner = b"".join(record(0x0FA0, f"{n} 中".encode("utf-16-le")) + record(0x0FA8, f"{s} {k}".encode()) for k, n, s in rows)
    return _compound(PowerPoint_Document=struct.pack("<HHI", 15, 1000, len(inner)) + inner)


def _xls(title: str, rows: list[Row]) -> bytes:
    records, body = [], struct.pack("<II", len(rows), len(rows))
    for _, n, _ in rows:
        item = struct.pack("<HB", len(n), 0) + n.encode()
        if len(body) + len(item) > 8000:
            records.append(body)
            body = b""
        body += item
    records.append(body)
    return _compound(Workbook=b"".join(struct.pack("<HH", 0x3C if i else 0xFC, len(r)) + r for i, r in enumerate(records)))


def _mp3(title: str, rows: list[Row]) -> bytes:
    tag = b"TIT2" + struct.pack(">I", len(title) + 1) + b"\0\0\0" + title.encode()
    return b"ID3\x03\0\0" + bytes([0, 0, 0, len(tag)]) + tag + struct.pack(">I", 0xFFFB9000) + b"\0" * 15996


def _mp4(title: str, rows: list[Row]) -> bytes:
    box = lambda name, body: struct.pack(">I", 8 + len(body)) + name + body
    tkhd = b"\0" * 76 + struct.pack(">II", 640 << 16, 360 << 16)
    return box(b"ftyp", b"isom") + box(b"moov", box(b"mvhd", b"\0" * 12 + struct.pack(">II", 1000, 1000 * len(rows)) + b"\0" * 80) + box(b"trak", box(b"tkhd", tkhd)))


def _mkv(title: str, rows: list[Row]) -> bytes:
    v = lambda n: bytes([0x80 | n])
    info = b"\x44\x89" + v(8) + struct.pack(">d", 1000.0 * len(rows))
    track = b"\xae" + v(9) + b"\xe0" + v(7) + b"\xb0\x82\x02\x80\xba\x81\x64"
    inner = b"\x15\x49\xa9\x66" + v(len(info)) + info + b"\x16\x54\xae\x6b" + v(len(track)) + track
    return b"\x18\x53\x80\x67" + v(len(inner)) + inner


def _flv(title: str, rows: list[Row]) -> bytes:
    meta = b"\x02\0\x0aonMetaData\x08\0\0\0\1\0\x08duration\0" + struct.pack(">d", len(rows) + 0.5) + b"\0\0\x09"
    return b"FLV\x01\x05\0\0\0\x09\0\0\0\0\x12" + len(meta).to_bytes(3, "big") + b"\0" * 7 + meta + b"\0" * 8


def _flac(title: str, rows: list[Row]) -> bytes:
    return b"fLaC\x80\0\0\x22" + b"\0" * 10 + ((44100 << 44) | (1 << 41) | (15 << 36) | 44100 * len(rows)).to_bytes(8, "big") + b"\0" * 16


WRITERS: dict[str, Callable[[str, list[Row]], bytes]] = {
    "csv": _text('{k},"{n}, Ltd", {s} ', "key,name,segment\n"),
    "tsv": _text("{k}\t{n}\t{s}", "key\tname\tsegment\n"),
    "json": lambda t, rows: json.dumps({"nation": t, "customers": [{"key": k, "name": n, "tags": [s, None, True]} for k, n, s in rows]}).encode(),
    "xml": _text("<customer><name>{n}</name><!-- {k} --><segment> {s} &amp; co</segment></customer>", "<?xml version='1.0'?>\n<nation><title>{t}</title>", "</nation>"),
    "yaml": _text('c{k}: "{n}"', "# list\nnation: {t}\n"),
    "toml": _text('c{k} = "{n}"', 'title = "{t}"\n[customers]\n'),
    "ini": _text("c{k} = {n} ; {s}", "; head\n[{t}]\n"),
    "properties": _text("cust\\:{k}=\\u4e2d{n}\\\n   {s}", "! head\n"),
    "log": _text("\x01{k}      {n}​  ", between="\n\n\n\n\n"),
    "txt": _text("客户 {n} {s}", encoding="gbk"),
    "md": _text("- {n}", "﻿# {t}\n\n"),
    "html": _text("<li>{n} &lt;{s}&gt; &eacute;</li>", "<html><head><style>p {x}</style></head><body><h1>{t}</h1><ul>", "</ul></body></html>"),
    "py": _text('c{k} = "{n}"'),
    "srt": _text("{i}\n00:00:01,000 --> 00:00:02,000\n{n}\n{s}\n"),
    "vtt": _text("00:01.000 --> 00:02.000\n{n}\n", "WEBVTT\n\nNOTE head\n\n"),
    "ass": _text("Dialogue: 0,0:00:01.00,0:00:04.00,Default,,0,0,0,,{\\pos(1,2)}{n}, {s}", "[Script Info]\nTitle: {t}\n[Events]\n"),
    "rtf": _text("{k}\\cell {n}\\cell\\row", "{\\rtf1\\ansi\\ansicpg1252 caf\\'e9 {t}\\par ", "}", between="\n"),
    "docx": _docx, "pptx": _pptx, "xlsx": _xlsx, "odt": _odt, "ods": _ods, "odp": _odp, "epub": _epub, "pdf": _pdf, "mht": _mht, "zip": _archive, "wav": _wav,
    "dotx": _dotx, "jpg": _text("{n}"), "m4a": _text("{s}"), "doc": _doc, "ppt": _ppt, "xls": _xls, "mp3": _mp3, "mp4": _mp4, "mkv": _mkv, "flv": _flv, "flac": _flac,
}


def files(rows: DataFrame, kind: str, group: str = "nation") -> DataFrame:
    """One file of type ``kind`` for each ``group`` of ``rows`` (``key``, ``name``, ``segment``), as :func:`leafmill.sources.extract.read_files` gives them."""
    write = WRITERS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            titles = batch.column(0).to_pylist()
            bodies = [write(t, [(r["key"], r["name"], r["segment"]) for r in items]) for t, items in zip(titles, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([f"/files/{t}.{kind}" for t in titles], pa.string()), pa.array(list(map(len, bodies)), pa.int64()), pa.array(bodies, pa.binary())], names=["path", "length", "content"])

    grouped = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("key", "name", "segment"))).alias("items"))
    made = grouped.mapInArrow(run, "path string, length long, content binary")
    return made.select("path", F.lit(None).cast("timestamp").alias("modificationTime"), "length", "content", F.substring_index("path", "/", -1).alias("name"), F.lit(kind).alias("file_type"))
