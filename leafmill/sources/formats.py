"""Readers of text, web and data formats: bytes in, text out. Pure Python, run inside Arrow batches."""

from __future__ import annotations

import csv
import email
import email.policy
import html
import io
import json
import re
import tomllib
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

#: Encodings tried in turn; the last takes anything.
ENCODINGS = ("utf-8", "gbk", "gb18030", "big5", "latin-1")
# Rows of a table, characters and bytes of an archive's member.
TABLE_ROWS, MEMBER_CHARS, MEMBER_BYTES = 1000, 10_000, 5 * 1024 * 1024
# Extensions of archive members that hold no text.
BINARY = frozenset("exe dll so dylib bin dat jpg jpeg png gif bmp ico webp mp3 mp4 avi mkv mov wmv zip rar 7z gz bz2 xz pdf doc docx ppt pptx xls xlsx".split())

_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
_HIDDEN = dict.fromkeys(map(ord, "​‌‍﻿  ­‪‫‬‭‮"))


def decode(raw: bytes, encodings: tuple[str, ...] = ENCODINGS) -> str:
    """Text of ``raw`` by the first encoding that fits, without a byte order mark."""
    for e in encodings:
        try:
            return raw.decode(e).removeprefix("﻿")
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace").removeprefix("﻿")


def clean(text: str) -> str:
    """Arrow-side twin of :func:`leafmill.functions.text.clean_text`."""
    text = _CONTROL.sub("", text).translate(_HIDDEN)
    text = re.sub(r"\n{4,}", "\n\n\n", re.sub(r"[^\S\n]{3,}", " ", text))
    return "\n".join(map(str.rstrip, text.split("\n"))).strip()


def text(raw: bytes, name: str) -> str:
    return decode(raw)


def log(raw: bytes, name: str) -> str:
    return clean(decode(raw))


def code(raw: bytes, name: str) -> str:
    return f"[代码文件: {name}]\n{decode(raw)}"


_DROPPED = re.compile(r"<(script|style)[^>]*>.*?</\1>", re.S | re.I)
_ENDS = re.compile(r"</(?:p|div|h[1-6]|li|tr|pre|blockquote)\s*>|<br\s*/?>", re.I)


def strip_html(source: str) -> str:
    """Visible text of HTML, with the full table of entities."""
    plain = html.unescape(re.sub(r"<[^>]+>", "", _ENDS.sub("\n", _DROPPED.sub("", source))))
    return "\n".join(filter(None, map(str.strip, plain.split("\n"))))


def web(raw: bytes, name: str) -> str:
    return strip_html(decode(raw))


def _table(rows: list[list[str]], total: int) -> str:
    lines = [("[表头] " if i == 0 else "") + " | ".join(r) for i, r in enumerate(rows[: TABLE_ROWS + 1])]
    return "\n".join(lines + [f"... 共{total - 1}行数据（已截取前{TABLE_ROWS}行）"] if total > TABLE_ROWS + 1 else lines)


def comma_table(raw: bytes, name: str) -> str:
    rows = [[c.strip() for c in r] for r in csv.reader(io.StringIO(decode(raw, ENCODINGS[:3])))]
    return _table(rows, len(rows))


def tab_table(raw: bytes, name: str) -> str:
    lines = decode(raw).split("\n")
    return _table([x.split("\t") for x in lines[: TABLE_ROWS + 1]], len(lines))


def paths(value: object, at: str = "", bare_items: bool = False) -> Iterator[str]:
    """``path: value`` lines of nested data; ``bare_items`` writes strings of a list, and leaves out nulls, as YAML's rendering does."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from paths(v, f"{at}.{k}" if at else str(k), bare_items)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            if bare_items and isinstance(v, str):
                yield v
            else:
                yield from paths(v, f"{at}[{i}]", bare_items)
    elif not (bare_items and value is None):
        yield f"{at}: {value}" if at else str(value)


def json_text(raw: bytes, name: str) -> str:
    source = decode(raw)
    try:
        return clean("\n".join(paths(json.loads(source))))
    except ValueError:
        return clean(source)


def xml_text(raw: bytes, name: str) -> str:
    try:
        found = (x.strip() for x in ET.fromstring(raw).itertext())
    except ET.ParseError:
        source = re.sub(r"<\?.*?\?>|<!DOCTYPE[^>]*>|<!--.*?-->", "", decode(raw), flags=re.S)
        source = re.sub(r"<!\[CDATA\[(.*?)\]\]>", r"\1", source, flags=re.S)
        found = (re.sub(r"\s+", " ", x).strip() for x in re.findall(r">([^<]+)<", f">{source}<"))
        found = (x for x in found if len(x) > 1)
    return clean("\n".join(filter(None, found)))


def yaml_text(raw: bytes, name: str) -> str:
    source = decode(raw)
    try:
        import yaml

        return clean("\n".join(paths(yaml.safe_load(source), "", True)))
    except Exception:  # no YAML library, or not YAML
        return clean("\n".join(_yaml_lines(source)))


def _yaml_lines(source: str) -> Iterator[str]:
    for line in source.split("\n"):
        s = line.strip()
        if not s or s[0] == "#" or s in ("---", "..."):
            continue
        m = re.match(r"(?:- )?([^:#]+):\s*(.*)", s)
        if m and m[2]:
            yield f"{m[1].strip()}: {m[2].strip(chr(34) + chr(39))}"
        elif not m and s.startswith("- "):
            yield s[2:].strip("\"'")


def toml_text(raw: bytes, name: str) -> str:
    source = decode(raw)
    try:
        return clean("\n".join(paths(tomllib.loads(source))))
    except tomllib.TOMLDecodeError:
        out = []
        for s in map(str.strip, source.split("\n")):
            if m := re.fullmatch(r"\[+([^\]]+)\]+", s):
                out.append(f"[节] {m[1]}")
            elif s and s[0] != "#" and "=" in s:
                k, v = s.split("=", 1)
                out.append(f"{k.strip()}: {v.strip().strip(chr(34) + chr(39))}")
        return clean("\n".join(out))


def uncomment(value: str) -> str:
    """``value`` without a comment after ``;`` or ``#`` that stands outside quotes and after a blank."""
    quote = ""
    for i, c in enumerate(value):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in ";#" and (i == 0 or value[i - 1].isspace()):
            return value[:i].rstrip()
    return value


def ini_text(raw: bytes, name: str) -> str:
    out = []
    for s in map(str.strip, decode(raw).split("\n")):
        if not s or s[0] in ";#":
            continue
        if s[0] == "[" and "]" in s:
            out.append(f"[节] {s[1 : s.index(']')]}")
            continue
        sep = "=" if "=" in s else ":" if ":" in s else ""
        if sep:
            k, v = s.split(sep, 1)
            out.append(f"{k.strip()}: {uncomment(v.strip())}")
        else:
            out.append(uncomment(s))
    return clean("\n".join(out))


_ESCAPE = re.compile(r"\\(u[0-9a-fA-F]{4}|.)", re.S)


def _unescape(s: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if m[1][0] == "u" and len(m[1]) == 5 else {"t": "\t", "n": "\n", "r": "\r", "f": "\f"}.get(m[1], m[1]), s)


def properties(source: str) -> list[tuple[str, str]]:
    """Keys and values of a Java properties file: continued lines, escaped separators and characters."""
    out, held = [], ""
    for line in source.split("\n"):
        line = held + (line.lstrip() if held else line).rstrip("\r")
        held = ""
        s = line.lstrip()
        if not s or s[0] in "#!":
            continue
        if (len(line) - len(line.rstrip("\\"))) % 2:
            held = line[:-1]
            continue
        m = re.match(r"((?:[^\\=:\s]|\\.)*)\s*(?:[=:]\s*)?(.*)", s, re.S)
        out.append((_unescape(m[1]), _unescape(m[2])))
    if held.strip():
        m = re.match(r"((?:[^\\=:\s]|\\.)*)\s*(?:[=:]\s*)?(.*)", held.strip(), re.S)
        out.append((_unescape(m[1]), _unescape(m[2])))
    return out


def properties_text(raw: bytes, name: str) -> str:
    return clean("\n".join(f"{k}: {v}" for k, v in properties(decode(raw))))


def subtitles(raw: bytes, name: str) -> str:
    """Spoken text of SRT, VTT, ASS and SSA files; other subtitle files as they are."""
    source, kind = decode(raw), name.rsplit(".", 1)[-1].lower()
    lines = [x.strip() for x in source.split("\n")]
    if kind == "srt":
        lines = [x for x in lines if x and not x.isdigit() and "-->" not in x]
    elif kind == "vtt":
        lines = [x for x in lines if x and not x.isdigit() and "-->" not in x and not x.startswith(("WEBVTT", "STYLE", "NOTE"))]
    elif kind in ("ass", "ssa"):
        inside, kept = False, []
        for x in lines:
            if x.startswith("["):
                inside = x.startswith("[Events]")
            elif inside and x.startswith("Dialogue:") and x.count(",") >= 9:
                kept.append(re.sub(r"\{[^}]*\}", "", x.split(",", 9)[9]).strip())
        lines = [x for x in kept if x]
    return clean("\n".join(lines))


def archive_members(raw: bytes, text_types: frozenset[str]) -> Iterator[tuple[str, str]]:
    """Name and text of an archive's text members, in order. Members that are large or hold no text are left out; archives inside are not opened."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        for info in z.infolist():
            name = info.filename
            stem, dot, ext = name.rsplit("/", 1)[-1].rpartition(".")
            ext = ext.lower() if dot and stem else ""
            if info.is_dir() or ext in BINARY or info.file_size > MEMBER_BYTES:
                continue
            body = z.read(info)
            if ext and ext not in text_types:
                head = body[:1024]
                try:
                    head.decode("utf-8")
                except UnicodeDecodeError as e:
                    if e.start < len(head) - 4:
                        continue
                if head.count(0) > 5:
                    continue
            content = decode(body, ("utf-8", "gbk", "gb18030", "latin-1"))
            if content.strip():
                yield name, content


def archive(raw: bytes, name: str) -> str:
    from leafmill.sources.extract import TEXT_TYPES

    out = []
    for member, content in archive_members(raw, TEXT_TYPES):
        out.append(f"[文件: {member}]\n{content[:MEMBER_CHARS]}")
        if len(content) > MEMBER_CHARS:
            out.append(f"... ({len(content)} 字符，已截断)")
    return "\n\n".join(out)


def web_archive(raw: bytes, name: str) -> str:
    """Text of the HTML parts of an MHTML file, then of its plain parts."""
    pages, plain = [], []
    for part in email.message_from_bytes(raw, policy=email.policy.compat32).walk():
        kind = part.get_content_type()
        if kind not in ("text/html", "text/plain"):
            continue
        body = part.get_payload(decode=True) or b""
        charset = part.get_content_charset()
        try:
            content = body.decode(charset) if charset else decode(body)
        except (LookupError, UnicodeDecodeError):
            content = decode(body)
        (pages if kind == "text/html" else plain).append(strip_html(content) if kind == "text/html" else content.strip())
    found = [x for x in pages + plain if x]
    if not found:
        raise ValueError("no text part")
    return clean("\n\n".join(found))
