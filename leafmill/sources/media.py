"""Properties of sound and film files out of their headers. Pure Python, run inside Arrow batches."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

from leafmill.sources.formats import clean

# Characters of subtitles that a report carries.
SOUND_CHARS, FILM_CHARS = 5000, 8000


def size_text(n: float) -> str:
    """Arrow-side twin of :func:`leafmill.functions.text.size_text`."""
    if n < 1 << 10:
        return f"{n} B"
    unit, digits, base = ("KB", 1, 1 << 10) if n < 1 << 20 else ("MB", 1, 1 << 20) if n < 1 << 30 else ("GB", 2, 1 << 30)
    return f"{n / base:.{digits}f} {unit}"


def duration_text(seconds: float) -> str:
    """Arrow-side twin of :func:`leafmill.functions.text.duration_text`."""
    s = int(seconds)
    h, m, r = s // 3600, s % 3600 // 60, s % 60
    return f"{h}时{m:02d}分{r:02d}秒" if h else f"{m}分{r:02d}秒" if m else f"{r}秒"


# ---------------------------------------------------------------- MP3

# Bit rates (kbit/s) and sampling rates of ISO 11172-3 and 13818-3, by version and layer.
_RATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448), (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384), (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256), (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160), (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
_SAMPLING = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
_FRAMES = {"TIT2": "标题", "TPE1": "艺术家", "TALB": "专辑", "TYER": "年份", "TDRC": "年份", "TCON": "流派", "TRCK": "音轨", "COMM": "注释"}


def syncsafe(b: bytes) -> int:
    """A number of seven bits a byte."""
    out = 0
    for x in b:
        out = out << 7 | x & 127
    return out


def _id3_text(b: bytes) -> str:
    kind = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(b[0], "latin-1") if b else "latin-1"
    return b[1:].decode(kind, "replace").strip("\0 ")


def mp3(raw: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    at = 0
    if raw[:3] == b"ID3":
        version, end = raw[3], 10 + syncsafe(raw[6:10])
        at = 10
        while at + 10 < end:
            name = raw[at : at + 4].decode("latin-1")
            n = syncsafe(raw[at + 4 : at + 8]) if version >= 4 else struct.unpack_from(">I", raw, at + 4)[0]
            if not re.fullmatch("[A-Z0-9]{4}", name) or n <= 0:
                break
            body = raw[at + 10 : at + 10 + n]
            if name in _FRAMES:
                out[_FRAMES[name]] = _id3_text(body[:1] + body[4:]).split("\0")[-1] if name == "COMM" else _id3_text(body)
            at += 10 + n
        at = end
    elif raw[-128:-125] == b"TAG":
        for label, a, b in (("标题", 3, 33), ("艺术家", 33, 63), ("专辑", 63, 93), ("年份", 93, 97)):
            s = raw[-128:][a:b].split(b"\0")[0].decode("latin-1").strip()
            if s:
                out[label] = s
    while at + 4 <= len(raw):
        at = raw.find(b"\xff", at)
        if at < 0 or at + 4 > len(raw):
            break
        h = struct.unpack_from(">I", raw, at)[0]
        version, layer, rate, sampling = h >> 19 & 3, 4 - (h >> 17 & 3), h >> 12 & 15, h >> 10 & 3
        if h >> 21 == 2047 and version != 1 and layer < 4 and 0 < rate < 15 and sampling < 3:
            kbit = _RATES[1 if version == 3 else 2, layer][rate - 1]
            out |= {"比特率": f"{kbit} kbps", "采样率": f"{_SAMPLING[version][sampling]} Hz", "声道": "单声道" if h >> 6 & 3 == 3 else "立体声", "时长": duration_text((len(raw) - at) * 8 / (kbit * 1000))}
            break
        at += 1
    return out


# ---------------------------------------------------------------- WAV, AVI


def _riff(raw: bytes, at: int, end: int) -> Iterator[tuple[str, int, int]]:
    while at + 8 <= end:
        name, n = raw[at : at + 4].decode("latin-1"), struct.unpack_from("<I", raw, at + 4)[0]
        yield name, at + 8, min(at + 8 + n, end)
        at += 8 + n + n % 2


def wav(raw: bytes) -> dict[str, str]:
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    out, rate = {}, 0
    for name, a, b in _riff(raw, 12, len(raw)):
        if name == "fmt ":
            kind, channels, sampling, rate, _, bits = struct.unpack_from("<HHIIHH", raw, a)
            out |= {"编码": {1: "PCM", 3: "IEEE Float", 6: "A-law", 7: "μ-law"}.get(kind, str(kind)), "声道": str(channels), "采样率": f"{sampling} Hz", "位深": f"{bits} bit"}
        elif name == "data" and rate:
            out["时长"] = duration_text(struct.unpack_from("<I", raw, a - 4)[0] / rate)
    return out


def avi(raw: bytes) -> dict[str, str]:
    at = raw.find(b"avih", 0, 4096)
    if raw[:4] != b"RIFF" or at < 0:
        raise ValueError("no AVI header")
    micro, _, _, _, frames = struct.unpack_from("<5I", raw, at + 8)
    width, height = struct.unpack_from("<2I", raw, at + 40)
    return {"分辨率": f"{width}x{height}", "帧率": f"{1e6 / micro:.2f} fps" if micro else "", "时长": duration_text(frames * micro / 1e6)}


# ---------------------------------------------------------------- FLAC, OGG


def _comments(b: bytes) -> dict[str, str]:
    labels = {"TITLE": "标题", "ARTIST": "艺术家", "ALBUM": "专辑", "DATE": "年份", "GENRE": "流派", "TRACKNUMBER": "音轨"}
    out, at = {}, 4 + struct.unpack_from("<I", b)[0]
    count, at = struct.unpack_from("<I", b, at)[0], at + 4
    for _ in range(min(count, 1000)):
        if at + 4 > len(b):
            break
        n = struct.unpack_from("<I", b, at)[0]
        key, _, value = b[at + 4 : at + 4 + n].decode("utf-8", "replace").partition("=")
        if key.upper() in labels:
            out[labels[key.upper()]] = value
        at += 4 + n
    return out


def flac(raw: bytes) -> dict[str, str]:
    if raw[:4] != b"fLaC":
        raise ValueError("not a FLAC file")
    out, at, last = {}, 4, False
    while not last and at + 4 <= len(raw):
        last, kind, n = bool(raw[at] & 128), raw[at] & 127, int.from_bytes(raw[at + 1 : at + 4], "big")
        body = raw[at + 4 : at + 4 + n]
        if kind == 0 and len(body) >= 18:
            v = int.from_bytes(body[10:18], "big")
            rate, samples = v >> 44, v & (1 << 36) - 1
            out |= {"采样率": f"{rate} Hz", "声道": str((v >> 41 & 7) + 1), "位深": f"{(v >> 36 & 31) + 1} bit"} | ({"时长": duration_text(samples / rate)} if rate and samples else {})
        elif kind == 4:
            out |= _comments(body)
        at += 4 + n
    return out


def ogg(raw: bytes) -> dict[str, str]:
    if raw[:4] != b"OggS":
        raise ValueError("not an Ogg file")
    out, at, body = {}, 0, b""
    for _ in range(5):
        if raw[at : at + 4] != b"OggS":
            break
        n = raw[at + 26]
        start = at + 27 + n
        at = start + sum(raw[at + 27 : start])
        body += raw[start:at]
    if (k := body.find(b"\x01vorbis")) >= 0:
        channels, rate = struct.unpack_from("<BI", body, k + 11)
        out |= {"编码": "Vorbis", "声道": str(channels), "采样率": f"{rate} Hz"}
        last = raw.rfind(b"OggS")
        if last > 0 and rate:
            out["时长"] = duration_text(struct.unpack_from("<q", raw, last + 6)[0] / rate)
    if (k := body.find(b"\x03vorbis")) >= 0:
        out |= _comments(body[k + 7 :])
    return out


# ---------------------------------------------------------------- MP4

_HOLDERS = frozenset("moov trak mdia minf stbl udta ilst meta".split())
_ILST = {"\xa9nam": "标题", "\xa9ART": "艺术家", "\xa9alb": "专辑", "\xa9day": "年份", "\xa9gen": "流派"}


def boxes(raw: bytes, at: int, end: int, path: str = "") -> Iterator[tuple[str, int, int]]:
    """Path and extent of the boxes of an MP4 file, nested ones too."""
    while at + 8 <= end:
        n, name, head = struct.unpack_from(">I", raw, at)[0], raw[at + 4 : at + 8].decode("latin-1"), 8
        if n == 1 and at + 16 <= end:
            n, head = struct.unpack_from(">Q", raw, at + 8)[0], 16
        n = end - at if n == 0 else n
        if n < head:
            return
        start, stop = at + head, min(at + n, end)
        yield f"{path}/{name}", start, stop
        if name in _HOLDERS or path.endswith("/ilst"):
            # a meta box has a version and flags before its boxes
            inner = start + 4 if name == "meta" and raw[start + 4 : start + 8] != b"hdlr" else start
            yield from boxes(raw, inner, stop, f"{path}/{name}")
        at += n


def mp4(raw: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    codecs: list[str] = []
    for path, a, b in boxes(raw, 0, len(raw)):
        name = path.rsplit("/", 1)[-1]
        if name == "ftyp":
            out["品牌"] = raw[a : a + 4].decode("latin-1").strip()
        elif name == "mvhd":
            scale, length = struct.unpack_from(">IQ", raw, a + 20) if raw[a] == 1 else struct.unpack_from(">II", raw, a + 12)
            if scale:
                out["时长"] = duration_text(length / scale)
        elif name == "tkhd":
            width, height = struct.unpack_from(">II", raw, a + (88 if raw[a] == 1 else 76))
            if width and height:
                out["分辨率"] = f"{width >> 16}x{height >> 16}"
        elif name == "stsd" and b - a >= 16:
            codecs.append(raw[a + 12 : a + 16].decode("latin-1"))
        elif name == "data" and path.split("/")[-2] in _ILST:
            out[_ILST[path.split("/")[-2]]] = raw[a + 8 : b].decode("utf-8", "replace")
    if codecs:
        out["编码"] = ", ".join(dict.fromkeys(codecs[:21]))
    return out


# ---------------------------------------------------------------- Matroska


def vint(raw: bytes, at: int, keep: bool = False) -> tuple[int, int]:
    """A number of variable length at ``at``, and its length; ``keep`` leaves the marker bit in, as ids have it."""
    first = raw[at] if at < len(raw) else 0
    n = 9 - first.bit_length()
    if n > 8:
        raise ValueError("bad length")
    v = int.from_bytes(raw[at : at + n], "big")
    return (v if keep else v & (1 << 7 * n) - 1), n


def matroska(raw: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    scale, length = 1_000_000, None
    codecs: list[str] = []

    def walk(at: int, end: int) -> None:
        nonlocal scale, length
        while at < end:
            try:
                name, n = vint(raw, at, True)
                size, m = vint(raw, at + n)
            except ValueError:
                return
            start = at + n + m
            stop = end if size == (1 << 7 * m) - 1 else min(start + size, end)
            body = raw[start:stop]
            if name in (0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0xE0, 0xE1):
                walk(start, stop)
            elif name == 0x2AD7B1:
                scale = int.from_bytes(body, "big")
            elif name == 0x4489 and len(body) in (4, 8):
                length = struct.unpack(">f" if len(body) == 4 else ">d", body)[0]
            elif name == 0x7BA9:
                out["标题"] = body.decode("utf-8", "replace")
            elif name == 0x86:
                codecs.append(body.decode("latin-1").strip("\0"))
            elif name == 0xB0:
                out["宽"] = str(int.from_bytes(body, "big"))
            elif name == 0xBA:
                out["高"] = str(int.from_bytes(body, "big"))
            elif name == 0x1F43B675:
                return
            at = stop

    walk(0, len(raw))
    if "宽" in out and "高" in out:
        out["分辨率"] = f"{out.pop('宽')}x{out.pop('高')}"
    if length is not None:
        out["时长"] = duration_text(length * scale / 1e9)
    if codecs:
        out["编码"] = ", ".join(codecs)
    return out


# ---------------------------------------------------------------- FLV


def amf(raw: bytes, at: int) -> tuple[object, int]:
    """An AMF0 value at ``at``, and where it ends."""
    kind, at = raw[at], at + 1
    if kind == 0:
        return struct.unpack_from(">d", raw, at)[0], at + 8
    if kind == 1:
        return bool(raw[at]), at + 1
    if kind in (2, 12):
        wide = 4 if kind == 12 else 2
        n = int.from_bytes(raw[at : at + wide], "big")
        return raw[at + wide : at + wide + n].decode("utf-8", "replace"), at + wide + n
    if kind in (3, 8):
        at += 4 if kind == 8 else 0
        out = {}
        while raw[at : at + 3] != b"\0\0\x09" and at + 3 < len(raw):
            n = struct.unpack_from(">H", raw, at)[0]
            key = raw[at + 2 : at + 2 + n].decode("utf-8", "replace")
            out[key], at = amf(raw, at + 2 + n)
        return out, at + 3
    if kind == 10:
        n, at = struct.unpack_from(">I", raw, at)[0], at + 4
        items = []
        for _ in range(n):
            v, at = amf(raw, at)
            items.append(v)
        return items, at
    if kind == 11:
        return struct.unpack_from(">d", raw, at)[0], at + 10
    return None, at


def flv(raw: bytes) -> dict[str, str]:
    if raw[:3] != b"FLV":
        raise ValueError("not an FLV file")
    at = struct.unpack_from(">I", raw, 5)[0] + 4
    while at + 11 < min(len(raw), 50_000):
        kind, n = raw[at], int.from_bytes(raw[at + 1 : at + 4], "big")
        if kind == 18:
            name, end = amf(raw, at + 11)
            v = amf(raw, end)[0] if name == "onMetaData" else {}
            if isinstance(v, dict):
                out = {}
                if v.get("width") and v.get("height"):
                    out["分辨率"] = f"{int(v['width'])}x{int(v['height'])}"
                if v.get("duration"):
                    out["时长"] = duration_text(v["duration"])
                if v.get("framerate"):
                    out["帧率"] = f"{v['framerate']:.2f} fps"
                return out
        at += 11 + n + 4
    return {}


_READERS = {"mp3": mp3, "wav": wav, "flac": flac, "m4a": mp4, "aac": mp4, "ogg": ogg, "mp4": mp4, "m4v": mp4, "mov": mp4, "3gp": mp4, "mkv": matroska, "webm": matroska, "avi": avi, "flv": flv}


def properties(raw: bytes, kind: str) -> dict[str, str]:
    """Properties of a file by its type; a note instead where the type is not read or the header is broken."""
    if kind not in _READERS:
        return {"格式": kind.upper(), "时长": "未知"}
    try:
        return _READERS[kind](raw)
    except (ValueError, struct.error, IndexError):
        return {"格式": kind.upper(), "状态": "元数据解析失败"}


def report(raw: bytes, name: str, label: str, film: bool, spoken: str = "", transcript: str = "") -> str:
    """Text that stands for a sound or film file: name, format, size, properties, and what is said if that is known."""
    kind = name.rsplit(".", 1)[-1].lower()
    lines = [f"{'视频' if film else '音频'}文件: {name}", f"格式: {label}", f"大小: {size_text(len(raw))}", "", "--- 元数据 ---"]
    lines += [f"{k}: {v}" for k, v in properties(raw, kind).items() if v]
    most = FILM_CHARS if film else SOUND_CHARS
    if spoken:
        lines += ["", "--- 字幕文本 ---", spoken[:most], *([f"... (共{len(spoken)}字符，已截断)"] if len(spoken) > most else [])]
    elif transcript:
        lines += ["", "--- 语音转文字 ---", transcript]
    else:
        lines += ["", "--- 提示 ---", "未找到字幕文件。"]
    return clean("\n".join(lines))
