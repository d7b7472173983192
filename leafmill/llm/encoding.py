"""Garbled text from wrong decoding: detection and restoration (problem 6)."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.vocabulary import BOUND, SIGNS, frequent, kind, term_counts, terms
from leafmill.session import cut

#: One-byte encodings that UTF-8 bytes may have been read in.
SINGLE = ("cp1252", "latin-1", "cp437", "mac_roman", "cp1250", "cp1251", "koi8_r", "cp850", "cp866", "iso8859_2", "iso8859_15", "cp1254")
#: Pairs (written in, read in) of encodings without UTF-8, tried on whole lines.
CROSSED = (
    ("cp1251", "latin-1"), ("koi8_r", "latin-1"), ("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp866", "latin-1"), ("iso8859_5", "latin-1"),
    ("cp1251", "mac_roman"), ("cp1251", "cp437"), ("gbk", "latin-1"), ("big5", "latin-1"), ("gbk", "cp1251"), ("gbk", "mac_roman"), ("gbk", "cp437"), ("gbk", "big5"), ("big5", "gbk"), ("gbk", "shift_jis"), ("gbk", "euc_kr"),
    ("latin-1", "cp437"), ("latin-1", "cp850"), ("cp437", "latin-1"), ("cp850", "latin-1"), ("latin-1", "mac_roman"), ("mac_roman", "latin-1"), ("latin-1", "cp1251"), ("latin-1", "cp1250"), ("latin-1", "koi8_r"), ("latin-1", "gbk"), ("latin-1", "cp866"),
)
#: Two-byte encodings that UTF-8 bytes may have been read in.
DOUBLE = ("gbk", "big5", "shift_jis", "euc_kr")
_CYR = ("cp1251", "koi8_r", "cp866")
#: Stands for a lost byte.
LOST = "�"
#: Follows a character that was filled in for lost bytes, until the line is done. It is none that text may hold; a line that does is left alone.
GUESS = "\ufdd0"

# What text in the seven languages is written with, beyond ASCII.
_LATIN = "àâäáãåçéèêëíìîïñóòôöõúùûüýÿœæßÀÂÄÁÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜÝŒÆ"
_SIGNS = "¡¿«»“”„‘’‚‹›–—…•·°€£§©®™×÷±²³½¼¾µ¶ªº¬ ­​‐☐☑→≤≥≠√"
_CYRILLIC = "".join(map(chr, range(0x410, 0x450))) + "Ёё№"
PLAUSIBLE = frozenset(_LATIN + _SIGNS + _CYRILLIC + "　、。〈〉《》「」『』【】！（），：；？～￥％")

_HAN = re.compile(r"[一-鿿]")
_SPAN = re.compile(r"[^\x00-\x7f]+")
_LETTERS = re.compile(r"[^\W\d_一-鿿]{2,}")
_C1 = re.compile(r"[\x80-\x84\x86-\x9f]")


def plausible(c: str) -> bool:
    return c < "\x80" and (c >= " " or c in "\t\n\r") or c in PLAUSIBLE or "一" <= c <= "鿿"


@lru_cache(maxsize=None)
def byte_of(encoding: str) -> dict[str, int]:
    """Character to byte, for the upper half of a one-byte encoding; undefined bytes are read as C1 controls."""
    out: dict[str, int] = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    if encoding == "cp1252":  # often mixed with latin-1
        for b in range(0x80, 0xA0):
            out.setdefault(chr(b), b)
    return out


def _set(chars) -> str:
    return "[" + "".join(re.escape(c) for c in sorted(chars)) + "]"


@lru_cache(maxsize=None)
def sequence(encoding: str) -> re.Pattern:
    """UTF-8 sequences of two bytes or more as they look when read in a one-byte ``encoding``; a continuation may be lost."""
    m = byte_of(encoding)
    at = lambda lo, hi: _set(c for c, b in m.items() if lo <= b <= hi)
    tail = "[" + at(0x80, 0xBF)[1:-1] + LOST + "]"
    return re.compile(f"{at(0xE0, 0xEF)}{tail}{{2}}|{at(0xC2, 0xDF)}{tail}|{at(0xF0, 0xF4)}{tail}{{3}}")


def lattice(span: str, encoding: str) -> list[int | None] | None:
    """The bytes behind ``span``, None standing for a lost one; None if a character cannot come from ``encoding``."""
    out: list[int | None] = []
    if encoding in DOUBLE:
        for c in span:
            if c == LOST:
                out.append(None)
            elif c == "€" and encoding == "gbk":
                out.append(0x80)
            else:
                try:
                    out += c.encode(encoding)
                except UnicodeEncodeError:
                    return None
        return out
    m = byte_of(encoding)
    for c in span:
        if c == LOST:
            out.append(None)
        elif c < "\x80":
            out.append(ord(c))
        elif c in m:
            out.append(m[c])
        else:
            return None
    return out


class Frequencies:
    """Log frequencies of terms and of characters, from counts of the whole corpus."""

    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        total = sum(counts.values()) + 1
        self.floor = math.log(0.05 / total)
        self.term = {w: math.log(n / total) for w, n in counts.items()}
        chars: dict[str, int] = {}
        for w, n in counts.items():
            for c in w:
                chars[c] = chars.get(c, 0) + n
        size = sum(chars.values()) + 1
        self.char = {c: math.log(n / size) for c, n in chars.items()}
        self.rare_char = math.log(0.01 / size)
        self.filled: dict[tuple[str, str, str], str] = {}
        #: Words with filled letters that are not frequent: the known letters, and the word put in.
        self.open: list[tuple[str, str]] = []
        self.edges: dict[tuple[int | None, ...], list[tuple[int, str, float]]] = {}
        self._starts: set[str] | None = None

    @property
    def starts(self) -> set[str]:
        """All beginnings of frequent words; a word that has another beginning has no frequency, whatever follows."""
        if self._starts is None:
            self._starts = {w[:k] for w in self.term if w.isalpha() and not _HAN.match(w) for k in range(1, len(w) + 1)}
        return self._starts

    def of_word(self, word: str) -> float:
        """By how much a finished word in lower case is likelier than an unknown one."""
        return self.term.get(word, self.floor) - self.floor if len(word) > 1 else 0.0

    def likelihood(self, text: str) -> float:
        """Log likelihood of the words of a text and of its other characters beyond ASCII. An unknown word is as likely as the rarest, spelt out in its characters."""
        words = _LETTERS.findall(text.lower())
        spelt = [w for w in words if w not in self.term]
        rest = [c for c in _LETTERS.sub(" ", text) if c > "\x7f"]
        lost = rest.count(LOST)
        chars = sum(self.of_char(c) for w in spelt for c in w if c > "\x7f") + sum(self.of_char(c) for c in rest if c != LOST)
        return sum(self.term.get(w, self.floor) for w in words) + chars - 12.0 * lost

    def of_char(self, c: str, before: str = "") -> float:
        """Log frequency of ``c``, of signs that of the sign after the kind of character ``before``."""
        if c in SIGNS and before:
            return self.term.get(kind(before) + c, self.floor)
        return self.char.get(c.lower(), self.rare_char if c not in PLAUSIBLE else math.log(1e-4 if c.isalpha() or c in SIGNS else 1e-7))

    def usual(self, c: str) -> bool:
        """Chinese characters count as readings only if the corpus has them among its frequent terms."""
        return not "一" <= c <= "鿿" or c in self.char

    def known(self, text: str) -> tuple[float, int]:
        """How many terms of ``text`` are frequent, and how many there are."""
        found = [w for w in terms(text) if w[0] not in SIGNS and w[-1] not in SIGNS]
        return sum(1 for w in found if w in self.term), len(found)


#: What a search keeps of the text read so far: the word it is in (lower case; None if no frequent word begins so), and its last character or that one's kind.
State = tuple[str | None, str]


def _after(state: State, c: str, freq: Frequencies) -> State:
    """The state once ``c`` has been read. Characters that later weights do not tell apart lead to the same state."""
    word = state[0]
    if "一" <= c <= "鿿":
        return "", c
    if not c.isalpha():
        # "e" and "E" are a full stop and a blank after one
        ends = "e" if c in ".!?。" else "E" if state[1] in ("e", "E") and kind(c) == "S" else kind(c)
        return "", c if c in SIGNS else ends
    longer = None if word is None else word + c.lower()
    return longer if longer in freq.starts else None, "l" if c.islower() else "L"


def _weight(state: State, c: str, freq: Frequencies) -> float:
    """What reading ``c`` adds: how usual it is after the last character, and the frequency of the word that it ends."""
    word, last = state
    s = 0.0
    if c in SIGNS and last:
        s += freq.of_char(c, _like(last)) - freq.of_char(c)
    if last in SIGNS:
        s += freq.term.get(last + kind(c), freq.floor)
    if last == "l" and c.isupper():
        s -= 6.0  # frequencies are counted without case, but words hardly change it inside
    elif last in ("S", "P") and c.isupper():
        s -= 1.0  # and seldom begin with a capital inside a sentence
    han = "一" <= c <= "鿿"
    if han and "一" <= last <= "鿿":
        s += 0.5 * (freq.term.get(last + c, freq.floor) - freq.floor)
    if han or not c.isalpha():
        s += 3.0 * freq.of_word(word or "")
    return s


def _like(last: str) -> str:
    """A character of the kind that a state keeps."""
    return {"l": "a", "L": "A", "S": " ", "P": ".", "e": ".", "E": " "}.get(last, last)


def _start(left: str, freq: Frequencies) -> State:
    state: State = ("", "")
    for c in left:
        state = _after(state, c, freq)
    return state


def read_marked(units: list[int | None], freq: Frequencies, left: str = "", right: str = "") -> str | None:
    """The likeliest UTF-8 reading of bytes with gaps, or None if there is none.

    Viterbi search over the whole span: bytes without a gap have one reading, and wherever a word ends all readings
    come together again, so gaps of one word are decided jointly and others alone, and no state is ever given up. Where no character fits, the
    likeliest reading so far is kept, a mark put for the byte, and the search goes on behind it. Characters that were filled in have :data:`GUESS` behind them. ``left`` and ``right`` are the letters around the span.
    """
    out, i = "", 0
    while i < len(units):
        read, end = viterbi(units[i:], freq, (left + out.replace(GUESS, ""))[-40:], right)
        out += read
        i += end
        if i < len(units):
            out, i = out + LOST, i + 1
    return out


def read_lattice(units: list[int | None], freq: Frequencies, left: str = "", right: str = "") -> str | None:
    """:func:`read_marked` without its marks."""
    read = read_marked(units, freq, left, right)
    return read and read.replace(GUESS, "")


def viterbi(units: list[int | None], freq: Frequencies, left: str = "", right: str = "") -> tuple[str, int]:
    """The likeliest UTF-8 reading of bytes with gaps, and how many of them it reads (all, unless nothing fits).

    A node is a byte offset with what later weights depend on (:data:`State`); an edge reads one character whose known bytes
    agree with the lattice, a gap matching any byte. Edges weigh by the character's frequency and, between Chinese characters, by the frequency of the pair; when a
    word ends it weighs by its own frequency in the corpus. A lost byte that fits nowhere is passed over at a price.
    """
    n = len(units)
    nodes: list[dict[State, tuple[float, str]]] = [{} for _ in range(n + 1)]
    nodes[0][_start(left, freq)] = (0.0, "")
    far = 0
    gaps = [k for k, u in enumerate(units) if u is None] + [n]
    g = 0
    for i in range(n):
        if not nodes[i]:
            continue
        far = i
        while gaps[g] < i:
            g += 1
        if len(nodes[i]) == 1 and gaps[g] - i > 8:
            # one reading up to the character before the gap
            (state, (score, text)), = nodes[i].items()
            sound = bytes(units[i : gaps[g] - 4]).decode("utf-8", "ignore")  # type: ignore[arg-type]
            whole = bytes(units[i : gaps[g] - 4])  # type: ignore[arg-type]
            if whole.startswith(sound.encode()) and all(map(plausible, sound)) and sound:
                for c in sound:
                    state = _after(state, c, freq)
                nodes[i + len(sound.encode())][state] = (score, text + sound)
                continue
        key = tuple(units[i : i + 4])
        if key not in freq.edges:
            if len(freq.edges) > 20_000:
                freq.edges.clear()
            freq.edges[key] = list(_edges(units, i, freq))
        edges = freq.edges[key]
        for state, (score, text) in nodes[i].items():
            for width, c, weight in edges:
                s = score + weight + (_weight(state, c, freq) if c else 0.0)
                to, at = nodes[i + width], _after(state, c, freq) if c else state
                if at not in to or s > to[at][0]:
                    to[at] = (s, text + c + GUESS if c and None in key[:width] else text + c)
    if not nodes[n]:
        return max(nodes[far].values())[1], far

    def ended(state: State) -> float:
        tail = re.match(r"[^\W\d_一-鿿]*", right).group().lower()
        sign = freq.term.get(state[1] + kind(right or " "), freq.floor) if state[1] in SIGNS and state[1] else 0.0
        return 3.0 * freq.of_word((state[0] or "") + tail if state[0] is not None else "") + sign

    best = max(nodes[n], key=lambda t: nodes[n][t][0] + ended(t))
    return nodes[n][best][1], n


def _edges(units: list[int | None], i: int, freq: Frequencies) -> Iterator[tuple[int, str, float]]:
    b = units[i]
    if b is None:
        yield 1, "", -12.0
        for c in _filling(tuple(units[i : i + 3])):
            if freq.usual(c):
                yield len(c.encode()), c, freq.of_char(c) - 4.0
        return
    if b < 0x80:
        yield 1, chr(b), 0.0
        return
    width = 2 if 0xC2 <= b <= 0xDF else 3 if 0xE0 <= b <= 0xEF else 4 if 0xF0 <= b <= 0xF4 else 0
    part = units[i : i + width]
    if not width:
        return
    # a decoder that stops at a bad byte may put one mark in place of two
    if None in part:
        for short in range(2, width + 1):
            cut = units[i : i + short]
            if cut[-1] is None or short == width:
                for c in _filling(tuple([*cut, *[None] * (width - short)])):
                    if freq.usual(c) and len(c.encode()) == width and c.encode()[0] == b and len(cut) == short:
                        yield short, c, freq.of_char(c) - (0.0 if short == width else 3.0)
    elif len(part) == width and all(0x80 <= x <= 0xBF for x in part[1:]):  # type: ignore[operator]
        try:
            c = bytes(part).decode()  # type: ignore[arg-type]
        except UnicodeDecodeError:
            return
        if plausible(c):
            yield width, c, freq.of_char(c)


@lru_cache(maxsize=20_000)
def _filling(part: tuple[int | None, ...]) -> tuple[str, ...]:
    """Plausible characters of two or three bytes that agree with the known bytes of ``part``."""
    out = []
    for width in (2, 3):
        if len(part) < width:
            continue
        for c in _candidates(width, part[0], part[1] if len(part) > 1 else None):
            e = c.encode()
            if all(x is None or x == y for x, y in zip(part, e)):
                out.append(c)
    return tuple(out)


@lru_cache(maxsize=5_000)
def _candidates(width: int, first: int | None, second: int | None) -> tuple[str, ...]:
    if width == 2:
        return tuple(c for c in PLAUSIBLE if len(c.encode()) == 2 and (first is None or c.encode()[0] == first))
    signs = tuple(c for c in PLAUSIBLE if len(c.encode()) == 3 and (first is None or c.encode()[0] == first))
    if first is not None and 0xE4 <= first <= 0xE9:
        low = ((first & 15) << 12) + (((second & 63) << 6) if second is not None else 0)
        high = low + (63 if second is not None else 4095)
        return signs + tuple(chr(c) for c in range(max(low, 0x4E00), min(high, 0x9FFF) + 1))
    return signs


_FAST = {e: byte_of(e) for e in SINGLE}


@lru_cache(maxsize=200_000)
def _of_run(span: str, encoding: str) -> tuple[str, int]:
    """A run of characters beyond ASCII with its well-formed and plausible UTF-8 sequences read again, and how many there were.

    Sequences also come about by chance, so they count only where they make up most of the run. Letters of sound Cyrillic
    text are such runs themselves: there the whole run must consist of sequences, two at least or one that gives a Latin letter or sign.
    """
    m, covered, count = _FAST[encoding], 0, 0

    def again(found: re.Match) -> str:
        nonlocal covered, count
        s = found.group()
        if LOST in s:
            covered += len(s)
            return s
        try:
            c = bytes(m[x] for x in s).decode()
        except UnicodeDecodeError:
            return s
        if plausible(c) or c in _odd():
            covered += len(s)
            count += 1
            return c
        return s

    new = sequence(encoding).sub(again, span)
    if encoding in _CYR and (covered < len(span) or count == 1 and not new <= "\u024f") or covered < 0.6 * len(span):
        return span, 0
    return new, count


@lru_cache(maxsize=200_000)
def _run_counts(span: str) -> tuple[int, ...] | None:
    """What :func:`_of_run` counts in each of :data:`SINGLE`; None if nothing in any."""
    out = tuple(_of_run(span, e)[1] for e in SINGLE)
    return out if any(out) else None


def undo_single(text: str, encoding: str) -> tuple[str, int]:
    """``text`` with the runs of characters beyond ASCII read again by :func:`_of_run`, and how many sequences there were."""
    n = 0

    def run(found: re.Match) -> str:
        nonlocal n
        new, count = _of_run(found.group(), encoding)
        n += count
        return new

    return _SPAN.sub(run, text), n


@lru_cache(maxsize=1)
def _odd() -> frozenset[str]:
    """Characters that UTF-8 lead bytes look like in one-byte encodings, so that a second pass can go on."""
    return frozenset(c for e in ("cp1252", "latin-1") for c, b in byte_of(e).items())


#: Sequences found by chance in sound text need this many neighbours before they count, by encoding.
_LEAST = {"cp1251": 2, "koi8_r": 2, "cp866": 3, "cp1250": 1, "iso8859_2": 2, "cp1254": 2, "iso8859_15": 2}
#: Signs that tell at sight, for the cheap first look at a text.
_HINT = re.compile(
    "[\x80-\x84\x86-\x9f�─-▟]|[Â-ô][\x80-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]|[¡-ÿ]{4}|Γ[Çéä]|[├┬╨╤][^\x00-\x7f]|[√¬‚–—Â‰Ê][^\x00-\x7f \n]"
    "|[РСГВвÐÑ][\x80-¿ЂЃ‚ѓ„…†‡€‰Љ‹ЊЌЋЏђ‘’“”•–—™љ›њќћџЎўЈҐЁЄЇІіґё№єјЅѕї]|[а-яё][А-ЯЁ]|[A-Za-z][Ѐ-ӿ]|[Ѐ-ӿ][A-Za-z]|[ЂЃѓЉЊЌЋЏђљњќћџЎўЈҐЄЇІіґєјЅѕї]"
    "|[ĂĹĽÄ][^\x00-\x7f]|[a-z][ΘΦΩδτσαßΓπΣµ∞φε∩≡±≥≤⌠⌡÷≈¢£¥₧ƒÆÅŠŽ][a-z]|[一-鿿]|[가-힣ｦ-ﾟ぀-ヿㄅ-ㄩ]"
)
#: The same without what sound Chinese text has too.
_NOT_HAN_HINT = re.compile(_HINT.pattern.replace("|[一-鿿]|", "|"))
_GBK_HINT = re.compile(r"[鈥鈧锟脙脗茅眉盲枚脽帽谩贸铆煤猫脿锛銆鐨鏄涓鍏鏂浜鍦閮鐢绗璁犺缁骞勫掳芦禄驴]|[€]")


def hinted(text: str) -> bool:
    """Whether a text may be garbled; sound text in Chinese passes too and is decided later."""
    return bool(_HINT.search(text))


def _undo_utf8(text: str) -> str:
    """One-byte misreadings of UTF-8 undone, as often as it was misread, as far as they are certain from their form alone."""
    while found := [c for c in map(_run_counts, _SPAN.findall(text)) if c]:
        best, encoding = 0, ""
        for e, n in zip(SINGLE, map(sum, zip(*found))):
            if n >= _LEAST.get(e, 1) and n > best:
                best, encoding = n, e
        if not best:
            break
        # every sequence becomes one character, so the text gets shorter each time
        text = undo_single(text, encoding)[0]
    return text


#: Characters that text in the seven languages is mostly written with and that no misreading does without others beside them.
_SOUND_CHARS = frozenset("°") | (PLAUSIBLE -frozenset("ÂÃÅÄÐÑÎÏÌÒÅåìòýÿðâ¡¢£§©®™×±²³½¼¾µ¶ªº‚√≥≤≠\xad​")) | frozenset(map(chr, [9, 10, 13, *range(32, 127)])) | frozenset(
    # the common characters are the first level of GB 2312
    bytes((a, b)).decode("gb2312", "ignore") for a in range(0xB0, 0xD8) for b in range(0xA1, 0xFF)
)
_SWAPPED = re.compile("[а-яё][А-ЯЁ]")


def rough_repair(text: str) -> str:
    """``text`` with misread UTF-8 restored where the form alone is proof; no word frequencies are used."""
    if text.isascii() or _SOUND_CHARS.issuperset(text) and not _SWAPPED.search(text):
        return text
    lines = []
    for line in text.split("\n"):
        if not line.isascii() and not (_SOUND_CHARS.issuperset(line) and not _SWAPPED.search(line)):
            hint = _NOT_HAN_HINT.search(line)
            if hint:
                line = _undo_utf8(line)
            if not _COMMON_HAN.search(line) and _HAN.search(line):
                line = _undo_double(line, None)[0]
            if hint:
                line = _undo_crossed(line, None)[0]
        lines.append(line)
    return "\n".join(lines)


#: Sound Chinese text of some length has one of these characters.
_COMMON_HAN = re.compile("[的了在是和有不这为与]")
_NON = re.compile(r"[^\x00-\x7f]+(?:[ -~]?[^\x00-\x7f]+)*")


def _undo_double(line: str, freq: Frequencies | None) -> tuple[str, bool, bool]:
    """UTF-8 read in a two-byte encoding: the restored line, whether anything was, whether anything was lost."""
    if not _HAN.search(line) and not re.search("[가-힣ｦ-ﾟ぀-ヿ]", line):
        return line, False, False
    touched = incomplete = False

    def again(found: re.Match) -> str:
        nonlocal touched, incomplete
        span = found.group()
        for e in DOUBLE:
            units = lattice(span, e)
            if not units:
                continue
            gaps = units.count(None)
            if gaps == 0:
                try:
                    read = bytes(units).decode()  # type: ignore[arg-type]
                except UnicodeDecodeError:
                    continue
                if all(map(plausible, read)):
                    touched = True
                    return read
                continue
            # with losses: most of the span must read as UTF-8 all the same
            whole = bytes(0xFF if u is None else u for u in units).decode("utf-8", "replace")
            good = sum(1 for c in whole if c != LOST and plausible(c) and c > "\x7f")
            if good * 2 < whole.count(LOST) and not (e == "gbk" and _GBK_HINT.match(span)):
                continue
            touched = incomplete = True
            if freq is None:
                return whole
            a, b = found.start(), found.end()
            read = read_marked(units, freq, _tail_letters(line[:a]), _head_letters(line[b:])) or whole
            return read
        return span

    return _NON.sub(again, line), touched, incomplete


def _tail_letters(s: str) -> str:
    m = re.search(r"[^\W\d_]{0,20}$", s)
    return m.group() if m and not _HAN.search(m.group()) else ""


def _head_letters(s: str) -> str:
    m = re.match(r"[^\W\d_]{0,20}", s)
    return m.group() if m and not _HAN.search(m.group()) else ""


_ODD_LINE = re.compile(r"[a-zß-ÿ][一-鿿]|[一-鿿][a-zß-ÿ]|[¡-ÿ]{4}|[а-яё][А-ЯЁ]|[ЂЃѓЉЊЌЋЏђљњќћџЎўЈҐЄЇІіґєјЅѕї]|[A-Za-z][Ѐ-ӿ]|[Ѐ-ӿ][A-Za-z]|[─-▟]|[가-힣ｦ-ﾟ぀-ヿㄅ-ㄩ]|[a-z][ΘΦΩδτσαßΓπΣµ∞φε∩≡±≥≤⌠⌡÷≈¢£¥₧ƒÆÅŠŽ‚„…†‡ˆ‰‹][a-z]|[\x80-\x9f]")


def _reading(line: str, freq: Frequencies | None) -> float:
    """Share of a line's units that are sound: frequent terms, or without frequencies ones made of usual letters in usual order."""
    if freq is not None:
        known, n = freq.known(line)
        return known / n if n else 0.0
    words = re.findall(r"[^\W\d_]+", line)
    good = sum(1 for w in words if w.isascii() or re.fullmatch(r"[а-яё]+|[А-ЯЁ]?[а-яё]+|[А-ЯЁ]+|[一-鿿]+", w) or w <= "\u024f" and sum(c > "\x7f" for c in w) * 2 < len(w))
    return good / len(words) if words else 0.0


def _undo_crossed(line: str, freq: Frequencies | None) -> tuple[str, bool]:
    """A line written in one encoding and read in another, neither of them UTF-8."""
    if not _ODD_LINE.search(line) and not (_HAN.search(line) and freq is not None):
        return line, False
    now = _reading(line, freq)
    if now > 0.6:
        return line, False
    best = (now + 0.25, "")
    for wrote, read in CROSSED:
        try:
            raw = line.encode(read) if read not in _FAST else bytes(_FAST[read][c] if c > "\x7f" else ord(c) for c in line)
            new = raw.decode(wrote)
        except (UnicodeError, KeyError):
            continue
        if not all(map(plausible, new)):
            continue
        value = _reading(new, freq)
        if value > best[0]:
            best = (value, new)
    return (best[1], True) if best[1] else (line, False)


def _fill_losses(line: str, freq: Frequencies) -> str:
    """Misread UTF-8 with lost bytes, in one-byte encodings, restored by :func:`viterbi`: all losses of a word at once, or each by itself if the word also has sound letters."""
    for e in ("cp1252", "cp437", "mac_roman", "cp1250", "cp1251"):
        pattern = sequence(e)

        def span(found: re.Match) -> str:
            if LOST not in found.group():
                return found.group()
            units = lattice(found.group(), e)  # noqa: B023
            before, after = found.string[: found.start()], found.string[found.end() :]
            return units and read_marked(units, freq, _tail_letters(before), _head_letters(after)) or found.group()

        def word(found: re.Match) -> str:
            whole = found.group()
            if not any(LOST in m.group() for m in pattern.finditer(whole)):  # noqa: B023
                return whole
            units = lattice(whole, e)  # noqa: B023
            read = units and read_marked(units, freq, found.string[max(0, found.start() - 3) : found.start()])
            return read if read and LOST not in read else pattern.sub(span, whole)  # noqa: B023

        new = re.sub(r"\S+", word, line)
        if new != line:
            return new
    return line


_LETTER_LOSS = re.compile(f"[^\\W\\d_]*(?:{LOST}[^\\W\\d_]*)+")
_LOWER = tuple(c for c in _LATIN if c.islower())
_ONE_SIGN = tuple(c for c in SIGNS)


def _letter(state: State, c: str, freq: Frequencies) -> float:
    """What a letter or sign adds after ``state``: the frequency of the word that it ends, and of signs that of their neighbours' kinds."""
    word, last = state
    s = 0.0
    if last in SIGNS and last:
        s += freq.term.get(last + kind(c), freq.floor) - freq.floor
    if c in SIGNS:
        s += freq.term.get(kind(_like(last) if last else " ") + c, freq.floor) - freq.floor
    return s if c.isalpha() and not "一" <= c <= "鿿" else s + 2.5 * freq.of_word(word or "")


def _fill_letters(line: str, freq: Frequencies) -> str:
    """Lost one-byte letters and signs, each filled so that its word is as frequent as can be."""

    def again(found: re.Match) -> str:
        span = found.group()
        before, after = line[found.start() - 1 : found.start()], line[found.end() : found.end() + 1]
        key = (kind(before or " "), span, kind(after or " "))
        if key not in freq.filled:
            if len(freq.filled) > 50_000:
                freq.filled.clear()
            freq.filled[key] = filled(span, before, after)
        return freq.filled[key]

    def filled(span: str, before: str, after: str) -> str:
        # Viterbi over the places of the span; a node is what later weights depend on, as in viterbi()
        nodes: dict[State, tuple[float, str]] = {_start(before, freq): (0.0, "")}
        for c in span:
            grown: dict[State, tuple[float, str]] = {}
            for state, (score, text) in nodes.items():
                for new in (*_LOWER, *_ONE_SIGN) if c == LOST else (c,):
                    s = score + _letter(state, new, freq) + (freq.of_char(new) * 0.1 if c == LOST else 0.0)
                    to = _after(state, new, freq)
                    if to not in grown or s > grown[to][0]:
                        grown[to] = (s, text + new + GUESS if c == LOST else text + new)
            nodes = grown
        end = after or " "
        best = max(nodes, key=lambda t: nodes[t][0] + _letter(t, "." if end.isalpha() else end, freq))
        capitals = [c for c in span if c.isalpha()]
        return nodes[best][1].upper() if len(capitals) > 1 and all(map(str.isupper, capitals)) else nodes[best][1]

    return _LETTER_LOSS.sub(again, line)


_STUCK = re.compile(r"(?<=[A-Za-zß-ÿ])[一-鿿]{1,2}|[一-鿿]{1,2}(?=[a-zß-ÿ])")


def _undo_stuck(line: str) -> tuple[str, bool]:
    """Single signs of Latin text that a two-byte decoder merged with the letter after them."""
    if len(_HAN.findall(line)) * 10 > len(line):
        return line, False

    def again(found: re.Match) -> str:
        try:
            read = found.group().encode("gbk").decode("cp1252")
        except UnicodeError:
            return found.group()
        return read if all(map(plausible, read)) else found.group()

    new = _STUCK.sub(again, line)
    return new, new != line


_GUESSED = re.compile(f"(?:[^\\W\\d_]{GUESS}?)+")
_ASCII = re.compile("[A-Za-z]")
#: What a wrong decoding costs, in nats: how much likelier its undoing must make a line.
CHANNEL = 3.0


def _readings(line: str, freq: Frequencies, hint: bool) -> list[tuple[str, int, bool]]:
    """What a line may have been before it went through none, one or two wrong decodings: the text, how many were undone, whether bytes were lost.

    UTF-8 read in one-byte encodings, any number of times over, counts as one; then, or by itself, UTF-8 read in a two-byte encoding, a line
    crossed between two other encodings, or single letters that a two-byte decoder took with their neighbours. Without a ``hint`` the first is not tried.
    """
    out = [(line, 0, False)]
    once = _undo_utf8(line) if hint else line
    if once != line:
        out.append((_fill_losses(once, freq) if LOST in once else once, 1, LOST in once))
    elif LOST in line and (filled := _fill_losses(line, freq)) != line:
        out.append((filled, 1, True))
    for text, steps, lost in list(out):
        if steps == 0 and _sound(text, freq):
            continue
        double, touched, gaps = _undo_double(text, freq)
        if touched:
            out.append((double, steps + 1, lost or gaps))
        crossed, touched = _undo_crossed(text, freq)
        if touched:
            out.append((crossed, steps + 1, lost))
        stuck, touched = _undo_stuck(text)
        if touched:
            out.append((stuck, steps + 1, lost))
    return out


def restore(text: str, freq: Frequencies) -> tuple[str, bool, bool]:
    """The restored text, whether it was garbled, and whether the restoration is certain to be complete.

    A noisy channel, line by line: of all readings of a line (:func:`_readings`) that one is taken which is likeliest under the corpus frequencies, each
    wrong decoding costing :data:`CHANNEL`. Words with filled letters that are not among those frequencies are left in ``freq.open``. Readings come from lattices of bytes in which lost bytes are open, filled by what the frequencies
    favour; letters that were lost by themselves are filled in the same way. A line with lost bytes or control characters is garbled whatever its best reading.
    """
    if text.isascii() or not _HINT.search(text):
        return text, False, True
    out, garbled, complete = [], False, True
    for line in text.split("\n"):
        if line.isascii() or GUESS in line:
            out.append(line)
            continue
        hint = bool(_NOT_HAN_HINT.search(line))
        if not hint and _sound(line, freq):
            out.append(line)
            continue
        readings = _readings(line, freq, hint)
        new, _, lost = max(readings, key=lambda r: freq.likelihood(r[0].replace(GUESS, "")) - CHANNEL * r[1]) if len(readings) > 1 else readings[0]
        if LOST in line:
            garbled = True
        complete &= not lost
        if LOST in new:
            new = _fill_letters(new, freq)
            complete = False
        if GUESS in new:
            for m in _GUESSED.finditer(new):
                word = m.group().replace(GUESS, "")
                if GUESS in m.group() and word.lower() not in freq.term and len(_ASCII.findall(word)) >= 3:
                    freq.open.append((re.sub(f".{GUESS}", LOST, m.group()).lower(), word))
            new = new.replace(GUESS, "")
        if new != line:
            garbled = True
        elif _C1.search(line):
            garbled, complete = True, False
        out.append(new)
    return "\n".join(out), garbled, complete


def _sound(line: str, freq: Frequencies) -> bool:
    """A line of which most terms are frequent and that has no odd sign needs no second look."""
    if _ODD_LINE.search(line):
        return False
    known, n = freq.known(line)
    return n == 0 or known >= 0.5 * n


_OPEN = pa.struct([("pattern", pa.string()), ("word", pa.string())])
_SCHEMA = pa.schema([("id", pa.int64()), ("complete", pa.bool_()), ("content", pa.string()), ("open", pa.list_(_OPEN))])


def _kernel(counts: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = Frequencies(counts)
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                freq.open = []
                new, garbled, complete = restore(text, freq)
                if garbled:
                    rows.append((i, complete, new, [{"pattern": p, "word": w} for p, w in freq.open]))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_SCHEMA)], schema=_SCHEMA)

    return run


def _rare_words(asked: DataFrame, counts: DataFrame) -> DataFrame:
    """The most frequent word of the whole corpus that each pattern of ``asked`` fits, if there is one that stands twice: ``pattern``, ``form``.

    Lost letters are never ASCII ones, so a word and its pattern agree in their ASCII letters, by which they are joined.
    """
    key = lambda c: F.regexp_replace(c, "[^a-z]", "")
    words = counts.filter((F.col("n") > 1) & F.col("word").rlike(r"^\p{L}*[^\x00-\x7f]\p{L}*$")).select("word", "n", key("word").alias("key")).filter(F.length("key") >= 3)
    fits = asked.withColumn("key", key("pattern")).join(words, "key").filter(F.length("word") == F.length("pattern")).filter(F.expr(f"word rlike concat('^', replace(pattern, '{LOST}', '[^ -~]'), '$')"))
    return fits.groupBy("pattern").agg(F.max_by("word", F.struct("n", "word")).alias("form"))


def restore_chunks(chunks: DataFrame, counts: DataFrame | None = None, bound: int = BOUND, rare: bool = True) -> DataFrame:
    """The garbled chunks: ``id``, ``complete`` (nothing was lost), ``content`` (restored as far as possible).

    NULL and ASCII texts are sound. A row delivered twice comes out once. Word frequencies are those of all chunks (or ``counts``: ``word``, ``n``). Those of the terms that
    make up 1 / ``bound`` of the corpus or more, hence at most ``bound``, are sent to the executors and decide on the spot. With ``rare``, words with filled letters that are not among
    them are looked up among all words of the corpus by a join.
    """
    counts = cut(term_counts(chunks, "content")) if counts is None else counts
    common = {r.word: r.n for r in frequent(counts, bound).collect()}
    suspects = chunks.filter(F.col("content").rlike("[^\\x00-\\x7f]")).select("id", "content")
    found = suspects.mapInArrow(_kernel(common), "id long, complete boolean, content string, open array<struct<pattern: string, word: string>>")
    once = found.groupBy("id").agg(F.min("complete").alias("complete"), F.min(F.struct("content", "open")).alias("c")).select("id", "complete", "c.content", "c.open")
    if not rare:
        return once.drop("open")
    once = cut(once)
    open_ = once.select("id", F.explode("open").alias("o")).select("id", "o.pattern", "o.word")
    if open_.isEmpty():
        return once.drop("open")
    forms = open_.join(_rare_words(open_.select("pattern").distinct(), counts), "pattern").filter(F.lower("word") != F.col("form"))
    first = F.substring("word", 1, 1)
    letters = F.regexp_replace("word", "[^A-Za-z]", "")
    cased = F.when((letters == F.upper(letters)) & (F.length(letters) > 1), F.upper("form")).when(first == F.upper(first), F.concat(F.upper(F.substring("form", 1, 1)), F.expr("substring(form, 2)"))).otherwise(F.col("form"))
    fixes = forms.groupBy(F.col("id").alias("_id")).agg(F.array_sort(F.collect_set(F.struct("word", cased.alias("form")))).alias("fixes"))
    put = F.aggregate("fixes", F.col("content"), lambda t, f: F.regexp_replace(t, F.concat(F.lit(r"(?<!\p{L})"), f["word"], F.lit(r"(?!\p{L})")), f["form"]))
    joined = once.join(fixes, F.col("id").eqNullSafe(F.col("_id")), "left")
    return joined.select("id", "complete", F.when(F.col("fixes").isNull(), F.col("content")).otherwise(put).alias("content"))
