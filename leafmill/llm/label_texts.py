"""Documents whose kind of text is known because they are made: what the rules of problem 7 are learned from.

Prose is put together from sentences, lists and tables from pieces of sentences, figures, dates and numbers, code from statements over made-up names,
junk from random signs. The kind follows from how a document is made, never from its statistics.
"""

from __future__ import annotations

import base64
import random
import re
from collections.abc import Callable

#: Sentences of one language.
Sentences = list[str]

_HAN = re.compile("[㐀-鿿]")
_MARKERS = ("- ", "* ", "• ", "· ", "– ", "{n}. ", "({n}) ", "{n}) ", "{a}) ", "", "")
_WRONG = (("utf-8", "latin-1"), ("utf-8", "cp1252"), ("utf-8", "cp437"), ("utf-8", "mac_roman"), ("utf-8", "cp1251"), ("gbk", "latin-1"), ("cp1251", "latin-1"), ("utf-8", "gbk"))
_MISREAD = str.maketrans({"e": "c", "o": "0", "i": "1", "l": "1", "s": "5", "t": "+", "a": "@"})


def _garbled(rng: random.Random, text: str) -> str:
    wrote, read = rng.choice(_WRONG)
    return text.encode(wrote, "replace").decode(read, "replace")


def _wrapped(text: str, width: int) -> str:
    if _HAN.search(text):
        return "\n".join(text[i : i + width // 2] for i in range(0, len(text), width // 2))
    lines, line = [], ""
    for w in text.split():
        if line and len(line) + len(w) >= width:
            lines.append(line)
            line = w
        else:
            line = f"{line} {w}".strip()
    return "\n".join([*lines, line])


def _phrase(rng: random.Random, sentences: Sentences) -> str:
    """Some words of a sentence, without its punctuation."""
    s = re.split(r"[,;:，。；：.!?！？]", rng.choice(sentences))[0]
    if _HAN.search(s):
        n = rng.randint(2, 22)
        at = rng.randrange(max(1, len(s) - n))
        return s[at : at + n]
    words = s.split()
    n = rng.randint(1, 11)
    at = rng.randrange(max(1, len(words) - n))
    return " ".join(words[at : at + n])


def _code_number(rng: random.Random) -> str:
    a = lambda: chr(65 + rng.randrange(26))
    return rng.choice((f"{a()}{a()}-{rng.randint(100, 9999)}", f"{a()}{rng.randint(1, 999)}{a()}", f"{rng.randint(1, 99)}/{a()}{rng.randint(1, 99)}"))


def _title(rng: random.Random, sentences: Sentences) -> str:
    t = _phrase(rng, sentences)
    return rng.choice((t.upper(), t.title(), t + ":", f"# {t}", f"{t.title()} {rng.randint(1980, 2024)}"))


def _items(rng: random.Random, sentences: Sentences, n: int) -> str:
    marker, out = rng.choice(_MARKERS), []
    for i in range(1, n + 1):
        item = _phrase(rng, sentences)
        item = f"{_code_number(rng)} {item}" if rng.random() < 0.2 else item
        item = f"{item} ({rng.randint(1, 99)})" if rng.random() < 0.2 else item
        out.append(marker.format(n=i, a=chr(97 + (i - 1) % 26)) + item)
    return "\n".join(out)


def _cell(rng: random.Random, sentences: Sentences) -> str:
    r = rng.random()
    if r < 0.4:
        return _phrase(rng, sentences)
    return rng.choice((str(rng.randint(-9999, 9999)), f"{rng.randint(0, 9999)}.5", f"{rng.randint(1, 9999)}%", f"{rng.randint(1990, 2024)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", _code_number(rng), _code_number(rng), ""))


def _rows(rng: random.Random, sentences: Sentences, n: int) -> str:
    columns, sep = rng.randint(3, 8), rng.choice((" | ", "\t", ",", ";", "  "))
    table = [[_phrase(rng, sentences) for _ in range(columns)]] + [[_cell(rng, sentences) for _ in range(columns)] for _ in range(n)]
    if sep == "  ":
        width = rng.randint(18, 34)
        lines = ["".join(c[: width - 2].ljust(width) for c in r).rstrip() for r in table]
    else:
        lines = [sep.join(r) for r in table]
    return rng.choice(("", "", "[表头] ")) + "\n".join(lines)


def prose(rng: random.Random, sentences: Sentences) -> str:
    """Paragraphs of sentences; some wrapped, marked up, misread, wrongly decoded, repetitive, without punctuation, or with a small list or table."""
    han = bool(_HAN.search(sentences[0]))
    plain = [s for s in sentences if not re.search("[,;，；]", s)]
    if len(plain) > 20 and rng.random() < 0.25:
        sentences = plain
    paragraphs = [("" if han else " ").join(rng.choice(sentences) for _ in range(rng.randint(2, 7))) for _ in range(rng.choice((rng.randint(1, 9), rng.randint(1, 9), rng.randint(6, 30))))]
    kind = rng.random()
    if kind < 0.16:
        mark = rng.choice(("<b>{}</b>", "**{}**", "''{}''", "\\emph{{{}}}", "[[{}]]", "`{}`", "<a href=\"x.html\">{}</a>"))
        block = rng.choice(("{}", "{}", "<p>{}</p>", "<div class=\"c3\">{}</div>", "== Part ==\n{}", "\\begin{{quote}}\n{}\n\\end{{quote}}"))
        paragraphs = [block.format(p) for p in paragraphs]
        paragraphs = [re.sub(r"\b(\w{4,})\b", lambda m: mark.format(m.group()) if rng.random() < 0.06 else m.group(), p) for p in paragraphs]
    elif kind < 0.26:
        paragraphs = ["".join(c.translate(_MISREAD) if rng.random() < 0.03 else c for c in _wrapped(p, 66)) for p in paragraphs]
        head = _title(rng, sentences)
        paragraphs = [f"{head}\n{p}\n{rng.choice(('', 'Page '))}{i}" for i, p in enumerate(paragraphs, 1)]
    elif kind < 0.31:
        paragraphs = ["\n".join(s.rstrip(".!?。").lower() for s in rng.sample(sentences, min(len(sentences), 6))) for _ in paragraphs]
    elif kind < 0.37:
        again = paragraphs[0] if rng.random() < 0.5 else " ".join([_phrase(rng, sentences)] * rng.randint(5, 60))
        paragraphs += [again] * rng.randint(1, 4)
    elif kind < 0.52:
        # lists and tables that make up a third at most
        room = sum(map(len, paragraphs)) / 2
        for _ in range(rng.randint(1, 5)):
            extra = rng.choice((_items, _items, _rows))(rng, sentences, rng.randint(2, 16))
            if len(extra) < room:
                room -= len(extra)
                paragraphs.insert(rng.randrange(len(paragraphs) + 1), extra)
    if rng.random() < 0.35:
        width = rng.randint(56, 90)
        paragraphs = [_wrapped(p, width) for p in paragraphs]
    text = rng.choice(("\n", "\n\n")).join(paragraphs)
    if rng.random() < 0.2:
        # wrongly decoded as a whole or from some place on
        at = rng.choice((0, 0, rng.randrange(len(text))))
        return text[:at] + _garbled(rng, text[at:])
    return text


def listing(rng: random.Random, sentences: Sentences) -> str:
    text = (_title(rng, sentences) + "\n" if rng.random() < 0.4 else "") + _items(rng, sentences, rng.randint(5, 70))
    return _garbled(rng, text) if rng.random() < 0.1 else text


def table(rng: random.Random, sentences: Sentences) -> str:
    text = ("[工作表: Data]\n" if rng.random() < 0.3 else "") + _rows(rng, sentences, rng.randint(4, 60))
    return _garbled(rng, text) if rng.random() < 0.1 else text


def junk(rng: random.Random, sentences: Sentences) -> str:
    """Signs, figures in base 16 or 64, words of consonants, beaten keys, or letters and figures mixed, in lines."""
    word = lambda letters, low, high: "".join(rng.choices(letters, k=rng.randint(low, high)))
    ways: tuple[Callable[[], str], ...] = (
        lambda: word("!#$%&*+-./:;<=>?@[]^{|}~\\", 20, 90),
        lambda: rng.choice((" ", "")).join(word("0123456789abcdef", 2, 2) for _ in range(24)),
        lambda: base64.b64encode(rng.randbytes(rng.randint(20, 54))).decode(),
        lambda: " ".join(word("bcdfghjklmnpqrstvwxz", 2, 12) for _ in range(rng.randint(5, 12))),
        lambda: "".join(rng.choice(("qwer", "asdf", "zxcv", "uiop", "hjkl", "fgh", "jklö", "12", ";;")) for _ in range(rng.randint(8, 20))),
        lambda: " ".join(rng.choice(('"', "(", "\\", "")) + word("0123456789aejkqxz#$%&:;", 1, 6) + rng.choice(("", ".", "$")) for _ in range(rng.randint(8, 16))),
    )
    way = rng.choice(ways)
    return rng.choice(("\n", "\n", "\n\n")).join(way() for _ in range(rng.randint(4, 50)))


def code(rng: random.Random, sentences: Sentences) -> str:
    name = lambda: rng.choice(("load", "row", "page", "item", "queue", "index", "user", "file", "merge", "total")) + rng.choice(("", "_", "")) + rng.choice(("count", "map", "id", str(rng.randint(1, 99)), "list"))
    n = lambda: rng.randint(0, 999)
    ways: tuple[Callable[[], str], ...] = (
        lambda: f'{name()} = {name()}({n()}, "{_code_number(rng)}")', lambda: f"def {name()}({name()}, *args, **kw):", lambda: f"    return {name()}[{n()}] * {name()}", lambda: f"for {name()} in range({n()}):",
        lambda: f"if {name()} < {n()} and {name()} > {n()}:", lambda: f"List<Integer> {name()} = new ArrayList<>({n()});", lambda: f"    {name()} += {n()}  # {name()}", lambda: f"assert {name()} >= {n()} || !{name()};",
        lambda: f"const {name()} = {name()}.{name()}();", lambda: f"func {name()}({name()} int) error {{", lambda: "}", lambda: f"    {name()}({name()}, {n()});",
    )
    lines = [rng.choice(ways)() if rng.random() > 0.06 else rng.choice(("# ", "// ")) + rng.choice(sentences) for _ in range(rng.randint(8, 90))]
    return ("[代码文件: a.py]\n" if rng.random() < 0.5 else "") + "\n".join(lines)


#: How documents of each kind are made, and the share of each.
KINDS: dict[str, tuple[Callable[[random.Random, Sentences], str], float]] = {"prose": (prose, 0.5), "list": (listing, 0.15), "table": (table, 0.15), "junk": (junk, 0.1), "code": (code, 0.1)}


def made(by_language: dict[str, Sentences], n: int, seed: int = 11) -> list[tuple[str, str]]:
    """``n`` documents with their kinds, out of sentences by language; the same for the same seed."""
    rng, out = random.Random(seed), []
    languages = sorted(k for k, v in by_language.items() if len(v) > 20)
    for _ in range(n):
        kind = rng.choices(list(KINDS), [w for _, w in KINDS.values()])[0]
        first = by_language[rng.choice(languages)]
        sentences = first + by_language[rng.choice(languages)] if kind == "prose" and rng.random() < 0.1 else first
        out.append((kind, KINDS[kind][0](rng, sentences)))
    return out
