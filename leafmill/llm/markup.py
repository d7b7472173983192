"""Markup residue in text: which kinds there are, and clean text that keeps the structure (problem 5)."""

from __future__ import annotations

import html
import html.entities
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.quality import COMMON, COMMON_HAN

KINDS = ("html", "markdown", "wiki", "latex")

# Element names of HTML.
_TAGS = (
    "a abbr acronym address applet area article aside audio b base basefont bdi bdo big blockquote body br button canvas caption center cite code col colgroup "
    "data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html i iframe "
    "img input ins kbd label legend li link main map mark meta meter nav noframes noscript object ol optgroup option output p param picture pre progress q rp rt ruby s samp "
    "script section select small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr"
).split()
# Commands of LaTeX that text is marked up with.
_COMMANDS = (
    "part chapter section subsection subsubsection paragraph subparagraph emph textbf textit texttt textsc textsf textrm textsl underline uppercase "
    "begin end item label ref eqref pageref cite citep citet footnote footnotemark footnotetext caption includegraphics input include usepackage documentclass title author date maketitle tableofcontents "
    "frac sqrt int sum prod lim infty partial cdot times leq geq neq approx equiv alpha beta gamma delta epsilon varepsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau phi chi psi omega "
    "mathbf mathrm mathcal mathbb left right ldots dots quad qquad hline centering noindent newline newpage linebreak bibliography bibliographystyle href url verb hspace vspace hfill vfill "
    "bf it tt sc sf rm em large Large small tiny bigskip medskip smallskip par"
).split()

_COMMENT = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<!doctype[^>]*>|<\?xml[^>]*\?>", re.S | re.I)
_TAG = re.compile(rf"</?(?:{'|'.join(sorted(_TAGS, key=len, reverse=True))})(?:\s[^<>]*)?\s*/?>", re.I)
_ENTITY = re.compile(r"&(?:[A-Za-z][A-Za-z0-9]{1,30}|#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6});")
_FENCE = re.compile(r"(?m)^[ \t]*(```+|~~~+)[ \t]*([\w+#-]*)[ \t]*\r?$")
_MD = re.compile(
    r"!?\[[^\[\]\n]*\]\((?!\s*\))[^()\s]*(?:\([^()\s]*\))?[^()\n]*\)"
    r"|(?<![\w*\\])\*\*\*(?=[^\s*])[^*\n]++(?<=[^\s*])\*\*\*(?![\w*])|(?<![\w_\\])___(?=[^\s_])[^_\n]++(?<=[^\s_])___(?![\w_(])"
    r"|(?<![\w*])\*\*(?=[^\s*])[^*\n]++(?<=[^\s*])\*\*"
    r"|\*\*(?=[^\s*])[^*\n]++(?<=[^\s*])\*\*(?![\w*])|(?<=[㐀-鿿])\*\*[^*\n]++\*\*"
    r"|(?<![\w_])__(?=[^\s_])[^_\n]++(?<=[^\s_])__(?![\w(])|(?<=[㐀-鿿])__[^_\n]++__"
    r"|~~(?=[^\s~])[^~\n]++(?<=[^\s~])~~"
    r"|(?<![`\w\\])`[^`\n]++`(?!`)|(?<=[㐀-鿿])`[^`\n]++`"
    r"|(?m:^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*\r?$)"
    r"|(?m:^[ ]{0,3}\[[^\]\n]++\]:[ \t]+\S+)"
)
_EM = re.compile(r"(?<![\w*\\])\*(?=[^\s*])[^*\n]++(?<=[^\s*,;(=])\*(?![\w*])|(?<![\w_\\])_(?=[^\s_])[^_\n]++(?<=[^\s_])_(?![\w_(])")
_WIKI = re.compile(
    r"\[\[[^\[\]\n]++\]\]|\{\{[^{}]++\}\}|(?m:^[ \t]*(={2,6})[ \t]*[^=\s][^\n]*?[ \t]*\1[ \t]*\r?$)|(?m:^[ \t]*\{\|[^\n]*$)|(?m:^[ \t]*\|\}[ \t]*\r?$)"
    r"|(?<![\w'])(?:'{5}|'{2,3})(?=[^\s'])[^'\n]++(?:(?<=\w)'(?=\w)[^'\n]++)*+(?<=[^\s'])(?:'{5}|'{2,3})(?!['])|(?<=[㐀-鿿])'{2,3}[^'\n]++'{2,3}"
    r"|(?<![\]\[!])\[(?:https?|ftp)://[^\s\]]+(?: [^\]\n]*)?\]|(?i:</?(?:ref|nowiki|references|gallery)\b[^<>]*>)|(?i:^#redirect\b)"
)
_MATH = re.compile(r"\$\$[^$]++\$\$|(?<![\\$\w])\$(?=[^\s$])[^$\n\\^_=]*+[\\^_=][^$\n]*+\$(?![\w$])|\\\((?:(?!\\\)|\\\()[^\n])++\\\)|\\\[[^\]]+?\\\]")
_TEX = re.compile(rf"(?<![\w\\:])\\(?:{'|'.join(sorted(_COMMANDS, key=len, reverse=True))})\*?(?![A-Za-z\\])|(?<![\w\\:])\\[A-Za-z]+\*?\{{")
#: Lines of program code, in which signs are no markup.
_CODE = re.compile(r"^\s*(?:def|for|if|elif|while|return|assert|class|import|from|public|private|func|fn|var|let|const|switch|case)\b.*[\[\](){};:=.]|^[^\\]*[;{}]\s*$|^\s*[\w.\[\]]+ ?[-+*/|&]?= ?\S|^\s*(?://|#include|/\*)|\w<[A-Z]\w*>")
_CODE_FILE = re.compile(r"^\s*\[代码文件")


@dataclass
class Block:
    """A piece of text between structural breaks."""

    text: str
    role: str = "text"  # text, heading, item, code, formula, row
    linked: int = 0  # characters inside links
    label: str = ""
    words: str | None = None  # the text without formulas and inline code, if it has any


_STOP, _STOP_HAN = frozenset(COMMON), frozenset(COMMON_HAN)
#: Limits of the block rules: link density, stop-word density (low and high), lengths in characters (short and long), share of readable words.
LINK_DENSITY, STOP_LOW, STOP_HIGH, SHORT, LONG, READABLE = 0.5, 0.1, 0.25, 40, 160, 0.25
#: Labels that the first pass gives for good; the second spreads them.
DECIDED = frozenset(("good", "bad", "junk"))
_LETTERS = re.compile(r"[^\W\d_]+")
_VOWEL = re.compile("[aeiouyAEIOUY]")
#: Names that no chance brings about: a block that has one is not junk by its signs.
_NAMED = re.compile(rf"\\(?:{'|'.join(c for c in _COMMANDS if len(c) > 2)})(?![A-Za-z])|</?(?:{'|'.join(t for t in _TAGS if len(t) > 1)})\b[^<>]*>", re.I)
_OUTER = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def _unreadable(text: str) -> bool:
    """Whether a block has hardly a stop word and next to none of its words could be read aloud: ciphers, random letters, runs of signs."""
    if sum(c > "\x7f" for c in text) * 5 > len(text):
        return False
    words = text.split()
    whole = [w for w in (x.strip(_OUTER) for x in words) if w.isalpha()]
    if sum(len(w) > 1 and w.lower() in _STOP for w in whole) * 10 > len(words):
        return False
    sound = sum(len(w) for w in whole if len(w) < 25 and (_VOWEL.search(w) or w > "\x7f"))
    return sound < READABLE * sum(map(len, words)) and not _NAMED.search(text)


def _first_label(b: Block) -> str:
    n = len(b.text.strip())
    if b.role in ("code", "formula"):
        return "good"
    if b.linked > LINK_DENSITY * max(1, n):
        return "bad"
    if n < SHORT:
        return "short"
    if _unreadable(b.text if b.words is None else b.words):
        return "junk"
    if b.role in ("heading", "item", "row"):
        return "short"
    words = _LETTERS.findall(b.text.lower())
    han = sum(c in _STOP_HAN for c in b.text)
    units = sum(len(w) / 2 if w[0] >= "㐀" else 1 for w in words)
    density = (sum(w in _STOP for w in words) + han) / max(1.0, units)
    if density >= STOP_HIGH:
        return "good" if n > LONG else "near"
    return "near" if density >= STOP_LOW else "bad" if n < LONG and not re.search(r"[.!?。]", b.text) else "near"


def label_blocks(blocks: list[Block]) -> None:
    """Two passes over the blocks of a text: decide each by itself, then let ambiguous short ones follow their neighbours.

    First: code and formulas are ``good``; a block mostly of links is ``bad``; one below :data:`SHORT` characters is ``short``; one with hardly
    a stop word of which next to nothing is readable is ``junk``; by
    the density of stop words a longer one is ``good`` (long enough), ``near`` or ``bad``. Second: a short or near block takes the label on which its nearest decided neighbours
    agree, where ``near`` ones become good whatever those are; if they differ, short ones follow the closer neighbour, the one before in a tie. Without any decided
    neighbour a block is good. Headings, items and rows are never ``bad`` for their words alone.
    """
    first = [_first_label(b) for b in blocks]
    before, after = [-1] * len(blocks), [-1] * len(blocks)
    last = -1
    for i in range(len(blocks)):
        before[i] = last
        last = i if first[i] in DECIDED else last
    last = -1
    for i in range(len(blocks) - 1, -1, -1):
        after[i] = last
        last = i if first[i] in DECIDED else last
    for i, b in enumerate(blocks):
        b.label = first[i]
        if b.label in DECIDED:
            continue
        sides = [j for j in (before[i], after[i]) if j >= 0]
        if b.label == "near" or not sides:
            b.label = "good"
            continue
        b.label = first[min(sides, key=lambda j: abs(i - j))]
        if b.label == "bad" and b.role != "text":
            b.label = "good"


def _paragraphs(text: str) -> tuple[list[int], list[Block]]:
    """A text as blocks, and where each starts: lines up to a blank one, or of program code. A line with a sign of markup that code lacks is not code."""
    starts, blocks, at, open_ = [], [], 0, ""
    for x in text.split("\n"):
        code = _CODE.search(x) and not ("`" in x or "](" in x or "}}" in x or "]]" in x or "{|" in x or "|}" in x)
        role = "" if not x or x.isspace() else "code" if code else "text"
        if role and role == open_:
            blocks[-1].text += "\n" + x
        elif role:
            starts.append(at)
            blocks.append(Block(x, role))
        open_ = role
        at += len(x) + 1
    return starts, blocks


class _Places:
    """Which blocks of one text are code or junk by their role and label, made when first asked for."""

    def __init__(self, text: str):
        self.text = text
        self.void: list[bool] | None = None

    def counts(self, at: int) -> bool:
        """Whether a sign at this offset counts: not in a block of code or one labelled junk."""
        if self.void is None:
            # formulas are no words, so they speak neither for nor against their block
            self.starts, blocks = _paragraphs(_MATH.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), self.text) if "$" in self.text or "\\" in self.text else self.text)
            label_blocks(blocks)
            self.void = [b.role == "code" or b.label == "junk" for b in blocks] or [False]
        return not self.void[max(0, bisect_right(self.starts, at) - 1)]

    def any(self, *patterns: re.Pattern) -> bool:
        """Whether a match of one of the patterns counts."""
        return any(self.counts(m.start()) for p in patterns for m in p.finditer(self.text))


def kinds(text: str) -> list[str]:
    """The kinds of markup that ``text`` holds any of, in the order of :data:`KINDS`.

    Signs are looked for by pattern; the blocks they stand in are labelled by :func:`label_blocks`, and a sign in a block of code or one labelled
    junk does not count. Markers of the parsers, plain bullets, numbers and ``#`` at the start of a line, and rows parted by bars are no signs.
    """
    if _CODE_FILE.match(text):
        return []
    out = []
    places = _Places(text)
    if "<" in text and places.any(_TAG, _COMMENT) or "&" in text and any((e[0][1] == "#" or e[0][1:] in html.entities.html5) and places.counts(e.start()) for e in _ENTITY.finditer(text)):
        out.append("html")
    fence = ("```" in text or "~~~" in text) and _FENCE.search(text)
    if fence or ("**" in text or "__" in text or "~~" in text or "`" in text or "](" in text or "--" in text or "]:" in text) and places.any(_MD):
        out.append("markdown")
    if ("[[" in text or "{{" in text or "==" in text or "{|" in text or "|}" in text or "''" in text or "://" in text or "<" in text) and places.any(_WIKI):
        out.append("wiki")
    if "\\" in text and places.any(_TEX, _MATH) or "$" in text and places.any(_MATH):
        out.append("latex")
    return out


_BLOCK_TAG = re.compile(r"<(/?)(p|div|h[1-6]|li|tr|td|th|br|hr|ul|ol|table|pre|blockquote|section|article|header|footer|nav|aside|dt|dd|title|caption|body|html|head|form|thead|tbody|figure|figcaption|main)\b[^<>]*>", re.I)
_DROP = re.compile(r"<(script|style|template|noscript)\b[^<>]*>.*?(?:</\1\s*>|$)", re.S | re.I)
_PRE = re.compile(r"<pre\b[^<>]*>(.*?)(?:</pre\s*>|$)", re.S | re.I)
_LINK = re.compile(r"<a\b[^<>]*>(.*?)</a\s*>", re.S | re.I)
#: Stand for the start and end of a link's text until blocks are made.
_L, _R = "\ue000", "\ue001"
_HOLD = re.compile("\ue002(\\d+)\ue003")


class _Kept:
    """Passages that later steps must not touch."""

    def __init__(self) -> None:
        self.items: list[tuple[str, str]] = []

    def hold(self, role: str, text: str) -> str:
        self.items.append((role, text))
        return f"\ue002{len(self.items) - 1}\ue003"


def _from_html(text: str, kept: _Kept) -> str:
    text = _DROP.sub("\n", _COMMENT.sub("", text))
    text = _PRE.sub(lambda m: "\n\n" + kept.hold("code", html.unescape(_TAG.sub("", m[1])).strip("\n")) + "\n\n", text)
    text = _LINK.sub(lambda m: _L + m[1] + _R, text)

    def block(m: re.Match) -> str:
        close, tag = m[1], m[2].lower()
        if tag in ("td", "th"):
            return " | " if close else ""
        if tag == "br":
            return "\n"
        if close:
            return "\n"
        return "\n" + ("#" * int(tag[1]) + " " if tag[0] == "h" and tag[1:].isdigit() else "- " if tag == "li" else "")

    text = _TAG.sub("", _BLOCK_TAG.sub(block, text))
    text = re.sub(r"(?: \| )+(?=\n|$)", "", text)
    return html.unescape(text).replace("\xa0", " ")


def _from_latex(text: str, kept: _Kept) -> str:
    text = re.sub(r"\\begin\{(equation|align|gather|displaymath|eqnarray|multline)\*?\}(.*?)\\end\{\1\*?\}", lambda m: "\n\n" + kept.hold("formula", "$$" + m[2].strip() + "$$") + "\n\n", text, flags=re.S)
    text = re.sub(r"\\begin\{(verbatim|lstlisting|minted)\*?\}(?:\[[^\]]*\])?(?:\{\w+\})?(.*?)\\end\{\1\*?\}", lambda m: "\n\n" + kept.hold("code", m[2].strip("\n")) + "\n\n", text, flags=re.S)
    text = _MATH.sub(lambda m: kept.hold("inline", m.group()), text)
    text = re.sub(r"\\(part|chapter|section|subsection|subsubsection|paragraph)\*?(?:\[[^\]]*\])?\{([^{}]*)\}", lambda m: "\n" + "#" * {"part": 1, "chapter": 1, "section": 2, "subsection": 3}.get(m[1], 4) + " " + m[2] + "\n", text)
    text = re.sub(r"\\item\b(?:\[[^\]]*\])?[ \t]*", "\n- ", text)
    text = re.sub(r"\\footnote\{([^{}]*)\}", r" (\1)", text)
    text = re.sub(r"[~ ]?\\(?:cite[pt]?|ref|eqref|pageref|label|includegraphics|bibliography|bibliographystyle|usepackage|documentclass|input|include|vspace|hspace)\*?(?:\[[^\]]*\])*\{[^{}]*\}", "", text)
    text = re.sub(r"\\href\{[^{}]*\}\{([^{}]*)\}", _L + r"\1" + _R, text)
    text = re.sub(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]]*\]|\{[^{}]*\})*", "\n", text)
    for _ in range(3):
        text = re.sub(r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?\{([^{}]*)\}", r"\1", text)
    text = re.sub(r"\{\\(?:bf|it|tt|sc|sf|rm|em|large|Large|small|tiny)\s+([^{}]*)\}", r"\1", text)
    text = re.sub(rf"\\(?:{'|'.join(_COMMANDS)})\*?(?![A-Za-z])[ ]?", "", text)
    return re.sub(r"\\([%&#_{}$])", r"\1", text).replace("~", " ").replace("\\\\\n", "\n")


def _from_wiki(text: str, kept: _Kept) -> str:
    text = re.sub(r"(?m)^[ \t]*(={2,6})[ \t]*([^=\s][^\n]*?)[ \t]*\1[ \t]*\r?$", lambda m: "#" * (len(m[1]) - 1) + " " + m[2], text)
    text = re.sub(r"(?is)<ref\b[^<>]*/>|<ref\b[^<>]*>.*?</ref>|</?(?:nowiki|references|gallery)\b[^<>]*>", "", text)
    more = 1
    while more:
        text, more = re.subn(r"\{\{[^{}]*\}\}", "", text)
    text = re.sub(r"\[\[(?:File|Image|Datei|Fichier|Archivo|Ficheiro|Файл|文件|Category|Kategorie|Catégorie|Categoría|Categoria|Категория|分类):[^\[\]]*?(?:\|([^\[\]|]*))?\]\]", lambda m: m[1] if m[1] and " " in m[1] else "", text, flags=re.I)
    text = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", _L + r"\1" + _R, text)
    text = re.sub(r"\[(?:https?|ftp)://[^\s\]]+(?: ([^\]\n]*))?\]", lambda m: _L + (m[1] or "") + _R, text)
    text = re.sub(r"'{2,5}", "", text) if "''" in text else text
    text = re.sub(r"(?m)^[ \t]*\{\|[^\n]*$|^[ \t]*\|\}[ \t]*\r?$|^[ \t]*\|-[^\n]*$|^[ \t]*\|\+[ \t]*", "", text)
    text = re.sub(r"(?m)^[ \t]*!([^\n]*)$", lambda m: m[1].replace("!!", "|").strip(), text)
    return re.sub(r"(?m)^[ \t]*\|(?!\|)([^\n|]*(?:\|\|[^\n]*)+)$", lambda m: m[1].replace("||", "|").strip(), text)


def _from_markdown(text: str, kept: _Kept) -> str:
    text = re.sub(r"!\[([^\[\]\n]*)\]\([^()\n]*\)", r"\1", text)
    text = re.sub(r"\[([^\[\]\n]*)\]\([^()\s]*(?:\([^()\s]*\))?[^()\n]*\)", _L + r"\1" + _R, text)
    text = re.sub(r"(?m)^[ ]{0,3}\[[^\]\n]+\]:[ \t]+\S+.*$", "", text)
    text = re.sub(r"(?m)^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*\r?$\n?", "", text)
    text = re.sub(r"(?<![`\\])`([^`\n]+)`(?!`)", lambda m: kept.hold("inline", m[1]), text)
    for mark in (r"\*\*", "__", "~~"):
        text = re.sub(rf"{mark}(?=\S)([^\n]+?)(?<=\S){mark}", r"\1", text)
    text = _EM.sub(lambda m: m.group()[1:-1], text)
    text = re.sub(r"(?m)^[ \t]*>[ ]?", "", text)
    return re.sub(r"(?m)^[ \t]*\|([^\n]*)\|[ \t]*\r?$", lambda m: m[1].strip(), text)


def clean(text: str, found: list[str]) -> tuple[str, int]:
    """Clean text, and how many blocks were dropped as boilerplate.

    Markup of the kinds ``found`` is resolved into blocks: headings become lines with ``#``, items lines with ``-``, code is
    fenced, formulas keep their signs, rows are parted by bars. Blocks are labelled by :func:`label_blocks`; bad ones are left out.
    """
    kept = _Kept()
    if "markdown" in found:
        text = _hold_fences(text, kept)
    for kind, step in (("html", _from_html), ("latex", _from_latex), ("wiki", _from_wiki), ("markdown", _from_markdown)):
        if kind in found:
            text = step(text, kept)
    blocks: list[Block] = []
    for line in text.split("\n"):
        whole = _HOLD.fullmatch(line.strip())
        if whole and kept.items[int(whole[1])][0] != "inline":
            role, held = kept.items[int(whole[1])]
            blocks.append(Block(f"```\n{held}\n```" if role == "code" else held, role))
            continue
        words = _HOLD.sub(" ", line) if "\ue002" in line else None
        line = _HOLD.sub(lambda m: kept.items[int(m[1])][1], line)
        linked = sum(len(x) for x in re.findall(f"{_L}([^{_R}]*){_R}", line))
        line = re.sub(r"[ \t]+", " ", line.replace(_L, "").replace(_R, "")).strip()
        if not line or line in ("-", "|"):
            continue
        role = "heading" if re.match(r"#{1,6} ", line) else "item" if re.match(r"[-*+•·–] |\(?\d{1,3}[.)] ", line) else "row" if " | " in line else "code" if _CODE.search(line) else "text"
        blocks.append(Block(line, role, linked, words=words))
    label_blocks(blocks)
    good = [b for b in blocks if b.label not in ("bad", "junk")]
    return "\n".join(b.text for b in good), len(blocks) - len(good)


def _hold_fences(text: str, kept: _Kept) -> str:
    out: list[str] = []
    body: list[str] | None = None
    mark = ""
    for line in text.split("\n"):
        m = _FENCE.match(line)
        if body is None and m:
            body, mark = [], m[1][:3]
        elif body is not None and m and m[1].startswith(mark):
            out.append(kept.hold("code", "\n".join(body)))
            body = None
        elif body is not None:
            body.append(line)
        else:
            out.append(line)
    if body is not None:  # the end is in another chunk
        out.append(kept.hold("code", "\n".join(body)))
    return "\n".join(out)


_SCHEMA = pa.schema([("id", pa.int64()), ("document_id", pa.int64()), ("markup", pa.list_(pa.string())), ("content", pa.string()), ("dropped", pa.int32())])


def _kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
            found = kinds(text)
            if found:
                rows.append((i, doc, found, *clean(text, found)))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_SCHEMA)], schema=_SCHEMA)


def cleaned(chunks: DataFrame) -> DataFrame:
    """The chunks that hold markup: ``id``, ``document_id``, ``markup`` (kinds), ``content`` (clean), ``dropped`` (blocks).

    Signs in code, and in blocks that the block rules label junk, are no markup (:func:`kinds`). NULL and empty texts have none. A row delivered twice comes out once. Only rows
    with a sign that markup needs reach Python; they are handled one by one, and only chunks with markup are shuffled.
    """
    signs = F.col("content").rlike(r"[<&`\\$]|\*\*|__|~~|\]\(|\[\[|\{[{|]|\|\}|==|''|://|-\||\]:")
    found = chunks.filter(signs).select("id", "document_id", "content").mapInArrow(_kernel, "id long, document_id long, markup array<string>, content string, dropped int")
    return found.dropDuplicates(["id"])
