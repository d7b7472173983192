"""Noise in text from scanned pages: cut words, misread characters, running titles, page numbers (problem 1)."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.vocabulary import BOUND, frequent, term_counts, words
from leafmill.session import cut, stored

#: A form this many times rarer than another of its skeleton is a misreading of it; so a word must stand this often to be meant by any.
RARER = 20
#: Bits of the table that tells which words may be among rival forms.
BITS = 1 << 20
#: Letters that a word must have to be meant if it is not frequent: shorter ones are too often met by chance.
RARE_LETTERS = 5
#: Places of a document whose titles are joined in one task.
SPAN = 4096

# Strokes that characters are made of, as far as recognisers confuse them. A character stands for
# its strokes, so that "m" and "rn", "d" and "cl", "u" and "ii" come out alike.
_STROKES = {
    "d": "cl", "e": "c", "h": "ll", "i": "l", "m": "rrl", "n": "rl", "q": "g", "u": "ll", "w": "vv", "y": "v",
    "@": "a", "0": "o", "1": "l", "|": "l", "!": "l", "+": "t", "5": "s", "$": "s", "9": "g", "(": "c", "6": "b", "8": "b", "2": "z",
    "а": "a", "е": "c", "ё": "c", "о": "o", "р": "p", "с": "c", "у": "v", "х": "x", "к": "k", "и": "rl", "й": "rl", "н": "п", "ы": "bl", "ь": "b", "з": "3", "ч": "4",
}
_TABLE = str.maketrans(_STROKES)
#: A six may also be a round letter with an accent.
_SIX = ("c", "o")


def bare(word: str) -> str:
    """``word`` without accents."""
    return word if word.isascii() else "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def skeleton(word: str) -> str:
    """The strokes of a word in lower case, accents aside."""
    return bare(word.replace("й", "и").replace("ё", "е")).translate(_TABLE)


# Words, misread ones included; signs that recognisers put for letters belong to them.
_TOKEN = re.compile(r"[^\W_]+(?:[@+(|!$][^\W_]+|[@+|$](?![^\W_]))*|[@(+$][^\W\d_][^\W_]*(?:[@+(|!$][^\W_]+)*")
_LETTERS = re.compile(r"[^\W\d_]")
_HAN = re.compile(r"[㐀-鿿豈-﫿]")
_ODD = re.compile(r"[@+(|!$\d]|[a-z][а-яё]|[а-яё][a-z]")
_CODE = re.compile(r"^\s*(?:def|for|if|while|return|assert|class|import)\b|^\s*[\w.\[\]]+ ?[-+*/]?= ?\S|[;{}]\s*$|->|==|&&|\|\|")
_CUT = re.compile(r"([^\W\d_]{1,40})([-‐¬\xad])[ \t\r]*$")
_HYPHENS = ("-", "‐", "¬", "\xad")
_HEAD = re.compile(r"[ \t]*([^\W\d_]{1,40})")

_WORDS = r"(?:pages?|pag[.]?|pg[.]?|p[.]|seite|s[.]|página|pagina|pág[.]?|стр[.]?|страница|с[.])"
_NUMBER = r"(?:\d{1,4}|[ivxlc]{1,7}|[IVXLC]{1,7})"
_OF = r"(?:\s*(?:/|of|von|sur|de|из)\s*\d{1,4})"
_PAGE = rf"(?:(?i:{_WORDS})\s*{_NUMBER}{_OF}?|[-–—·•~*|]+\s*{_NUMBER}{_OF}?\s*[-–—·•~*|]+|\[\s*{_NUMBER}\s*\]|\d{{1,4}}{_OF}|第\s*\d{{1,4}}\s*页(?:[\s,，/]*共\s*\d{{1,4}}\s*页)?)"
_ALONE = re.compile(rf"\s*{_PAGE}\s*$")
_BARE = re.compile(r"\s*(?:\d{1,3}|[ivxlc]{1,7})\s*$")
_BEFORE = re.compile(rf"\s*({_PAGE}|{_NUMBER})(?:\s{{3,}}|\t)\s*(\S.*\S)\s*$")
_AFTER = re.compile(rf"\s*(\S.*\S)(?:\s{{3,}}|\t)\s*({_PAGE}|{_NUMBER})\s*$")
_MARKER = re.compile(r"\s*\[(?:第|表|工作表|代码文件|表头)[^\]]*\]")
_NOT_TITLE = re.compile(r"[|<>{}\\#*=\[\]`~_]|[.!?:;,。，！？：；、…]\s*$|[.!?,;。，；！？]\s|^\s*(?:[-+•·–◦▪☐☑]|\(?\d+[.)]|[a-z]\))\s")
_YEAR = re.compile(r"(?:1[89]|20)[\dOolI]{2}$")
_GAP = re.compile(r"\S {3,}\S")

TEXT, BLANK, PAGE, TITLE, BOTH, MARK = "text", "blank", "page", "title", "both", "marker"


def titled(line: str) -> bool:
    """Whether a line could be a title: short, without sentence marks or markup, and ending like a name."""
    s = line.strip()
    if not 4 <= len(s) <= 80 or _NOT_TITLE.search(s):
        return False
    if _HAN.search(s):
        return len(s) <= 30
    words = s.split()
    last = words[-1]
    return len(words) <= 10 and s[0].isupper() and (s.isupper() or last[0].isupper() or bool(_YEAR.match(last)) or (last[0].isdigit() and len(words) > 2 and words[-2][0].isupper()))


def masked(title: str) -> str:
    """A title with digits masked and misreadings levelled, so that its repeats on other pages are equal."""
    return " ".join(skeleton(re.sub(r"\d+", "#", w.lower()) if w.isdigit() else w.lower()) for w in title.split())


class Reader:
    """Finds and repairs the noise of one text, given the frequent words of the corpus.

    ``counts`` has the frequent terms; ``contexts`` how often a word that shares its skeleton with another frequent one stands
    after or before a neighbour (``"left word"``, ``"word right"``).

    With ``shared``, the skeletons that frequent words share with established rarer ones, the frequent terms are taken for a part of the corpus only: what they do
    not decide is left in :attr:`open` (words with neighbours and place) and :attr:`cuts` (words that line ends may cut), to be looked up in the
    counts of all words (:func:`resolve`).
    """

    def __init__(self, counts: dict[str, int], contexts: dict[str, int] | None = None, shared: frozenset[str] | None = None):
        self.shared = shared
        #: Of the text read last: word, left and right neighbour, line, offset and length in the line, how it is written.
        self.open: list[tuple[str, str, str, int, int, int, str]] = []
        self.cuts: list[str] = []
        self.counts = {w: n for w, n in counts.items() if len(w) > 1 and w.isalpha() and not _HAN.search(w)}
        self.contexts = contexts or {}
        self.groups: dict[str, list[str]] = {}
        for w in sorted(self.counts, key=lambda w: (-self.counts[w], w)):
            self.groups.setdefault(skeleton(w), []).append(w)
        # forms that are themselves misreadings of a far more frequent one are no targets
        for s, forms in self.groups.items():
            if len(forms) > 1:
                top = self.counts[forms[0]]
                self.groups[s] = [f for f in forms if self.counts[f] * RARER > top]
        self.known: dict[str, str | None] = {}
        self.fine = {f for forms in self.groups.values() for f in forms}

    def sound(self, word: str) -> bool:
        """Whether a word in lower case is a frequent form that no far more frequent one explains."""
        return word in self.fine

    def rivals(self) -> set[str]:
        """Forms that share their skeleton with another frequent form, so that only context can tell them apart."""
        return {w for forms in self.groups.values() if len(forms) > 1 for w in forms}

    def forms(self, word: str) -> list[str]:
        """Frequent forms that ``word`` may be a misreading of, most frequent first."""
        out = self.groups.get(skeleton(word), [])
        if "6" in word and not out:
            for c in _SIX:
                out = out or self.groups.get(skeleton(word.replace("6", c)), [])
        return out

    def correct(self, word: str, left: str, right: str) -> str | None:
        """The form meant by a misread ``word`` (lower case), None if it is sound or nothing explains it, empty if the frequent terms do not decide.

        Candidates share the skeleton. Words of letters alone need four letters and, if the corpus has them, to be far rarer
        than the form meant. Several candidates are ordered by how often they stand between these neighbours.
        """
        got = self.known.get(word, word)
        if got is not word:
            if not got or len(self.groups.get(skeleton(got), ())) < 2:
                return got
        letters = len(_LETTERS.findall(word))
        odd = _ODD.search(word)
        forms: list[str] = []
        if letters >= (2 if odd else 4) and letters * 2 >= len(word) and not self.sound(word) and (not word.isdigit()):
            own = self.counts.get(word, 0)
            forms = [f for f in self.forms(word) if f != word and own * RARER <= self.counts[f]]
            if self.shared is not None and (len(forms) != 1 or skeleton(word) in self.shared):
                self._keep(word, "")
                return ""
        if not forms:
            self._keep(word, None)
            return None
        if len(forms) > 1:
            support = lambda f: self.contexts.get(f"{left} {f}", 0) + self.contexts.get(f"{f} {right}", 0)
            forms = sorted(forms, key=lambda f: (-support(f), sum(a != b for a, b in zip(f, word)) + abs(len(f) - len(word)), -self.counts[f]))
        self._keep(word, forms[0])
        return forms[0]

    def _keep(self, word: str, form: str | None) -> None:
        if len(self.known) > 300_000:
            self.known.clear()
        self.known[word] = form

    def joined(self, a: str, sign: str, b: str) -> bool:
        """Whether ``a`` + ``b`` is one word cut at a line end, rather than a compound written with a hyphen."""
        if sign != "-":
            return True
        a, b = a.lower(), b.lower()
        if self.sound(a + b) or self.forms(a + b):
            return True
        two = len(a) > 2 and len(b) > 2 and self.sound(a) and self.sound(b)
        if two and self.shared is not None:
            self.cuts.append(a + b)
        return not two

    def read(self, text: str, repair: bool = False):
        """``(hyphen, glyph, page_number, titles, lines)`` of a text.

        ``titles`` lists candidates for running titles: masked form, line number, whether a page number stands beside it
        or in it, whether it opens the page. ``lines`` (with ``repair``) has number, text and kind of each line, misread
        words put right; hyphens are left to the reflow.
        """
        self.open, self.cuts = [], []
        lines = text.split("\n")
        kinds = [BLANK if not x.strip() else MARK if _MARKER.match(x) else TEXT for x in lines]
        page = False
        titles: list[tuple[str, int, bool, bool]] = []
        beside = self._with_number(lines) if "   " in text or "\t" in text else {}
        for i, x in enumerate(lines):
            if kinds[i] != TEXT or len(x) > 100:
                continue
            if _ALONE.match(x) or _BARE.match(x) and self._lonely(lines, i):
                kinds[i], page = PAGE, True
        for i, x in enumerate(lines):
            if kinds[i] != TEXT or len(x) > 110:
                continue
            if i in beside:
                kinds[i], page = BOTH, True
                titles.append((beside[i], i, True, True))
                continue
            if titled(x) and len(lines) > 1:
                before, after = self._beside(kinds, i, -1), self._beside(kinds, i, 1)
                sure = before in (PAGE, BOTH) or after in (PAGE, BOTH) and before == ""
                top = before in ("", PAGE, BOTH)
                follow = lines[i + 1].lstrip()[:1] if i + 1 < len(lines) else ""
                wide = bool(_HAN.search(x)) and len(x.strip()) * 1.4 < max(map(len, lines))
                if sure or wide or x.strip().isupper() or not follow or follow.isupper() or not follow.isalpha():
                    # a line as wide as the column is running text that happens to end in a name
                    narrow = wide or not _HAN.search(x) and (x.strip().isupper() or len(x.strip()) <= 0.8 * max(map(len, lines)))
                    titles.append((masked(x), i, sure, top and narrow and bool(follow)))
        hyphen = False
        for i, x in enumerate(lines):
            if kinds[i] == TEXT and x.rstrip()[-1:] in _HYPHENS and (m := _CUT.search(x)) and not _CODE.search(x):
                j = i + 1
                while j < len(lines) and (kinds[j] in (BLANK, PAGE, BOTH, MARK) or any(t[1] == j for t in titles)):
                    j += 1
                if j >= len(lines):
                    hyphen |= m[2] != "-" or not self.sound(m[1].lower())
                elif h := _HEAD.match(lines[j]):
                    if (h[1][0].islower() or m[1].isupper()) and self.joined(m[1], m[2], h[1]):
                        hyphen = True
        glyph, out = self._misread(lines, kinds, repair)
        return hyphen, glyph, page, titles, [(i, out[i], kinds[i]) for i in range(len(lines))] if repair else None

    @staticmethod
    def _with_number(lines: list[str]) -> dict[int, str]:
        """Lines that hold a title and a page number, with the masked title.

        Rows of a table look the same. Where more than a few lines have gaps, a line with another such line next to it is a row, unless
        that one has the same title, or its own title stands alone with a number elsewhere too and the other side is free.
        """
        found: dict[int, str] = {}
        for i, x in enumerate(lines):
            if len(x) <= 110 and ("   " in x or "\t" in x) and not _MARKER.match(x) and (both := _BEFORE.match(x) or _AFTER.match(x)):
                a, b = both.groups()
                title = b if both.re is _BEFORE else a
                if titled(title):
                    found[i] = masked(title)
        if not found or sum(1 for x in lines if "   " in x and _GAP.search(x.strip())) <= 3:
            return found
        filled = [i for i, x in enumerate(lines) if x.strip()]
        at = {i: k for k, i in enumerate(filled)}

        def rows(i: int) -> int:
            near = (filled[k] for k in (at[i] - 1, at[i] + 1) if 0 <= k < len(filled))
            return sum(1 for j in near if found.get(j) != found[i] and (_GAP.search(lines[j].strip()) or "\t" in lines[j].strip()))

        touching = {i: rows(i) for i in found}
        free = {t for i, t in found.items() if not touching[i]}
        return {i: t for i, t in found.items() if not touching[i] or touching[i] == 1 and t in free}

    @staticmethod
    def _beside(kinds: list[str], i: int, step: int) -> str:
        i += step
        while 0 <= i < len(kinds) and kinds[i] in (BLANK, MARK):
            i += step
        return kinds[i] if 0 <= i < len(kinds) else ""

    @staticmethod
    def _lonely(lines: list[str], i: int) -> bool:
        """A bare number is a page number unless lines beside it are numbers, rows or list items."""
        for j in (i - 1, i + 1):
            if 0 <= j < len(lines):
                s = lines[j].strip()
                if _BARE.match(s) and s or "|" in s or "\t" in s or re.match(r"[-*+•·]\s|\(?\d+[.)]\s", s):
                    return False
        return True

    def _misread(self, lines: list[str], kinds: list[str], repair: bool) -> tuple[bool, list[str]]:
        fine, known, glyph, out = self.fine, self.known, False, lines
        if repair:
            out = list(lines)
        for i, x in enumerate(lines):
            if kinds[i] in (BLANK, PAGE, MARK):
                continue
            low = _TOKEN.findall(x.lower())
            # most words are sound, and most others have been looked at before
            open_ = [k for k, w in enumerate(low) if w not in fine and len(w) > 2 and w[0] < "㐀" and known.get(w, w) is not None]
            if not open_:
                continue
            # as they are written, where that is asked for
            as_is = _TOKEN.findall(x) if repair or any(not low[k].isalpha() for k in open_) else low
            if len(as_is) != len(low):
                continue
            fixes: list[str | None] | None = None
            left_open: list[int] = []
            code = None
            for k in open_:
                w = low[k]
                if w.isdigit() or _HAN.search(w):
                    continue
                if as_is[k].isupper() and sum(c.isdigit() for c in w) * 3 > len(w):
                    continue  # a code such as G11E
                form = self.correct(w, low[k - 1] if k else "", low[k + 1] if k + 1 < len(low) else "")
                if form is None:
                    continue
                if code is None:
                    code = bool(_CODE.search(x))
                if code:
                    break
                half = k + 1 == len(low) and _CUT.search(x)
                if not form:
                    if not half:
                        left_open.append(k)
                    continue
                if not (bare(form) == bare(w) or half):
                    glyph = True
                    if not repair:
                        self.open = []
                        return True, out
                if repair:
                    fixes = fixes or [None] * len(low)
                    fixes[k] = _cased(form, as_is[k])
            if left_open:
                places = _places(x, fixes) if repair else None
                for k in left_open:
                    at, size = places[k] if places else (0, 0)
                    self.open.append((low[k], low[k - 1] if k else "", low[k + 1] if k + 1 < len(low) else "", i, at, size, _case(as_is[k]) if repair else ""))
            if fixes:
                it = iter(fixes)
                out[i] = _TOKEN.sub(lambda m: f if (f := next(it)) else m.group(), x)  # noqa: B023
        return glyph, out


def _places(line: str, fixes: list[str | None] | None) -> list[tuple[int, int]]:
    """Offset and length of each word of a line once ``fixes`` are put in."""
    out, moved = [], 0
    for k, m in enumerate(_TOKEN.finditer(line)):
        new = fixes[k] if fixes else None
        size = len(new or m.group())
        out.append((m.start() + moved, size))
        moved += size - (m.end() - m.start())
    return out


def _case(like: str) -> str:
    """``U`` for a word mostly in capitals, ``T`` for one that starts with one, else empty."""
    letters = [c for c in like if c.isalpha()]
    if len(letters) > 1 and sum(c.isupper() for c in letters) * 2 > len(letters):
        return "U"
    return "T" if letters and letters[0].isupper() and like[0].isalpha() else ""


def _cased(form: str, like: str) -> str:
    case = _case(like)
    return form.upper() if case == "U" else form[0].upper() + form[1:] if case else form


def _skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column(0).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array(list(map(skeleton, words)), pa.string()), *batch.columns, pa.array(list(map(bare, words)), pa.string())], names=["skeleton", "word", "n", "bare"])


def _readings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The skeletons that a word may have been read from, best first: its own, and where it has a six those with a round letter."""
    for batch in batches:
        rows = []
        for w in batch.column(0).to_pylist():
            own = [skeleton(w)] + [skeleton(w.replace("6", c)) for c in _SIX if "6" in w]
            rows += [(w, k, x, bare(w)) for k, x in enumerate(own)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.string()))], names=["word", "place", "skeleton", "bare"])


def established(counts: DataFrame) -> DataFrame:
    """The forms that misreadings may stand for, by skeleton: ``skeleton``, ``forms`` (``n``, ``word``, ``bare``).

    These are all words of the corpus that stand :data:`RARER` times or more and are not themselves as many times rarer than another of their skeleton.
    """
    words = counts.filter((F.col("n") >= RARER) & F.col("word").rlike(r"^[\p{L}&&[^\x{3400}-\x{9fff}]]{2,}$")).select("word", "n")
    groups = words.mapInArrow(_skeletons, "skeleton string, word string, n long, bare string").groupBy("skeleton").agg(F.max("n").alias("top"), F.collect_list(F.struct("n", "word", "bare")).alias("forms"))
    return groups.select("skeleton", F.filter("forms", lambda f: f["n"] * RARER > F.col("top")).alias("forms"))


_PLAIN = re.compile(r"[^\W\d_]+")


def rival_contexts(chunks: DataFrame, rivals: DataFrame) -> DataFrame:
    """How often the words of ``rivals`` (``word``) stand beside each neighbour, over all chunks: ``word`` ("left right"), ``n``.

    The tasks get a table of :data:`BITS` bits in which the rivals' places are set, whatever their number; pairs of words that only share a place are counted in vain.
    """
    bits = bytearray(BITS // 8)
    for r in rivals.select(F.pmod(F.crc32("word"), F.lit(BITS)).alias("b")).distinct().collect():  # at most BITS rows
        bits[r.b >> 3] |= 1 << (r.b & 7)
    table = bytes(bits)
    seen: set[str] = set()
    marked: set[str] = set()

    def pairs(text: str) -> list[str]:
        found = _PLAIN.findall(text.lower())
        distinct = set(found)
        for w in distinct - seen:
            place = zlib.crc32(w.encode()) % BITS
            if table[place >> 3] >> (place & 7) & 1:
                marked.add(w)
        seen.update(distinct)
        if len(seen) > 300_000:
            seen.clear()
        if marked.isdisjoint(distinct):
            return []
        return [f"{a} {b}" for a, b in zip(found, found[1:]) if a in marked or b in marked]

    return term_counts(chunks, "content", pairs)


def resolve(asked: DataFrame, counts: DataFrame, forms: DataFrame, chunks: DataFrame, often: int = RARER) -> DataFrame:
    """The form meant by each misread word of ``asked`` (``word``, ``left``, ``right``): those columns, ``form``, ``changed`` (accents aside).

    Candidates are the established forms of the word's skeleton (``forms``) that it is :data:`RARER` times rarer than, those of fewer than
    :data:`RARE_LETTERS` letters only if they stand ``often`` times. Where there are several, the one that
    stands most often between these neighbours is meant, then the one that differs least, then the most frequent. Words are joined by their
    skeleton; only if any has rivals the neighbours are counted.
    """
    asked = asked.distinct()
    words = asked.select("word").distinct().mapInArrow(_readings, "word string, place int, skeleton string, bare string")
    own = counts.select("word", F.col("n").alias("own"))
    fits = words.join(forms, "skeleton").join(own, "word", "left").withColumn("forms", F.filter("forms", lambda f: (f["word"] != F.col("word")) & (F.coalesce("own", F.lit(0)) * RARER <= f["n"]) & ((f["n"] >= often) | (F.length(f["word"]) >= RARE_LETTERS))))
    best = cut(fits.filter(F.size("forms") > 0).groupBy("word").agg(F.min_by(F.struct("bare", "forms"), "place").alias("b")).select("word", "b.*"))
    form = lambda f: [f["word"].alias("form"), (f["bare"] != F.col("bare")).alias("changed")]
    one = asked.join(best.filter(F.size("forms") == 1), "word").select("word", "left", "right", *form(F.get("forms", F.lit(0))))
    rival = best.filter(F.size("forms") > 1)
    if rival.isEmpty():
        return one
    each = asked.join(rival, "word").select("word", "left", "right", "bare", F.explode("forms").alias("f"))
    pairs = rival_contexts(chunks, rival.select(F.explode("forms.word").alias("word")))
    for side, key in (("_l", F.concat_ws(" ", "left", "f.word")), ("_r", F.concat_ws(" ", "f.word", "right"))):
        each = each.withColumn("_key", key).join(pairs.select(F.col("word").alias("_key"), F.col("n").alias(side)), "_key", "left").drop("_key")
    rank = F.struct(F.coalesce("_l", F.lit(0)) + F.coalesce("_r", F.lit(0)), -F.levenshtein("f.word", "word"), F.col("f.n"), F.col("f.word"))
    chosen = each.groupBy("word", "left", "right").agg(F.max_by(F.struct("f", "bare"), rank).alias("c")).select("word", "left", "right", "c.*")
    return one.unionByName(chosen.select("word", "left", "right", *form(F.col("f"))))


_TITLE = pa.struct([("masked", pa.string()), ("line", pa.int32()), ("sure", pa.bool_()), ("top", pa.bool_())])
_LINE = pa.struct([("no", pa.int32()), ("text", pa.string()), ("kind", pa.string())])
_OPEN = pa.struct([("word", pa.string()), ("left", pa.string()), ("right", pa.string()), ("line", pa.int32()), ("at", pa.int32()), ("size", pa.int32()), ("case", pa.string())])
_SCHEMA = [
    ("id", pa.int64()), ("document_id", pa.int64()), ("chunk_index", pa.int32()), ("hyphen", pa.bool_()), ("glyph", pa.bool_()), ("page_number", pa.bool_()),
    ("titles", pa.list_(_TITLE)), ("lines", pa.list_(_LINE)), ("open", pa.list_(_OPEN)), ("cuts", pa.list_(pa.string())),
]
_DDL = (
    "id long, document_id long, chunk_index int, hyphen boolean, glyph boolean, page_number boolean, "
    "titles array<struct<masked: string, line: int, sure: boolean, top: boolean>>, lines array<struct<no: int, text: string, kind: string>>, "
    "open array<struct<word: string, left: string, right: string, line: int, at: int, size: int, case: string>>, cuts array<string>"
)


def _records(rows: list[tuple], names: tuple[str, ...]) -> list[dict]:
    return [dict(zip(names, r)) for r in rows]


def _kernel(counts: dict[str, int], shared: frozenset[str], repair: bool):
    schema = pa.schema(_SCHEMA)
    names = [tuple(f.name for f in kind) for kind in (_TITLE, _LINE, _OPEN)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(counts, shared=shared)
        for batch in batches:
            rows = []
            for i, doc, index, text in zip(*(c.to_pylist() for c in batch.columns)):
                hyphen, glyph, page, titles, lines = reader.read(text, repair)
                open_ = reader.open if repair else [(*o, 0, 0, 0, "") for o in {o[:3] for o in reader.open}]
                rows.append((i, doc, index, hyphen, glyph, page, _records(titles, names[0]), lines and _records(lines, names[1]), _records(open_, names[2]), [] if hyphen else reader.cuts))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return run


def read_chunks(chunks: DataFrame, repair: bool = False, bound: int = BOUND) -> tuple[DataFrame, DataFrame]:
    """What :meth:`Reader.read` finds in every chunk, and the form meant by each misread word of ``open`` (:func:`resolve`).

    Words are counted over all chunks. The frequent ones (1 / ``bound`` of all words or more, hence at most ``bound``) are sent to the tasks, which so decide most words on the spot;
    all others are looked up among all words of the corpus by joins. ``bound`` sets what is decided where, not the result.
    """
    used = chunks.filter("content IS NOT NULL AND content <> ''").select("id", "document_id", "chunk_index", "content")
    counts = cut(term_counts(chunks, "content", words))
    common = {r.word: r.n for r in frequent(counts, bound).collect()}
    forms = cut(established(counts))
    least = min(common.values(), default=0)
    # skeletons of frequent words, so there are at most as many
    mixed = forms.filter(F.exists("forms", lambda f: f["n"] >= least) & F.exists("forms", lambda f: f["n"] < least)).select("skeleton").collect()
    found = used.mapInArrow(_kernel(common, frozenset(r.skeleton for r in mixed), repair), _DDL)
    # with its lines a row is as wide as its text
    read = stored(found) if repair else cut(found)
    asked = read.select(F.explode("open").alias("o")).select("o.word", "o.left", "o.right")
    meant = cut(resolve(asked, counts, forms, chunks, least))
    changed = read.select("id", F.explode("open").alias("o")).select("id", "o.word", "o.left", "o.right").join(meant.filter("changed").select("word", "left", "right"), ["word", "left", "right"], "left_semi").select("id", F.lit("g").alias("kind"))
    whole = forms.select(F.explode("forms.word").alias("word"))
    joined = read.select("id", F.explode("cuts").alias("word")).join(whole, "word", "left_semi").select("id", F.lit("h").alias("kind"))
    more = changed.unionByName(joined).groupBy(F.col("id").alias("_id")).agg(F.bool_or(F.col("kind") == "g").alias("_g"), F.bool_or(F.col("kind") == "h").alias("_h"))
    flagged = read.join(more, F.col("id").eqNullSafe(F.col("_id")), "left")
    return flagged.withColumns({"glyph": F.col("glyph") | F.coalesce("_g", F.lit(False)), "hyphen": F.col("hyphen") | F.coalesce("_h", F.lit(False))}).drop("_id", "_g", "_h", "cuts"), meant


def running_titles(read: DataFrame, least_share: float = 0.3) -> DataFrame:
    """The titles among the candidates that are running ones: ``id``, ``line``.

    Running is a title that stands beside a page number; that stands in several places of its document, opening the page in one at
    least; or that opens a page of a chunk with other scanning defects, or of a document of which ``least_share`` of the chunks have some. Candidates
    are grouped by document and masked form; groups are aggregated, never collected.
    """
    noisy = F.col("hyphen") | F.col("glyph") | F.col("page_number")
    # a document is joined in spans of places, so that one with a third of all chunks is spread over many tasks
    span = F.floor(F.coalesce("chunk_index", F.lit(0)) / SPAN)
    each = read.select("id", "document_id", "chunk_index", noisy.alias("noisy"), span.alias("span"), F.explode("titles").alias("t")).select("id", "document_id", "chunk_index", "noisy", "span", "t.*")
    spans = F.sequence(F.min("span"), F.max("span"))
    groups = each.groupBy("document_id", "masked").agg((F.min("chunk_index") < F.max("chunk_index")).alias("again"), F.max("top").alias("opens"), F.max("sure").alias("known"), spans.alias("_s"))
    documents = read.withColumn("span", span).groupBy("document_id").agg(F.avg(noisy.cast("int")).alias("share"), spans.alias("_s"))
    g = groups.withColumn("_s", F.explode("_s")).withColumnsRenamed({"document_id": "_d", "masked": "_m"})
    d = documents.withColumn("_s2", F.explode("_s")).drop("_s").withColumnsRenamed({"document_id": "_d2"})
    joined = each.join(g, F.col("document_id").eqNullSafe(F.col("_d")) & (F.col("masked") == F.col("_m")) & (F.col("span") == F.col("_s"))).join(d, F.col("document_id").eqNullSafe(F.col("_d2")) & (F.col("span") == F.col("_s2")))
    running = F.col("sure") | (F.col("again") & (F.col("opens") | F.col("known"))) | (F.col("top") & (F.col("noisy") | (F.col("share") >= least_share)))
    return joined.filter(running).select("id", "line")


def defects(chunks: DataFrame, bound: int = BOUND) -> DataFrame:
    """One row for each chunk and each kind of noise it holds: ``id``, ``defect``.

    Kinds are ``hyphen``, ``glyph``, ``header`` and ``page_number``. NULL and empty texts have none; a row delivered
    twice counts once, a chunk stored under two ids under each.
    """
    # flags and title candidates only; written once, since titles are grouped, joined and counted from it
    read = cut(read_chunks(chunks, bound=bound)[0].drop("lines", "open"))
    titled_ids = running_titles(read).select("id", F.lit("header").alias("defect"))
    kinds = F.array(*[F.when(F.col(k), F.lit(k)) for k in ("hyphen", "glyph", "page_number")])
    other = read.select("id", F.explode(F.array_compact(kinds)).alias("defect"))
    return other.unionByName(titled_ids).distinct()


def repaired(chunks: DataFrame, bound: int = BOUND) -> DataFrame:
    """Continuous readable paragraphs of every chunk: ``id``, ``content``.

    Running titles and page numbers are taken out, misread words put right, cut words joined, and lines
    reflowed by windows over the lines of a chunk: a line continues the paragraph unless a blank line or marker parts them, it opens a list
    item or row, or the line before ends a sentence clearly short of the chunk's widest line. NULL and empty content comes back empty.
    Rows without ``id`` come out once for each text.
    """
    # rows without an id are told apart by their text
    own = F.coalesce("id", F.xxhash64("content"))
    read, meant = read_chunks(chunks.withColumn("id", own), repair=True, bound=bound)
    written = F.when(F.col("case") == "U", F.upper("form")).when(F.col("case") == "T", F.concat(F.upper(F.substring("form", 1, 1)), F.expr("substring(form, 2)"))).otherwise(F.col("form"))
    fixed = read.select("id", F.explode("open").alias("o")).select("id", "o.*").join(meant.filter("changed").select("word", "left", "right", "form"), ["word", "left", "right"])
    fixes = fixed.groupBy("id").agg(F.array_sort(F.collect_set(F.struct((-F.col("at")).alias("back"), "line", "size", written.alias("form")))).alias("fixes"))
    gone = running_titles(cut(read.drop("lines", "open"))).groupBy("id").agg(F.collect_set("line").alias("gone"))
    # texts are shuffled by id once; all that follows keeps to that
    once = read.select("id", "lines").dropDuplicates(["id"]).join(fixes, "id", "left").join(gone, "id", "left")
    none = F.array().cast("array<int>")
    kept = F.filter("lines", lambda x: ~x["kind"].isin(PAGE, BOTH) & ~F.array_contains(F.coalesce("gone", none), x["no"]))
    each = once.select("id", "fixes", F.explode(kept).alias("l"))
    # from the end of the line, so that offsets before it stay right
    put = F.aggregate(F.filter("fixes", lambda f: f["line"] == F.col("l.no")), F.col("l.text"), lambda t, f: F.overlay(t, f["form"], 1 - f["back"], f["size"]))
    kept = each.select("id", F.col("l.no").alias("no"), F.rtrim(F.when(F.col("fixes").isNull(), F.col("l.text")).otherwise(put)).alias("text"), F.col("l.kind").alias("kind"))
    by = Window.partitionBy("id").orderBy("no")
    whole = Window.partitionBy("id")
    kept = kept.withColumns({"before": F.lag("text").over(by), "kind_before": F.lag("kind").over(by), "widest": F.max(F.length("text")).over(whole)})
    item = F.col("text").rlike(r"^\s*(?:[-*+•·–#|]|\(?\d{1,3}[.)]|[a-z]\))\s|\||^\s*<|^\t| {3,}\S")
    ended = F.col("before").rlike(r"[.!?:。！？：…][\"”’»)]*$") & (F.length("before") < F.col("widest") * 0.8)
    # cut words go on without a blank, and so does Chinese text
    cut_word = F.col("before").rlike(r"[\p{L}][-‐¬\x{ad}]$") & F.col("text").rlike(r"^\s*\p{Ll}")
    parted = F.col("before").isNull() | (F.col("kind") != TEXT) | (F.col("kind_before") != TEXT) | item | (F.col("before").rlike(r"\|| {3,}\S|^\s*(?:[-*+•·#])\s") & ~cut_word) | (ended & ~cut_word)
    glue = F.when(cut_word, "").when(F.col("before").rlike(r"[\x{3000}-\x{9fff}\x{ff00}-\x{ffef}]$") | F.col("text").rlike(r"^[\x{3000}-\x{9fff}\x{ff00}-\x{ffef}]"), "").otherwise(" ")
    after = Window.partitionBy("id").orderBy("no")
    kept = kept.withColumns({"parted": parted.cast("int"), "glue": glue, "cut_word": cut_word})
    kept = kept.withColumn("cut_next", F.coalesce(F.lead("cut_word").over(after) & (F.lead("parted").over(after) == 0), F.lit(False)))
    body = F.when(F.col("cut_next"), F.regexp_replace("text", r"[-‐¬\x{ad}]$", "")).otherwise(F.col("text"))
    # a line that opens a paragraph brings the line end before it
    kept = kept.withColumn("part", F.when(F.col("parted") == 0, F.concat("glue", F.ltrim(body))).otherwise(F.concat(F.lit("\n"), body)))
    parts = F.array_sort(F.collect_list(F.struct("no", "part")))
    done = kept.filter("kind <> 'blank'").groupBy("id").agg(F.array_join(F.transform(parts, lambda x: x["part"]), "").alias("_c")).select("id", F.expr("substring(_c, 2)").alias("content"))
    every = chunks.select(F.col("id").alias("_own"), own.alias("id")).distinct()
    return every.join(done, "id", "left").select(F.col("_own").alias("id"), F.coalesce("content", F.lit("")).alias("content"))
