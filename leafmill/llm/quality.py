"""Per-document text statistics and the kind of text they tell (problem 7)."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.rules import parse, to_sql

MODEL = Path(__file__).with_name("quality_rules.json")

# Common words of the seven languages, as known from public frequency lists.
COMMON = tuple(
    """
    the of and to a in is that it for was on are as with they be at this have from or had by not but what all were when we there can an your which
    their if will how about out up has more her his our no been than its who did may so after before because without since under
    der die das den dem des ein eine einer eines einem einen und ist im in zu von mit für auf nicht auch als an am bei nach aus um wie oder wenn dass
    wird werden war hat sich es sie er wir ihr noch nur vor durch über unter zum zur falls weil bis keine ohne seit sofern
    le la les l d un une des du de et est en dans que qui pour pas par sur au aux avec plus ce cette ses son sa il elle nous vous ils se ne ou mais
    si sans sous selon afin entre depuis avant après chez jusque été
    el los las una unos unas del al y es en que por para con no se su sus lo como más o pero sin sobre este esta ya hasta desde según aunque
    antes tras ha han fue son está junto ni entre cuando
    o os as um uma uns umas do da dos das no na nos nas ao aos à às e é em que por para com não se seu sua seus mais mas sem sobre como já até
    desde segundo embora antes após foi está ou entre pelo pela junto
    и в во не на что с со по как из у за от к о для это но так же при до если был была было были его её их мы вы они он она или без под об все чтобы
    который которая потому хотя после перед только уже
    """.split()
)
#: Chinese has no blanks; these characters are its most common function words.
COMMON_HAN = "的了在是和有不这为与之以于而中上下里被把就也都并因"

_HAN = r"[\x{3400}-\x{9fff}]"
_MARKER = r"(?md)^\[(?:第|表|工作表|代码文件|Sheet)[^\]\n]*\]|^\[表头\]"


_VOWELS = "aeiouyäöüáéíóúàèìòùâêîôûãõœаеёиоуыэюя"
_MARK = r"(?md)^\s*(?:[-*+•·–◦▪☐☑✓]|\[[ x]\]|\(?\d{1,3}[.)]|[a-z]\))\s.*$"
_ROW = r"(?md)^(?:[^\n|\t;]*+(?:[|\t]|;(?=\S))){2}.*$|^ ?\S.*? {3,}\S.*$|^[^\n,]+,[^ \n,][^\n,]*,[^ \n,][^\n]*$"
_CODE = (
    r"(?md)^\s*(?:(?:def|for|if|while|return|assert|import|class|public|private|func|var|let|const|elif|switch|case|package|using|fn|SELECT)\b.*[\[\](){};:=.]"
    r"|[\w.\[\]]+ ?[-+*/|&]?= ?\S|[\w<>\[\], ]+ \w+ ?= ?new\b|[^\\<\s].*[;{}]\s*$|#include|//|/\*)"
)


def counts(t: Column, words: Column) -> dict[str, Column]:
    """Counts over one text ``t`` and its ``words`` that add up over the chunks of a document."""
    n = lambda pattern: F.regexp_count(t, F.lit(pattern))
    chars_in = lambda pattern: F.length(F.array_join(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), ""))
    return {
        "chars": F.length(t),
        "bytes": F.octet_length(t),
        "words": F.size(words),
        "word_chars": F.length(F.array_join(words, "")),
        "common": F.size(F.filter(words, lambda w: w.isin(*COMMON))) + n(f"(?={_HAN})[{COMMON_HAN}]"),  # a look at the range first, since the set is slow
        "han": n(_HAN),
        "lines": n(r"(?md)^.*\S"),
        "ended": n(r"(?md)[.!?:。！？：…][\"”’»)）]*\s*$"),
        "stops": n(r"(?md)[.!?](?<!^[ (]{0,4}\d{1,3}[.!?])[\"”’»)]*(?=\s|$)|[。！？]"),
        "commas": n(r",(?= )|，"),
        "mark_chars": chars_in(_MARK),
        "row_chars": chars_in(_ROW),
        "figures": n(r"(?<![\w.])-?\d[\d.,:/-]*%?(?!\w)"),
        "symbols": n(r"(?![A-Za-z ])[^\p{L}\p{N}\s.,;:!?'’\"“”„«»()\[\]%°€|，。！？：；、（）《》-]"),
        "vowels": F.length(t) - F.length(F.translate(F.lower(t), _VOWELS, "")),
        "code": n(_CODE),
    }


#: The names that :func:`counts` gives.
COUNTS = ("chars", "bytes", "words", "word_chars", "common", "han", "lines", "ended", "stops", "commas", "mark_chars", "row_chars", "figures", "symbols", "vowels", "code")


def _words(text: str) -> Column:
    """Words of a column in lower case, split at blanks and common punctuation."""
    return F.filter(F.split(F.lower(text), r"[\s,;|.:!?()“”„«»\"]+"), lambda w: w != "")


def _counted(df: DataFrame, text: str) -> DataFrame:
    """``df`` with the counts; text and words are made once a row, in steps of their own."""
    df = df.withColumn("_t", F.regexp_replace(F.coalesce(F.col(text), F.lit("")), _MARKER, ""))
    df = df.withColumn("_w", _words("_t"))
    return df.withColumns({k: v.cast("int") for k, v in counts(F.col("_t"), F.col("_w")).items()}).drop("_t", "_w")


def _per(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


#: The statistics of a document out of its summed counts, which ``c`` gives by name; 0 where there is nothing to count.
RATIOS: dict[str, Callable[[Callable[[str], Column]], Column]] = {
    "word_count": lambda c: c("words").cast("long"),
    "mean_word_length": lambda c: _per(c("word_chars"), c("words")),
    "symbol_ratio": lambda c: _per(c("symbols"), c("chars")),
    "ended_ratio": lambda c: _per(c("ended"), c("lines")),
    "common_ratio": lambda c: _per(c("common"), _units(c)),
    "stop_ratio": lambda c: _per(c("stops"), _units(c)),
    "comma_ratio": lambda c: _per(c("commas"), _units(c)),
    "words_per_line": lambda c: _per(_units(c), c("lines")),
    "mark_ratio": lambda c: _per(c("mark_chars"), c("chars")),
    "row_ratio": lambda c: _per(c("row_chars"), c("chars")),
    "figure_ratio": lambda c: _per(c("figures"), _units(c)),
    "vowel_ratio": lambda c: _per(c("vowels"), c("word_chars")),
    "wide_ratio": lambda c: _per(c("bytes") - c("chars"), c("chars")),
    "code_ratio": lambda c: _per(c("code"), c("lines")),
}


def _units(c: Callable[[str], Column]) -> Column:
    """Words, a Chinese one having two characters or so."""
    return c("words") + c("han") / 2


#: What the rules may use: all statistics but the size of the document.
FEATURES = ("mean_word_length", "symbol_ratio", "ended_ratio", "common_ratio", "stop_ratio", "comma_ratio", "words_per_line", "mark_ratio", "row_ratio", "figure_ratio", "vowel_ratio", "wide_ratio", "code_ratio")


def statistics(chunks: DataFrame) -> DataFrame:
    """One row a document: ``document_id`` and the statistics of :data:`RATIOS`.

    A place (``chunk_index``) stored several times counts once, by the greatest of its counts. NULL content counts as empty; rows
    without ``document_id`` are skipped. Counting is done at the scan, in the JVM; only numbers are
    shuffled, and they are added up before the shuffle, so no document is ever in one place.
    """
    counted = _counted(chunks.filter("document_id IS NOT NULL").select("document_id", "chunk_index", "content"), "content")
    # a column for each count, so that those which nobody asks for are never counted
    once = counted.groupBy("document_id", "chunk_index").agg(*[F.max(k).alias(k) for k in COUNTS])
    total = once.groupBy("document_id").agg(*[F.sum(k).alias(k) for k in COUNTS])
    return total.select("document_id", *[v(F.col).alias(k) for k, v in RATIOS.items()])


def rules() -> list:
    """The learned rule list (:mod:`leafmill.llm.train_quality` makes it)."""
    return parse(json.loads(MODEL.read_text())["rules"])


def classify(stats: DataFrame) -> DataFrame:
    """``stats`` with ``text_kind``: list, table, junk, code or prose, by one native CASE expression."""
    return stats.withColumn("text_kind", F.expr(to_sql(rules(), "prose")))


def with_kind(df: DataFrame, text: str, asked: tuple[str, ...] | None = None) -> DataFrame:
    """``df`` with the ``text_kind`` of its column ``text``, taken as a whole document.

    If only the kinds ``asked`` are of interest, other texts may come out as prose, and what those kinds' own rules do not use is counted only
    for texts that one of these rules would take. Counts go through generators of one row, which no filter on ``text_kind`` can be pushed through; otherwise the
    optimizer would put the counts in place of each of their uses in the rules and evaluate them many times a row.
    """
    learned = rules()
    if asked is not None:
        learned = learned[: max((k + 1 for k, r in enumerate(learned) if r.label in asked), default=0)]
    own = [r for r in learned if asked is None or r.label in asked]
    first = {name for r in own for name, _, _ in r.conditions}
    rest = {name for r in learned for name, _, _ in r.conditions} - first
    if not first:
        return df.withColumn("text_kind", F.lit("prose"))
    out = df.withColumn("_t", F.regexp_replace(F.coalesce(F.col(text), F.lit("")), _MARKER, "")).withColumn("_w", _words("_t"))
    made: set[str] = set()
    maybe = F.lit(True)
    for names in (first, rest) if rest else (first,):
        needed: set[str] = set()
        told = [RATIOS[name](lambda k: needed.add(k) or F.col(f"_c_{k}")).alias(f"_r_{name}") for name in sorted(names)]  # noqa: B023
        counted = [F.when(maybe, v.cast("int")).alias(f"_c_{k}") for k, v in counts(F.col("_t"), F.col("_w")).items() if k in needed - made]
        out = out.select("*", F.inline(F.array(F.struct(*counted)))) if counted else out
        out = out.select("*", F.inline(F.array(F.struct(*told))))
        made |= needed
        maybe = F.expr(" OR ".join("(" + " AND ".join(f"_r_{n} {op} {t!r}D" for n, op, t in r.conditions) + ")" for r in own))
    return out.select(*df.columns, F.expr(to_sql(learned, "prose", "_r_")).alias("text_kind"))
