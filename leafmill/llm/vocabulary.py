"""Word frequencies of the whole corpus, and the part of them that is small by construction."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A word that makes up 1/BOUND of all words or more is frequent; there cannot be more than BOUND of them.
BOUND = 60_000

_HAN_RUN = re.compile(r"[㐀-鿿豈-﫿]{2,}")
_WORD = re.compile(r"[^\W\d_㐀-鿿豈-﫿぀-ヿ]{2,}")
#: Signs that are counted with the kind of character before and after them.
SIGNS = frozenset("“”„‘’‚«»‹›–—…•·°€£§¿¡")
_SIGN = re.compile(f"(?s)(.?)([{''.join(sorted(SIGNS))}])(?=(.?))")


def kind(c: str) -> str:
    """``L`` for a letter or digit, ``S`` for a blank or nothing, ``P`` for other signs."""
    return "L" if c.isalnum() else "S" if not c.strip() else "P"


def words(text: str) -> list[str]:
    """Words of two letters or more in lower case; Chinese and Japanese characters are none."""
    return _WORD.findall(text.lower())


def terms(text: str) -> list[str]:
    """Words in lower case, the overlapping pairs of characters of Chinese runs, and signs with the kinds of their neighbours."""
    low = text.lower()
    out = _WORD.findall(low)
    if not text.isascii():
        for run in _HAN_RUN.findall(low):
            out += map(str.__add__, run, run[1:])
        for a, sign, b in _SIGN.findall(text):
            out += (kind(a) + sign, sign + kind(b))
    return out


def counter_kernel(split: Callable[[str], list[str]], most: int = 300_000):
    """Arrow kernel that counts terms within a task and hands on partial counts, never more than ``most`` at a time."""

    def rows(c: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c.keys()), pa.string()), pa.array(list(c.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    own.update(split(text))
            if len(own) > most:
                yield rows(own)
                own = Counter()
        yield rows(own)

    return run


def term_counts(df: DataFrame, text: str, split: Callable[[str], list[str]] = terms) -> DataFrame:
    """``word``, ``n``: how often each term stands in all of column ``text``. Counted per task before the shuffle."""
    return df.select(text).mapInArrow(counter_kernel(split), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, bound: int = BOUND) -> DataFrame:
    """The terms whose share of all terms is at least 1 / ``bound``, hence at most ``bound`` rows at any corpus size."""
    return counts.filter(F.col("n") * bound >= counts.agg(F.sum("n")).scalar())
