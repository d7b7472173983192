"""Cutting texts into chunks bounded in tokens, by one of five strategies."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.tokens import TOKENIZERS, VOCABULARY, Tokenizer

# Names of the strategies, as they are shown.
STRATEGIES = {"fixed": "固定大小分块", "paragraph": "段落感知分块", "semantic": "语义边界分块", "recursive": "递归分块", "sentence": "句子级分块"}
# Separators of the recursive strategy, coarsest first.
SEPARATORS = ("\n\n", "\n", "。", ".", "！", "!", "？", "?", "；", ";", " ")
# What opens a section, and what ends a sentence.
_SECTION = re.compile(r"\n(?=#{1,6}\s|\[第?\d+页\]|\[表格\]|\[工作表)")
_SENTENCE = re.compile(r"(?<=[。！？.!?])\s*")

#: Stands for a vocabulary whose tokens are the words between blanks.
BLANK = "blank"


class Words:
    """Words between blanks as tokens, in the place of a :class:`~leafmill.functions.tokens.Tokenizer`; they are put together again with one blank."""

    @property
    def encoding(self) -> Words:
        return self

    def encode_ordinary(self, text: str) -> list[str]:
        return text.split()

    def decode(self, tokens: list[str]) -> str:
        return " ".join(tokens)


#: A chunk: its text and size in tokens.
Chunk = tuple[str, int]


@dataclass(frozen=True)
class Chunking:
    """How to cut: greatest ``size`` and ``overlap`` in tokens, the strategy (unknown names mean ``semantic``), the tokenizer's files (or :data:`BLANK`)."""

    size: int = 512
    overlap: int = 64
    strategy: str = "semantic"
    vocabulary: str = VOCABULARY
    folder: str = TOKENIZERS

    def __post_init__(self) -> None:
        if not 0 <= self.overlap < self.size:
            raise ValueError("overlap must be less than size, else cutting would not advance")


class Cutter:
    """The strategies over one pair of encode and decode functions."""

    def __init__(self, size: int, overlap: int, encode: Callable[[str], list[int]], decode: Callable[[list[int]], str]):
        self.size, self.overlap, self.encode, self.decode = size, overlap, encode, decode

    def run(self, strategy: str, text: str | None) -> list[Chunk]:
        """Chunks of ``text`` in order; none for NULL or blank text."""
        if not text:
            return []
        return getattr(self, strategy if strategy in STRATEGIES else "semantic")(text)

    def fixed(self, text: str) -> list[Chunk]:
        """Windows of ``size`` tokens, each starting ``overlap`` before the end of the last."""
        ids = self.encode(text)
        step = self.size - self.overlap
        count = 0 if not ids else 1 + max(0, -(-(len(ids) - self.size) // step))
        windows = (ids[k * step : k * step + self.size] for k in range(count))
        return [(self.decode(w), len(w)) for w in windows]

    def paragraph(self, text: str) -> list[Chunk]:
        """Lines packed greedily; a full chunk hands its last ``overlap`` tokens on. A longer line is not cut."""
        out: list[Chunk] = []
        held: list[int] = []
        for line in filter(None, map(str.strip, text.split("\n"))):
            ids = self.encode(line)
            if held and len(held) + len(ids) > self.size:
                out.append((self.decode(held), len(held)))
                held = held[max(0, len(held) - self.overlap) :]
            held = held + ids
        return out + [(self.decode(held), len(held))] if held else out

    def semantic(self, text: str) -> list[Chunk]:
        """Sections at headings and markers, packed without overlap; a longer section is cut by :meth:`fixed`."""
        out: list[Chunk] = []
        held: list[str] = []
        total = 0

        def flush() -> None:
            nonlocal held, total
            if held:
                out.append(("\n\n".join(held), total))
            held, total = [], 0

        for section in filter(None, map(str.strip, _SECTION.split(text))):
            n = len(self.encode(section))
            if total + n > self.size:
                flush()
            if n > self.size:
                out += self.fixed(section)
            else:
                held.append(section)
                total += n
        flush()
        return out

    def recursive(self, text: str) -> list[Chunk]:
        """Parts at the coarsest separator, packed; what is still too long goes to the next finer one, at last to :meth:`fixed`."""
        return self._level(text, 0)

    def _level(self, text: str, depth: int) -> list[Chunk]:
        if depth == len(SEPARATORS):
            return self.fixed(text)
        sep = SEPARATORS[depth]
        out: list[Chunk] = []
        held, total = "", 0

        def flush() -> None:
            if held:
                out.extend([(held, total)] if total <= self.size else self._level(held, depth + 1))

        for part in filter(None, map(str.strip, text.split(sep))):
            n = len(self.encode(part))
            if held and total + n > self.size:
                flush()
                held, total = "", 0
            held = (held + sep + part).strip() if held else part
            total += n
        flush()
        return out

    def sentence(self, text: str) -> list[Chunk]:
        """Sentences packed with blanks between; a full chunk hands on its last quarter, one sentence at least. A longer sentence is not cut."""
        out: list[Chunk] = []
        held: list[tuple[str, int]] = []
        for s in filter(None, map(str.strip, _SENTENCE.split(text))):
            n = len(self.encode(s))
            total = sum(k for _, k in held)
            if held and total + n > self.size:
                out.append((" ".join(x for x, _ in held), total))
                held = held[-max(1, len(held) // 4) :]
            held.append((s, n))
        return out + [(" ".join(x for x, _ in held), sum(k for _, k in held))] if held else out


def _kernel(options: Chunking):
    schema = pa.schema([("document_id", pa.int64()), ("chunk_index", pa.int32()), ("content", pa.string()), ("token_count", pa.int32())])

    tokenizer = Words() if options.vocabulary == BLANK else Tokenizer(options.vocabulary, options.folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = tokenizer.encoding
        cutter = Cutter(options.size, options.overlap, e.encode_ordinary, e.decode)
        for batch in batches:
            rows = [(i, k, *c) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for k, c in enumerate(cutter.run(options.strategy, text))]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(schema)], schema=schema)

    return run


def chunk(documents: DataFrame, options: Chunking = Chunking(), key: str = "id", text: str = "text") -> DataFrame:
    """Chunks of every document: ``document_id``, ``chunk_index`` (from 0, without holes), ``content``, ``token_count``.

    NULL and blank texts have none. Each text is cut where it lies, without a shuffle.
    """
    return documents.select(F.col(key).cast("long"), F.col(text)).mapInArrow(_kernel(options), "document_id long, chunk_index int, content string, token_count int")


def token_windows(tokens: Column, size: int, overlap: int) -> Column:
    """The fixed strategy on an array of tokens, natively: an array of windows."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size, else cutting would not advance")
    step, n = size - overlap, F.size(tokens)
    count = F.when(n == 0, 0).otherwise(F.lit(1) + F.greatest(F.lit(0), F.ceil((n - size) / step))).cast("int")
    empty = F.array().cast("array<array<string>>")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.slice(tokens, k * step + 1, size))).otherwise(empty)


def word_chunks(documents: DataFrame, size: int, overlap: int, key: str = "id", text: str = "text") -> DataFrame:
    """The fixed strategy with blank-separated words as tokens; all in the JVM."""
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != "")
    # a column of its own: inside the windows' lambda the text would be split anew for each window
    split = documents.select(F.col(key).alias("document_id"), words.alias("_words"))
    cut = split.select("document_id", F.posexplode(token_windows(F.col("_words"), size, overlap)).alias("chunk_index", "_w"))
    return cut.select("document_id", "chunk_index", F.array_join("_w", " ").alias("content"), F.size("_w").alias("token_count"))
