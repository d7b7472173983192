"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from leafmill.functions.tokens import TOKENIZERS, VOCABULARY, Tokenizer, encoder  # noqa: F401


def _kernel(tokenizer: Tokenizer, extra: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer.encoding.encode_ordinary
        for batch in batches:
            counts = [len(encode(t)) if t else 0 for t in batch.column(extra).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:extra], pa.array(counts, pa.int64())], names=[*batch.schema.names[:extra], "tokens"])

    return run


def token_counts(df: DataFrame, keep: list[str], text: str, vocabulary: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """The columns ``keep`` of ``df`` and ``tokens``, the size of column ``text``: 0 for NULL and empty texts.

    Whole texts are encoded, row by row in Arrow batches, without a shuffle. No text leaves the scan.
    """
    used = df.select(*keep, text)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in used.schema.fields[: len(keep)])
    return used.mapInArrow(_kernel(Tokenizer(vocabulary, folder), len(keep)), f"{ddl}, tokens long")
