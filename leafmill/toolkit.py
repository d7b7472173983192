"""Plain calls for single files, over the same readers that the DataFrames use."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from leafmill.sources import extract as E


def supported_types() -> dict[str, str]:
    """Registered types and what they are called."""
    return dict(E.TYPES)


def file_type(path: str) -> str:
    """Type of a file by its name; names without a dot stand for themselves."""
    name = Path(path).name
    return name.rsplit(".", 1)[-1].lower() if "." in name[1:] else name.lower()


def is_supported(path: str) -> bool:
    """Whether there is a reader for a file's type; ``Dockerfile`` and ``Makefile`` need no dot."""
    return file_type(path) in E.TYPES


def parse_file(spark: SparkSession, path: str) -> str:
    """Text of one file. FileNotFoundError if there is none, ValueError if it cannot be read."""
    try:
        row = E.extract(E.read_files(spark, path)).select("text", "error").first()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(path) from e
        raise
    if row is None or row.text is None:
        raise ValueError(row.error if row else f"no such file: {path}")
    return row.text


def get_metadata(spark: SparkSession, path: str) -> dict[str, str]:
    """Type, size and what the format tells of one file."""
    row = E.metadata(E.read_files(spark, path).filter(F.col("length") > 0)).first()
    return dict(row.metadata) if row else {"file_type": file_type(path), "file_size": "0"}
