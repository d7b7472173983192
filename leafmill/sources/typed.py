"""Typed readers of data formats, beside the renderings as text: columns instead of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, *paths: str, separator: str = ",", schema: str | None = None) -> DataFrame:
    """Delimited files with a header. Without a ``schema`` every column is text: types are never guessed by a second pass over the data."""
    reader = spark.read.option("header", "true").option("sep", separator).option("multiLine", "false").option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema else reader.option("inferSchema", "false")).csv(list(paths))


def read_json(spark: SparkSession, *paths: str, schema: str | None = None, lines: bool = True) -> DataFrame:
    """JSON files by ``schema``, or as one VARIANT column ``value`` that takes any shape."""
    reader = spark.read.option("multiLine", str(not lines).lower())
    return reader.schema(schema).json(list(paths)) if schema else reader.option("singleVariantColumn", "value").json(list(paths))


def json_entries(df: DataFrame, column: str = "value") -> DataFrame:
    """Top-level entries of a VARIANT column: ``pos``, ``key``, ``entry``; natively, for JSON of known depth."""
    df.createOrReplaceTempView("_variants")
    return df.sparkSession.sql(f"SELECT e.pos, e.key, e.value AS entry FROM _variants, LATERAL variant_explode({column}) AS e")


def read_xml(spark: SparkSession, *paths: str, row_tag: str, schema: str | None = None) -> DataFrame:
    """Elements ``row_tag`` of XML files as rows."""
    reader = spark.read.option("rowTag", row_tag)
    return (reader.schema(schema) if schema else reader).xml(list(paths))


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Lines of text files with the file they stand in: ``path``, ``value``."""
    return spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("path"), "value")
