"""What the physical plan of a query does, for tests and reviews."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def formatted(df: DataFrame) -> str:
    """The plan before adaptive execution changes it."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def exchanges(df: DataFrame) -> int:
    """Number of shuffles; reused ones and broadcasts are not counted."""
    tree = formatted(df).split("\n\n")[0]
    return len(re.findall(r"(?<!Broadcast)(?<!Reused)Exchange \(", tree))


def columns_read(df: DataFrame) -> list[set[str]]:
    """Columns that each scan reads."""
    return [set(re.findall(r"(\w+):", m)) for m in re.findall(r"ReadSchema: struct<(.*)>", formatted(df))]


def pushed_filters(df: DataFrame) -> list[str]:
    """Filters that each scan gets."""
    return re.findall(r"PushedFilters: \[(.*)\]", formatted(df))


def python_steps(df: DataFrame) -> int:
    """Number of steps that hand rows to Python."""
    return len(re.findall(r"(?:MapInArrow|MapInPandas|FlatMapGroupsInPandas|FlatMapGroupsInArrow|ArrowEvalPython|BatchEvalPython) \(", formatted(df).split("\n\n")[0]))
