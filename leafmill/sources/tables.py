"""Readers for the engine's own Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Table ``name`` below ``root``: a Parquet file or a directory of them."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many tasks as there are cores, if its scan gives less than half as many; for steps that cost far more than a shuffle of their input.

    A table of a few row groups would otherwise occupy a few cores. Scans of tables of some size give more tasks than cores and are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() * 2 < cores else df
