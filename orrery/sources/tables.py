"""Readers of the Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Lazy scan of ``root/name.parquet`` (a file or a folder of part files)."""
    return spark.read.parquet(f"{root}/{name}.parquet")
