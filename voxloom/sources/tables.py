"""Table scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of one table; filters and column selection are pushed into it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
