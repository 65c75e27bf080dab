"""Access to the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark's reader touches the path, so any Hadoop store will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
