"""Readers of the star-schema and text tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table, as a lazy parquet scan: filters and columns are pushed into it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
