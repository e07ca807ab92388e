"""Deduplication, leakage checks and cleaners."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .search import nearest_in_blocks


def first_of_each(df: DataFrame, text: str, order: str) -> DataFrame:
    """The row with the smallest ``order`` of each text (``order`` is unique). The group's state is a digest and an id, never a text."""
    firsts = df.groupBy(F.sha2(F.coalesce(F.col(text), F.lit("")), 256), F.col(text).isNull()).agg(F.min(order).alias(order))
    return df.join(firsts.select(order), order, "left_semi")


def nearest_by_vector(vectors: DataFrame, asked: DataFrame, leak: float, borderline: float) -> DataFrame:
    """(query, best, nearest, verdict) of each query vector among all others; equal scores go to the smaller id."""
    best = nearest_in_blocks(vectors, asked, 1).select("query", F.col("score").alias("best"), F.col("doc").alias("nearest"))
    return best.withColumn("verdict", F.when(F.col("best") >= leak, "leak").when(F.col("best") >= borderline, "borderline").otherwise("clean"))


def _early(similar: float) -> Column:
    return F.when(F.col("excluded"), "excluded").when(F.col("in_test"), "test match").when(F.col("sim") >= similar, "similar")


def clean_duplicates_first(rows: DataFrame, key: Sequence[str], order: Sequence[str], similar: float = 0.85) -> DataFrame:
    """``rows`` with verdict: any row after the first of its key is a duplicate, whatever became of the first."""
    seen = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("verdict", F.when(seen > 1, "duplicate").otherwise(F.coalesce(_early(similar), F.lit("kept"))))


def clean_duplicates_last(rows: DataFrame, key: Sequence[str], order: Sequence[str], similar: float = 0.85) -> DataFrame:
    """``rows`` with verdict: a row is a duplicate only of a row that stays."""
    early = rows.withColumn("__early", _early(similar))
    seen = F.row_number().over(Window.partitionBy(*key, F.col("__early").isNull()).orderBy(*order))
    verdict = F.when(F.col("__early").isNotNull(), F.col("__early")).when(seen > 1, "duplicate").otherwise("kept")
    return early.withColumn("verdict", verdict).drop("__early")


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df``, or an error that names the columns it lacks."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
