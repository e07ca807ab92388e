"""Relational operators that are more than one built-in call."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coverage_by_group(df: DataFrame, group: str, hit: Column, total_name: str = "TOTAL") -> DataFrame:
    """(group, total, covered, pct) and a row for the whole, in one aggregation by rollup."""
    counted = df.withColumn("__hit", hit.cast("long")).rollup(group)
    out = counted.agg(F.count("*").alias("total"), F.sum("__hit").alias("covered"), F.grouping(group).alias("__whole"))
    named = F.when(F.col("__whole") == 1, F.lit(total_name)).otherwise(F.col(group))
    return out.select(named.alias(group), "total", "covered", F.round(F.lit(100.0) * F.col("covered") / F.col("total"), 2).alias("pct"))


def natural_key(label: Column) -> tuple[Column, Column]:
    """(number, suffix) of labels such as 12A."""
    return F.regexp_extract(label, r"(\d+)", 1).try_cast("long"), F.regexp_extract(label, r"\d+(.*)$", 1)


def deterministic_sample(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n rows in the order of the MD5 of seed and key: the same on every engine and run."""
    return df.orderBy(F.md5(F.concat(F.lit(seed + "|"), F.col(key).cast("string"))), key).limit(n)


def missing_in_sequence(df: DataFrame, group: str, number: str) -> DataFrame:
    """(group, number) for the numbers from 1 to a group's largest that it lacks. Held as arrays, so one grouped pass without a join."""
    seen = df.groupBy(group).agg(F.collect_set(number).alias("seen"), F.max(number).alias("hi")).where("hi >= 1")
    return seen.select(group, F.explode(F.array_except(F.sequence(F.lit(1).cast("long"), F.col("hi").cast("long")), "seen")).alias(number))


def rows_at_positions(df: DataFrame, group: str, order: Sequence[str], positions: Sequence[int], keep: bool = True) -> DataFrame:
    """Rows whose place in their group (from 0) is, or is not, one of the positions."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1
    inside = F.col("__p").isin(*positions)
    return df.withColumn("__p", place).where(inside if keep else ~inside).drop("__p")
