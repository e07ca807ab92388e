"""Join operators that are more than one built-in call."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup_in_order(asked: DataFrame, records: DataFrame, asked_key: str, record_key: str, ordinal: str) -> DataFrame:
    """Inner join on trimmed keys without case, in the order of the requests."""
    norm = lambda c: F.lower(F.trim(F.col(c)))
    return asked.withColumn("__k", norm(asked_key)).join(records.withColumn("__k", norm(record_key)), "__k").drop("__k").orderBy(ordinal)


def _both_keys(asked: DataFrame, known: DataFrame, asked_key: str, known_key: str) -> DataFrame:
    """``asked`` with __exact and __loose: the known key that equals, and the least that equals but for case."""
    exact = known.select(F.col(known_key).alias("__exact"))
    loose = known.groupBy(F.lower(known_key).alias("__low")).agg(F.min(known_key).alias("__loose"))
    return asked.join(exact, F.col(asked_key) == F.col("__exact"), "left").join(loose, F.lower(asked_key) == F.col("__low"), "left").drop("__low")


def fallback_join(asked: DataFrame, known: DataFrame, asked_key: str, known_key: str) -> DataFrame:
    """Inner join on the exact key, else on the key without case."""
    both = _both_keys(asked, known, asked_key, known_key)
    return both.withColumn(known_key, F.coalesce("__exact", "__loose")).where(F.col(known_key).isNotNull()).drop("__exact", "__loose")


def fallback_outcomes(asked: DataFrame, known: DataFrame, asked_key: str, known_key: str) -> DataFrame:
    """(outcome, keys, n): the rows that ``fallback_join`` finds exactly, without case or not at all, and their distinct keys.

    Rows of a key are counted before the joins, so a key that many rows ask for is one row there.
    """
    keys = asked.groupBy(asked_key).agg(F.count("*").alias("n"))
    outcome = F.when(F.col("__exact").isNotNull(), "exact").when(F.col("__loose").isNotNull(), "without case").otherwise("missed")
    one = known.select(known_key).distinct()
    return _both_keys(keys, one, asked_key, known_key).groupBy(outcome.alias("outcome")).agg(F.count("*").alias("keys"), F.sum("n").alias("n"))


def contains_either_way_top(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_text: str, right_text: str, group: str, order: str, k: int, right_stem: int | None = None) -> DataFrame:
    """Rows equal in the keys of which one text contains the other (of the right one its first ``right_stem`` characters, if given); the first k of each group."""
    small = F.col(right_text) if right_stem is None else F.substring(right_text, 1, right_stem)
    either = F.contains(F.col(right_text), F.col(left_text)) | F.contains(F.col(left_text), small)
    place = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return left.join(right, (F.col(left_key) == F.col(right_key)) & either).withColumn("__r", place).where(F.col("__r") <= k).drop("__r")


def positional_mismatches(left: DataFrame, right: DataFrame, group: str, order: str, value: str, wrong: Callable[[Column, Column], Column]) -> DataFrame:
    """(group, p, left_n, right_n) of places that only one side has, or whose values are wrong together."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(order)).alias("p")
    a, b = left.select(group, place, F.col(value).alias("left_n")), right.select(group, place, F.col(value).alias("right_n"))
    bad = F.col("left_n").isNull() | F.col("right_n").isNull() | wrong(F.col("left_n"), F.col("right_n"))
    return a.join(b, [group, "p"], "full").where(bad)


def first_per_key_lookup(asked: DataFrame, records: DataFrame, keys: Sequence[str], value: str, order: str, name: str) -> DataFrame:
    """``asked`` with the first value, by order, that ``records`` has for the keys."""
    first = records.groupBy(*keys).agg(F.min_by(value, order).alias(name))
    return asked.join(first, list(keys), "left")


def prefix_join(texts: DataFrame, prefixes: DataFrame, text: str, prefix: str) -> DataFrame:
    """Texts with each prefix that they start with, up to a blank, and the ``rest`` after it. A text's own leading words are the join keys, no more of them than the longest prefix has."""
    longest = prefixes.agg(F.max(F.size(F.split(prefix, " ")))).first()[0] or 0
    words = F.split(text, " ", longest + 2)
    reach = F.least(F.size(words) - 1, F.lit(longest))
    heads = F.transform(F.sequence(F.lit(1), F.greatest(reach, F.lit(1))), lambda i: F.array_join(F.slice(words, F.lit(1), i), " "))
    spread = texts.where((F.size(words) > 1) & (F.lit(longest) > 0)).withColumn(prefix, F.explode(heads))
    return spread.join(prefixes.select(prefix).distinct(), prefix).withColumn("rest", F.expr(f"substring({text}, length({prefix}) + 2)"))
