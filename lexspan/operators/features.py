"""Folds, splits and confusion counts for classifier features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_bucket(salt: str, key: Column, n: int) -> Column:
    """A bucket from 0 to n - 1 by MD5, the same on every engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt + "|"), key.cast("string"))), 1, 8), 16, 10).cast("long") % n


def stable_folds(df: DataFrame, group: str, outer: int, inner: int) -> DataFrame:
    """``df`` with outer_fold and inner_fold; all rows of a group are in the same folds."""
    return df.withColumns({"outer_fold": hash_bucket("fold", F.col(group), outer), "inner_fold": hash_bucket("inner", F.col(group), inner)})


def stratified(df: DataFrame, label: str, key: str, percent: int, salt: str, buckets: int = 1 << 14) -> DataFrame:
    """``df`` with part: of each class exactly ``percent`` of the rows, rounded up, are test, those first by the key's hash, then the key.

    Rows are counted by class and range of hashes. Only the one range of a class in which the cut falls is
    ranked; all other rows are told by their range alone, so no class is sorted in one task. A null label is a
    class; rows with a null key share the hash of an empty text and come first among equal hashes.
    """
    h = hash_bucket(salt, F.coalesce(F.col(key).cast("string"), F.lit("")), 1 << 32)
    rows = df.withColumn("__h", h).withColumn("__b", F.floor(F.col("__h") / ((1 << 32) // buckets)))
    counts = rows.groupBy(F.col(label).alias("__l"), F.col("__b").alias("__at")).agg(F.count("*").alias("__n"))
    upto, every = Window.partitionBy("__l").orderBy("__at"), Window.partitionBy("__l")
    sums = counts.withColumns({"__sum": F.sum("__n").over(upto), "__want": F.ceil(F.sum("__n").over(every) * percent / 100)})
    cut = sums.where((F.col("__sum") >= F.col("__want")) & (F.col("__sum") - F.col("__n") < F.col("__want"))).select("__l", "__at", (F.col("__want") - F.col("__sum") + F.col("__n")).alias("__left"))
    met = rows.join(cut, F.col(label).eqNullSafe(F.col("__l")), "left")
    at = F.coalesce("__at", F.lit(-1))  # without a cut no row of the class is wanted
    sure = met.where(F.col("__b") != at).withColumn("part", F.when(F.col("__b") < at, "test").otherwise("train"))
    place = F.row_number().over(Window.partitionBy("__l", "__b").orderBy("__h", key))
    edge = met.where(F.col("__b") == at).withColumn("part", F.when(place <= F.col("__left"), "test").otherwise("train"))
    return sure.unionByName(edge).drop("__h", "__b", "__l", "__at", "__left")


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den, 0 where den is 0."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)


def confusion(df: DataFrame, truth: Column, predicted: Column, *groups: str) -> DataFrame:
    """tp, fp, fn, tn, accuracy, precision, recall and f1, by group if given."""
    n = lambda c: F.sum(c.cast("long"))
    t, p = truth.cast("boolean"), predicted.cast("boolean")
    counts = df.groupBy(*groups).agg(n(t & p).alias("tp"), n(~t & p).alias("fp"), n(t & ~p).alias("fn"), n(~t & ~p).alias("tn"))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return counts.withColumns(
        {
            "accuracy": F.round((tp + tn) / (tp + fp + fn + tn), 6),
            "precision": F.round(safe_ratio(tp, tp + fp), 6),
            "recall": F.round(safe_ratio(tp, tp + fn), 6),
            "f1": F.round(safe_ratio(2 * tp, 2 * tp + fp + fn), 6),
        }
    )
