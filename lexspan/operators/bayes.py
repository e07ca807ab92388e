"""Gaussian naive Bayes as grouped sums: every model of a cross-fitting comes from one pass over the rows.

A model needs, of each class, the number of rows and each feature's sum and sum of squares. Those of the rows
outside a fold are the whole table's less the fold's, and those outside two crossed folds follow by
inclusion and exclusion. So no row is read again for another fold, and no fold is a job of its own.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_VARIANCE, DIGITS, FARTHEST = 1e-6, 6, 50.0


def _names(features: Sequence[str]) -> list[str]:
    return [f"__{kind}{c}_{f}" for c in (0, 1) for f in features for kind in ("s", "q")] + ["__n0", "__n1"]


def sums(rows: DataFrame, label: str, features: Sequence[str], *by: str) -> DataFrame:
    """Count, sums and sums of squares of both classes, by group."""
    own = lambda c, x: F.sum(F.when(F.col(label) == c, x).otherwise(F.lit(0.0)))
    aggs = [own(c, x).alias(f"__{kind}{c}_{f}") for c in (0, 1) for f in features for kind, x in (("s", F.col(f)), ("q", F.col(f) * F.col(f)))]
    return rows.groupBy(*by).agg(*aggs, *[F.sum(F.when(F.col(label) == c, 1).otherwise(0)).alias(f"__n{c}") for c in (0, 1)])


def probability(features: Sequence[str]) -> Column:
    """The probability of class 1 for a row that stands beside a model's sums. A class without rows has a flat prior."""
    n = {c: F.greatest(F.col(f"__n{c}").cast("double"), F.lit(1.0)) for c in (0, 1)}

    def term(c: int, f: str) -> Column:
        mean = F.col(f"__s{c}_{f}") / n[c]
        variance = F.greatest(F.col(f"__q{c}_{f}") / n[c] - mean * mean, F.lit(LEAST_VARIANCE))
        return F.lit(-0.5) * F.log(variance) - (F.col(f) - mean) * (F.col(f) - mean) / (2 * variance)

    side = lambda c: reduce(lambda a, b: a + b, [F.log(n[c]), *(term(c, f) for f in features)])
    logit = F.greatest(F.lit(-FARTHEST), F.least(F.lit(FARTHEST), side(1) - side(0)))
    return F.round(1 / (1 + F.exp(-logit)), DIGITS)


def out_of_fold(rows: DataFrame, label: str, fold: str, features: Sequence[str], name: str) -> DataFrame:
    """``rows`` with the probability ``name``, from a model of all other folds."""
    own = sums(rows, label, features, fold)
    every = Window.partitionBy(F.lit(0))  # a row a fold
    rest = own.select(fold, *[(F.sum(c).over(every) - F.col(c)).alias(c) for c in _names(features)])
    scored = rows.join(F.broadcast(rest), fold).withColumn(name, probability(features))
    return scored.drop(*_names(features))


def stacked(rows: DataFrame, key: Sequence[str], group: str, label: str, outer: str, inner: str, base: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Nested cross-fitting: ``key``, group, label, outer fold, base_score, base_rank, plain and stacked, for each row.

    For each outer fold a first model over the ``base`` features scores the fold's rows, trained on all
    others; each of those others is scored by a model that left out the fold and the row's own inner
    fold. Score and rank within the group are then features of a second model over ``features``
    (``stacked``), beside one without them (``plain``). No row is scored by a model that saw its group: all
    rows of a group must be in one outer and one inner fold.
    """
    cells = sums(rows, label, base, outer, inner).withColumnsRenamed({outer: "__o", inner: "__i"})
    names = _names(base)
    over = lambda *by: Window.partitionBy(*(by or (F.lit(0),)))  # noqa: E731  a row for each two folds
    folds, inners = cells.select(F.col("__o").alias("__left")).distinct(), cells.select(F.col("__i").alias("__in")).distinct()
    total = cells.agg(*[F.sum(c).alias(f"t{c}") for c in names])
    by_outer = cells.groupBy(F.col("__o").alias("__left")).agg(*[F.sum(c).alias(f"o{c}") for c in names])
    by_inner = cells.groupBy(F.col("__i").alias("__in")).agg(*[F.sum(c).alias(f"i{c}") for c in names])
    both = cells.select(F.col("__o").alias("__left"), F.col("__i").alias("__in"), *[F.col(c).alias(f"b{c}") for c in names])
    grid = folds.join(F.broadcast(inners)).join(F.broadcast(by_outer), "__left").join(F.broadcast(by_inner), "__in").join(both, ["__left", "__in"], "left").join(F.broadcast(total))  # outer times inner folds
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    training = grid.select("__left", "__in", *[(F.col(f"t{c}") - F.col(f"o{c}") - F.col(f"i{c}") + zero(f"b{c}")).alias(c) for c in names])
    testing = by_outer.join(F.broadcast(total)).select("__left", F.lit(-1).cast("long").alias("__in"), *[(F.col(f"t{c}") - F.col(f"o{c}")).alias(c) for c in names])
    models = training.withColumn("__in", F.col("__in").cast("long")).union(testing)
    needed = list(dict.fromkeys([*key, group, label, outer, inner, *base, *features]))
    spread = rows.select(*needed).join(F.broadcast(folds))  # each row once for each outer fold
    is_test = F.col(outer) == F.col("__left")
    scored = spread.withColumn("__in", F.when(is_test, F.lit(-1)).otherwise(F.col(inner)).cast("long")).join(F.broadcast(models), ["__left", "__in"]).withColumn("base_score", probability(base)).drop(*names)
    rank = F.rank().over(Window.partitionBy("__left", group).orderBy(F.desc("base_score"))).cast("double")
    scored = scored.withColumn("base_rank", rank)
    wide = [*features, "base_score", "base_rank"]
    out = scored.where(is_test)
    for name, used in (("plain", list(features)), ("stacked", wide)):
        model = sums(scored.where(~is_test), label, used, "__left")
        out = out.join(F.broadcast(model), "__left").withColumn(name, probability(used)).drop(*_names(used))
    return out.select(*key, *([group] if group not in key else []), label, outer, "base_score", "base_rank", "plain", "stacked")
