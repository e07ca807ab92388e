"""Rules on scores, overrides, re-ranking and bands of (query, doc, ...) rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .search import HYBRID, Ranking, Rule, number


def boosted(name: str, rules: Sequence[Rule], without: str | None = None, score: str = HYBRID.score) -> Ranking:
    """The hybrid order with the factors of the rules; ``without`` leaves one out."""
    return Ranking(name, f"round({score} * {{factor}} + {number(1e-11)}, 8)", HYBRID.lexical, HYBRID.dense, tuple(r for r in rules if r.name != without))


def override(score: Column, priority: Column, by: str = "query") -> Column:
    """Rows with a priority go above all others of their group, the highest first."""
    return F.when(priority.isNotNull(), F.max(score).over(Window.partitionBy(by)) + 1 + priority).otherwise(score)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def two_phase(scored: DataFrame, relevance: str, pool: int = 20, reranked: int = 10, k: int = 5, weight: float = 0.2) -> DataFrame:
    """The ``pool`` best rows by ``score``; the first ``reranked`` mix their share of the best score with the second scorer, the rest keep their order; cut to k."""
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    top = scored.withColumn("place", F.row_number().over(by_score)).where(F.col("place") <= pool)
    best = F.max("score").over(Window.partitionBy("query"))
    share = F.when(best > 0, F.lit(weight) * F.col("score") / best).otherwise(0.0)
    final = F.round(share + F.when(F.col("place") <= reranked, F.lit(1 - weight) * sigmoid(F.col(relevance))).otherwise(0.0), 8)
    ordered = Window.partitionBy("query").orderBy((F.col("place") > reranked).cast("int"), F.desc("final"), "doc")
    return top.withColumn("final", final).withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= k)


def confidence_band(score: Column, by: str = "query") -> Column:
    """high, medium or low, by the score's ratio to the group's best."""
    best = F.max(score).over(Window.partitionBy(by))
    ratio = F.when(best > 0, score / best).otherwise(0.0)
    return F.when(ratio >= 0.95, "high").when(ratio >= 0.80, "medium").otherwise("low")
