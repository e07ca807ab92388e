"""Term statistics of a corpus, and the best rows of groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .search import EPSILON


def term_statistics(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term, df, idf) with negative idf raised to EPSILON times the mean, and one row (n, avgdl), for rows (doc, tokens)."""
    size = docs.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl"))
    df = docs.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    raw = df.join(F.broadcast(size)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))  # size is one row
    mean = raw.agg(F.avg("raw").alias("mean"))
    floor = F.when(F.col("raw") < 0, F.lit(EPSILON) * F.col("mean")).otherwise(F.col("raw"))
    return raw.join(F.broadcast(mean)).select("term", "df", floor.alias("idf")), size


def top_k(scores: DataFrame, k: int, by: str, score: str = "score", tie: str = "doc") -> DataFrame:
    """The k best rows of each group with their rank; rows that cannot be among them are cut before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), tie))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)
