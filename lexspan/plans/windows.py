"""Analytic operators: ranks, gaps, running values, groups from markers, folds and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspan.operators.features import hash_bucket, stable_folds, stratified
from lexspan.sources.tables import table

from .registry import query


@query("""
SELECT user_id, event_id, row_number() OVER w AS place, rank() OVER (PARTITION BY user_id ORDER BY round(value) DESC) AS min_rank,
       round(value - coalesce(lead(value) OVER w, value), 6) AS gap_to_next, round(value / max(value) OVER (PARTITION BY user_id), 6) AS normalised
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value DESC, event_id)""")
def rank_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, rank with ties at the lowest, gap to the next score (0 for the last) and share of the best, in one shuffle."""
    by_user = Window.partitionBy("user_id")
    w = by_user.orderBy(F.desc("value"), "event_id")
    e = table(spark, sf_dir, "events")
    return e.select(
        "user_id",
        "event_id",
        F.row_number().over(w).cast("long").alias("place"),
        F.rank().over(by_user.orderBy(F.desc(F.round("value")))).cast("long").alias("min_rank"),
        F.round(F.col("value") - F.coalesce(F.lead("value").over(w), "value"), 6).alias("gap_to_next"),
        F.round(F.col("value") / F.max("value").over(by_user), 6).alias("normalised"),
    )


@query("SELECT user_id, event_id, round(max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS running_max, (count(*) OVER (PARTITION BY user_id) - row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) + 1)::BIGINT AS multiplier FROM events")
def running_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    multiplier = F.count("*").over(Window.partitionBy("user_id")) - F.row_number().over(w) + 1
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.round(F.max("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 6).alias("running_max"), multiplier.cast("long").alias("multiplier"))


@query("SELECT user_id, event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS carried FROM events")
def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last non-empty value carried forward."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    marked = F.when(F.col("event_type") == "signup", F.col("event_id"))
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.last(marked, ignorenulls=True).over(w).alias("carried"))


@query("""
WITH g AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS exchange FROM conversations)
SELECT conv_id, exchange::BIGINT AS exchange, count(*) AS rows_in_group, string_agg(role, '>' ORDER BY turn) AS roles FROM g GROUP BY 1, 2""")
def group_continuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that follow a starting row belong to its group: a running count of starts numbers the groups."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    numbered = table(spark, sf_dir, "conversations").withColumn("exchange", F.sum((F.col("role") == "user").cast("long")).over(w))
    roles = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ">")
    return numbered.groupBy("conv_id", "exchange").agg(F.count("*").alias("rows_in_group"), roles.alias("roles"))


@query("""
SELECT user_id, event_id, event_type, round(value + CASE WHEN nxt = event_type THEN nv ELSE 0 END, 6) AS merged FROM (
  SELECT *, lead(event_type) OVER w AS nxt, lead(value) OVER w AS nv, lag(event_type) OVER w AS prv FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
WHERE prv IS NULL OR prv <> event_type""")
def merge_with_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row takes up the next one's value where the keys agree, and the next one goes."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumns({"nxt": F.lead("event_type").over(w), "nv": F.lead("value").over(w), "prv": F.lag("event_type").over(w)})
    merged = F.col("value") + F.when(F.col("nxt") == F.col("event_type"), F.col("nv")).otherwise(0)
    return e.where("prv IS NULL OR prv <> event_type").select("user_id", "event_id", "event_type", F.round(merged, 6).alias("merged"))


@query("SELECT doc_id, source, ('0x' || substr(md5('fold|' || source), 1, 8))::BIGINT % 5 AS outer_fold, ('0x' || substr(md5('inner|' || source), 1, 8))::BIGINT % 4 AS inner_fold FROM documents")
def group_kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds that no group straddles, from a hash of the group: no shuffle and no global rank."""
    return stable_folds(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", outer=5, inner=4)


@query("SELECT source, CASE WHEN ('0x' || substr(md5('split|' || source), 1, 8))::BIGINT % 100 < 20 THEN 'test' ELSE 'train' END AS part, count(*) AS n FROM documents GROUP BY 1, 2")
def group_shuffle_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.when(hash_bucket("split", F.col("source"), 100) < 20, "test").otherwise("train")
    return table(spark, sf_dir, "documents").groupBy("source", part.alias("part")).agg(F.count("*").alias("n"))


@query("SELECT quality, CASE WHEN ('0x' || substr(md5('row|' || doc_id), 1, 8))::BIGINT % 100 < 25 THEN 'test' ELSE 'train' END AS part, count(*) AS n FROM labels GROUP BY 1, 2")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.when(hash_bucket("row", F.col("doc_id"), 100) < 25, "test").otherwise("train")
    return table(spark, sf_dir, "labels").groupBy("quality", part.alias("part")).agg(F.count("*").alias("n"))


@query("""
WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY ('0x' || substr(md5('strata|' || doc_id), 1, 8))::BIGINT, doc_id) AS place, count(*) OVER (PARTITION BY quality) AS n FROM labels)
SELECT doc_id, quality, CASE WHEN place <= ceil(n * 25 / 100.0::DOUBLE) THEN 'test' ELSE 'train' END AS part FROM r""")
def stratified_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly a quarter of each class, rounded up, for the test."""
    return stratified(table(spark, sf_dir, "labels").select("doc_id", "quality"), "quality", "doc_id", 25, "strata")


@query("SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 21600000000 PRECEDING AND CURRENT ROW) AS recent FROM events")
def trailing_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the user in the six hours up to each one."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("s").rangeBetween(-21600 * 1_000_000, 0)
    return table(spark, sf_dir, "events").withColumn("s", seconds).select("user_id", "event_id", F.count("*").over(w).alias("recent"))


@query("""
WITH d AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events), g AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day)::INT AS island FROM d)
SELECT user_id, max(n) AS best, arg_max(n, last) AS current FROM (SELECT user_id, island, count(*) AS n, max(day) AS last FROM g GROUP BY 1, 2) GROUP BY 1""")
def daily_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest and latest run of days in a row (gaps and islands)."""
    days = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day")).distinct()
    island = F.date_sub("day", F.row_number().over(Window.partitionBy("user_id").orderBy("day")))
    runs = days.withColumn("island", island).groupBy("user_id", "island").agg(F.count("*").alias("n"), F.max("day").alias("last"))
    return runs.groupBy("user_id").agg(F.max("n").alias("best"), F.max_by("n", "last").alias("current"))


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY f) AS seen_order FROM (SELECT user_id, event_type, min(struct_pack(t := ts, e := event_id)) AS f FROM events GROUP BY 1, 2) GROUP BY 1")
def first_seen_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values in the order of their first occurrence."""
    firsts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("f"))
    return firsts.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f", "event_type"))), lambda x: x["event_type"]), ",").alias("seen_order"))
