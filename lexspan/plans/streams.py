"""Windows and state over the event log, as batch queries that share their operators with the streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.sources.tables import table
from lexspan.streaming import limits, windows

from .registry import query


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.tumbling(table(spark, sf_dir, "events"), "1 day").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH s AS (SELECT unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS start, user_id FROM events)
SELECT start, count(*) AS n, count(DISTINCT user_id) AS users FROM s GROUP BY 1""")
def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve-hour windows that start every six hours."""
    w = F.window(F.col("ts").cast("timestamp"), "12 hours", "6 hours")
    g = table(spark, sf_dir, "events").groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "users")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 4 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, sid""")
def session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that end after four hours without an event."""
    return windows.sessions(table(spark, sf_dir, "events"), "4 hours").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW) > 3 AS over_limit FROM events")
def rate_limit_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the user's requests of the last six hours, refused ones included, exceed three."""
    return limits.trailing_excess(table(spark, sf_dir, "events"), seconds=6 * 3600, most=3)


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
a AS (SELECT user_id, event_id, t, r, true AS admitted, [t] AS kept FROM e WHERE r = 1
  UNION ALL SELECT e.user_id, e.event_id, e.t, e.r, len(list_filter(a.kept, lambda x: x > e.t - 86400)) < 6,
    CASE WHEN len(list_filter(a.kept, lambda x: x > e.t - 86400)) < 6 THEN list_append(list_filter(a.kept, lambda x: x > e.t - 86400), e.t) ELSE list_filter(a.kept, lambda x: x > e.t - 86400) END
  FROM a JOIN e ON e.user_id = a.user_id AND e.r = a.r + 1)
SELECT user_id, event_id, admitted FROM a""")
def rate_limit_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact admission of six requests a day: refused requests are not recorded, so the rule is recursive."""
    return limits.admissions(table(spark, sf_dir, "events"), seconds=86400, most=6)


@query("""WITH k AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN concat('10.0.0.', user_id % 250, ', 192.168.1.1') WHEN event_id % 3 = 1 THEN '' END AS forwarded, CASE WHEN event_id % 7 <> 0 THEN concat('host', user_id) END AS host FROM events)
SELECT event_id, coalesce(nullif(trim(split_part(forwarded, ',', 1)), ''), host, '127.0.0.1') AS client FROM k""")
def client_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first forwarded address, else the host, else the local one."""
    e = table(spark, sf_dir, "events")
    forwarded = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("10.0.0."), F.col("user_id") % 250, F.lit(", 192.168.1.1"))).when(F.col("event_id") % 3 == 1, "")
    host = F.when(F.col("event_id") % 7 != 0, F.concat(F.lit("host"), F.col("user_id")))
    return e.select("event_id", limits.client_key(forwarded, host).alias("client"))


@query("SELECT event_id, user_id FROM events WHERE event_id % 4 <> 0 AND event_id % 9 <> 0")
def resumable_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a job that are neither processed nor skipped yet."""
    e = table(spark, sf_dir, "events")
    return limits.remaining(e, [e.where("event_id % 4 = 0"), e.where("event_id % 9 = 0")], "event_id").select("event_id", "user_id")
