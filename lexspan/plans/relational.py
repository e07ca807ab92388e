"""Scans, filters, aggregations, sorts and set operations over the star schema and the text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.operators.relational import coverage_by_group, deterministic_sample, missing_in_sequence, natural_key, rows_at_positions
from lexspan.sources.tables import table

from .registry import query


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45")
def scan_filter_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projection and filter, both pushed into the parquet scan."""
    return table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity >= 45").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00'")
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 4).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(revenue), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY 1")
def local_supplier_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six-way join; the small sides are broadcast by the planner where their size allows."""
    t = lambda n: table(spark, sf_dir, n)
    asia = t("region").where("r_name = 'ASIA'").join(t("nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    supply = asia.join(t("supplier"), F.col("n_nationkey") == F.col("s_nationkey"))
    bought = t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey")).join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    joined = bought.join(supply, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    return joined.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT count(*) AS n FROM lineitem")
def row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").agg(F.count("*").alias("n"))


@query("SELECT year(o_orderdate)::INT AS y, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1")
def year_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n")).orderBy("y")


@query("SELECT o_orderkey, o_custkey, year(o_orderdate)::INT AS y FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 1996 ORDER BY o_orderdate, o_orderkey")
def year_between_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inclusive year range as a range on the date itself, which the scan can use, then sorted."""
    o = table(spark, sf_dir, "orders").where("o_orderdate >= TIMESTAMP_NTZ '1995-01-01 00:00:00' AND o_orderdate < TIMESTAMP_NTZ '1997-01-01 00:00:00'")
    return o.orderBy("o_orderdate", "o_orderkey").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"))


@query("SELECT o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, 1")
def group_desc_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "priority")


@query("SELECT count(DISTINCT source) AS sources, count(DISTINCT doc_id) AS docs, count(DISTINCT lang) AS langs, count(DISTINCT lower(text)) AS texts FROM documents")
def count_distinct_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values of several columns; of texts the digests are counted, so no text is expanded or shuffled."""
    return table(spark, sf_dir, "documents").agg(F.count_distinct("source").alias("sources"), F.count_distinct("doc_id").alias("docs"), F.count_distinct("lang").alias("langs"), F.count_distinct(F.md5(F.lower("text"))).alias("texts"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3")
def value_counts_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type").limit(3)


@query("""
WITH g AS (SELECT source, count(*) AS total, count(l.doc_id) AS covered FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1)
SELECT source, total, covered, round(100.0::DOUBLE * covered / total, 2) AS pct FROM g
UNION ALL SELECT 'TOTAL', sum(total)::BIGINT, sum(covered)::BIGINT, round(100.0::DOUBLE * sum(covered) / sum(total), 2) FROM g""")
def coverage_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each source's documents that have a label, and a grand total by rollup."""
    covered = table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("hit"))
    return coverage_by_group(table(spark, sf_dir, "documents").join(covered, "doc_id", "left"), "source", F.col("hit").isNotNull())


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def group_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))


@query("SELECT user_id, round(sum(m), 6) AS total FROM (SELECT user_id, event_type, max(value) AS m FROM events GROUP BY 1, 2) GROUP BY 1")
def max_then_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    peak = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("m"))
    return peak.groupBy("user_id").agg(F.round(F.sum("m"), 6).alias("total"))


@query("SELECT lang, round(avg(quality), 6) AS quality_rate, round(avg(toxic), 6) AS toxic_rate FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def flag_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return j.groupBy("lang").agg(F.round(F.avg("quality"), 6).alias("quality_rate"), F.round(F.avg("toxic"), 6).alias("toxic_rate"))


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(quantile_cont(value, 0.025), 6) AS lo, round(quantile_cont(value, 0.975), 6) AS hi FROM events GROUP BY 1")
def mean_std_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, population deviation and the linearly interpolated 95 % interval."""
    p = lambda q: F.round(F.percentile("value", F.lit(q)), 6)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"), p(0.025).alias("lo"), p(0.975).alias("hi"))


@query("SELECT user_id, max(value) AS best, arg_max(event_id, {'v': value, 'e': -event_id}) AS best_event FROM events GROUP BY 1")
def argmax_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("value").alias("best"), F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("best_event"))


@query("SELECT user_id, bool_or(event_type = 'purchase') AS any_purchase, bool_and(event_type <> 'error') AS no_error FROM events GROUP BY 1")
def any_all_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.bool_or(F.col("event_type") == "purchase").alias("any_purchase"), F.bool_and(F.col("event_type") != "error").alias("no_error"))


@query("SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that occur more than once. Only digests are shuffled, and they are pre-aggregated."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return d.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query("SELECT o_custkey, string_agg('Order ' || o_orderkey || ': ' || o_orderpriority, '; ' ORDER BY o_orderdate, o_orderkey) AS listing FROM orders GROUP BY 1")
def ordered_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as one text, in order."""
    line = F.concat(F.lit("Order "), F.col("o_orderkey"), F.lit(": "), F.col("o_orderpriority"))
    held = F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", line.alias("line"))))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(held, lambda x: x["line"]), "; ").alias("listing"))


@query("SELECT event_type, count(*) AS failures, list(DISTINCT user_id ORDER BY user_id) AS users FROM events WHERE value < 1.0 GROUP BY 1")
def failure_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("value < 1.0").groupBy("event_type").agg(F.count("*").alias("failures"), F.array_sort(F.collect_set("user_id")).alias("users"))


@query("SELECT user_id, arg_min(event_id, {'t': ts, 'e': event_id}) AS first_event, arg_max(event_id, {'t': ts, 'e': event_id}) AS last_event FROM events GROUP BY 1")
def first_and_last_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First occurrence and last write of each key, as aggregates rather than a sorted window."""
    order = F.struct("ts", "event_id")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("event_id", order).alias("first_event"), F.max_by("event_id", order).alias("last_event"))


@query("SELECT l_partkey, count(DISTINCT l_suppkey) AS targets, CASE WHEN count(DISTINCT l_suppkey) > 1 THEN 'split' ELSE 'direct' END AS relation FROM lineitem GROUP BY 1")
def distinct_target_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = F.count_distinct("l_suppkey")
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(targets.alias("targets")).withColumn("relation", F.when(F.col("targets") > 1, "split").otherwise("direct"))


@query("SELECT l_returnflag, l_linestatus, grouping(l_returnflag)::INT AS g1, grouping(l_linestatus)::INT AS g2, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def star_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus")
    return c.agg(F.grouping("l_returnflag").cast("int").alias("g1"), F.grouping("l_linestatus").cast("int").alias("g2"), F.count("*").alias("n"))


@query("SELECT lang, count(*) FILTER (WHERE quality = 1) AS q1, count(*) FILTER (WHERE quality = 0) AS q0 FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def quality_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    wide = j.groupBy("lang").pivot("quality", [1, 0]).count()
    return wide.select("lang", F.coalesce("1", F.lit(0)).alias("q1"), F.coalesce("0", F.lit(0)).alias("q0"))


# Sorts and limits


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_k_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("SELECT c_custkey, o_orderkey FROM (SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING') WHERE r <= 2")
def head_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of each group; the rank filter also cuts groups before the shuffle."""
    from pyspark.sql import Window

    j = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    r = F.row_number().over(Window.partitionBy("c_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return j.withColumn("r", r).where("r <= 2").select("c_custkey", "o_orderkey")


@query("SELECT label, try_cast(regexp_extract(label, '(\\d+)', 1) AS BIGINT) AS num, regexp_extract(label, '\\d+(.*)$', 1) AS suffix FROM (SELECT DISTINCT p_size || substr(p_type, 1, 1) AS label FROM part)")
def natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels such as 12A sorted by number, then suffix."""
    labels = table(spark, sf_dir, "part").select(F.concat(F.col("p_size").cast("string"), F.substring("p_type", 1, 1)).alias("label")).distinct()
    num, suffix = natural_key(F.col("label"))
    return labels.select("label", num.alias("num"), suffix.alias("suffix")).orderBy("num", "suffix")


@query("SELECT doc_id FROM documents ORDER BY md5('7|' || doc_id), doc_id LIMIT 25")
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A random sample that any engine repeats: the smallest hashes of seed and id."""
    return deterministic_sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 25, "7")


# Sequences and positions


@query("SELECT c.user_id, t.event_type FROM (SELECT DISTINCT user_id FROM events) c CROSS JOIN (SELECT DISTINCT event_type FROM events) t WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = c.user_id AND e.event_type = t.event_type AND e.value > 90)")
def missing_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of event that a user has no high value in: all kinds as an array of each user, less what was seen. One grouped pass."""
    e = table(spark, sf_dir, "events")
    kinds = e.agg(F.array_sort(F.collect_set("event_type")).alias("kinds"))  # one row: the event types
    seen = e.groupBy("user_id").agg(F.collect_set(F.when(F.col("value") > 90, F.col("event_type"))).alias("seen"))
    return seen.join(F.broadcast(kinds)).select("user_id", F.explode(F.array_except("kinds", "seen")).alias("event_type"))


@query("WITH m AS (SELECT o_custkey, max(o_orderkey % 40) AS hi FROM orders GROUP BY 1), s AS (SELECT o_custkey, unnest(range(1, hi + 1)) AS n FROM m) SELECT o_custkey, n FROM s WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = s.o_custkey AND o.o_orderkey % 40 = n)")
def missing_in_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of 1..N that a group lacks."""
    return missing_in_sequence(table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderkey") % 40).alias("n")), "o_custkey", "n")


@query("SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p FROM conversations) WHERE p NOT IN (1, 3)")
def drop_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each conversation but those at given places."""
    return rows_at_positions(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], [1, 3], keep=False).select("conv_id", "turn")


# Set operations


@query("SELECT doc_id AS id, text FROM documents WHERE lang = 'es' UNION ALL SELECT item_id, text FROM benchmark")
def union_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "documents").where("lang = 'es'").select(F.col("doc_id").alias("id"), "text")
    return a.unionByName(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text"))


@query("SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer")
def distinct_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).union(table(spark, sf_dir, "customer").select("c_custkey")).distinct()


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, sf_dir, "orders").select("o_custkey"))


@query("SELECT user_id AS k FROM events WHERE event_type = 'error' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase'")
def set_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.where("event_type = 'error'").select(F.col("user_id").alias("k")).intersect(e.where("event_type = 'purchase'").select("user_id"))


@query("SELECT count(*) AS n_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS dropped FROM documents")
def exact_row_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows an exact duplicate removal drops."""
    d = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("h"), "lang").agg(F.count("*").alias("n"))
    return d.agg(F.sum("n").alias("n_rows"), (F.sum("n") - F.count("*")).alias("dropped"))


@query("""
WITH l AS (SELECT user_id, event_type, max(ts) AS last_ts, max(event_id) FILTER (WHERE true) AS e FROM events GROUP BY 1, 2)
SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY last_ts DESC, event_type) AS place FROM l
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY last_ts DESC, event_type) <= 3""")
def most_recent_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's three most recently used kinds of event, newest first."""
    from pyspark.sql import Window

    last = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("last_ts"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("last_ts"), "event_type"))
    return last.withColumn("place", place.cast("long")).where("place <= 3").drop("last_ts")
