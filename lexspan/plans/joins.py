"""Join shapes: lookups, semi and anti joins, defaults and updates, theta and prefix joins, multimaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspan.operators.joins import contains_either_way_top, fallback_join, fallback_outcomes, first_per_key_lookup, lookup_in_order, positional_mismatches, prefix_join
from lexspan.sources.tables import table

from .registry import query


@query("SELECT r.ordinal, c_custkey, c_name FROM (SELECT o_custkey AS k, min(o_orderkey) AS ordinal FROM orders GROUP BY 1) r JOIN customer ON lower(trim(c_name)) = lower('Customer#' || lpad(k::VARCHAR, 9, '0')) ORDER BY 1")
def lookup_preserving_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request keys looked up by normalised name; misses fall out, requests keep their order."""
    asked = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("ordinal"))
    asked = asked.withColumn("name", F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")))
    return lookup_in_order(asked, table(spark, sf_dir, "customer"), "name", "c_name", "ordinal").select("ordinal", "c_custkey", "c_name")


@query("SELECT c_custkey, coalesce(max(o_orderpriority), 'no order found') AS priority FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY 1")
def left_join_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.max("o_orderpriority").alias("p"))
    joined = table(spark, sf_dir, "customer").join(top, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.coalesce("p", F.lit("no order found")).alias("priority"))


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL AND l.toxic = 1 THEN 'toxic' ELSE d.source END AS source FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_join_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column replaced where the other table matches."""
    flagged = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id", F.lit("toxic").alias("new"))
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(flagged, "doc_id", "left").select("doc_id", F.coalesce("new", "source").alias("source"))


@query("""
WITH k AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN upper(p_brand) ELSE p_brand END AS want FROM part),
b AS (SELECT DISTINCT p_brand FROM part)
SELECT p_partkey, coalesce(e.p_brand, i.p_brand) AS brand FROM k LEFT JOIN b e ON e.p_brand = want LEFT JOIN b i ON lower(i.p_brand) = lower(want)
WHERE coalesce(e.p_brand, i.p_brand) IS NOT NULL""")
def fallback_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact key first, then the key without case; rows that neither finds fall out."""
    part = table(spark, sf_dir, "part")
    asked = part.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.upper("p_brand")).otherwise(F.col("p_brand")).alias("want"))
    known = part.select(F.col("p_brand").alias("brand")).distinct()
    return fallback_join(asked, known, "want", "brand").select("p_partkey", "brand")


@query("""
WITH k AS (SELECT CASE WHEN p_partkey % 7 = 0 THEN p_brand || '?' WHEN p_partkey % 3 = 0 THEN upper(p_brand) ELSE p_brand END AS want FROM part),
b AS (SELECT DISTINCT p_brand FROM part)
SELECT CASE WHEN e.p_brand IS NOT NULL THEN 'exact' WHEN i.p_brand IS NOT NULL THEN 'without case' ELSE 'missed' END AS outcome, count(DISTINCT want) AS keys, count(*) AS n
FROM k LEFT JOIN b e ON e.p_brand = want LEFT JOIN b i ON lower(i.p_brand) = lower(want) GROUP BY 1""")
def fallback_key_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many keys, and rows, the exact key finds, the key without case finds, and none finds."""
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    want = F.when(k % 7 == 0, F.concat("p_brand", F.lit("?"))).when(k % 3 == 0, F.upper("p_brand")).otherwise(F.col("p_brand"))
    return fallback_outcomes(part.select(want.alias("want")), part.select(F.col("p_brand").alias("brand")), "want", "brand")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id", "left_semi")


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_join_uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("""
SELECT n_name, p_partkey FROM (
  SELECT n_name, p_partkey, row_number() OVER (PARTITION BY n_name ORDER BY p_partkey) AS r
  FROM (SELECT n_name, n_nationkey, lower(substr(n_name, 1, 3)) AS stem FROM nation) n JOIN part ON p_size = n_nationkey + 1
    AND (contains(lower(p_type), substr(stem, 1, 1)) OR contains(stem, lower(substr(p_type, 1, 1))))) WHERE r <= 3""")
def theta_contains_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An equi-join with a containment test either way as residue, and the first three of each left row."""
    nation = table(spark, sf_dir, "nation").select("n_name", (F.col("n_nationkey") + 1).alias("k"), F.lower(F.substring("n_name", 1, 1)).alias("a"))
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("size"), F.lower("p_type").alias("b"))
    return contains_either_way_top(nation, part, "k", "size", "a", "b", "n_name", "p_partkey", 3, right_stem=1).select("n_name", "p_partkey")


@query("SELECT n_nationkey, (SELECT min(p_partkey) FROM part WHERE p_size = n_nationkey + 1 AND contains(p_type, 'STEEL')) AS p_partkey FROM nation")
def contains_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row, in id order, that contains a text and has the key."""
    hits = table(spark, sf_dir, "part").where(F.contains("p_type", F.lit("STEEL"))).groupBy("p_size").agg(F.min("p_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "nation").join(hits, F.col("n_nationkey") + 1 == F.col("p_size"), "left").select("n_nationkey", "p_partkey")


@query("""
WITH u AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p, length(text) AS n FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p, length(text) AS n FROM conversations WHERE role = 'assistant')
SELECT conv_id, p::INT AS p, u.n::INT AS left_n, a.n::INT AS right_n FROM u FULL JOIN a USING (conv_id, p) WHERE u.n IS NULL OR a.n IS NULL OR a.n < u.n""")
def positional_zip_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists paired by place within a group; unpaired places and pairs that break a rule are reported."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))
    return positional_mismatches(c.where("role = 'user'"), c.where("role = 'assistant'"), "conv_id", "turn", "n", lambda a, b: b < a)


@query("""
WITH f AS (SELECT lang, source, arg_min(n_chars, doc_id) AS first_chars FROM documents GROUP BY 1, 2)
SELECT d.doc_id, f.first_chars FROM documents d JOIN labels l USING (doc_id) LEFT JOIN f ON f.lang = d.lang AND f.source = 'src' || (d.doc_id % 25)""")
def group_first_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first value of each group of the one table, mapped onto the other; null where there is none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    asked = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id").select("doc_id", "lang", F.concat(F.lit("src"), F.col("doc_id") % 25).alias("source"))
    return first_per_key_lookup(asked, docs, ["lang", "source"], "n_chars", "doc_id", "first_chars").select("doc_id", "first_chars")


@query("SELECT o.o_orderkey, l.l_suppkey FROM (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') o JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) l ON o.o_orderkey = l.l_orderkey")
def multimap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key to a list of targets, each once, as rows."""
    many = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("targets"))
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey")
    return urgent.join(many, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.explode("targets").alias("l_suppkey"))


@query("SELECT item_id, word FROM (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{6,}'))) AS word FROM benchmark)")
def gold_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each of several expected values."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0)))
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(words).alias("word"))


@query("""
WITH p AS (SELECT item_id, text FROM benchmark), k AS (SELECT DISTINCT split_part(text, ' ', 1) AS prefix FROM benchmark UNION SELECT DISTINCT array_to_string(string_split(text, ' ')[1:3], ' ') FROM benchmark WHERE item_id % 2 = 0)
SELECT item_id, prefix, substr(text, length(prefix) + 2) AS rest FROM p JOIN k ON starts_with(text, prefix || ' ')""")
def prefix_match_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts joined to the prefixes they start with. Prefixes end at a word, so the join is on the text's own leading words: an equi-join, not all pairs."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    words = F.split("text", " ")
    three = items.where("item_id % 2 = 0").select(F.array_join(F.slice(words, 1, 3), " ").alias("prefix"))
    prefixes = items.select(F.get(words, F.lit(0)).alias("prefix")).union(three).distinct()
    return prefix_join(items, prefixes, "text", "prefix").select("item_id", "prefix", "rest")


@query("SELECT s_suppkey, t.template || ' ' || s_name AS line FROM supplier, (VALUES ('ask'), ('tell'), ('show')) t(template)")
def cross_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row with each of a fixed list of templates: an explode of a literal array, no join."""
    made = F.transform(F.array(*map(F.lit, ("ask", "tell", "show"))), lambda t: F.concat_ws(" ", t, "s_name"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(made).alias("line"))


@query("""
SELECT d.doc_id, d.lang = 'en' AS strict, d.lang = 'en' OR coalesce(l.quality, 0) = 1 AS lenient FROM documents d LEFT JOIN labels l USING (doc_id)""")
def label_or_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A strict verdict, and a lenient one that a second label may also grant."""
    second = table(spark, sf_dir, "labels").select("doc_id", "quality")
    j = table(spark, sf_dir, "documents").select("doc_id", "lang").join(second, "doc_id", "left")
    strict = F.col("lang") == "en"
    return j.select("doc_id", strict.alias("strict"), (strict | (F.coalesce("quality", F.lit(0)) == 1)).alias("lenient"))


@query("SELECT user_id, event_id, (SELECT max(p.ts) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'view' AND p.ts <= e.ts) AS viewed_at FROM events e WHERE event_type = 'purchase'")
def as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the user's latest view at or before it: a union and a running last value, one shuffle."""
    e = table(spark, sf_dir, "events").where("event_type IN ('purchase', 'view')").select("user_id", "event_id", "ts", "event_type")
    before = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    seen = e.withColumn("viewed_at", F.max(F.when(F.col("event_type") == "view", F.col("ts"))).over(before))
    return seen.where("event_type = 'purchase'").select("user_id", "event_id", "viewed_at")
