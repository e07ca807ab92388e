"""Duplicates, leakage between sets, cleaners and their reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspan.functions import text as T
from lexspan.operators import quality
from lexspan.sources.tables import table

from .registry import query
from .retrieval import gold


@query("SELECT doc_id, text FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def exact_dedup_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each text. Survivors are chosen on digests; the texts are only joined, not grouped."""
    return quality.first_of_each(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id")


@query("SELECT item_id, count(*) AS n, min(doc_id) AS first_doc FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1")
def benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that occur inside documents."""
    return gold(spark, sf_dir).groupBy(F.col("query").alias("item_id")).agg(F.count("*").alias("n"), F.min("doc").alias("first_doc"))


_KEY = r"trim(regexp_replace(lower({}), '[\s!-/:-@\[-`{{-~]+', ' ', 'g'))"


@query(f"""WITH t AS (SELECT conv_id, turn, {_KEY.format('text')} AS k FROM conversations), s AS (SELECT DISTINCT {_KEY.format('text')} AS k FROM conversations WHERE role = 'system')
SELECT conv_id, turn FROM t WHERE k IN (SELECT k FROM s)""")
def exact_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose normalised text occurs in another set; the set is compared by digest."""
    c = table(spark, sf_dir, "conversations").withColumn("k", F.md5(T.dedup_key(F.col("text"))))
    return c.select("conv_id", "turn", "k").join(c.where("role = 'system'").select("k"), "k", "left_semi").select("conv_id", "turn")


_SIM = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query(f"""WITH p AS (SELECT a.vec_id AS query, b.vec_id AS doc, round({_SIM}, 8) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query, max(score) AS best, arg_max(doc, {{'s': score, 'd': -doc}}) AS nearest, CASE WHEN max(score) >= 0.35 THEN 'leak' WHEN max(score) >= 0.30 THEN 'borderline' ELSE 'clean' END AS verdict FROM p GROUP BY 1""")
def near_dup_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stated query set (every fiftieth vector) against all vectors: the nearest, and the band it falls in. Bands are where this data has pairs."""
    v = table(spark, sf_dir, "embeddings")
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("qvec"))
    return quality.nearest_by_vector(v.select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vec")), asked, leak=0.35, borderline=0.30)


_CLEAN = f"""
r AS (SELECT c.conv_id, c.turn, c.role AS file, {_KEY.format('c.text')} AS k, c.conv_id % 10 = 3 AS excluded, ('0x' || substr(md5('sim|' || c.conv_id || '|' || c.turn), 1, 8))::BIGINT % 100 / 100.0::DOUBLE AS sim FROM conversations c),
t AS (SELECT DISTINCT {_KEY.format('text')} AS k FROM conversations WHERE conv_id % 17 = 5),
f AS (SELECT r.*, k IN (SELECT k FROM t) AS in_test FROM r)"""
_V2 = f"""WITH {_CLEAN}, o AS (SELECT *, row_number() OVER (PARTITION BY file, k ORDER BY conv_id, turn) AS seen FROM f)
SELECT conv_id, turn, file, sim, CASE WHEN seen > 1 THEN 'duplicate' WHEN excluded THEN 'excluded' WHEN in_test THEN 'test match' WHEN sim >= 0.85 THEN 'similar' ELSE 'kept' END AS verdict FROM o"""
_OLD = f"""WITH {_CLEAN}, e AS (SELECT *, CASE WHEN excluded THEN 'excluded' WHEN in_test THEN 'test match' WHEN sim >= 0.85 THEN 'similar' END AS early FROM f),
o AS (SELECT *, row_number() OVER (PARTITION BY k, early IS NULL ORDER BY conv_id, turn) AS seen FROM e)
SELECT conv_id, turn, file, sim, CASE WHEN early IS NOT NULL THEN early WHEN seen > 1 THEN 'duplicate' ELSE 'kept' END AS verdict FROM o"""


def cleaner_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as training rows: key, exclusion, membership in a test set, and a similarity drawn from a hash (the vectors here have no near pairs)."""
    c = table(spark, sf_dir, "conversations").withColumn("k", F.md5(T.dedup_key(F.col("text"))))
    test = c.where("conv_id % 17 = 5").select("k").distinct().withColumn("in_test", F.lit(True))
    sim = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("sim"), "conv_id", "turn")), 1, 8), 16, 10).cast("long") % 100 / 100.0
    rows = c.select("conv_id", "turn", F.col("role").alias("file"), "k", (F.col("conv_id") % 10 == 3).alias("excluded"), sim.alias("sim"))
    return rows.join(test, "k", "left").withColumn("in_test", F.coalesce("in_test", F.lit(False)))


@query(_V2)
def cleaner_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In-file duplicates first, then exclusions, test matches and similar rows."""
    return quality.clean_duplicates_first(cleaner_rows(spark, sf_dir), ["file", "k"], ["conv_id", "turn"]).select("conv_id", "turn", "file", "sim", "verdict")


@query(_OLD)
def cleaner_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exclusions, test matches and similar rows first; only rows that stay count as seen."""
    return quality.clean_duplicates_last(cleaner_rows(spark, sf_dir), ["k"], ["conv_id", "turn"]).select("conv_id", "turn", "file", "sim", "verdict")


@query(f"SELECT file, verdict, count(*) AS n FROM ({_V2}) GROUP BY 1, 2")
def drop_reason_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaner_v2(spark, sf_dir).groupBy("file", "verdict").agg(F.count("*").alias("n"))


@query(f"SELECT conv_id, turn, sim, verdict FROM ({_V2}) WHERE sim >= 0.80 AND sim < 0.85 ORDER BY sim DESC, conv_id, turn LIMIT 10")
def borderline_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most similar rows of the borderline band, whatever became of them."""
    c = cleaner_v2(spark, sf_dir).where("sim >= 0.80 AND sim < 0.85")
    return c.orderBy(F.desc("sim"), "conv_id", "turn").limit(10).select("conv_id", "turn", "sim", "verdict")


@query("""WITH s AS (SELECT text, ('0x' || substr(md5('row|' || doc_id), 1, 8))::BIGINT % 100 < 25 AS test FROM documents)
SELECT count(*) AS shared FROM (SELECT text FROM s WHERE test INTERSECT SELECT text FROM s WHERE NOT test)""")
def train_test_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts on both sides of a row-level split."""
    from lexspan.operators.features import hash_bucket

    s = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("h"), (hash_bucket("row", F.col("doc_id"), 100) < 25).alias("test"))
    sides = s.groupBy("h").agg(F.bool_or("test").alias("a"), F.bool_or(~F.col("test")).alias("b"))
    return sides.agg(F.count_if(F.col("a") & F.col("b")).alias("shared"))


@query("""WITH p AS (SELECT conv_id, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
SELECT conv_id, count(*) AS pairs, count(*) FILTER (WHERE trim(lower(text)) = trim(lower(before))) AS echoes, count(*) FILTER (WHERE trim(lower(text)) = trim(lower(before))) * 2 > count(*) AS fails FROM p WHERE before IS NOT NULL GROUP BY 1""")
def echo_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that only repeat the one before; a conversation fails if most do."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    p = table(spark, sf_dir, "conversations").select("conv_id", F.trim(F.lower("text")).alias("a"), F.trim(F.lower(F.lag("text").over(w))).alias("b")).where("b IS NOT NULL")
    g = p.groupBy("conv_id").agg(F.count("*").alias("pairs"), F.count_if(F.col("a") == F.col("b")).alias("echoes"))
    return g.withColumn("fails", F.col("echoes") * 2 > F.col("pairs"))


@query("""SELECT lang, count(*) AS n, count(*) FILTER (WHERE text IS NULL OR length(trim(text)) < 50) AS short, count(*) FILTER (WHERE source IS NULL) AS no_source, count(*) - count(DISTINCT doc_id) AS repeated_ids FROM documents GROUP BY 1""")
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null or short texts, missing values and repeated ids by language, after the required columns were checked."""
    d = quality.require_columns(table(spark, sf_dir, "documents"), ["doc_id", "text", "lang", "source"])
    short = F.col("text").isNull() | (F.length(F.trim("text")) < 50)
    return d.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(short).alias("short"), F.count_if(F.col("source").isNull()).alias("no_source"), (F.count("*") - F.count_distinct("doc_id")).alias("repeated_ids"))


@query("""SELECT doc_id, source, CASE WHEN source = 'src3' AND lang = 'en' THEN 'crawl' WHEN source = 'src7' THEN 'mirror' END AS reason, source NOT IN ('src7') AND NOT (source = 'src3' AND lang = 'en') AS kept FROM documents""")
def exclusion_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows against a list of excluded keys, with the reason; the two outputs are the two values of ``kept``."""
    listed = spark.createDataFrame([("src3", "en", "crawl"), *[("src7", x, "mirror") for x in ("en", "fr", "de", "es")]], "source string, lang string, reason string")
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(F.broadcast(listed), ["source", "lang"], "left")
    return d.select("doc_id", "source", "reason", F.col("reason").isNull().alias("kept"))
