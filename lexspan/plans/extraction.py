"""References and entities extracted from texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.functions import text as T
from lexspan.operators.extract import NUMBER_BREAK, POINTING_WORDS, SHORT_NAMES, extract_entities, extract_references, reference_layouts
from lexspan.sources.tables import table

from .registry import query

#: Sentences in every form of reference, made of an order's own values.
SENTENCE = """concat('It was held that ', CASE o_orderkey % 13
 WHEN 0 THEN concat('the Motor Vehicles Act, ', year(o_orderdate), ' – s. ', o_custkey % 300, ' applies')
 WHEN 1 THEN concat('under Transfer of Property Act, ', year(o_orderdate), ': ss. ', o_custkey % 90, ', ', o_custkey % 70, ' and ', o_custkey % 50, 'A')
 WHEN 2 THEN concat('an offence u/s ', o_custkey % 400, ' of the Arms Act was shown')
 WHEN 3 THEN concat('the charge u/ss ', o_custkey % 400, ' and ', o_custkey % 99, ' of the Indian Penal Code fails')
 WHEN 4 THEN concat('Indian Penal Code, 1860 - Sections ', o_custkey % 400, '/', o_custkey % 30)
 WHEN 5 THEN concat('the IPC s. ', o_custkey % 500, '/', o_custkey % 34, ' charge')
 WHEN 6 THEN concat('relief u/s ', o_custkey % 482, ' of Cr.P.C. was sought')
 WHEN 7 THEN concat('Section ', o_custkey % 138, ' of the Negotiable Instruments Act governs')
 WHEN 8 THEN concat('Section ', o_custkey % 151, ' of the Code of Civil Procedure allows it')
 WHEN 9 THEN concat('Section ', o_custkey % 500, ' CrPC and Section ', 100000 + o_custkey, ' of the Act')
 WHEN 10 THEN concat('Article ', o_custkey % 300, ' of the Constitution protects it')
 WHEN 11 THEN concat('Art. ', o_custkey % 30, ' and Section ', o_custkey % 30, '(b) of the Limitation Act')
 ELSE 'no statute was named' END, '.')"""


def _sql() -> str:
    groups = lambda p: ", ".join(f"regexp_extract_all(t, '{p.regex.replace(chr(39), chr(39) * 2)}', {k}) AS {c}" for c, k in (("numbers", p.numbers), ("names", p.name), ("years", p.year)))
    found = " UNION ALL ".join(f"SELECT o_orderkey, '{p.kind}' AS source, '{p.fixed_name}' AS fixed, '{p.prefix}' AS prefix, {groups(p)} FROM s" for p in reference_layouts())
    cases = " ".join(f"WHEN raw = '{k}' THEN '{v}'" for k, v in SHORT_NAMES.items())
    return rf"""
WITH s AS (SELECT o_orderkey, {SENTENCE} AS t FROM orders),
f AS (SELECT o_orderkey, source, fixed, prefix, unnest(numbers) AS numbers, unnest(names) AS raw, unnest(years) AS year FROM ({found})),
n AS (SELECT *, CASE WHEN fixed <> '' THEN fixed ELSE CASE {cases}
        ELSE trim(regexp_replace(regexp_replace(trim(regexp_replace(raw, '\s+', ' ', 'g')), ',+$', ''), '(?i)^(the|of|and) +', '')) END || CASE WHEN coalesce(year, '') <> '' THEN ', ' || year ELSE '' END END AS name FROM f),
e AS (SELECT o_orderkey, name, prefix, source, unnest(regexp_split_to_array(numbers, '{NUMBER_BREAK}')) AS number FROM n WHERE NOT regexp_matches(lower(name), '^(?:{"|".join(POINTING_WORDS)}) (?:act|code)\b'))
SELECT o_orderkey, name, prefix || number AS section, source, length(regexp_replace(number, '[^0-9]', '', 'g')) >= 5 AS low_confidence FROM e"""


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(SENTENCE).alias("t"))
    return extract_references(texts, "t")


@query(_sql())
def citation_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All references in sentences made of the orders table."""
    return references(spark, sf_dir)


@query(f"SELECT source, count(*) AS n, count(DISTINCT name) AS names, count(*) FILTER (WHERE NOT low_confidence) AS sure FROM ({_sql()}) GROUP BY 1")
def citation_counts_by_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("name").alias("names"), F.count_if(~F.col("low_confidence")).alias("sure"))


@query(f"SELECT regexp_replace(CASE WHEN name = 'Indian Penal Code' THEN 'Penal Code' ELSE name END, ',?\\s*\\d{{4}}$', '') AS merged, count(*) AS n, count(DISTINCT o_orderkey) AS texts FROM ({_sql()}) GROUP BY 1")
def normalised_entity_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names without their year, one spelling for two, and their counts."""
    one = F.when(F.col("name") == "Indian Penal Code", "Penal Code").otherwise(F.col("name"))
    return references(spark, sf_dir).groupBy(T.name_without_year(one).alias("merged")).agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("texts"))


ENTITIES = {
    "mail": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ipv4": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
    "phone": r"\+?[0-9][0-9 ()-]{7,}[0-9]",
    "licence": r"Licensed under [A-Za-z ]+",
}


@query("SELECT doc_id, kind, value FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(text, '{rx}')) AS value FROM documents" for k, rx in ENTITIES.items()) + ")")
def entity_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses, numbers and licence lines that do occur in the documents."""
    return extract_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", ENTITIES)


@query("""
WITH m AS (SELECT o_custkey, o_orderkey, concat('Section ', o_orderkey % 50, ' and Section ', o_custkey % 60) AS answer, [(o_orderkey % 50)::VARCHAR, (o_orderkey % 7)::VARCHAR] AS given FROM orders)
SELECT o_orderkey, list_filter(regexp_extract_all(answer, '[Ss]ection\\s+(\\d+[A-Za-z]?)', 1), lambda s: NOT list_contains(given, s)) AS unverified FROM m""")
def verify_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections that an answer names but was not given; repeats stay."""
    o = table(spark, sf_dir, "orders")
    answer = F.concat(F.lit("Section "), F.col("o_orderkey") % 50, F.lit(" and Section "), F.col("o_custkey") % 60)
    given = F.array((F.col("o_orderkey") % 50).cast("string"), (F.col("o_orderkey") % 7).cast("string"))
    m = o.select("o_orderkey", F.regexp_extract_all(answer, F.lit(r"[Ss]ection\s+(\d+[A-Za-z]?)"), F.lit(1)).alias("said"), given.alias("given"))
    return m.select("o_orderkey", F.filter("said", lambda s: ~F.array_contains("given", s)).alias("unverified"))
