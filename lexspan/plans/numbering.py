"""Old and new section numbers, and laws cut into sections, over texts made of the part table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.functions import text as T
from lexspan.operators import numbering
from lexspan.operators.numbering import PENAL_CODE
from lexspan.sources.tables import table

from .registry import query

#: A mapping made of the parts' sizes: each size maps, one in five to two numbers, one in seven to none, and its form with a letter to another.
_MAP = """
SELECT CAST(p_size AS STRING) AS old, CAST(2 * p_size AS STRING) AS new, CASE WHEN p_size % 7 = 0 THEN 'omitted' ELSE 'direct' END AS relation, 1 AS o FROM {part}
UNION ALL SELECT CAST(p_size AS STRING), CAST(2 * p_size + 1 AS STRING), 'split', 2 FROM {part} WHERE p_size % 5 = 0 AND p_size % 7 <> 0
UNION ALL SELECT concat(p_size, 'A'), concat('1', p_size), 'direct', 3 FROM {part}
UNION ALL SELECT '420', '318', 'direct', 4 FROM {part} UNION ALL SELECT 'n/a', '9', 'direct', 5 FROM {part}"""
_ASKED = """CASE p_partkey % 8 WHEN 0 THEN concat('What is IPC ', p_size, '?') WHEN 1 THEN concat('Explain section ', p_size, ' a of the Indian Penal Code and ', p_size + 1)
 WHEN 2 THEN concat('Is ', p_size, 'A bailable, or ', p_size, '?') WHEN 3 THEN 'what is a 420 case' WHEN 4 THEN concat('Section ', p_size, ' of the Contract Act')
 WHEN 5 THEN concat('IPC ', p_size, ' and IPC ', p_size, ' and ', p_size + 2) WHEN 6 THEN '420 things' ELSE p_name END"""
_TOLD = """CASE p_partkey % 8 WHEN 0 THEN concat('Convicted under Sections ', p_size, ', ', p_size + 1, ' and ', p_size, 'A of the Indian Penal Code.') WHEN 1 THEN concat('Section ', p_size, ' CrPC and section ', p_size + 3, ' IPC apply')
 WHEN 2 THEN concat('charged with IPC sec. ', p_size, ' or ', p_size + 5, ' (b) IPC') WHEN 3 THEN concat('Section ', p_size, ' of the Contract Act only') WHEN 4 THEN concat('s. 999 and s. ', 600 + p_size, ' of the IPC')
 WHEN 5 THEN concat('Section', chr(10), p_size, ' read with', chr(10), 'section ', p_size + 9, ' of the IPC, and again ', p_size, ' IPC') WHEN 6 THEN '420 IPC' ELSE p_name END"""


def _mapping_sql() -> str:
    made = _MAP.format(part="part").replace("STRING", "VARCHAR")
    return f"""raw AS (SELECT lower(trim(old)) AS old, CASE WHEN relation <> 'omitted' THEN new END AS new, min(o) AS o FROM ({made}) WHERE old <> 'n/a' GROUP BY 1, 2),
map AS (SELECT old, new, row_number() OVER (PARTITION BY old ORDER BY (new IS NULL)::INT, o)::INT AS ordinal FROM raw QUALIFY new IS NOT NULL OR row_number() OVER (PARTITION BY old ORDER BY (new IS NULL)::INT, o) = 1)"""


def mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "part").select("p_size").createOrReplaceTempView("__sizes")
    return numbering.number_map(spark.sql(_MAP.format(part="__sizes")), "old", "new", "relation", "o")


_FAMOUS = " OR ".join(f"(regexp_matches(low, '\\b{n}\\b') AND regexp_matches(low, '{'|'.join(w)}'))" for n, w in PENAL_CODE.famous)


@query(rf"""WITH {_mapping_sql()},
t AS (SELECT p_partkey, {_ASKED} AS text FROM part),
l AS (SELECT *, regexp_replace(lower(text), '\b(\d+)\s+([a-z]{{1,2}})\b', '\1\2', 'g') AS low FROM t),
f AS (SELECT p_partkey, text, CASE WHEN regexp_matches(low, '\b(?:{PENAL_CODE.name})\b') THEN regexp_extract_all(low, '\b(\d+[a-z]*)\b', 1)
        ELSE list_concat(regexp_extract_all(low, '\b(\d+[a-z]+)\b', 1), CASE WHEN {_FAMOUS} THEN ['420'] ELSE [] END) END AS found FROM l),
u AS (SELECT p_partkey, number, min(place) AS place FROM (SELECT p_partkey, unnest(found) AS number, generate_subscripts(found, 1) AS place FROM f) GROUP BY 1, 2),
m AS (SELECT p_partkey, place, number, ordinal, new FROM u JOIN map ON old = number)
SELECT f.p_partkey, coalesce((SELECT list(number ORDER BY place) FROM (SELECT DISTINCT place, number FROM m WHERE m.p_partkey = f.p_partkey)), []) AS numbers,
       concat_ws(' ', text, (SELECT string_agg('bns section ' || new, ' ' ORDER BY place, ordinal) FROM m WHERE m.p_partkey = f.p_partkey AND new IS NOT NULL)) AS expanded FROM f""")
def query_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with the new numbers of the old sections that they name."""
    asked = table(spark, sf_dir, "part").select("p_partkey", F.expr(_ASKED).alias("text"))
    return numbering.expand_query_numbers(asked, "p_partkey", "text", mapping(spark, sf_dir))


@query(rf"""WITH {_mapping_sql()},
t AS (SELECT p_partkey, regexp_replace(lower({_TOLD}), '\s+', ' ', 'g') AS flat FROM part),
c AS (SELECT *, list_transform(regexp_extract_all(flat, '\b(?:sections?|sec\.?|s\.?)\s+([0-9a-z\s,/&–-]+?)\s*(?:of\s+the\s+)?(?:{PENAL_CODE.name})\b', 1), lambda part: regexp_split_to_array(part, '\b(?:{"|".join(PENAL_CODE.others)})\b')[-1]) AS lists FROM t),
f AS (SELECT p_partkey, list_concat(list_concat(flatten(list_transform(lists, lambda part: regexp_extract_all(part, '\b(\d+[a-z]*)\b', 1))),
        regexp_extract_all(flat, '\bipc\s*(?:sections?|sec\.?|s\.?)?\s*(\d+[a-z]*)\b', 1)), regexp_extract_all(flat, '\b(\d+[a-z]*)\s*(?:\([a-z0-9\s]+\)\s*)?ipc\b', 1)) AS found FROM c),
u AS (SELECT p_partkey, number, min(place) AS place FROM (SELECT p_partkey, unnest(found) AS number, generate_subscripts(found, 1) AS place FROM f) GROUP BY 1, 2),
m AS (SELECT p_partkey, place, number, arg_min(new, coalesce(ordinal, 0)) AS new FROM u LEFT JOIN map ON old = number
      WHERE old IS NOT NULL OR coalesce(try_cast(regexp_extract(number, '^(\d+)', 1) AS INT) BETWEEN 1 AND 511, false) GROUP BY 1, 2, 3)
SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY place)::INT AS place, 'IPC ' || upper(number) AS cited, 'BNS ' || new AS now FROM m""")
def document_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old sections that documents cite, and what they are now; sections of other laws are left out."""
    told = table(spark, sf_dir, "part").select("p_partkey", F.expr(_TOLD).alias("text"))
    return numbering.law_references(told, "p_partkey", "text", mapping(spark, sf_dir))


_LAW = """concat('ARRANGEMENT', chr(10), 'THE ACT', chr(10), '1. Short title', chr(10), '2. Wrong place', chr(10), 'THE ACT', chr(10), 'Preface.', chr(10), '1. The ', p_name, ' — in force.', chr(10), '17', chr(10), 'More of it, see rule 5.', chr(10),
 '2. 4 The ', p_type, ' is meant. IndiaCode here.', chr(10), '99. Out of range.', chr(10), '3. [Omitted] ', p_brand, chr(10), '2. Again, but late.', chr(10), '4. Last ', p_size)"""


@query("""WITH p AS (SELECT * FROM part),
s AS (SELECT p_partkey, 1 AS n, concat('The ', p_name, ' — in force. More of it, see rule 5.') AS body FROM p UNION ALL SELECT p_partkey, 2, concat('The ', p_type, ' is meant. here.') FROM p
  UNION ALL SELECT p_partkey, 3, concat('[Omitted] ', p_brand) FROM p UNION ALL SELECT p_partkey, 4, concat('Last ', p_size) FROM p)
SELECT p_partkey, n::INT AS section_number, n::INT AS ordinal, trim(regexp_replace(body, '\\s+', ' ', 'g')) AS body FROM s""")
def law_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laws with a table of contents, a page mark, a footnote mark, a number out of range and a repeated one, cut into their sections."""
    laws = table(spark, sf_dir, "part").select("p_partkey", F.expr(_LAW).alias("text"))
    return numbering.split_in_range(laws, "text", "THE ACT", 1, 31, noise=("IndiaCode",))


@query("""SELECT p_partkey, concat(p_name, ', Section ', p_size, ': ', p_type, '. ', substr(p_comment, 1, 10)) AS document, regexp_replace(trim(regexp_replace(p_type, '\\s+', ' ', 'g')), '\\.+$', '') AS concept,
  CASE WHEN length(p_type) >= 5 THEN p_type END AS topic FROM (SELECT *, p_brand AS p_comment FROM part)""")
def document_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's text for a model, its concept, and its topic where that is long enough."""
    p = table(spark, sf_dir, "part")
    topic = F.when(T.is_topic(F.col("p_type")), F.col("p_type"))
    return p.select("p_partkey", T.document_text(F.col("p_name"), F.col("p_size").cast("string"), F.col("p_type"), F.col("p_brand"), 10).alias("document"), T.concept_of(F.col("p_type")).alias("concept"), topic.alias("topic"))


@query(r"""SELECT doc_id, unnest(regexp_extract_all(text, '[^\n]{20}(?:all|and|und|de|el)[^\n]{20}')) AS snippet FROM documents""")
def context_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty characters of a line on both sides of a word."""
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(T.snippets(F.col("text"), "all|and|und|de|el", 20)).alias("snippet"))


@query(r"""WITH p AS (SELECT conv_id, text AS original, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS translated FROM conversations)
SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN trim(translated) = '' THEN 'empty' WHEN lower(trim(translated)) = lower(trim(original)) THEN 'echo' WHEN regexp_matches(translated, '[À-ÿ]') THEN 'untranslated' ELSE 'ok' END AS verdict FROM p WHERE translated IS NOT NULL) GROUP BY 1""")
def translation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns against the next one as its translation: empty, an echo, or with letters of the source's script left."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    p = table(spark, sf_dir, "conversations").select("text", F.lead("text").over(w).alias("t")).where("t IS NOT NULL")
    return p.groupBy(T.translation_problem(F.col("text"), F.col("t"), "À-ÿ").alias("verdict")).agg(F.count("*").alias("n"))
