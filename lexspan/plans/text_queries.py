"""Text functions over documents, pages, benchmark items and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspan.functions import text as T
from lexspan.sources.tables import table

from .registry import query

_STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def tokens_sql(col: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({col}, '')), '[a-z0-9]+'), lambda w: w NOT IN ({_STOPS}) AND NOT regexp_full_match(w, '[a-z]'))"


@query(f"SELECT doc_id, len({tokens_sql('text')})::INT AS n_tokens, len(list_distinct({tokens_sql('text')}))::INT AS n_distinct, len(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: w NOT IN ({_STOPS})))::INT AS n_letters FROM documents")
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"), T.letter_tokens(F.col("text")).alias("l"))
    return d.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"), F.size("l").alias("n_letters"))


_KEYS = rf"""
SELECT conv_id, turn, md5(regexp_replace(regexp_replace(lower(text), '[ \t\n\r\f\v]+', ' ', 'g'), '^[{T.EDGE_MARKS}]+|[{T.EDGE_MARKS}]+$', '', 'g')) AS cache_md5,
       md5(trim(regexp_replace(lower(text), '[\s!-/:-@\[-`{{-~]+', ' ', 'g'))) AS dedup_md5
FROM conversations"""


@query(_KEYS)
def normalize_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(T.cache_key(F.col("text"))).alias("cache_md5"), F.md5(T.dedup_key(F.col("text"))).alias("dedup_md5"))


@query(r"""
SELECT verdict, count(*) AS n FROM (
  SELECT CASE WHEN t = '' THEN 'blank' WHEN length(t) < 12 THEN 'too_short' WHEN length(text) > 900 THEN 'too_long' ELSE 'ok' END AS verdict
  FROM (SELECT text, regexp_replace(text, '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g') AS t FROM conversations)) GROUP BY 1""")
def query_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all turns taken as queries, with limits at which each verdict occurs here."""
    return table(spark, sf_dir, "conversations").groupBy(T.query_problem(F.col("text"), 12, 900).alias("verdict")).agg(F.count("*").alias("n"))


_QUESTION = """concat('What does ', CASE p_size % 6 WHEN 0 THEN concat('Section ', p_size, ' say') WHEN 1 THEN 'the Act say' WHEN 2 THEN 'this law say' WHEN 3 THEN concat('sec. ', p_size, ' say') WHEN 4 THEN repeat('word ', p_size) ELSE 'the seller owe' END, ' about ', p_name, '?')"""


@query(rf"""
WITH q AS (SELECT p_partkey, {_QUESTION} AS q FROM part)
SELECT p_partkey, CASE {" ".join(f"WHEN regexp_matches(q, '{form}') THEN '{reason}'" for reason, form in T.QUESTION_RULES)}
  WHEN len(regexp_extract_all(q, '[^ \t\n\r\f\v]+')) > 25 THEN 'too long' END AS problem FROM q""")
def question_validator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First reason against questions made from the part table in forms that meet each rule."""
    q = table(spark, sf_dir, "part").select("p_partkey", F.expr(_QUESTION).alias("q"))
    return q.select("p_partkey", T.question_problem(F.col("q")).alias("problem"))


@query(r"""
WITH m AS (SELECT doc_id, n_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS junk, lower(text) AS low,
             len(string_split(text, chr(10))) AS lines, len(list_distinct(string_split(text, chr(10)))) AS kinds FROM documents),
r AS (SELECT doc_id, CASE WHEN n_chars < 40 THEN 'fragment' WHEN junk * 10 > n_chars THEN 'symbols' WHEN lines - kinds > 2 AND 2 * kinds < lines THEN 'repeated lines'
             WHEN contains(low, 'licensed under') OR contains(low, 'all rights reserved') OR contains(low, 'copyright') THEN 'licence marker' END AS reason FROM m)
SELECT coalesce(reason, 'kept') AS reason, count(*) AS n, min(doc_id) AS first_doc FROM r GROUP BY 1""")
def rule_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered placeholder rules, first match wins, and their histogram."""
    low, lines = F.lower("text"), F.split("text", "\n")
    n_lines, kinds = F.size(lines), F.size(F.array_distinct(lines))
    junk = F.regexp_count("text", F.lit("[#*$%&|<>]"))
    rules = [
        ("fragment", F.col("n_chars") < 40),
        ("symbols", junk * 10 > F.col("n_chars")),
        ("repeated lines", (n_lines - kinds > 2) & (2 * kinds < n_lines)),
        ("licence marker", F.contains(low, F.lit("licensed under")) | F.contains(low, F.lit("all rights reserved")) | F.contains(low, F.lit("copyright"))),
    ]
    reason = F.coalesce(T.rule_chain(rules), F.lit("kept"))
    return table(spark, sf_dir, "documents").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query(r"""
SELECT doc_id, CASE WHEN regexp_matches(text, '[ßäöüÄÖÜ]') THEN 'de' WHEN regexp_matches(text, '[ñóáíú¿¡]') THEN 'es' WHEN regexp_matches(text, '[çêèàùœÇÊÈ]') THEN 'fr' ELSE 'en' END AS script_lang,
       len(regexp_extract_all(text, '[^\x00-\x7F\x{2000}-\x{206F}À-ÿ]+'))::INT AS stray, NOT regexp_matches(text, '[^\x00-\x7F]') AS ascii FROM documents""")
def script_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First range of letters that a text has, runs outside a range, and the ASCII test."""
    ranges = {"de": "ßäöüÄÖÜ", "es": "ñóáíú¿¡", "fr": "çêèàùœÇÊÈ"}
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.script_of(F.col("text"), ranges).alias("script_lang"), F.size(T.stray_words(F.col("text"), "À-ÿ")).alias("stray"), (~F.rlike("text", F.lit(r"[^\x00-\x7F]"))).alias("ascii"))


@query(r"""
WITH p AS (SELECT conv_id, text AS original, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS translated FROM conversations)
SELECT conv_id, count(*) AS n_pairs, count(*) FILTER (WHERE length(translated) >= 0.5 * length(original) AND len(regexp_extract_all(translated, '[À-ÿ]')) >= 0.04 * length(translated) AND length(translated) > 0) AS n_translated
FROM p WHERE translated IS NOT NULL GROUP BY 1""")
def looks_translated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns against the next one: long enough, and with enough letters of a range (a twenty-fifth here, Latin-1 letters being rarer than a script's own)."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    p = table(spark, sf_dir, "conversations").select("conv_id", "text", F.lead("text").over(w).alias("t")).where("t IS NOT NULL")
    return p.groupBy("conv_id").agg(F.count("*").alias("n_pairs"), F.count_if(T.looks_translated(F.col("text"), F.col("t"), "À-ÿ", 0.04)).alias("n_translated"))


@query(r"""
SELECT page_id, length(t)::INT AS n_chars, md5(t) AS text_md5 FROM (
  SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(
    regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->|<![^>]*>|</?[a-z][^>]*>', ' ', 'g'),
    '&middot;', '·'), '&copy;', '©'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \t\n\r\f\v]+', ' ', 'g')) AS t FROM pages)""")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "pages").select("page_id", T.html_text(F.col("html")).alias("t"))
    return t.select("page_id", F.length("t").alias("n_chars"), F.md5("t").alias("text_md5"))


@query(r"""
WITH s AS (SELECT p_partkey, p_size, p_name, p_type, unnest(range(1, 2 + p_size % 5)) AS i FROM part)
SELECT p_partkey, i::INT AS ordinal, (i + p_size)::VARCHAR AS section_number, trim(p_name) AS title, length(concat(p_name, CASE WHEN i % 2 = 0 THEN '. ' ELSE '—' END, p_type, ' body.'))::INT AS n_chars FROM s""")
def section_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text cut into numbered sections at its heading lines, with each section's title."""
    from lexspan.operators.extract import split_sections

    body = "concat_ws(chr(10), array('Preamble of the text.'), transform(sequence(1, cast(1 + p_size % 5 as int)), i -> concat(cast(i + p_size as string), '. ', p_name, CASE WHEN i % 2 = 0 THEN '. ' ELSE '—' END, p_type, ' body.')))"
    texts = table(spark, sf_dir, "part").select("p_partkey", F.expr(body).alias("text"))
    return split_sections(texts, "text").select("p_partkey", "ordinal", "section_number", T.title_of(F.col("body")).alias("title"), F.length("body").alias("n_chars"))


@query("""
WITH v AS (SELECT DISTINCT lower(w) AS w FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]{4,}')) AS w FROM benchmark)),
q AS (SELECT DISTINCT lower(w) AS q FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]{4,}')) AS w FROM conversations)),
d AS (SELECT q, w, levenshtein(q, w) AS dist FROM q, v WHERE q <> w AND abs(length(q) - length(w)) <= 2 AND q NOT IN (SELECT w FROM v))
SELECT q AS word, arg_min(w, {'d': dist, 'w': w}) AS suggestion, min(dist)::INT AS distance FROM d WHERE dist <= CASE WHEN length(q) >= 7 THEN 2 ELSE 1 END GROUP BY 1""")
def levenshtein_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest known word of unknown ones, by deletion keys instead of all pairs."""
    from lexspan.operators.extract import suggest_spelling

    words = lambda df, rx: df.select(F.explode(F.regexp_extract_all("text", F.lit(rx), F.lit(0))).alias("w")).select(F.lower("w").alias("w")).distinct()
    known = words(table(spark, sf_dir, "benchmark"), "[A-Za-z]{4,}")
    asked = words(table(spark, sf_dir, "conversations"), "[A-Za-z]{4,}")
    return suggest_spelling(asked, known, "w")


@query("SELECT doc_id, sha256(text) AS sha256, substr(text, 1, 400) AS head, 'DOC-' || lpad(doc_id::VARCHAR, 7, '0') AS label, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+'))::INT AS n_words FROM documents")
def fingerprint_and_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content hash, a cut, a padded label and the word count."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2("text", 256).alias("sha256"), F.substring("text", 1, 400).alias("head"), F.concat(F.lit("DOC-"), F.lpad(F.col("doc_id").cast("string"), 7, "0")).alias("label"), T.word_count(F.col("text")).alias("n_words"))


@query("SELECT event_type, (props->>'$.k')::INT AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k INT")["k"]
    return table(spark, sf_dir, "events").groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"))


_FORM = "concat('Name: ', c_name, chr(10), 'Market Segment: ', c_mktsegment, chr(10), 'Note:', chr(10), 'no colon here', chr(10), 'Name: ', upper(c_name))"


@query("SELECT c_custkey, k, v FROM (SELECT c_custkey, unnest([{'k': 'name', 'v': upper(c_name)}, {'k': 'market_segment', 'v': c_mktsegment}], recursive := true) FROM customer)")
def key_value_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form lines as key and value; empty values fall out and the last of a key stays."""
    made = table(spark, sf_dir, "customer").select("c_custkey", F.explode(T.key_values(F.expr(_FORM))).alias("e"))
    return made.select("c_custkey", "e.k", "e.v")


@query("""
SELECT conv_id, turn, CASE WHEN f >= greatest(d, s) AND f > 0 THEN 'fr' WHEN d >= s AND d > 0 THEN 'de' WHEN s > 0 THEN 'es' END AS lang FROM (
  SELECT conv_id, turn, len(regexp_extract_all(lower(text), '\\b(?:le|la|les|des|une)\\b')) AS f, len(regexp_extract_all(lower(text), '\\b(?:der|die|und|von|das)\\b')) AS d, len(regexp_extract_all(lower(text), '\\b(?:el|los|que|las|del)\\b')) AS s
  FROM (SELECT conv_id, turn, regexp_replace(text, '[^\\x00-\\x7F]', 'z', 'g') AS text FROM conversations))""")
def function_word_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language by hits of whole function words; the first listed wins a tie."""
    words = {"fr": ("le", "la", "les", "des", "une"), "de": ("der", "die", "und", "von", "das"), "es": ("el", "los", "que", "las", "del")}
    ascii_only = F.regexp_replace("text", r"[^\x00-\x7F]", "z")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.romanised(ascii_only, words).alias("lang"))


_ERROR = "concat(CASE event_id % 4 WHEN 0 THEN 'Error 429: Rate limit reached' WHEN 1 THEN 'limit 500000 tokens per day (TPD)' WHEN 2 THEN 'Request timed out' ELSE 'bad gateway' END, ' for user ', user_id)"


@query(f"""
SELECT kind, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(e, 'tokens per day|per day|day limit|daily limit|tpd|rpd') THEN 'daily_limit' WHEN regexp_matches(e, '429|rate limit|too many requests') THEN 'rate_limit' WHEN regexp_matches(e, 'timeout|timed out') THEN 'timeout' ELSE 'other' END AS kind
FROM (SELECT lower({_ERROR}) AS e FROM events WHERE event_type = 'error')) GROUP BY 1""")
def error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    return e.groupBy(T.error_class(F.expr(_ERROR)).alias("kind")).agg(F.count("*").alias("n"))


_ANSWER = "concat('```json', chr(10), CASE WHEN event_id % 3 = 0 THEN '[{\"k\": ' ELSE concat('[{\"k\": ', event_id, '}]') END, chr(10), '```')"


@query("SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN event_id END AS k FROM events")
def tolerant_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fenced answers parsed as JSON; a broken one gives null instead of an error."""
    answer = T.fenced_json(F.expr(_ANSWER))
    parsed = F.from_json(answer, "array<struct<k: bigint>>", {"mode": "PERMISSIVE"})
    return table(spark, sf_dir, "events").select("event_id", F.when(answer.endswith("]"), F.get(parsed, F.lit(0))["k"]).alias("k"))
