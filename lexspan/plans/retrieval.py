"""Ranked retrieval: benchmark items as queries against documents, and vectors against vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspan.functions import text as T
from lexspan.operators import index, retrieval
from lexspan.operators.search import BM25, DENSE, HYBRID, Ranking, Rule, factor_sql, nearest_in_blocks, search
from lexspan.sources.scratch import materialise
from lexspan.sources.tables import table

from .registry import query
from .text_queries import tokens_sql

#: An own small dictionary: a key found in the query adds its phrases, in this order.
SYNONYMS = {"the": ("article", "determiner"), "ing": ("gerund",), "was": ("past tense", "been"), "with": ("together",)}
#: A phrase that is added where words of two kinds meet in the query, as (first kind, second kind, phrase).
PAIRED = ((r"\b(?:und|der|die)\b", r"\b(?:el|la|los)\b", "two languages"),)
EXPANDED_SQL = "concat_ws(' ', lower(text), " + ", ".join([f"CASE WHEN contains(lower(text), '{k}') THEN '{' '.join(v)}' END" for k, v in SYNONYMS.items()] + [f"CASE WHEN regexp_matches(lower(text), '{a}') AND regexp_matches(lower(text), '{b}') THEN '{p}' END" for a, b, p in PAIRED]) + ")"

RULES = (
    Rule("english", "true", "lang = 'en'", 1.25),
    Rule("licence", "true", "lower(text) LIKE '%licensed under%'", 0.3),
    Rule("long", "true", "n_chars > 5000", 1.5),
    Rule("crawl", "true", "source = 'src0'", 0.7),
    Rule("german", "q LIKE '%und %'", "lang = 'de'", 1.25),
    Rule("german, elsewhere", "q LIKE '%und %'", "lang = 'fr'", 0.7),
    Rule("spanish", "q LIKE '%el %' OR q LIKE '%los %'", "lang = 'es'", 1.2),
    Rule("french", "q LIKE '%le %' AND q LIKE '%t%'", "lang = 'fr' AND lower(text) LIKE '%les %'", 2.0),
    Rule("determiner", "x LIKE '%determiner%'", "lower(text) LIKE '%the %'", 1.25),
    Rule("short for short", "length(q) < 300", "n_chars < 1000", 1.2),
    Rule("two sources", "q LIKE '%de%' AND q LIKE '%a%'", "source IN ('src1', 'src2') AND lower(text) LIKE '%ing%'", 2.5),
    Rule("rights", "q LIKE '%ra%'", "lower(text) LIKE '%all rights reserved%' OR n_chars < 3000", 1.5, phase="post"),
    Rule("gerund or less", "x LIKE '%gerund%'", "lower(text) LIKE '%ing%'", 1.0, otherwise=0.3, phase="post"),
)


def bm25_cte(text: str = "text") -> str:
    """BM25 of the benchmark items, taken as the SQL ``text``, against all documents that share a term."""
    return f"""
tok AS (SELECT doc_id AS doc, {tokens_sql('text')} AS tokens FROM documents),
size AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM tok),
dfs AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(tokens)) AS term FROM tok) GROUP BY 1),
raws AS (SELECT term, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM dfs, size),
mean AS (SELECT avg(raw) AS m FROM raws),
stats AS (SELECT term, CASE WHEN raw < 0 THEN 0.25::DOUBLE * m ELSE raw END AS idf FROM raws, mean),
asked AS (SELECT query, term, count(*) AS times FROM (SELECT item_id AS query, unnest({tokens_sql(text)}) AS term FROM benchmark) GROUP BY 1, 2),
posted AS (SELECT doc, dl, term, count(*) AS tf FROM (SELECT doc, len(tokens) AS dl, unnest(tokens) AS term FROM tok) WHERE term IN (SELECT term FROM asked) GROUP BY 1, 2, 3),
bm25 AS (SELECT query, doc, round(sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 8) AS score, count(*) AS matched
         FROM posted JOIN stats USING (term) JOIN asked USING (term), size GROUP BY 1, 2)"""


BM25_CTE = bm25_cte()
#: All documents for each query, whether they share a term or not.
_ALL_PAIRS = """,
pairs AS (SELECT i.item_id AS query, t.doc_id AS doc, coalesce(b.matched, 0) AS matched, coalesce(b.score, 0.0::DOUBLE) AS bm25, max(coalesce(b.score, 0.0::DOUBLE)) OVER (PARTITION BY i.item_id) AS best,
            CASE WHEN d.vec_id IS NULL OR q.vec_id IS NULL THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, list_dot_product(d.embedding::DOUBLE[], q.embedding::DOUBLE[]))) END AS dense
          FROM benchmark i CROSS JOIN documents t LEFT JOIN bm25 b ON b.query = i.item_id AND b.doc = t.doc_id LEFT JOIN embeddings d ON d.vec_id = t.doc_id LEFT JOIN embeddings q ON q.vec_id = i.item_id),
hyb AS (SELECT query, doc, matched, bm25, share, dense, round(0.15::DOUBLE * share + 0.85::DOUBLE * dense, 8) AS score FROM (SELECT *, CASE WHEN best > 0 THEN bm25 / best ELSE bm25 END AS share FROM pairs))"""
HYBRID_CTE = BM25_CTE + _ALL_PAIRS
EXPANDED_CTE = bm25_cte(EXPANDED_SQL) + _ALL_PAIRS
FACTOR_SQL = factor_sql(RULES)
_BOOSTED = f""",
asks AS (SELECT item_id AS query, lower(text) AS q, {EXPANDED_SQL} AS x FROM benchmark),
boosted AS (SELECT query, doc, matched, bm25, share, dense, round(h.score * ({FACTOR_SQL}) + 1e-11::DOUBLE, 8) AS score, h.score AS plain FROM hyb h JOIN documents ON doc_id = doc JOIN asks USING (query))"""
BOOST_CTE = HYBRID_CTE + _BOOSTED
BOOSTED = retrieval.boosted("boosted", RULES)


def _rank(cte: str, source: str, k: int = 5, score: str = "score") -> str:
    return f"WITH {cte} SELECT query, doc, {score} AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY {score} DESC, doc)::INT AS rank FROM {source}) WHERE rank <= {k}"


def best(spark: SparkSession, sf_dir: str, rankings: Sequence[Ranking], k: int, expanded: bool = False, matching_only: bool = False) -> DataFrame:
    """The k best of all documents for each benchmark item (or its expanded form) and ranking."""
    docs = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "doc")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("item"))
    wide = T.expand_query(F.lower("item"), SYNONYMS, PAIRED)
    asked = items.select("query", (wide if expanded else F.col("item")).alias("text"), F.lower("item").alias("q"), wide.alias("x"))
    if all(r.dense == 0 for r in rankings):
        return search(docs, asked, rankings, k, matching_only=matching_only)
    vectors = table(spark, sf_dir, "embeddings")
    asked = asked.join(vectors.select(F.col("vec_id").alias("query"), F.col("embedding").alias("qvec")), "query", "left")
    return search(docs, asked, rankings, k, vectors.select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vec")))


def bm25_ranks(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """query, doc, score, matched and rank of the k best documents that share a term with the query."""
    return best(spark, sf_dir, [BM25], k, matching_only=True).select("query", "doc", "score", "matched", "rank")


@query(_rank(BM25_CTE, "bm25"))
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best documents for each benchmark item by BM25."""
    return bm25_ranks(spark, sf_dir, 5).drop("matched")


@query("""
SELECT query, doc, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc)::INT AS rank FROM (
  SELECT q.vec_id AS query, d.vec_id AS doc, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, list_dot_product(d.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 8) AS score
  FROM embeddings d, embeddings q WHERE q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id)) WHERE rank <= 5""")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors to each of a stated query set (every fiftieth vector), against all vectors."""
    v = table(spark, sf_dir, "embeddings")
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("qvec"))
    return nearest_in_blocks(v.select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vec")), asked, 5)


@query(_rank(HYBRID_CTE, "hyb"))
def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all documents by words and vectors, also where no word is shared."""
    return best(spark, sf_dir, [HYBRID], 5).select("query", "doc", "score", "rank")


@query(_rank(BOOST_CTE, "boosted"))
def boosted_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hybrid order under rules that read query, expanded query and document."""
    return best(spark, sf_dir, [BOOSTED], 5).select("query", "doc", "score", "rank")


@query("WITH " + BOOST_CTE + """,
o AS (SELECT query, doc, CASE WHEN doc % 97 = query % 97 THEN round(max(score) OVER (PARTITION BY query) + 1 + (doc // 97), 8) ELSE score END AS score FROM boosted)
SELECT query, doc, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc)::INT AS rank FROM o) WHERE rank <= 5""")
def override_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that a rule names for the query come first, by priority. The rule names them by an equi-join, of which five a query matter."""
    others = best(spark, sf_dir, [BOOSTED], 5).select("query", "doc", "score")
    key = lambda c: F.pmod(c, F.lit(97))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), key(F.col("doc_id")).alias("key"), F.floor(F.col("doc_id") / 97).alias("priority"))
    first = index.top_k(docs, 5, "key", "priority").drop("rank")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), key(F.col("item_id")).alias("key"))
    named = items.join(first, "key").select("query", "doc", "priority")
    top = others.groupBy("query").agg(F.max("score").alias("top"))
    scored = named.join(top, "query").select("query", "doc", F.round(F.col("top") + 1 + F.col("priority"), 8).alias("score"))
    return index.top_k(others.join(named.select("query", "doc"), ["query", "doc"], "left_anti").union(scored), 5, "query").select("query", "doc", "score", "rank")


_TERMS = "terms AS (SELECT query, count(*) AS n_terms FROM asked GROUP BY 1)"
_RERANK = f"""WITH {BOOST_CTE}, {_TERMS},
p AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS place FROM boosted LEFT JOIN terms USING (query)),
t AS (SELECT query, doc, score, place, round(CASE WHEN max(score) OVER (PARTITION BY query) > 0 THEN 0.2::DOUBLE * score / max(score) OVER (PARTITION BY query) ELSE 0.0::DOUBLE END + CASE WHEN place <= 10 THEN 0.8::DOUBLE * (1 / (1 + exp(-(8.0::DOUBLE * matched / greatest(coalesce(n_terms, 1), 1) - 4)))) ELSE 0.0::DOUBLE END, 8) AS final FROM p WHERE place <= 20)
SELECT query, doc, final, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY (place > 10)::INT, final DESC, doc)::INT AS rank FROM t) WHERE rank <= 5"""


def _with_overlap(spark: SparkSession, sf_dir: str, pool: int = 20) -> DataFrame:
    """A pool of boosted rows with a second scorer: the share of the query's distinct terms that the document has."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.greatest(F.size(F.array_distinct(T.tokens(F.col("text")))), F.lit(1)).alias("n_terms"))
    return best(spark, sf_dir, [BOOSTED], pool).join(asked, "query").withColumn("relevance", F.lit(8.0) * F.col("matched") / F.col("n_terms") - 4)


@query(_RERANK)
def two_phase_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pool of 20, the first 10 re-ranked by a second scorer."""
    return retrieval.two_phase(_with_overlap(spark, sf_dir), "relevance").select("query", "doc", "final", "rank")


@query("WITH " + HYBRID_CTE + """,
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM hyb)
SELECT query, max(score) AS best, max(score) < 0.3::DOUBLE AS low_confidence, CASE WHEN max(score) < 0.3::DOUBLE THEN string_agg('Document ' || doc, '; ' ORDER BY rank) END AS candidates FROM r WHERE rank <= 5 GROUP BY 1""")
def low_confidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries whose best score is low give their candidates as a text instead of an answer."""
    top = best(spark, sf_dir, [HYBRID], 5)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc"))), lambda x: F.concat(F.lit("Document "), x["doc"])), "; ")
    g = top.groupBy("query").agg(F.max("score").alias("best"), listed.alias("listed"))
    low = F.col("best") < 0.3
    return g.select("query", "best", low.alias("low_confidence"), F.when(low, F.col("listed")).alias("candidates"))


@query("WITH " + BOOST_CTE + """,
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank, CASE WHEN max(score) OVER (PARTITION BY query) > 0 THEN score / max(score) OVER (PARTITION BY query) ELSE 0 END AS ratio FROM boosted)
SELECT query, doc, CASE WHEN ratio >= 0.95 THEN 'high' WHEN ratio >= 0.80 THEN 'medium' ELSE 'low' END AS band FROM r WHERE rank <= 10""")
def confidence_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best(spark, sf_dir, [BOOSTED], 10).select("query", "doc", retrieval.confidence_band(F.col("score")).alias("band"))


@query("WITH " + HYBRID_CTE + """,
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM hyb)
SELECT query, doc, matched_terms FROM r JOIN tok USING (doc) JOIN (SELECT item_id AS query, """ + tokens_sql("text") + """ AS qt FROM benchmark) USING (query),
LATERAL (SELECT list_slice(list_filter(list_distinct_ordered, lambda w: list_contains(tokens, w)), 1, 5) AS matched_terms FROM (SELECT list_filter(qt, lambda w, i: list_position(qt, w) = i) AS list_distinct_ordered)) WHERE rank <= 3""")
def matched_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query terms found in each of the best documents, first five."""
    top = best(spark, sf_dir, [HYBRID], 3).select("query", "doc")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), T.tokens(F.col("text")).alias("dt"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), T.tokens(F.col("text")).alias("qt"))
    return top.join(docs, "doc").join(asked, "query").select("query", "doc", T.matched_terms(F.col("qt"), F.col("dt")).alias("matched_terms"))


@query(f"SELECT item_id, {EXPANDED_SQL} AS expanded FROM benchmark")
def expand_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", T.expand_query(F.lower("text"), SYNONYMS, PAIRED).alias("expanded"))


@query("WITH " + BOOST_CTE + """,
v AS (SELECT query, 'plain' AS variant, max(plain) AS best FROM boosted GROUP BY 1 UNION ALL SELECT query, 'boosted', max(score) FROM boosted GROUP BY 1)
SELECT query, arg_max(variant, {'b': best, 'p': (variant = 'plain')::INT}) AS chosen, max(best) AS best FROM v GROUP BY 1""")
def best_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two runs of a query the one with the higher best score; the original on a tie."""
    top = best(spark, sf_dir, [HYBRID, BOOSTED], 1)
    b = top.groupBy("query").agg(F.max(F.when(F.col("ranking") == "hybrid", F.col("score"))).alias("p"), F.max(F.when(F.col("ranking") == "boosted", F.col("score"))).alias("s"))
    return b.select("query", F.when(F.col("s") > F.col("p"), "boosted").otherwise("plain").alias("chosen"), F.greatest("s", "p").alias("best"))


GOLD_CTE = "gold AS (SELECT item_id AS query, doc_id AS doc FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query, doc) of documents that contain an item's text. Candidates share three inner tokens of the item, which containment leaves whole, by an equi-join; containment decides."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("item"))
    parts = F.split("item", r"[ \n]")  # the first and the last may be parts of longer tokens in a document
    inner = F.coalesce(F.size(parts), F.lit(0)) >= 5
    keyed = items.where(inner).withColumn("head", F.array_join(F.slice(parts, 2, 3), " "))
    words, n = F.col("w"), F.size("w")
    joined = lambda a, b: F.concat(a, F.lit(" "), b)
    triples = F.zip_with(F.zip_with(words, F.slice(words, 2, n), joined), F.slice(words, 3, n), joined)  # the last two are null
    wanted = docs.select("doc", F.split("text", r"[ \n]").alias("w")).select("doc", F.explode(F.array_distinct(triples)).alias("head")).join(keyed.select("query", "head"), "head").select("query", "doc").distinct()
    sure = wanted.join(docs, "doc").join(items, "query").where(F.contains("text", F.col("item"))).select("query", "doc")
    rest = items.where(~inner)  # items of fewer than three inner tokens, tested against all texts
    return materialise(sure.union(docs.join(rest, F.contains("text", F.col("item"))).select("query", "doc")), "gold")  # asked more than once


def _ablation_sql(cte: str, runs: str) -> str:
    return f"""(WITH {cte}, {GOLD_CTE}, runs AS ({runs}),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY variant, query ORDER BY s DESC, doc) AS rank FROM runs) WHERE rank <= 5),
h AS (SELECT variant, query, bool_or(g.doc IS NOT NULL) AS hit FROM top LEFT JOIN gold g USING (query, doc) WHERE query IN (SELECT query FROM gold) GROUP BY 1, 2)
SELECT variant, count(*) AS n, round(avg(hit::INT), 6) AS recall5 FROM h GROUP BY 1)"""


_PLAIN_RUNS = "SELECT 'bm25' AS variant, query, doc, bm25 AS s FROM hyb UNION ALL SELECT 'dense', query, doc, round(dense, 8) FROM hyb UNION ALL SELECT 'hybrid', query, doc, score FROM hyb"
_WIDE_RUNS = "SELECT 'hybrid, expanded' AS variant, query, doc, plain AS s FROM boosted UNION ALL SELECT 'boosted, expanded', query, doc, score FROM boosted"


def hits_at(top: DataFrame, right: DataFrame, by: str) -> DataFrame:
    """(by, n, recall5) from the five best rows of each query and (query, doc) of the right ones."""
    asked = top.join(right.select("query").distinct(), "query", "left_semi")
    per = asked.join(right.withColumn("gold", F.lit(1)), ["query", "doc"], "left").groupBy(by, "query").agg(F.max(F.coalesce("gold", F.lit(0))).alias("hit"))
    return per.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg("hit"), 6).alias("recall5"))


@query(f"SELECT * FROM {_ablation_sql(HYBRID_CTE, _PLAIN_RUNS)} UNION ALL SELECT * FROM {_ablation_sql(EXPANDED_CTE + _BOOSTED, _WIDE_RUNS)}")
def ablation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at 5 by words, by vectors, by both, with the expanded query, and with the rules on top."""
    plain = best(spark, sf_dir, [BM25, DENSE, HYBRID], 5)
    wide = best(spark, sf_dir, [Ranking("hybrid, expanded", HYBRID.score, HYBRID.lexical, HYBRID.dense), retrieval.boosted("boosted, expanded", RULES)], 5, expanded=True)
    return hits_at(plain.union(wide), gold(spark, sf_dir), "ranking").withColumnRenamed("ranking", "variant")


_LEFT_OUT = " UNION ALL ".join([f"SELECT '{r.name}' AS rule, query, doc, round(h.score * ({factor_sql([x for x in RULES if x is not r])}) + 1e-11::DOUBLE, 8) AS s FROM hyb h JOIN documents ON doc_id = doc JOIN asks USING (query)" for r in RULES] + ["SELECT '' AS rule, query, doc, score AS s FROM boosted"])


@query(f"""WITH {BOOST_CTE}, {GOLD_CTE}, x AS ({_LEFT_OUT}),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rule, query ORDER BY s DESC, doc) AS rank FROM x) WHERE rank <= 5),
c AS (SELECT a.rule, count(*) FILTER (WHERE a.doc <> b.doc) AS changed FROM top a JOIN top b ON a.query = b.query AND a.rank = 1 AND b.rank = 1 AND b.rule = '' WHERE a.rule <> '' GROUP BY 1),
h AS (SELECT rule, query, bool_or(g.doc IS NOT NULL) AS hit FROM top LEFT JOIN gold g USING (query, doc) WHERE query IN (SELECT query FROM gold) GROUP BY 1, 2),
m AS (SELECT rule, round(avg(hit::INT), 6) AS recall5 FROM h GROUP BY 1)
SELECT rule, changed, m.recall5 AS recall5_without, round(f.recall5 - m.recall5, 6) AS delta, row_number() OVER (ORDER BY round(f.recall5 - m.recall5, 6) DESC, rule)::INT AS place
FROM c JOIN m USING (rule), (SELECT recall5 FROM m WHERE rule = '') f""")
def rule_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rule left out: the queries whose best document changes, and what the rule adds to recall at 5, most useful rules first."""
    top = best(spark, sf_dir, [BOOSTED, *[retrieval.boosted(r.name, RULES, r.name) for r in RULES]], 5)
    first = top.where("rank = 1").select("ranking", "query", "doc")
    full = first.where("ranking = 'boosted'").select("query", F.col("doc").alias("full_doc"))
    changed = first.where("ranking <> 'boosted'").join(full, "query").groupBy("ranking").agg(F.count_if(F.col("doc") != F.col("full_doc")).alias("changed"))
    measured = hits_at(top, gold(spark, sf_dir), "ranking")
    whole = measured.where("ranking = 'boosted'").select(F.col("recall5").alias("whole"))
    rows = changed.join(measured, "ranking").join(F.broadcast(whole)).select(F.col("ranking").alias("rule"), "changed", F.col("recall5").alias("recall5_without"), F.round(F.col("whole") - F.col("recall5"), 6).alias("delta"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("delta"), "rule")))  # a row a rule
