"""Evaluation of rankings, classifiers and paired runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspan.functions import text as T
from lexspan.operators import bayes, evaluate, features
from lexspan.sources.scratch import materialise
from lexspan.sources.tables import table

from .registry import query
from .retrieval import BM25_CTE, BOOST_CTE, BOOSTED, GOLD_CTE, best, bm25_ranks, gold

_FIRST = f"""{BM25_CTE}, {GOLD_CTE},
ranked AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM bm25),
firsts AS (SELECT g.query, min(r.rank) FILTER (WHERE r.rank <= 10) AS rank FROM gold g LEFT JOIN ranked r USING (query, doc) GROUP BY 1)"""
_METRICS = """count(*) AS n, round(avg(coalesce((rank <= 5)::INT, 0)), 6) AS recall5, round(avg(coalesce((rank <= 1)::INT, 0)), 6) AS p1, round(avg(coalesce((rank <= 3)::INT, 0)), 6) AS p3,
round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr, round(avg(coalesce(CASE WHEN rank <= 5 THEN 1 / log2(rank + 1) END, 0)), 6) AS ndcg5"""


def first_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query, rank) of the first of a query's gold documents among its ten best by BM25; null if there is none."""
    return gold(spark, sf_dir).join(bm25_ranks(spark, sf_dir, 10), ["query", "doc"], "left").groupBy("query").agg(F.min("rank").alias("rank"))


@query(f"WITH {_FIRST} SELECT {_METRICS} FROM firsts")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.ranking_metrics(first_hits(spark, sf_dir))


@query(f"WITH {_FIRST} SELECT query % 4 AS category, {_METRICS} FROM firsts GROUP BY 1")
def category_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.ranking_metrics(first_hits(spark, sf_dir).withColumn("category", F.col("query") % 4), "category")


@query(f"""WITH {_FIRST}, h AS (SELECT query, count(*) AS n_gold, count(*) FILTER (WHERE r.rank <= 5) AS hits, min(r.rank) FILTER (WHERE r.rank <= 5) AS first FROM gold g LEFT JOIN ranked r USING (query, doc) GROUP BY 1)
SELECT query, n_gold, hits, round(hits / 5.0::DOUBLE, 6) AS p5, round(least(hits, n_gold) / n_gold::DOUBLE, 6) AS r5, round(coalesce(1.0::DOUBLE / first, 0), 6) AS rr FROM h""")
def multi_gold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall at five where a query has several right documents."""
    top = bm25_ranks(spark, sf_dir, 5).select("query", "doc", "rank")
    h = gold(spark, sf_dir).join(top, ["query", "doc"], "left").groupBy("query").agg(F.count("*").alias("n_gold"), F.count("rank").alias("hits"), F.min("rank").alias("first"))
    return h.select("query", "n_gold", "hits", F.round(F.col("hits") / 5.0, 6).alias("p5"), F.round(F.least("hits", "n_gold") / F.col("n_gold"), 6).alias("r5"), F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("rr"))


@query(f"""WITH {_FIRST}, t AS (SELECT r.query, bool_or(g.doc IS NOT NULL) AS strict, bool_or(d.lang = q.lang) AS same_lang
  FROM ranked r JOIN documents d ON d.doc_id = r.doc LEFT JOIN gold g USING (query, doc) JOIN (SELECT query, min(lang) AS lang FROM gold JOIN documents ON doc_id = doc GROUP BY 1) q ON q.query = r.query WHERE r.rank <= 5 GROUP BY 1)
SELECT count(*) AS n, round(avg(strict::INT), 6) AS strict, round(avg((strict OR same_lang)::INT), 6) AS lenient, count(*) FILTER (WHERE NOT strict AND same_lang) AS near_misses, count(*) FILTER (WHERE NOT strict AND NOT same_lang) AS misses FROM t""")
def lenient_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at five by the right document, and by any document of its language."""
    top = bm25_ranks(spark, sf_dir, 5).select("query", "doc")
    langs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "lang")
    g = gold(spark, sf_dir)
    want = g.join(langs, "doc").groupBy("query").agg(F.min("lang").alias("want"))
    t = top.join(langs, "doc").join(want, "query").join(g.withColumn("g", F.lit(1)), ["query", "doc"], "left")
    per = t.groupBy("query").agg(F.bool_or(F.col("g").isNotNull()).alias("s"), F.bool_or(F.col("lang") == F.col("want")).alias("l"))
    return per.agg(F.count("*").alias("n"), F.round(F.avg(F.col("s").cast("int")), 6).alias("strict"), F.round(F.avg((F.col("s") | F.col("l")).cast("int")), 6).alias("lenient"), F.count_if(~F.col("s") & F.col("l")).alias("near_misses"), F.count_if(~F.col("s") & ~F.col("l")).alias("misses"))


#: Features of a labelled document, as SQL; the first two are what the lesser model sees.
_FEATURES = {
    "log_chars": "ln(1 + length(text))",
    "mean_word": "greatest(length(text), 1) / cast({n} AS DOUBLE)",
    "symbol_share": "{symbols} / cast(greatest(length(text), 1) AS DOUBLE)",
    "digit_share": "{digits} / cast(greatest(length(text), 1) AS DOUBLE)",
    "distinct_share": "{kinds} / cast({n} AS DOUBLE)",
}
_LESS = ("log_chars", "mean_word")
FOLDS = 5


def _feature_sql(spark: bool) -> str:
    words = r"split(text, '[ \\t\\n\\r\\f]+', -1)" if spark else r"regexp_split_to_array(text, '[ \t\n\r\f]+')"
    count = (lambda rx: f"regexp_count(text, '{rx}')") if spark else (lambda rx: f"len(regexp_extract_all(text, '{rx}'))")
    known = {"n": f"size({words})" if spark else f"len({words})", "kinds": f"size(array_distinct({words}))" if spark else f"len(list_distinct({words}))", "symbols": count("[#*$%&|<>]"), "digits": count("[0-9]")}
    return ", ".join(f"round({x.format(**known)}, 6) AS {name}" for name, x in _FEATURES.items())


def _bayes_sql(name: str, columns: tuple[str, ...]) -> str:
    """The out-of-fold probability ``name`` of the rows ``f`` from sums of all other folds."""
    sides = {c: f"CASE WHEN quality = {c} THEN {{}} ELSE 0 END" for c in (0, 1)}
    own = ", ".join([f"sum({sides[c].format(x)}) AS {k}{c}_{f}" for c in (0, 1) for f in columns for k, x in (("s", f), ("q", f"{f} * {f}"))] + [f"sum({sides[c].format(1)}) AS n{c}" for c in (0, 1)])
    names = [f"{k}{c}_{f}" for c in (0, 1) for f in columns for k in ("s", "q")] + ["n0", "n1"]
    rest = ", ".join(f"sum({x}) OVER () - {x} AS {x}" for x in names)

    def term(c: int, f: str) -> str:
        n, mean = f"greatest(n{c}::DOUBLE, 1)", f"(s{c}_{f} / greatest(n{c}::DOUBLE, 1))"
        variance = f"greatest(q{c}_{f} / {n} - {mean} * {mean}, 1e-6::DOUBLE)"
        return f"(-0.5::DOUBLE * ln({variance}) - ({f} - {mean}) * ({f} - {mean}) / (2 * {variance}))"

    side = lambda c: " + ".join([f"ln(greatest(n{c}::DOUBLE, 1))", *(term(c, f) for f in columns)])
    return f"""{name}_own AS (SELECT fold, {own} FROM f GROUP BY 1), {name}_rest AS (SELECT fold, {rest} FROM {name}_own),
{name}_s AS (SELECT doc_id, round(1 / (1 + exp(-greatest(-50.0::DOUBLE, least(50.0::DOUBLE, ({side(1)}) - ({side(0)}))))), 6) AS {name} FROM f JOIN {name}_rest USING (fold))"""


_SCORED = f"""f AS (SELECT doc_id, source, quality, ('0x' || substr(md5('fold|' || source), 1, 8))::BIGINT % {FOLDS} AS fold, {_feature_sql(False)} FROM labels JOIN documents USING (doc_id)),
{_bayes_sql('score', tuple(_FEATURES))}, {_bayes_sql('other', _LESS)},
s AS (SELECT doc_id, source, quality, fold, score, other FROM f JOIN score_s USING (doc_id) JOIN other_s USING (doc_id))"""


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with the probabilities of two models, over all features and over two, each trained on the other folds of sources."""
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", "source", _feature_sql(True).split(", round", 1)[0], *["round" + x for x in _feature_sql(True).split(", round")[1:]])
    rows = docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").withColumn("fold", features.hash_bucket("fold", F.col("source"), FOLDS))
    rows = materialise(rows, "text_features")  # texts are read once, whatever the number of models
    scored = bayes.out_of_fold(bayes.out_of_fold(rows, "quality", "fold", list(_FEATURES), "score"), "quality", "fold", list(_LESS), "other")
    return materialise(scored.select("doc_id", "source", "quality", "fold", "score", "other"), "scores")


_CONF = """count(*) FILTER (WHERE quality = 1 AND score >= 0.5) AS tp, count(*) FILTER (WHERE quality = 0 AND score >= 0.5) AS fp, count(*) FILTER (WHERE quality = 1 AND score < 0.5) AS fn, count(*) FILTER (WHERE quality = 0 AND score < 0.5) AS tn"""
_RATES = """round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 6) AS accuracy, CASE WHEN tp + fp = 0 THEN 0 ELSE round(tp / (tp + fp)::DOUBLE, 6) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE round(tp / (tp + fn)::DOUBLE, 6) END AS recall, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) END AS f1"""


@query(f"WITH {_SCORED}, c AS (SELECT {_CONF} FROM s) SELECT *, {_RATES} FROM c")
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.confusion(scored_labels(spark, sf_dir), F.col("quality") == 1, F.col("score") >= 0.5)


_F1 = "CASE WHEN 2 * {0}tp + {0}fp + {0}fn = 0 THEN 0 ELSE round(2 * {0}tp / (2 * {0}tp + {0}fp + {0}fn)::DOUBLE, 6) END"


@query(f"""WITH {_SCORED}, c AS (SELECT source, {_CONF}, {_CONF.replace("score >=", "other >=").replace("score <", "other <").replace("AS ", "AS o_")} FROM s GROUP BY 1)
SELECT source, tp, fp, fn, tn, {_F1.format('')} AS f1, {_F1.format('o_')} AS other_f1, round({_F1.format('')} - ({_F1.format('o_')}), 6) AS gain FROM c""")
def per_group_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 of both models in each source, and what the first gains over the second."""
    rows, right = scored_labels(spark, sf_dir), F.col("quality") == 1
    a = features.confusion(rows, right, F.col("score") >= 0.5, "source").select("source", "tp", "fp", "fn", "tn", "f1")
    b = features.confusion(rows, right, F.col("other") >= 0.5, "source").select("source", F.col("f1").alias("other_f1"))
    return a.join(b, "source").withColumn("gain", F.round(F.col("f1") - F.col("other_f1"), 6))


@query(f"WITH {_SCORED} SELECT doc_id, source, score, CASE WHEN quality = 0 THEN 'false positive' ELSE 'false negative' END AS error, (other >= 0.5) = (quality = 1) AS other_right FROM s WHERE (score >= 0.5) <> (quality = 1)")
def error_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents that the model has wrong, and whether the lesser model has them right."""
    rows = scored_labels(spark, sf_dir).where((F.col("score") >= 0.5) != (F.col("quality") == 1))
    return rows.select("doc_id", "source", "score", F.when(F.col("quality") == 0, "false positive").otherwise("false negative").alias("error"), ((F.col("other") >= 0.5) == (F.col("quality") == 1)).alias("other_right"))


@query(f"""WITH {_SCORED}, t AS (SELECT score, sum(quality) AS pos, count(*) AS n FROM s GROUP BY 1), r AS (SELECT score, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM t WINDOW w AS (ORDER BY score DESC))
SELECT score AS threshold, tp::BIGINT AS tp, round(tp / seen::DOUBLE, 6) AS precision, round(tp / (SELECT sum(quality) FROM s)::DOUBLE, 6) AS recall FROM r""")
def precision_recall_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall at every distinct score."""
    curve = evaluate.precision_recall(scored_labels(spark, sf_dir), "score", "quality")
    return curve.select("threshold", "tp", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(f"""WITH {_SCORED}, t AS (SELECT score, sum(quality) AS pos, count(*) AS n FROM s GROUP BY 1), r AS (SELECT pos, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM t WINDOW w AS (ORDER BY score DESC))
SELECT round(sum(pos * tp / seen::DOUBLE) / sum(pos), 6) AS ap, sum(pos)::BIGINT AS positives FROM r""")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.average_precision(scored_labels(spark, sf_dir), "score", "quality")


@query(f"""WITH {_SCORED}, g AS (SELECT round(0.10 + 0.01 * i, 2)::DOUBLE AS threshold FROM range(0, 81) t(i)),
c AS (SELECT threshold, count(*) FILTER (WHERE score >= threshold AND quality = 1) AS tp, count(*) FILTER (WHERE score >= threshold AND quality = 0) AS fp, count(*) FILTER (WHERE score < threshold AND quality = 1) AS fn FROM s, g GROUP BY 1)
SELECT threshold, tp, fp, fn, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) END AS f1 FROM c ORDER BY f1 DESC, threshold LIMIT 1""")
def threshold_tuning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.best_threshold(scored_labels(spark, sf_dir), "score", "quality", [round(0.10 + 0.01 * i, 2) for i in range(81)])


@query(f"""WITH {_SCORED}, x AS (SELECT fold, 2 * count(*) FILTER (WHERE quality = 1 AND score >= 0.5) / (count(*) FILTER (WHERE score >= 0.5) + sum(quality))::DOUBLE AS f1 FROM s GROUP BY 1)
SELECT count(*) AS folds, round(avg(f1), 6) AS mean, round(stddev_pop(f1), 6) AS std FROM x""")
def fold_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 by fold, then its mean and population deviation."""
    s = scored_labels(spark, sf_dir)
    per = s.groupBy("fold").agg((2 * F.count_if((F.col("quality") == 1) & (F.col("score") >= 0.5)) / (F.count_if(F.col("score") >= 0.5) + F.sum("quality"))).alias("f1"))
    return per.agg(F.count("*").alias("folds"), F.round(F.avg("f1"), 6).alias("mean"), F.round(F.stddev_pop("f1"), 6).alias("std"))


_PAIRS = f"{_SCORED}, c AS (SELECT source, count(*) FILTER (WHERE (score >= 0.5) = (quality = 1) AND (other >= 0.5) <> (quality = 1)) AS b, count(*) FILTER (WHERE (score >= 0.5) <> (quality = 1) AND (other >= 0.5) = (quality = 1)) AS c FROM s GROUP BY 1)"
_LOGS = "list_sum(list_transform(range(1, greatest({0}, 1) + 1), lambda x: ln(x::DOUBLE)))"
_MCNEMAR = f"""m AS (SELECT source, b, c, round(CASE WHEN b + c = 0 THEN 1 ELSE least(1.0::DOUBLE, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: exp({_LOGS.format('b + c')} - {_LOGS.format('i')} - {_LOGS.format('b + c - i')} - (b + c) * 0.6931471805599453::DOUBLE)))) END, 6) AS p_exact,
  round(CASE WHEN b + c = 0 THEN 0 ELSE greatest(abs(b - c) - 1, 0) ** 2 / (b + c)::DOUBLE END, 6) AS chi2 FROM c)"""


def discordant(s: DataFrame) -> DataFrame:
    """(source, b, c): rows that only the first model has right, and only the second."""
    right = lambda c: (F.col(c) >= 0.5) == (F.col("quality") == 1)
    return s.groupBy("source").agg(F.count_if(right("score") & ~right("other")).alias("b"), F.count_if(~right("score") & right("other")).alias("c"))


@query(f"WITH {_PAIRS}, {_MCNEMAR} SELECT * FROM m")
def mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired test of the two scores in each source."""
    return evaluate.mcnemar(discordant(scored_labels(spark, sf_dir)))


@query(f"""WITH {_PAIRS}, {_MCNEMAR}, h AS (SELECT *, least(1.0::DOUBLE, (count(*) OVER () - row_number() OVER (ORDER BY p_exact, source) + 1) * p_exact) AS s FROM m)
SELECT source, p_exact, round(max(s) OVER (ORDER BY p_exact, source), 6) AS p_holm FROM h""")
def holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = evaluate.mcnemar(discordant(scored_labels(spark, sf_dir))).withColumn("family", F.lit(1))  # one row a source: a small family
    return evaluate.holm(tests, "p_exact", "family", "source").select("source", "p_exact", "p_holm")


_ROUNDS = 5000


@query(f"""WITH {_PAIRS}, k AS (SELECT source, count(*) AS n FROM s GROUP BY 1),
draws AS (SELECT source, r, n, b, c, ('0x' || substr(md5('boot|' || doc_id || '|' || r), 1, 8))::BIGINT % n AS i FROM s JOIN k USING (source) JOIN c USING (source), range(0, {_ROUNDS}) a(r)),
m AS (SELECT source, r, sum(CASE WHEN i < c THEN -1 WHEN i >= n - b THEN 1 ELSE 0 END) / max(n)::DOUBLE AS mean FROM draws GROUP BY 1, 2)
SELECT source, round(quantile_cont(mean, 0.025), 6) AS lo, round(quantile_cont(mean, 0.975), 6) AS hi, round(avg((mean <= 0)::INT), 6) AS p_one_sided FROM m GROUP BY 1""")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired bootstrap of the difference in each source; draws come from hashes, so every engine draws alike.

    A row of a source differs by -1, 0 or 1, so a draw is a place in the source's sorted differences,
    told by its two discordant counts: no draw has to be joined with a row.
    """
    s = scored_labels(spark, sf_dir)
    sizes = discordant(s).join(s.groupBy("source").agg(F.count("*").alias("n")), "source")
    spread = s.select("source", "doc_id").repartition(spark.sparkContext.defaultParallelism, "doc_id")  # few rows, of 5,000 draws each
    return evaluate.sign_bootstrap(spread.join(F.broadcast(sizes), "source"), "source", "doc_id", "boot", _ROUNDS)  # a row a source


_DRAWS = " + ".join(f"(u >= {c})::INT" for c in evaluate.poisson_cuts())


@query(f"""WITH {_SCORED}, g AS (SELECT source, doc_id, round((abs(other - quality) - abs(score - quality)) * 1000000)::BIGINT AS gap FROM s),
u AS (SELECT source, r, gap, ('0x' || substr(md5('poisson|' || doc_id || '|' || r // 4), (1 + 8 * (r % 4))::INT, 8))::BIGINT AS u FROM g, range(0, {_ROUNDS}) a(r)),
m AS (SELECT source, r, sum(({_DRAWS}) * gap)::DOUBLE / nullif(sum({_DRAWS}), 0)::DOUBLE / 1000000 AS mean FROM u GROUP BY 1, 2)
SELECT source, round(quantile_cont(mean, 0.025), 6) AS lo, round(quantile_cont(mean, 0.975), 6) AS hi, round(avg((mean <= 0)::INT), 6) AS p_one_sided FROM m WHERE mean IS NOT NULL GROUP BY 1""")
def bootstrap_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired bootstrap of how much nearer the truth one model's probabilities are than the other's, in each source."""
    s = scored_labels(spark, sf_dir)
    gap = F.round((F.abs(F.col("other") - F.col("quality")) - F.abs(F.col("score") - F.col("quality"))) * 1_000_000).cast("long")
    spread = s.select("source", "doc_id", gap.alias("gap")).repartition(spark.sparkContext.defaultParallelism, "doc_id")  # few rows, of many rounds each
    return evaluate.paired_bootstrap(spread, "source", "doc_id", "gap", "poisson", _ROUNDS)


_DEPTHS, _WEIGHTS = (5, 10, 15, 20), (0.2, 0.4, 0.5, 0.6, 0.8)


@query(f"""WITH {BOOST_CTE}, {GOLD_CTE}, grid AS (SELECT * FROM (VALUES {", ".join(f"({n})" for n in _DEPTHS)}) a(n), (VALUES {", ".join(f"({w}::DOUBLE)" for w in _WEIGHTS)}) b(w)),
p AS (SELECT query, doc, score, matched, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS place FROM boosted QUALIFY place <= 20),
x AS (SELECT n, w, query, doc, place, place > n AS tail, round(CASE WHEN max(score) OVER (PARTITION BY n, w, query) > 0 THEN w * score / max(score) OVER (PARTITION BY n, w, query) ELSE 0 END + CASE WHEN place <= n THEN (1 - w) * matched / greatest(max(matched) OVER (PARTITION BY n, w, query), 1) ELSE 0 END, 8) AS f FROM p, grid),
k AS (SELECT n, w, query, doc, row_number() OVER (PARTITION BY n, w, query ORDER BY tail::INT, f DESC, doc) AS rank FROM x),
r AS (SELECT n, w, k.query, min(CASE WHEN g.doc IS NOT NULL THEN rank END) AS rank FROM k LEFT JOIN gold g USING (query, doc) WHERE k.query IN (SELECT query FROM gold) GROUP BY 1, 2, 3),
g AS (SELECT n, w, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr FROM r GROUP BY 1, 2)
SELECT n, w, mrr, row_number() OVER (ORDER BY mrr DESC, n, w) = 1 AS best FROM g""")
def weight_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean reciprocal rank for each re-ranking depth and weight, over one scored pool; the best cell is marked, the first on a tie."""
    grid = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(w).alias("w")) for n in _DEPTHS for w in _WEIGHTS])
    pool = best(spark, sf_dir, [BOOSTED], 20).withColumnRenamed("rank", "place")
    g = gold(spark, sf_dir)
    pool = pool.join(g.select("query").distinct(), "query", "left_semi").select("query", "doc", "score", "matched", "place", F.explode(grid).alias("g")).select("query", "doc", "score", "matched", "place", "g.*")
    cell = Window.partitionBy("n", "w", "query")
    top = F.max("score").over(cell)
    share = F.when(top > 0, F.col("w") * F.col("score") / top).otherwise(0.0)
    mixed = F.round(share + F.when(F.col("place") <= F.col("n"), (1 - F.col("w")) * F.col("matched") / F.greatest(F.max("matched").over(cell), F.lit(1))).otherwise(0), 8)
    ranked = pool.withColumn("f", mixed).withColumn("rank", F.row_number().over(cell.orderBy((F.col("place") > F.col("n")).cast("int"), F.desc("f"), "doc")))
    firsts = ranked.join(g.withColumn("hit", F.lit(1)), ["query", "doc"], "left").groupBy("n", "w", "query").agg(F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("rank"))
    cells = firsts.groupBy("n", "w").agg(F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))
    return cells.withColumn("best", F.row_number().over(Window.orderBy(F.desc("mrr"), "n", "w")) == 1)  # twenty rows


@query()
def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold probabilities of a balanced random forest over text features, folds by source. No SQL equals it; the driver checks rows, the tests accuracy."""
    from lexspan.operators.models import out_of_fold

    return out_of_fold(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: What the first model of a stack sees of a candidate, and what the second does.
_BASE = ("dense", "matched")
_CANDIDATE = ("share", "dense", "bm25_log", "rank", "reciprocal_rank", "matched_ratio", "dense_minus_share", "gap_to_next")


def candidate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each query with features of the pair, whether they are right, and folds by query."""
    top = best(spark, sf_dir, [BOOSTED], 10)
    terms = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.greatest(F.size(F.array_distinct(T.tokens(F.col("text")))), F.lit(1)).alias("n_terms"))
    right = gold(spark, sf_dir).withColumn("relevant", F.lit(1))
    rows = top.join(terms, "query").join(right, ["query", "doc"], "left").withColumn("relevant", F.coalesce("relevant", F.lit(0)))
    following = F.lead("score").over(Window.partitionBy("query").orderBy("rank"))
    rows = rows.withColumns({"bm25_log": F.log1p("bm25"), "reciprocal_rank": 1.0 / F.col("rank"), "matched_ratio": F.col("matched") / F.col("n_terms"), "dense_minus_share": F.col("dense") - F.col("share"), "gap_to_next": F.coalesce(F.col("score") - following, F.lit(0.0))})
    return features.stable_folds(rows, "query", 5, 4)


@query()
def stacked_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with out-of-fold probabilities, without and with a first model's score and rank as features. Nested folds by query; the tests compare it with a model fitted for each fold."""
    return bayes.stacked(candidate_rows(spark, sf_dir), ["query", "doc", "rank"], "query", "relevant", "outer_fold", "inner_fold", _BASE, _CANDIDATE)


@query()
def classifier_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of ten candidates by the stacked probability, ties in the old order, with whether each is right."""
    rows = stacked_scores(spark, sf_dir).withColumnRenamed("rank", "old_rank")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("stacked"), "old_rank"))
    return rows.withColumn("rank", place).where("rank <= 5").select("query", "doc", F.col("stacked").alias("probability"), "old_rank", "rank", "relevant")


@query()
def voting_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean out-of-fold probability of a forest and a logistic model, folds by source."""
    from lexspan.operators.models import soft_vote

    return soft_vote(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
