"""Exact best documents of a set of queries by BM25, vectors, or any product of both with rules.

Queries are taken in blocks of ``BLOCK``. For a block the documents are read once: each task tokenises its
texts, counts in how many of them each term occurs, and keeps of a document only the terms that the block
asks for. That table of postings then is met by the block's terms as a compiled table: a document scores
all queries in its own row, and a task hands on at most ``depth`` rows a query. Vectors are met in the same
way, as a product of matrices.

The best part by words of each query comes first; with it a second pass knows what each document can score at
most by words, vectors and rules together, and keeps the best by that. Where the last of those is not below the
k-th best score found, the query goes on with four times the depth. So every document counts, those without
a shared word too, no row is made for each query and document, and what a task holds does not grow with the table.

Rules multiply scores. Their conditions on documents are read once, as bits beside the postings, those on
queries as bits of the block, so a task knows a document's factor for each query.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from lexspan.functions.text import STOP_WORDS, tokens
from lexspan.sources.scratch import materialise

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Queries of a block, the first depth, and distinct terms that a task counts before it hands its counts on.
BLOCK, DEPTH, HELD = 1024, 32, 1 << 17
#: Documents read and scored at once in a task.
ROWS = 256
#: Decimals of scores; ties at that precision go to the smaller document.
DIGITS = 8
_LOWER = bytes(c if chr(c).isalnum() and c < 128 else 32 for c in range(256))
_DROPPED = [*(w.encode() for w in STOP_WORDS if len(w) > 1), *(bytes([c]) for c in b"abcdefghijklmnopqrstuvwxyz")]


@dataclass(frozen=True)
class Rule:
    """A factor on the score of a document for a query.

    ``asks`` is a SQL condition on the query's columns, ``holds`` one on the document's. Where both hold the
    score is multiplied by ``factor``, where only ``asks`` does by ``otherwise``. Rules of phase ``post`` are
    applied to the mixed score before those of phase ``boost``.
    """

    name: str
    asks: str
    holds: str
    factor: float
    otherwise: float = 1.0
    phase: str = "boost"


@dataclass(frozen=True)
class Ranking:
    """One order of documents.

    ``score`` is a SQL expression over bm25, matched, share (bm25 over the query's best), dense and
    {factor}, the product of the factors of ``rules``. No document may score above that product
    times (``lexical`` * share + ``dense`` * dense).
    """

    name: str
    score: str
    lexical: float
    dense: float
    rules: tuple[Rule, ...] = ()


BM25 = Ranking("bm25", "bm25", 1.0, 0.0)
DENSE = Ranking("dense", f"round(dense, {DIGITS})", 0.0, 1.0)
HYBRID = Ranking("hybrid", f"round(0.15D * share + 0.85D * dense, {DIGITS})", 0.15, 0.85)


def number(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def factor_sql(rules: Sequence[Rule], asks: Sequence[str] | None = None, holds: Sequence[str] | None = None) -> str:
    """The product of the factors that apply, post rules first, as SQL; conditions may be given in another form, in the order of the rules."""
    forms = zip(rules, asks or [r.asks for r in rules], holds or [r.holds for r in rules], strict=True)
    ordered = sorted(forms, key=lambda f: f[0].phase != "post")
    return " * ".join([f"CASE WHEN ({a}) AND ({h}) THEN {number(r.factor)} WHEN {a} THEN {number(r.otherwise)} ELSE {number(1.0)} END" for r, a, h in ordered] or [number(1.0)])


class Conditions:
    """The conditions of all rankings as bits of two whole numbers."""

    def __init__(self, rankings: Sequence[Ranking]) -> None:
        rules = [r for x in rankings for r in x.rules]
        self.asks, self.holds = list(dict.fromkeys(r.asks for r in rules)), list(dict.fromkeys(r.holds for r in rules))
        if max(len(self.asks), len(self.holds)) > 62:
            raise ValueError("more than 62 different conditions")

    @staticmethod
    def bits(conditions: Sequence[str]) -> Column:
        return reduce(lambda a, b: a + b, [F.when(F.expr(c), 1 << i).otherwise(0).cast("long") for i, c in enumerate(conditions)], F.lit(0).cast("long"))

    def sql(self, rules: Sequence[Rule]) -> str:
        bit = lambda name, known, c: f"(({name} & {1 << known.index(c)}L) <> 0)"
        return factor_sql(rules, [bit("__asks", self.asks, r.asks) for r in rules], [bit("__holds", self.holds, r.holds) for r in rules])

    def factors(self, rules: Sequence[Rule], asks: np.ndarray, holds: np.ndarray) -> np.ndarray:
        """The factor of each document (bits ``holds``) for each query (bits ``asks``)."""
        out = np.ones((len(holds), len(asks)))
        for r in rules:
            a, h = (asks >> self.asks.index(r.asks)) & 1 == 1, (holds >> self.holds.index(r.holds)) & 1 == 1
            out[:, a] *= np.where(h, r.factor, r.otherwise)[:, None]
        return out


def term_counter(text: str | None) -> Counter:
    """Occurrences of each token of a text, by the rule of ``functions.text.tokens``."""
    found = Counter(text.lower().encode("utf-8").translate(_LOWER).split() if text else ())
    for w in _DROPPED:
        found.pop(w, None)
    return found


class Block:
    """The terms of up to BLOCK queries: for each term the queries that say it, and how often."""

    def __init__(self, queries: Sequence[Row]) -> None:
        self.ids = [q["query"] for q in queries]
        said = [Counter(t.encode() for t in q["tokens"]) for q in queries]
        self.terms = {t: i for i, t in enumerate(sorted({t for c in said for t in c}))}
        cells = sorted((self.terms[t], q, n) for q, c in enumerate(said) for t, n in c.items())
        self.query = np.array([c[1] for c in cells], np.int64)
        self.times = np.array([c[2] for c in cells], float)
        self.start = np.searchsorted(np.array([c[0] for c in cells], np.int64), np.arange(len(self.terms) + 1))
        self.asks = np.array([q["asks"] for q in queries], np.int64)
        self.vectors = [None if q["qvec"] is None or any(x is None for x in q["qvec"]) else np.array(q["qvec"], float) for q in queries]


def places(group: np.ndarray) -> np.ndarray:
    """The number of each element among those of its group, for groups in order."""
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.zeros(0, int)
    return np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group))))


class Best:
    """The k best (score, then smaller document) of each query seen so far."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.least, self.parts, self.size = k, np.full(n, -np.inf), [], 0

    def add(self, query: np.ndarray, score: np.ndarray, doc: np.ndarray, matched: np.ndarray) -> None:
        kept = score >= self.least[query]
        self.parts.append((query[kept], score[kept], doc[kept], matched[kept]))
        self.size += int(kept.sum())
        if self.size > 4 * self.k * len(self.least):
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        query, score, doc, matched = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        name = doc if doc.dtype.kind in "iu" else np.unique(doc, return_inverse=True)[1]
        order = np.lexsort((name, -score, query))
        place = places(query[order])
        order = order[place < self.k]
        last = places(query[order]) == self.k - 1
        self.least[query[order][last]] = score[order][last]
        self.parts = [(query[order], score[order], doc[order], matched[order])]
        self.size = len(order)
        return self.parts[0]


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out if Spark reads it in fewer pieces than it has cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _postings(docs: DataFrame, block: Block, counts: bool) -> DataFrame:
    """Rows of three parts from (doc, text, holds): documents with the block's terms, sizes by task, and, if asked, document counts of all terms."""
    shared = docs.sparkSession.sparkContext.broadcast(block.terms)
    doc_kind = docs.schema["doc"].dataType
    doc_arrow = pa.int64() if doc_kind.simpleString() == "bigint" else pa.string()
    schema = pa.schema([("part", pa.string()), ("doc", doc_arrow), ("holds", pa.int64()), ("dl", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32())), ("term", pa.string()), ("n", pa.int64())])

    def rows(part: str, k: int, **columns: object) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part] * k) if f.name == "part" else pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(k, f.type) for f in schema], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, seen, n, total = shared.value, Counter(), 0, 0
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, len(b), ROWS)):
            dl, terms, tfs = [], [], []
            for text in batch.column(1):
                found = term_counter(text.as_py())
                dl.append(found.total())
                if counts:
                    seen.update(found.keys())
                both = found.keys() & asked.keys()
                terms.append([asked[t] for t in both])
                tfs.append([found[t] for t in both])
            n, total = n + len(dl), total + sum(dl)
            yield rows("doc", len(dl), doc=batch.column(0), holds=batch.column(2), dl=dl, terms=terms, tfs=tfs)
            if len(seen) > HELD:
                yield rows("term", len(seen), term=list(seen), n=list(seen.values()))
                seen = Counter()
        yield rows("term", len(seen), term=list(seen), n=list(seen.values()))
        yield rows("size", 1, dl=[total], n=[n])

    return spread(docs.select("doc", "text", "holds")).mapInArrow(work, f"part string, doc {doc_kind.simpleString()}, holds long, dl long, terms array<int>, tfs array<int>, term string, n long")


class Lexical:
    """Scores of a block's queries for rows of postings."""

    def __init__(self, block: Block, idf: np.ndarray, mean_length: float) -> None:
        self.start, self.query, self.times, self.idf, self.mean, self.n = block.start, block.query, block.times, idf, mean_length, len(block.ids)

    def scores(self, rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """(score, matched terms) of each row of (dl, terms, tfs) and each query."""
        dl = rows.column("dl").to_numpy(zero_copy_only=False)
        sizes = pc.list_value_length(rows.column("terms")).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(rows)), sizes)
        term, tf = (rows.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("terms", "tfs"))
        weight = self.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[row] / self.mean))
        reach = self.start[term + 1] - self.start[term]
        cell = np.repeat(self.start[term] - (np.cumsum(reach) - reach), reach) + np.arange(int(reach.sum()))
        place = np.repeat(row, reach) * self.n + self.query[cell]
        score = np.bincount(place, np.repeat(weight, reach) * self.times[cell], len(rows) * self.n)
        return np.round(score.astype(float), DIGITS).reshape(-1, self.n), np.bincount(place, minlength=len(rows) * self.n).reshape(-1, self.n)


def _best_rows(batches: Iterator[pa.RecordBatch], score: Callable[[pa.RecordBatch], tuple[list[np.ndarray], np.ndarray]], open_queries: np.ndarray, depth: int, doc: pa.DataType, matching: bool) -> Iterator[pa.RecordBatch]:
    """The ``depth`` best rows of each query and variant of the score in a task: those above 0 or, if ``matching``, all that share a term."""
    n, best = len(open_queries), None
    for batch in batches:
        for i in range(0, len(batch), ROWS):
            rows = batch.slice(i, ROWS)
            values, matched = score(rows)
            ids = np.asarray(rows.column("doc").to_numpy(zero_copy_only=False))
            best = best or Best(n * len(values), depth)
            for v, value in enumerate(values):
                row, query = np.nonzero(((matched if matching else value) > 0) & open_queries[None] & (value >= best.least[None, v * n : (v + 1) * n]))
                best.add(v * n + query, value[row, query], ids[row], matched[row, query])
    if best and best.parts:
        query, value, row, matched = best.cut()
        yield pa.RecordBatch.from_arrays([pa.array(query // n), pa.array(query % n), pa.array(row, doc), pa.array(value), pa.array(matched, pa.int64())], names=["__v", "__q", "doc", "score", "matched"])


def search(docs: DataFrame, queries: DataFrame, rankings: Sequence[Ranking], k: int, vectors: DataFrame | None = None, matching_only: bool = False) -> DataFrame:
    """(ranking, query, doc, bm25, matched, share, dense, score, rank): the k best of all documents for each query and ranking.

    ``docs`` has doc, text and columns that rules read; ``queries`` has query, text, and others likewise;
    ``vectors`` has doc and vec, and then ``queries`` has qvec. With ``matching_only``, for orders by words alone and without rules, documents
    that share no term with the query are no answer. Ties go to the smaller document.

    Defined results: null and empty texts have no terms; a document or query without a vector, or with one of
    another length, has dense 0; negative products are 0; null ids take no part; ids do not repeat; an
    empty table gives an empty table. In a corpus so uniform that the mean idf, and with it the floor of
    idf, is negative, scores can be too: such documents stand below those that share no term, of which
    only the k smallest are looked at.
    """
    conditions = Conditions(rankings)
    docs = docs.where("doc IS NOT NULL").select("doc", "text", conditions.bits(conditions.holds).alias("holds"))
    qvec = F.col("qvec").cast("array<double>") if vectors is not None else F.lit(None).cast("array<double>")
    asked = queries.where("query IS NOT NULL").select("query", tokens(F.col("text")).alias("tokens"), qvec.alias("qvec"), conditions.bits(conditions.asks).alias("asks"))
    parts, held, counted = [], [], None
    for q in asked.orderBy("query").toLocalIterator():
        held.append(q)
        if len(held) == BLOCK:
            found, counted = _search_block(docs, Block(held), conditions, rankings, k, vectors, matching_only, counted)
            parts, held = [*parts, *found], []
    if held:
        parts += _search_block(docs, Block(held), conditions, rankings, k, vectors, matching_only, counted)[0]
    kinds = queries.schema["query"].dataType.simpleString(), docs.schema["doc"].dataType.simpleString()
    empty = "ranking string, query {}, doc {}, bm25 double, matched long, share double, dense double, score double, rank int".format(*kinds)
    return reduce(DataFrame.union, parts) if parts else docs.sparkSession.createDataFrame([], empty)


def _statistics(posted: DataFrame) -> tuple[int, float, DataFrame, float]:
    """Documents, their mean length, (term, raw idf) of all terms, and the mean of that."""
    size = posted.where("part = 'size'").agg(F.sum("n").alias("n"), F.sum("dl").alias("dl")).first()
    n = size["n"] or 0
    df = posted.where("part = 'term'").groupBy("term").agg(F.sum("n").alias("df"))
    raw = F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    terms = materialise(df.select("term", raw.alias("raw")), "terms")
    return n, max(1e-9, (size["dl"] or 0) / max(1, n)), terms, terms.agg(F.avg("raw")).first()[0] or 0.0


def _search_block(docs: DataFrame, block: Block, conditions: Conditions, rankings: Sequence[Ranking], k: int, vectors: DataFrame | None, matching_only: bool, counted: tuple | None) -> tuple[list[DataFrame], tuple]:
    spark, n = docs.sparkSession, len(block.ids)
    doc_kind = docs.schema["doc"].dataType.simpleString()
    doc_arrow = pa.int64() if doc_kind == "bigint" else pa.string()
    posted = materialise(_postings(docs, block, counted is None), "postings")
    counted = counted or _statistics(posted)
    n_docs, mean_length, terms, mean = counted
    wanted = spark.createDataFrame(pa.table({"term": pa.array([t.decode() for t in block.terms], pa.string()), "i": pa.array(block.terms.values(), pa.int64())}))
    idf = np.zeros(len(block.terms))
    for r in terms.join(F.broadcast(wanted), "term").select("i", "raw").collect():  # a row for each term of the block
        idf[r["i"]] = r["raw"] if r["raw"] >= 0 else EPSILON * mean
    by_doc = posted.where("part = 'doc'").select("doc", "holds", "dl", "terms", "tfs")
    lexical = spark.sparkContext.broadcast(Lexical(block, idf, mean_length))
    dim = max([len(v) for v in block.vectors if v is not None], default=0)
    matrix = spark.sparkContext.broadcast(np.array([v if v is not None and len(v) == dim else np.zeros(dim) for v in block.vectors]).reshape(n, dim))
    names = spark.createDataFrame([(i, q, int(a), v if v is None else v.tolist()) for i, (q, a, v) in enumerate(zip(block.ids, block.asks, block.vectors, strict=True))], f"__q long, query {'string' if isinstance(block.ids[0], str) else 'long'}, __asks long, qvec array<double>")  # a block of queries
    variants = list(dict.fromkeys((r.rules, r.lexical, r.dense) for r in rankings))

    def dense_scores(rows: pa.RecordBatch) -> np.ndarray:
        fits = pc.fill_null(pc.equal(pc.list_value_length(rows.column("vec")), dim), False).to_numpy(zero_copy_only=False)
        score = np.zeros((len(rows), n))
        flat = rows.column("vec").filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
        score[fits] = np.round(np.clip(flat @ matrix.value.T, 0, 1), DIGITS)
        return np.nan_to_num(score)

    def most(tops: np.ndarray) -> Callable[[pa.RecordBatch], tuple[list[np.ndarray], np.ndarray]]:
        """What each document can score at most for each query, by variant; ``tops`` are the best scores by words."""

        def score(rows: pa.RecordBatch) -> tuple[list[np.ndarray], np.ndarray]:
            plain, matched = lexical.value.scores(rows)
            share, near, holds = plain / np.where(tops > 0, tops, 1.0), dense_scores(rows) if by_vectors else 0.0, rows.column("holds").to_numpy(zero_copy_only=False)
            return [(words * share + dense * near) * (conditions.factors(rules, block.asks, holds) if rules else 1.0) for rules, words, dense in variants], matched

        return score

    row_kind = f"__v long, __q long, doc {doc_kind}, score double, matched long"

    def stream(source: DataFrame, score: Callable, open_queries: np.ndarray, depth: int) -> DataFrame:
        found = source.mapInArrow(lambda batches: _best_rows(batches, score, open_queries, depth, doc_arrow, matching_only), row_kind)
        by = Window.partitionBy("__v", "__q").orderBy(F.desc("score"), "doc")
        return found.withColumn("at", F.row_number().over(by)).where(F.col("at") <= depth).drop("at")

    def by_words(rows: pa.RecordBatch) -> tuple[list[np.ndarray], np.ndarray]:
        score, matched = lexical.value.scores(rows)
        return [score], matched

    keep = ["query", "doc", "bm25", "matched", "share", "dense"]
    if matching_only:
        if any(r.dense or r.rules for r in rankings):
            raise ValueError("matching_only is for orders by words alone")
        top = materialise(stream(by_doc, by_words, np.ones(n, bool), k), "best").withColumnsRenamed({"score": "bm25"})
        first = F.max("bm25").over(Window.partitionBy("__q"))
        rows = top.withColumns({"share": F.when(first > 0, F.col("bm25") / first).otherwise(F.col("bm25")), "dense": F.lit(0.0)}).join(F.broadcast(names.select("__q", "query")), "__q")
        ordered = [rows.select(F.lit(r.name).alias("ranking"), *keep, F.expr(r.score).cast("double").alias("score")) for r in rankings]
        by = Window.partitionBy("ranking", "query").orderBy(F.desc("score"), "doc")
        return [reduce(DataFrame.union, ordered).withColumn("rank", F.row_number().over(by))], counted

    by_vectors = vectors is not None and dim > 0 and any(r.dense for r in rankings)
    tops = np.zeros(n)
    for r in stream(by_doc, by_words, np.ones(n, bool), 1).select("__q", "score").collect():  # a row a query of the block
        tops[r["__q"]] = r["score"]
    known = spark.createDataFrame(list(enumerate(tops.tolist())), "__q long, __best double")
    if by_vectors:
        by_doc = materialise(by_doc.join(vectors.where("doc IS NOT NULL AND vec IS NOT NULL").select("doc", "vec"), "doc", "left"), "documents")
    first_docs = F.array(*[F.lit(r["doc"]) for r in docs.select("doc").orderBy("doc").limit(k).collect()]).cast(f"array<{doc_kind}>")

    def pair_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), ROWS):
                rows = batch.slice(i, ROWS)
                score, matched = lexical.value.scores(rows)
                query = rows.column("qs").flatten().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(rows)), pc.list_value_length(rows.column("qs")).to_numpy(zero_copy_only=False))
                out = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(query), rows.column("doc").take(out), rows.column("holds").take(out), pa.array(score[row, query]), pa.array(matched[row, query], pa.int64())], names=["__q", "doc", "__holds", "bm25", "matched"])

    open_queries, depth, parts = np.ones(n, bool), max(DEPTH, k), []
    last = lambda df: df.groupBy("__v", "__q").agg(F.count("*").alias("n"), F.min("score").alias("last")).collect()
    while open_queries.any():
        nearest = materialise(stream(by_doc, most(tops), open_queries, depth), "nearest")
        ends = {(r["__v"], r["__q"]): r["last"] for r in last(nearest) if r["n"] >= depth}  # a row for each variant and query of the block
        # what a document outside of these has at most, by ranking and query
        left = [(r.name, q, ends.get((variants.index((r.rules, r.lexical, r.dense)), q), 0.0)) for q in np.flatnonzero(open_queries).tolist() for r in rankings]
        state = spark.createDataFrame(left, "ranking string, __q long, left double")
        pairs = nearest.select("__q", "doc").union(state.select("__q").distinct().select("__q", F.explode(first_docs).alias("doc")))  # documents without any score come by their ids
        asked = materialise(pairs.groupBy("doc").agg(F.collect_set("__q").alias("qs")), "candidates")  # at most a block of queries a document
        chosen = by_doc.join(asked, "doc") if not by_vectors else materialise(by_doc.join(asked, "doc"), "chosen")
        rows = chosen.select("doc", "holds", "dl", "terms", "tfs", "qs").mapInArrow(pair_scores, f"__q long, doc {doc_kind}, __holds long, bm25 double, matched long").join(F.broadcast(known), "__q").join(F.broadcast(names), "__q")
        rows = rows.withColumn("share", F.when(F.col("__best") > 0, F.col("bm25") / F.col("__best")).otherwise(F.col("bm25")))
        if by_vectors:
            product = F.aggregate(F.zip_with("vec", "qvec", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
            dense = F.when((F.size("vec") == dim) & (F.size("qvec") == dim), F.greatest(F.lit(0.0), F.least(F.lit(1.0), product)))
            rows = rows.join(chosen.select("doc", "vec"), "doc").withColumn("dense", F.coalesce(dense, F.lit(0.0)))
        else:
            rows = rows.withColumn("dense", F.lit(0.0))
        orders = [F.struct(F.lit(r.name).alias("ranking"), F.expr(r.score.replace("{factor}", f"({conditions.sql(r.rules)})")).cast("double").alias("score")) for r in rankings]
        scored = rows.select("__q", *keep, F.explode(F.array(*orders)).alias("o")).select("__q", *keep, "o.*")
        by = Window.partitionBy("ranking", "__q").orderBy(F.desc("score"), "doc")
        found = materialise(scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k), "best")
        done = open_queries.copy()
        if depth < n_docs:
            reached = found.groupBy("__q", "ranking").agg(F.min(F.when(F.col("rank") == k, F.col("score"))).alias("last")).join(F.broadcast(state), ["ranking", "__q"])
            short = reached.where((F.col("left") > 0) & (F.col("last").isNull() | (F.col("left") + 10.0 ** (1 - DIGITS) >= F.col("last"))))
            for r in short.select("__q").distinct().collect():  # queries of the block
                done[r["__q"]] = False
        closed = spark.createDataFrame([(int(q),) for q in np.flatnonzero(done)], "__q long")
        parts.append(found.join(F.broadcast(closed), "__q", "left_semi").select("ranking", *keep, "score", "rank"))
        open_queries &= ~done
        depth *= 4
    return parts, counted


def nearest_in_blocks(vectors: DataFrame, asked: DataFrame, k: int, block: int = 2048, rows: int = 16384) -> DataFrame:
    """(query, doc, score, rank): the k largest inner products of unit vectors, clipped to [0, 1], of (query, qvec) among all other (doc, vec); ties to the smaller id.

    Both sides are dealt by hash into blocks of fixed size and each block of queries meets each block of
    vectors as a product of matrices, of which k rows a query stay. No side is held whole anywhere. Null
    vectors, and those of another length than the query's, take no part.
    """
    n_queries, n_vectors = asked.count(), vectors.count()
    ys, xs = max(1, math.ceil(n_queries / block)), max(1, math.ceil(n_vectors / rows))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    kind = vectors.schema["doc"].dataType.simpleString()
    arrow = pa.int64() if kind == "bigint" else pa.string()
    left = vectors.where("vec IS NOT NULL AND doc IS NOT NULL").select(part("doc", xs).alias("x"), every(ys).alias("y"), F.col("doc").alias("id"), F.col("vec").cast("array<double>").alias("vec")).groupBy("x", "y")
    right = asked.where("qvec IS NOT NULL AND query IS NOT NULL").select(every(xs).alias("x"), part("query", ys).alias("y"), F.col("query").alias("id"), F.col("qvec").cast("array<double>").alias("vec")).groupBy("x", "y")

    def multiply(stored: pa.Table, readers: pa.Table) -> pa.Table:
        out = []
        for dim in pc.unique(pc.list_value_length(readers.column("vec"))).to_pylist():
            own, theirs = (t.filter(pc.equal(pc.list_value_length(t.column("vec")), dim)) for t in (stored, readers))
            if not dim or not len(own) or not len(theirs):
                continue
            matrix = lambda t: t.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)  # noqa: E731, B023
            ids, names = (np.asarray(t.column("id").to_numpy()) for t in (own, theirs))
            best = Best(len(names), k)
            v, q = matrix(own), matrix(theirs)
            for i in range(0, len(v), ROWS):
                score = np.round(np.clip(v[i : i + ROWS] @ q.T, 0, 1), DIGITS)
                row, query = np.nonzero((score >= best.least[None]) & (ids[i : i + ROWS, None] != names[None]))
                best.add(query, score[row, query], ids[i : i + ROWS][row], row)
            query, score, doc, _ = best.cut()
            out.append((names[query], doc, score))
        if not out:
            return pa.table({"query": pa.array([], arrow), "doc": pa.array([], arrow), "score": pa.array([], pa.float64())})
        query, doc, score = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"query": pa.array(query, arrow), "doc": pa.array(doc, arrow), "score": pa.array(score)})

    found = left.cogroup(right).applyInArrow(multiply, f"query {kind}, doc {kind}, score double")
    by = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
