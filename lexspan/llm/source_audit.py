"""How much sources of a language differ in their words: each against each, and each against its language.

Terms are counted by source in each task, then laid out by term: all sources of a term stand together. A
cell holds a bounded number of these postings. In it each source is a row of a sparse product, in
Gustavson's way: the row's terms are looked up in the term-major index and what they say about the other
sources is added into one dense accumulator with a place for each. Only the accumulator leaves the cell, a
row for two sources, never a posting pair.

A source that lacks a term still has a smoothed share of it. So the sum over all kept terms starts from
these baselines: for a term that only one of two sources has, its share against the other's baseline, added
up densely by distinct counts; for one that neither has, the two baselines, times the number of such terms;
and where both have it, the accumulator takes their difference and takes back the two baselines.

All numbers are whole. Shares are 1 + floor(SCALE * (count + 2) / (N + 2 V)), for N occurrences of the V kept
terms; the difference of two shares is floor((p - q)^2 / (p + q)).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

SCALE = 1_000_000_000
LEAST_DOCS, BEST_TERMS = 10, 10
#: Distinct terms that a task counts before it hands its counts on.
HELD = 1 << 20
#: Postings of a cell, and elements of a block inside of it.
CELL, BLOCK = 1 << 18, 1 << 20
#: Parts into which the sources of a language are dealt when its pairs are made.
PARTS = 32
#: Letters as they are counted (A-Z in lower case); all else below 128 divides terms.
_TABLE = bytes(c if c >= 128 else ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8").translate(_TABLE).split() if text else []


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term, from rows (lang, source, text); several rows may add up to one."""

    def rows(held: dict[tuple, tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (times, within) in held.items():
            k = len(times)
            if k:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()), pa.array(list(times), pa.string()), pa.array(times.values(), pa.int64()), pa.array(map(within.__getitem__, times), pa.int64())], names=["lang", "source", "term", "n", "docs"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}
        pending = 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                terms = terms_of(text.as_py())
                times, within = held.setdefault((lang, source), (Counter(), Counter()))
                before = len(times)
                times.update(terms)
                within.update(set(terms))
                pending += len(times) - before
                if pending > HELD:
                    yield from rows(held)
                    held, pending = {}, 0
        yield from rows(held)

    return docs.select("lang", "source", "text").mapInArrow(work, "lang string, source string, term string, n long, docs long")


def scaled(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * count / total) for 0 <= count <= total, three digits at a time, so that nothing overflows."""
    out, rest = np.zeros_like(count), count
    for _ in range(3):
        out = out * 1000 + rest * 1000 // total
        rest = rest * 1000 % total
    return out + 1


def scaled_column(count: Column, total: Column) -> Column:
    """As ``scaled``, in decimals; ``total`` above 0."""
    wide = count.cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", wide, total.cast("decimal(20,0)")) + F.lit(1)


def difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def difference_column(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit_cell(source: np.ndarray, term: np.ndarray, n: np.ndarray, totals: np.ndarray, total: int) -> tuple[list[tuple[np.ndarray, ...]], list[tuple[np.ndarray, ...]]]:
    """What the postings (source, term, n) of a cell add to pairs of sources, as (a, b, value, both) with a < b, and its best terms, as (source, term, value).

    ``totals`` has N + 2 V of each source, ``total`` that of the language.
    """
    order = np.lexsort((source, term))
    source, term, n = source[order], term[order], n[order]
    sources = len(totals)
    base = scaled(np.full(sources, 2), totals)
    p = scaled(n + 2, totals[source])
    bounds = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
    size = np.diff(np.append(bounds, len(term)))
    stop = np.repeat(bounds + size, size)
    whole = np.repeat(np.add.reduceat(n, bounds), size)
    q = scaled(whole + 2, np.full(len(whole), total))
    rows = np.argsort(source, kind="stable")
    starts = np.searchsorted(source[rows], np.arange(sources + 1))
    pairs, best = [], []
    for g in range(sources):
        own = rows[starts[g] : starts[g + 1]]
        if not len(own):
            continue
        value, both = np.zeros(sources, np.int64), np.zeros(sources, np.int64)
        shares, times = np.unique(p[own], return_counts=True)
        step = max(1, BLOCK // sources)
        for i in range(0, len(shares), step):
            value += (difference(shares[i : i + step, None], base[None]) * times[i : i + step, None]).sum(0)
        ahead = stop[own] - own - 1  # places of the sources behind g under the same term
        cuts = np.searchsorted(np.cumsum(ahead), np.arange(0, int(ahead.sum()) + 1, BLOCK), "right") if ahead.sum() > BLOCK else np.array([0])
        for i, j in zip(cuts, np.append(cuts[1:], len(own)), strict=True):
            at = np.repeat(own[i:j], ahead[i:j])
            peer = at + 1 + np.arange(len(at)) - np.repeat(np.cumsum(ahead[i:j]) - ahead[i:j], ahead[i:j])
            h = source[peer]
            np.add.at(value, h, difference(p[at], p[peer]) - difference(p[at], base[h]) - difference(base[g], p[peer]))
            both += np.bincount(h, minlength=sources)
        others = np.flatnonzero(np.arange(sources) != g)
        pairs.append((np.minimum(others, g), np.maximum(others, g), value[others], both[others]))
        high = own[p[own] > q[own]]
        gain = difference(p[high], q[high])
        if len(high) > BEST_TERMS:  # all that tie with the last of the best stay, the names decide later
            least = np.partition(gain, len(gain) - BEST_TERMS)[len(gain) - BEST_TERMS]
            high, gain = high[gain >= least], gain[gain >= least]
        best.append((np.full(len(high), g), term[high], gain))
    return pairs, best


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has every other source of the language by falling difference, part ``term`` the ten terms that the source has most above its language.

    Terms are runs of letters (A-Z lower-cased; all characters from 128 on are letters); a language keeps
    those that ten of its documents have.

    Defined results: null texts, languages and sources are read as empty; a source without terms has the
    baselines only; where a language keeps no term, all pairs have 0; ties are ordered by the item's bytes;
    repeated rows are documents of their own; an empty table gives an empty table; other columns are dropped.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    chosen = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    by_term = Window.partitionBy("lang", "term")
    counts = term_counts(chosen).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    first = F.min("source").over(by_term) == F.col("source")
    kept = counts.withColumns({"all": F.sum("docs").over(by_term), "first": first.cast("long")}).where(F.col("all") >= LEAST_DOCS)
    index = materialise(kept.select("lang", "term", "source", "n", "first"), "term_index")
    groups = chosen.select("lang", "source").distinct().join(index.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count("*").alias("size"), F.sum("first").alias("firsts")), ["lang", "source"], "left").na.fill(0, ["n", "size", "firsts"])
    langs = groups.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.sum("firsts").alias("v"))
    number = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long")
    groups = materialise(groups.join(langs, "lang").select("lang", "source", number.alias("no"), "size", "v", (F.col("n") + 2 * F.col("v")).alias("total"), (F.col("lang_n") + 2 * F.col("v")).alias("lang_total")), "sources")
    blocks = max(1, math.ceil((groups.agg(F.sum("size")).first()[0] or 0) / CELL))

    def audit(postings: pa.Table, sources: pa.Table) -> pa.Table:
        sources = sources.sort_by("no")
        lang = sources.column("lang")[0].as_py() if len(sources) else ""
        names, kinds = ["lang", "a", "b", "term", "value", "both"], [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        if not len(postings):
            return pa.table([pa.array([], k) for k in kinds], names=names)
        source = pc.index_in(postings.column("source"), value_set=sources.column("source").combine_chunks()).to_numpy().astype(np.int64)
        coded = postings.column("term").combine_chunks().dictionary_encode()
        pairs, best = audit_cell(source, coded.indices.to_numpy(), postings.column("n").to_numpy(), sources.column("total").to_numpy(), sources.column("lang_total")[0].as_py())
        a, b, value, both = (np.concatenate(c) for c in zip(*pairs, strict=True))
        g, term, gain = (np.concatenate(c) for c in zip(*best, strict=True))
        k, m = len(a), len(g)
        return pa.table([pa.array([lang] * (k + m), kinds[0]), pa.array(np.concatenate([a, g])), pa.array(np.concatenate([b, g])), pa.concat_arrays([pa.nulls(k, kinds[3]), coded.dictionary.take(pa.array(term))]), pa.array(np.concatenate([value, gain])), pa.array(np.concatenate([both, np.zeros(m, np.int64)]))], names=names)

    block = F.pmod(F.xxhash64("term"), F.lit(blocks))
    left = index.select("lang", block.alias("block"), "term", "source", "n").groupBy("lang", "block")
    right = groups.where("v > 0").select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), "source", "no", "total", "lang_total").groupBy("lang", "block")
    found = materialise(left.cogroup(right).applyInArrow(audit, "lang string, a long, b long, term string, value long, both long"), "audit")

    added = found.where("term IS NULL").groupBy("lang", "a", "b").agg(F.sum("value").alias("added"), F.sum("both").alias("both"))
    side = lambda c: groups.select("lang", F.col("source").alias(f"{c}_source"), F.col("no").alias(c), F.col("size").alias(f"{c}_size"), F.when(F.col("v") > 0, scaled_column(F.lit(2), F.col("total")).cast("long")).alias(f"{c}_base"), "v")
    part = F.pmod("a", F.lit(PARTS))
    every = side("b").drop("v").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    pairs = side("a").withColumn("part", part).join(every, ["lang", "part"]).where("a < b").join(added, ["lang", "a", "b"], "left")
    neither = F.col("v") - F.col("a_size") - F.col("b_size") + F.coalesce("both", F.lit(0))
    value = F.when(F.col("v") > 0, F.coalesce("added", F.lit(0)) + neither * difference_column(F.col("a_base"), F.col("b_base"))).otherwise(F.lit(0)).cast("long")
    one_way = lambda x, y: F.struct(F.col(f"{x}_source").alias("source"), F.col(f"{y}_source").alias("item"))
    both_ways = pairs.select("lang", value.alias("value"), F.explode(F.array(one_way("a", "b"), one_way("b", "a"))).alias("x")).select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    terms = found.where("term IS NOT NULL").join(groups.select("lang", F.col("no").alias("a"), "source"), ["lang", "a"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return both_ways.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= BEST_TERMS))
