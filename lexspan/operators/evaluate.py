"""Measures of rankings and classifiers, and paired tests, as grouped aggregates."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspan.sources.scratch import materialise


def ranking_metrics(first_hit: DataFrame, *groups: str) -> DataFrame:
    """Means over rows with ``rank`` (of the first hit, null without one): recall5, p1, p3, mrr, ndcg5."""
    r = F.col("rank")
    mean = lambda c, n: F.round(F.avg(F.coalesce(c, F.lit(0.0))), 6).alias(n)
    return first_hit.groupBy(*groups).agg(
        F.count("*").alias("n"),
        mean((r <= 5).cast("double"), "recall5"),
        mean((r <= 1).cast("double"), "p1"),
        mean((r <= 3).cast("double"), "p3"),
        mean(1.0 / r, "mrr"),
        mean(F.when(r <= 5, 1 / F.log2(r + 1)), "ndcg5"),
    )


def binomial_tail(n: Column, most: Column) -> Column:
    """The chance of at most ``most`` heads in n tosses: each term's logarithm follows from the one before."""
    step = lambda s, i: F.struct((s["term"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double"))).alias("term"), (s["sum"] + F.exp(s["term"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double")))).alias("sum"))
    none = -n.cast("double") * F.lit(0.6931471805599453)
    places = F.when(most >= 1, F.sequence(F.lit(1), F.greatest(most, F.lit(1)).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, F.struct(none.alias("term"), F.exp(none).alias("sum")), step, lambda s: s["sum"])


def mcnemar(counts: DataFrame) -> DataFrame:
    """For rows with b and c (discordant pairs): the exact two-sided p and chi-squared with continuity correction."""
    n, low = F.col("b") + F.col("c"), F.least("b", "c")
    gap = F.greatest(F.abs(F.col("b") - F.col("c")) - 1, F.lit(0))
    return counts.withColumns({"p_exact": F.round(F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * binomial_tail(n, low))), 6), "chi2": F.round(F.when(n == 0, 0.0).otherwise(gap * gap / n), 6)})


def holm(df: DataFrame, p: str, family: str, order: str) -> DataFrame:
    """``df`` with the Holm-adjusted p within each family: the running maximum of (m - rank + 1) p, at most 1."""
    w = Window.partitionBy(family).orderBy(p, order)
    m = F.count("*").over(Window.partitionBy(family))
    step = F.least(F.lit(1.0), (m - F.row_number().over(w) + 1) * F.col(p))
    return df.withColumn("__s", step).withColumn("p_holm", F.round(F.max("__s").over(w.rowsBetween(Window.unboundedPreceding, 0)), 6)).drop("__s")


def poisson_cuts(scale: int = 1 << 32) -> list[int]:
    """A uniform number below ``scale`` that is not less than k of the cuts stands for k draws of a Poisson distribution with mean 1."""
    cuts, term, total, k = [], math.exp(-1), math.exp(-1), 0
    while int(total * scale) < scale - 1 and k < 12:
        cuts.append(int(total * scale))
        k += 1
        term /= k
        total += term
    return cuts


#: Turns, places and addends of the 64 steps of MD5.
_STEPS = [((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))[i // 16][i % 4] for i in range(64)]
_WORDS = [(i, (5 * i + 1) % 16, (3 * i + 5) % 16, 7 * i % 16)[i // 16] for i in range(64)]
_ADDED = [int(abs(math.sin(i + 1)) * (1 << 32)) for i in range(64)]


@lru_cache(maxsize=64)
def _tails(start: int, n: int) -> np.ndarray:
    """The 16 words of MD5's only block for texts of ``start`` zero bytes and a number below n; a row a word."""
    block = np.zeros((n, 64), np.uint8)
    for i in range(n):
        digits = str(i).encode() + b"\x80"
        block[i, start : start + len(digits)] = list(digits)
        block[i, 56:60] = list((8 * (start + len(digits) - 1)).to_bytes(4, "little"))
    return np.ascontiguousarray(block.view("<u4").T)


def numbered_md5(heads: list[bytes], n: int) -> np.ndarray:
    """The MD5 digests of ``heads``, all of one length, with each number from 0 to n - 1 behind: (4, heads, n) numbers, the eight hex digits from 0, 8, 16 and 24 on."""
    if len(heads[0]) + len(str(n - 1)) > 55:  # more than one block
        return np.array([[np.frombuffer(hashlib.md5(h + str(i).encode()).digest(), ">u4") for i in range(n)] for h in heads], np.uint32).transpose(2, 0, 1)
    own = np.stack([np.frombuffer(h.ljust(64, b"\0"), "<u4") for h in heads])
    words = [t[:1] | own[:, j : j + 1] if (t == t[0]).all() else t | own[:, j : j + 1] for j, t in enumerate(_tails(len(heads[0]), n))]
    first = [np.full((len(heads), n), x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (x.copy() for x in first)
    f, turned = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, f)
            f ^= d
        else:
            np.invert(d, f)
            f |= b
            f ^= c
        a += f
        a += words[_WORDS[i]] + np.uint32(_ADDED[i])
        np.left_shift(a, np.uint32(_STEPS[i]), turned)
        a >>= np.uint32(32 - _STEPS[i])
        a |= turned
        a += b
        a, b, c, d = d, a, b, c
    return np.stack([(x + y).byteswap() for x, y in zip((a, b, c, d), first, strict=True)])


#: Groups whose sums a task holds before it hands them on, and draws made at once.
GROUPS, AT_ONCE = 256, 20_000


def _sums_by_round(rows: DataFrame, group: str, names: list[str], rounds: int, draw: Callable[[list[dict]], np.ndarray]) -> DataFrame:
    """(group, __r, names): for each round the sum of what the rows draw; ``draw`` takes rows whose ``__k`` are of one length and gives (names, rows, rounds) numbers. A task adds up its rows before the shuffle."""

    def hand_on(held: dict) -> Iterator[pa.RecordBatch]:
        for name, total in held.values():
            columns = [name.take(pa.array(np.zeros(rounds, np.int64))), pa.array(np.arange(rounds), pa.int32()), *map(pa.array, total)]
            yield pa.RecordBatch.from_arrays(columns, names=[group, "__r", *names])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            found = sorted(({**row, "__at": i} for i, row in enumerate(batch.to_pylist())), key=lambda row: len(row["__k"].encode()))
            for _, same in groupby(found, key=lambda row: len(row["__k"].encode())):
                for some in iter(lambda same=same: list(islice(same, max(1, AT_ONCE // rounds))), []):
                    for row, drawn in zip(some, draw(some).swapaxes(0, 1), strict=True):
                        if row[group] not in held:
                            if len(held) >= GROUPS:
                                yield from hand_on(held)
                                held = {}
                            held[row[group]] = (batch.column(group).slice(row["__at"], 1), np.zeros((len(names), rounds), np.int64))
                        held[row[group]][1][:] += drawn
        yield from hand_on(held)

    sums = rows.mapInArrow(work, f"`{group}` {rows.schema[group].dataType.simpleString()}, __r int, " + ", ".join(f"{c} long" for c in names))
    return sums.groupBy(group, "__r").agg(*[F.sum(c).alias(c) for c in names])


def _interval(means: DataFrame, group: str) -> DataFrame:
    q = lambda p: F.round(F.percentile("mean", F.lit(p)), 6)
    return means.groupBy(group).agg(q(0.025).alias("lo"), q(0.975).alias("hi"), F.round(F.avg((F.col("mean") <= 0).cast("int")), 6).alias("p_one_sided"))


def sign_bootstrap(df: DataFrame, group: str, key: str, salt: str, rounds: int = 5000) -> DataFrame:
    """(group, lo, hi, p_one_sided): percentile interval of the mean of differences of -1, 0 and 1, of which the group has ``c``, n - b - c and ``b``.

    Each row makes one draw a round, by a hash of its key: a place among its group's n sorted differences. Rows bring
    n, b and c along, so no draw is joined with a row, and a task adds up its draws before the shuffle.
    """

    def draw(rows: list[dict]) -> np.ndarray:
        n, b, c = (np.array([[row[x]] for row in rows]) for x in ("__n", "__b", "__c"))
        i = numbered_md5([f"{salt}|{row['__k']}|".encode() for row in rows], rounds)[0] % n
        return ((i >= n - b).astype(np.int64) - (i < c))[None]

    rows = df.select(group, F.col(key).cast("string").alias("__k"), *[F.col(c).cast("long").alias(f"__{c}") for c in ("n", "b", "c")])
    sizes = rows.groupBy(group).agg(F.max("__n").alias("__n"))
    return _interval(_sums_by_round(rows, group, ["__gap"], rounds, draw).join(F.broadcast(sizes), group).select(group, (F.col("__gap") / F.col("__n")).alias("mean")), group)


def paired_bootstrap(df: DataFrame, group: str, key: str, gap: str, salt: str, rounds: int = 5000, unit: int = 1_000_000) -> DataFrame:
    """(group, lo, hi, p_one_sided): percentile interval of the mean of ``gap`` (whole numbers, ``unit`` to 1) and the share of rounds in which it is not above 0.

    Whatever values the differences take: in each round a row weighs as often as a Poisson draw of mean 1 from a
    hash of its key says, which is the bootstrap of large samples. No draw is joined with a row, a task sums
    its rows of a round before the shuffle, and whole sums make the result the same in any order. Four rounds share
    a hash. Rounds in which no row of a group weighs are left out; null gaps take no part.
    """
    rows = df.where(F.col(gap).isNotNull()).select(F.col(group), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("__k"), F.col(gap).cast("long").alias("__g"))
    cuts = np.array(poisson_cuts(), np.uint32)

    def draw(rows: list[dict]) -> np.ndarray:
        u = numbered_md5([f"{salt}|{row['__k']}|".encode() for row in rows], (rounds + 3) // 4)
        weight = np.searchsorted(cuts, u.transpose(1, 2, 0).reshape(len(rows), -1)[:, :rounds], "right")
        return np.stack([weight, weight * np.array([[row["__g"]] for row in rows])])

    sums = _sums_by_round(rows, group, ["__w", "__sum"], rounds, draw).where("__w > 0")
    return _interval(sums.select(group, (F.col("__sum") / F.col("__w") / unit).alias("mean")), group)


def precision_recall(df: DataFrame, score: str, truth: str, parts: int | None = None) -> DataFrame:
    """(threshold, pos, n, tp, seen, precision, recall) at each distinct score, highest first: the precision-recall curve.

    Rows are first counted by distinct score. Those are dealt out by ranges of the score and written, so
    that the running sums have an order of parts: a part's own sums, after the totals of the parts above it.
    """
    spark = df.sparkSession
    steps = df.groupBy(F.col(score).alias("threshold")).agg(F.sum(F.col(truth).cast("long")).alias("pos"), F.count("*").alias("n"))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(steps.repartitionByRange(parts, F.desc("threshold")).withColumn("part", F.spark_partition_id()), "score_steps")
    totals = {r["part"]: (r["pos"], r["n"]) for r in dealt.groupBy("part").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")).collect()}  # a row a part
    offsets, tp, seen = [], 0, 0
    for part in sorted(totals):
        offsets.append((part, tp, seen))
        tp, seen = tp + totals[part][0], seen + totals[part][1]
    above = spark.createDataFrame(offsets, "part int, tp_above long, seen_above long")
    w = Window.partitionBy("part").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    run = dealt.join(F.broadcast(above), "part").withColumns({"tp": F.col("tp_above") + F.sum("pos").over(w), "seen": F.col("seen_above") + F.sum("n").over(w)})
    return run.select("threshold", "pos", "n", "tp", "seen", (F.col("tp") / F.col("seen")).alias("precision"), (F.col("tp") / F.lit(max(1, tp))).alias("recall"))


def average_precision(df: DataFrame, score: str, truth: str) -> DataFrame:
    """Area under the precision-recall steps: sum of recall gained times precision there."""
    curve = precision_recall(df, score, truth)
    return curve.agg(F.round(F.sum(F.col("pos") * F.col("precision")) / F.sum("pos"), 6).alias("ap"), F.sum("pos").alias("positives"))


def best_threshold(df: DataFrame, score: str, truth: str, grid: list[float]) -> DataFrame:
    """The threshold of the grid with the highest F1 (the lowest on a tie): one pass that counts all thresholds side by side."""
    s, t = F.col(score), F.col(truth) == 1
    sums = [F.struct(F.lit(g).alias("threshold"), F.count_if((s >= g) & t).alias("tp"), F.count_if((s >= g) & ~t).alias("fp"), F.count_if((s < g) & t).alias("fn")) for g in grid]
    rows = df.agg(*[c.alias(f"c{i}") for i, c in enumerate(sums)]).select(F.explode(F.array(*[F.col(f"c{i}") for i in range(len(grid))])).alias("c")).select("c.*")
    f1 = F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") == 0, 0.0).otherwise(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))
    return rows.withColumn("f1", F.round(f1, 6)).orderBy(F.desc("f1"), "threshold").limit(1)
