"""Mixing sources to target weights by Poisson replication, then a global shuffle.

Each source has a target share of the output; its rate is share * wanted rows / its rows. A
document's count is the inverse of the Poisson distribution with that rate at a point hashed from
its id and a seed: it needs no state, and another run, or a lost executor, gives the same counts.
Copies are dealt to partitions by a hash of (seed, id, copy) and sorted by it there, which is a
uniform random order without a sampling pass.

Only the counts of the sources named in the weights, and one for all others, come to the driver.
A source in the weights without rows is left out and the other shares keep their ratios.

Defined results: a null source is among the others; a row with a null id is drawn and dealt by its
text; rows that repeat an id get equal counts and lie side by side, ordered by a hash of the row; an
empty table gives an empty table; ``rate``, ``n_copies``, ``copy`` and ``shuffle_key`` replace columns
of the same name. Rates have no bound; a caller that
gives ``max_rate`` lowers larger ones to it and loses that part of the target.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import private

#: Key of all sources that the weights do not name.
OTHERS = "*"
#: The production mixture: the twenty sources in equal shares, any others together as much as one.
WEIGHTS: dict[str, float] = {**{f"src{i}": 1.0 for i in range(20)}, OTHERS: 1.0}
SEED = "mix-1"
#: Largest rate of a single draw.
DRAW_RATE = 64.0


def poisson_steps(rate: float) -> list[float]:
    """The distribution function at 0, 1, 2, ... until it is 1 in double precision; a point's count is how many steps it has passed."""
    if rate > 700:
        raise ValueError("exp(-rate) is 0: take the sum of smaller draws")
    steps, term, total, k = [], math.exp(-rate), 0.0, 0
    while True:
        total += term
        if k > rate and term < 1e-18:
            return steps
        steps.append(min(total, 1.0))
        k += 1
        term *= rate / k


def hashed_point(seed: Column, key: Column) -> Column:
    """A uniform point in [0, 1) from 52 bits of MD5."""
    digest = F.md5(F.concat(seed, F.lit(":"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(2.0**52)


def target_rates(docs: DataFrame, weights: Mapping[str, float], source_col: str = "source", size: float = 1.0, max_rate: float | None = None) -> dict[str, float]:
    """Mean number of copies by source, for an output of ``size`` times the input's rows."""
    if any(w < 0 for w in weights.values()):
        raise ValueError("weights are 0 or more")
    named = [k for k in weights if k != OTHERS]
    key = F.when(F.col(source_col).isin(named), F.col(source_col)).otherwise(F.lit(OTHERS))
    rows = {r["k"]: r["n"] for r in docs.groupBy(key.alias("k")).agg(F.count("*").alias("n")).collect()}  # at most len(weights) + 1 rows
    total, share = sum(rows.values()), sum(weights.get(k, 0.0) for k in rows)
    rates = {k: weights.get(k, 0.0) / share * size * total / n if share else 0.0 for k, n in rows.items()}
    return rates if max_rate is None else {k: min(max_rate, r) for k, r in rates.items()}


def mix_sources(docs: DataFrame, weights: Mapping[str, float] = WEIGHTS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", size: float = 1.0, seed: str = SEED, max_rate: float | None = None) -> DataFrame:
    """``docs`` repeated to the target weights in a global random order, with rate, n_copies, copy (from 1) and shuffle_key."""
    rates = target_rates(docs, weights, source_col, size, max_rate)
    named = [k for k in weights if k != OTHERS]
    key = F.when(F.col(source_col).isin(named), F.col(source_col)).otherwise(F.lit(OTHERS))
    draws = {k: max(1, math.ceil(r / DRAW_RATE)) for k, r in rates.items()}
    by_key = lambda values, default: F.create_map(*chain.from_iterable((F.lit(k), v) for k, v in (values or {OTHERS: default}).items()))[key]
    rate = by_key({k: F.lit(r) for k, r in rates.items()}, F.lit(0.0))
    steps = by_key({k: F.array(*map(F.lit, poisson_steps(r / draws[k]))) for k, r in rates.items()}, F.array(F.lit(1.0)))
    n_draws = by_key({k: F.lit(n).cast("long") for k, n in draws.items()}, F.lit(1).cast("long"))
    own_point, own_steps, own_draws, own_key, own_row = private(docs, "point", "steps", "draws", "key", "row")
    of_text = F.concat(F.lit("text:"), F.md5(F.coalesce(F.col(text_col), F.lit("")))) if text_col in docs.columns else F.lit("")
    ident = F.coalesce(F.col(id_col).cast("string"), of_text)
    counted = docs.withColumns({own_key: ident, "rate": rate, own_point: hashed_point(F.lit(seed), ident), own_steps: steps, own_draws: n_draws, own_row: F.monotonically_increasing_id()})
    zero = F.lit(0).cast("long")
    passed = lambda point: F.aggregate(own_steps, F.struct(point.alias("u"), zero.alias("n")), lambda s, x: F.struct(s["u"].alias("u"), (s["n"] + (x <= s["u"]).cast("long")).alias("n")), lambda s: s["n"])
    summed = F.aggregate(F.sequence(F.lit(1).cast("long"), own_draws), zero, lambda n, j: n + passed(hashed_point(F.concat(F.lit(seed + "/"), j.cast("string")), F.col(own_key))))
    n_copies = F.when(F.col(own_draws) == 1, passed(F.col(own_point))).otherwise(summed)
    copies = counted.withColumn("n_copies", n_copies).where("n_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n_copies")))
    out = copies.withColumn("shuffle_key", F.md5(F.concat_ws("#", F.lit(seed), F.col(own_key), F.col("copy").cast("string")))).drop(own_point, own_steps, own_draws, own_key)
    tie = F.xxhash64(*[F.col(f"`{f.name}`") for f in out.schema if "map<" not in f.dataType.simpleString() and f.name != own_row])
    return out.repartition("shuffle_key", own_row).drop(own_row).sortWithinPartitions("shuffle_key", tie)  # equal rows, which share a key, go apart
