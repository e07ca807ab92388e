"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Each row of the table names a measure of a text and the closed range it has to lie in. A text is
kept if every measure is in range. All work is done inside the row with built-in array functions:
no shuffle, no Python, so a hot source or a large group of copies is no different from other rows.

Defined results: a null text counts as an empty one (no words, so it fails); a row keeps all its
columns, repeated rows stay repeated; an empty table gives an empty table; the measures are named
``n_words``, ``word_chars``, ... and replace columns of the same name in the input; a very long
text costs n log n in its number of words.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

#: Characters that count as symbols.
SYMBOLS = "[#*$%&|<>]"
# Frequent function words of the languages that are kept.
STOP_WORDS = (
    "the of and to in a is that it for on was be with as this by are at from "
    "de la le que des et les un une en du est "
    "der die und den von zu das mit sich ist "
    "el los se del las por con y"
).split()


#: Columns that measuring adds.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_stop_words", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Threshold:
    """``low * denominator <= numerator <= high * denominator``; an absent bound is not tested."""

    name: str
    numerator: str
    denominator: str = "1"
    low: float | None = None
    high: float | None = None


#: The production table. Ratios are compared by multiplication, so a zero denominator is no special case.
THRESHOLDS: tuple[Threshold, ...] = (
    Threshold("length", "n_words", low=50, high=1_000_000),
    Threshold("mean_word_length", "word_chars", "n_words", low=2.0, high=14.0),
    Threshold("symbols_per_word", "n_symbols", "n_words", high=0.25),
    Threshold("stop_words_per_word", "n_stop_words", "n_words", low=0.05),
    Threshold("repeated_lines", "n_dup_lines", "n_lines", high=0.50),
    Threshold("repeated_windows", "n_repeat_words", "n_words", high=0.50),
)


def _repeated_positions(words: Column, hashes: Column) -> Column:
    """Positions of the 3-word windows whose hash another window shares, sorted.

    Sorting (hash, position) brings equal windows together. Texts without a repeat, told by
    ``array_distinct``, skip the sort. Lambdas see their own arguments only, so nothing is
    computed anew per element.
    """
    keyed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    shared = F.zip_with(keyed, F.slice(keyed, 2, F.size(words)), lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"])))
    found = F.sort_array(F.array_distinct(F.flatten(F.filter(shared, lambda x: x.isNotNull()))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), found)


def _window_hashes(words: Column) -> Column:
    """The 64-bit hash of each 3-word window; two chained hashes keep word borders apart."""
    n = F.size(words)
    pairs = F.zip_with(words, F.slice(words, 2, n), lambda a, b: F.xxhash64(a, b))
    return F.slice(F.zip_with(pairs, F.slice(words, 3, n), lambda h, c: F.xxhash64(h, c)), 1, F.greatest(n - 2, F.lit(0)))


def _covered(positions: Column) -> Column:
    """Words covered by windows of 3 at sorted positions: 3 for the last, else at most the step to the next."""
    steps = F.zip_with(positions, F.slice(positions, 2, F.size(positions)), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)


def measure_quality(docs: DataFrame, text_col: str = "text", stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_stop_words, n_lines, n_dup_lines and n_repeat_words."""
    kept = [docs[f"`{c}`"] for c in docs.columns if c.lower() not in MEASURES]
    # The input's columns go along in a struct, so that none can clash with the helpers.
    packed = docs.select(F.struct(*kept).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("whole"))
    first = packed.select(
        "row",
        F.regexp_extract_all("whole", F.lit(WORD), F.lit(0)).alias("words"),
        F.filter(F.split("whole", "\n", -1), lambda line: line.rlike(WORD)).alias("lines"),
        F.regexp_count("whole", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
    )
    second = first.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "word_chars": F.length(F.array_join("words", "")).cast("long"),
            "n_stop_words": F.size(F.filter("words", lambda w: F.lower(w).isin(*stop_words))).cast("long"),
            "n_lines": F.size("lines").cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "hashes": _window_hashes(F.col("words")),
        }
    )
    third = second.withColumn("positions", _repeated_positions(F.col("words"), F.col("hashes")))
    fourth = third.withColumn("n_repeat_words", F.coalesce(_covered(F.col("positions")), F.lit(0).cast("long")))
    # Filters on the measures stop at an explode of one row; pushed into the projections above they would compute each measure anew wherever they name it.
    return fourth.select("row", F.explode(F.array(F.struct(*MEASURES))).alias("m")).select("row.*", "m.*")


def compile_thresholds(table: Sequence[Threshold] = THRESHOLDS) -> tuple[Column, Column]:
    """(verdict, names of the failed rules) as Columns over the measures."""
    tests: list[tuple[str, Column]] = []
    for t in table:
        num, den = F.expr(t.numerator).cast("double"), F.expr(t.denominator).cast("double")
        ok = F.lit(True)
        if t.low is not None:
            ok = ok & (num >= den * F.lit(float(t.low)))
        if t.high is not None:
            ok = ok & (num <= den * F.lit(float(t.high)))
        tests.append((t.name, ok))
    verdict = F.lit(True)
    for _, ok in tests:
        verdict = verdict & ok
    failed = F.filter(F.array(*[F.when(~ok, F.lit(name)) for name, ok in tests]), lambda x: x.isNotNull())
    return verdict, failed


def apply_quality_rules(docs: DataFrame, text_col: str = "text", table: Sequence[Threshold] = THRESHOLDS) -> DataFrame:
    """``docs`` with the measures, ``base_failed``, ``kept`` and ``failed_rules``."""
    verdict, failed = compile_thresholds(table)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measure_quality(docs, text_col).withColumns({"base_failed": base, "kept": ~base & verdict, "failed_rules": failed})
