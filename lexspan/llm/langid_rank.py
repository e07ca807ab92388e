"""Language identification by rank-order profiles of character n-grams.

A language's profile is the ranking of its most frequent n-grams (1 to 3 letters, words set off by a
boundary) in all training texts. A document is ranked the same way; its out-of-place distance to a
profile sums how far each of its n-grams is from its place there, or the profile's length where it
is missing. The nearest profile wins, ties by the language's name.

Training counts n-grams task by task into sorted arrays, adds them up by (language, n-gram) in a
pre-aggregated group, and brings only the profiles, ``PROFILE`` rows a language, to the driver. The
number of n-grams follows the alphabets, not the corpus. Prediction needs no shuffle.

Defined results: a null text, or one without letters, gives ``und`` with score 0, and so does every
text if nothing was learned; rows with a null language do not train; repeated rows count and are
predicted each by itself; ``max_langs`` bounds the languages (more is an error); very long texts
are read whole, in blocks; columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import private

PROFILE = 600
MAX_LANGS = 1000
UNDETERMINED = "und"
#: Code points counted at once.
BLOCK = 1 << 20
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """For each code point its lower-case letter, 0 for what is no letter; built once a process."""
    if not _letters:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if (ch := chr(c)).isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _letters.append(table)
    return _letters[0]


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram codes, counts): up to three 21-bit letters, first letter highest; 1 is a word's boundary in a run of three, 0 is beyond a shorter one's end."""
    codes: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    for k in range(0, len(text or ""), BLOCK):  # n-grams belong to the block of their middle or first letter
        around = ("" if k else "\n") + text[max(0, k - 1) : k + BLOCK + 1] + ("" if k + BLOCK < len(text) else "\n")
        at = letter_table()[np.frombuffer(around.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.uint64)
        before, here, after = at[:-2], at[1:-1], at[2:]
        letter = here != 0
        before, here, after = before[letter], here[letter], after[letter]
        high, one = here << np.uint64(42), np.uint64(1)
        tri = np.maximum(before, one) << np.uint64(42) | here << np.uint64(21) | np.maximum(after, one)
        bi = (high | after << np.uint64(21))[after != 0]
        c, n = np.unique(np.concatenate((tri, bi, high)), return_counts=True)
        codes.append(c)
        counts.append(n)
    return merge_counts(codes, counts)


def merge_counts(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if len(codes) < 2:
        return (codes[0], counts[0]) if codes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    keys, n = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(keys) else n


def ranked(codes: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` most frequent codes, by falling count, then code."""
    return codes[np.lexsort((codes, -counts))][:most]


def train_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", profile: int = PROFILE, max_langs: int = MAX_LANGS) -> dict[str, np.ndarray]:
    """Ranked n-gram codes of each language, from all rows that have a language."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list[np.ndarray], list[np.ndarray], int]] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                codes, counts, size = held.get(lang, ([], [], 0))
                c, n = ngram_counts(text.as_py())
                codes.append(c)
                counts.append(n)
                size += len(c)
                if size > 1 << 20:  # merged now and then, so what is held stays near the number of distinct n-grams
                    merged = merge_counts(codes, counts)
                    codes, counts, size = [merged[0]], [merged[1]], 0
                held[lang] = (codes, counts, size)
        for lang, (codes, counts, _) in held.items():
            c, n = merge_counts(codes, counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(c.astype(np.int64)), pa.array(n)], names=["lang", "code", "n"])

    counted = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(work, "lang string, code long, n long")
    total = counted.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    rows = total.withColumn("r", place).where(F.col("r") <= profile).select("lang", "code", "r").limit(profile * max_langs + 1).collect()
    if len(rows) > profile * max_langs or len({r["lang"] for r in rows}) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    found: dict[str, list[tuple[int, int]]] = {}
    for r in rows:
        found.setdefault(r["lang"], []).append((r["r"], r["code"]))
    return {lang: np.array([c for _, c in sorted(v)], np.uint64) for lang, v in sorted(found.items())}


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], text_col: str = "text", profile: int = PROFILE) -> DataFrame:
    """``docs`` with lang_pred and score: 1 less the nearest distance over the greatest possible."""
    langs = sorted(profiles)
    known = np.unique(np.concatenate([profiles[k] for k in langs])) if langs else np.zeros(0, np.uint64)
    places = np.full((len(known) + 1, len(langs)), -1, np.int64)  # the last row stands for n-grams in no profile
    for j, lang in enumerate(langs):
        places[np.searchsorted(known, profiles[lang]), j] = np.arange(len(profiles[lang]))

    def predict(text: str | None) -> tuple[str, float]:
        codes, counts = ngram_counts(text)
        if not len(codes) or not langs:
            return UNDETERMINED, 0.0
        top = ranked(codes, counts, profile)
        at = np.searchsorted(known, top)
        at[known[np.minimum(at, len(known) - 1)] != top] = len(known)
        there = places[at]
        off = np.where(there < 0, profile, np.abs(there - np.arange(len(top))[:, None])).sum(0)
        best = int(off.argmin())
        return langs[best], 1.0 - float(off[best]) / (profile * len(top))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.names.index(own)
            found = [predict(t.as_py()) for t in batch.column(k)]
            cols = [c for i, c in enumerate(batch.columns) if i != k]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[*(n for n in batch.schema.names if n != own), "lang_pred", "score"])

    rest = docs.drop("lang_pred", "score")
    own = private(rest, "text")[0]
    schema = rest.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return rest.withColumn(own, F.col(text_col)).mapInArrow(work, schema)


def held_out(id_col: Column, parts: int = 3, part: int = 1) -> Column:
    """Whether CRC-32 of the id as text leaves ``part``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % parts == part
