"""Language-model scoring with Brown class-based bigrams.

A token is a word (A-Z lower-cased) or a text's end. Exchange clustering assigns words to classes so
that class bigrams tell most about each other; the model is

    log10 P(text) = sum of log10 P(class | class before) + log10 P(word | class)

Transitions are smoothed towards the classes' own shares; emissions add one to each word's count and
leave one event a class for unknown words, so both sum to 1.

Scale. Words are counted task by task and added up by word over all training texts; so are bigrams,
which make a written table that grows with the corpus. In it each of the ``HEAD`` most frequent words
stands for itself, any other word for its ending. Clustering has two steps:

1. the ``CORE`` most frequent words and ``SUFFIXES`` endings are exchanged on the driver, on a table of at
   most ``CORE + SUFFIXES`` squared counts, until a sweep moves none;
2. every other head word moves to the class that its own neighbours favour, by the same gain: its counts
   of neighbouring classes are sums over the bigram table, and all words move at once, ``WORD_SWEEPS``
   times or until none moves.

Words outside the head, seen or not, have the class of their ending, so every word has a class.
Totals, class sizes and transitions cover every training token. The head is shipped to the tasks with
its counts and classes; counts of other words are joined by word, one row for each text and distinct word.

Defined results: a null text is empty and has one token, its end; null ids count as empty ids for
the training rule; repeated rows count and are scored each by itself; without training texts every
token is unknown and both models give it probability 1 (base: 1 / 1); columns named like an output
are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, private, words_of

CORE, SUFFIXES, CLASSES, HEAD = 768, 255, 64, 65536
#: Weight of the classes' shares in a transition, in tokens.
BACKOFF = 32.0
#: Bounds on the sweeps of either step; the first ends well before.
SWEEPS, WORD_SWEEPS = 100, 2
#: Bigrams that a task holds before it hands counts on.
HELD_BIGRAMS = 1 << 22
#: Distinct words that a task holds before it hands counts on.
HELD = 400_000
#: The end of a text; no word is empty.
END = b""


def _count_words(docs: DataFrame, text_col: str) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                held.update(words_of(text.as_py()))
                held[END] += 1
                if len(held) > HELD:
                    yield out()
                    held = Counter()
        if held:
            yield out()

    return docs.select(F.col(text_col).alias("text")).mapInArrow(work, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def move_gain(table: np.ndarray, row: np.ndarray, col: np.ndarray, left: np.ndarray, right: np.ndarray, own: float) -> np.ndarray:
    """What putting a symbol into each class adds to the mutual information, by its counts after (left), before (right) and beside itself; it is in none of table, row and col."""
    out, into = right.sum() + own, left.sum() + own
    ft, diag = _f(table), np.diag(table)
    gain_l, gain_r = _f(table + left[:, None]) - ft, _f(table + right[None]) - ft
    gain = gain_l.sum(0) - np.diag(gain_l) + gain_r.sum(1) - np.diag(gain_r) + _f(diag + left + right + own) - _f(diag)
    return gain - (_f(row + out) - _f(row) + _f(col + into) - _f(col))


def _shift(table: np.ndarray, row: np.ndarray, col: np.ndarray, c: int, left: np.ndarray, right: np.ndarray, own: float, sign: int) -> None:
    """Puts a symbol into class ``c`` (sign 1) or takes it out (-1)."""
    table[:, c] += sign * left
    table[c] += sign * right
    table[c, c] += sign * own
    row[c] += sign * (right.sum() + own)
    col[c] += sign * (left.sum() + own)


def exchange_classes(bigrams: np.ndarray, k: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each symbol. ``bigrams`` are counts of (symbol, next symbol); symbols are in falling frequency.

    Each symbol in turn moves to the class with the highest mutual information of adjacent classes,
    until a sweep moves none.
    """
    n = len(bigrams)
    k = max(1, min(k, n))
    cls = np.arange(n) % k
    b = bigrams.astype(np.float64)
    own = np.diag(b).copy()
    onehot = np.eye(k)[cls]
    table = onehot.T @ b @ onehot
    row, col = table.sum(1), table.sum(0)
    seen = np.flatnonzero(b.sum(0) + b.sum(1))
    for _ in range(sweeps):
        moved = 0
        for w in seen.tolist():
            a = int(cls[w])
            left, right = np.bincount(cls, b[:, w], k), np.bincount(cls, b[w], k)
            left[a] -= own[w]
            right[a] -= own[w]
            _shift(table, row, col, a, left, right, own[w], -1)
            gain = move_gain(table, row, col, left, right, own[w])
            best = int(gain.argmax()) if gain.max() > gain[a] + 1e-9 else a
            _shift(table, row, col, best, left, right, own[w], 1)
            cls[w] = best
            moved += best != a
        if not moved:
            break
    return cls


class Places(dict):
    """Place of a word: its own in the head, else its ending's, else the last one. Further answers are kept within a bound."""

    def __init__(self, head: Sequence[bytes], suffixes: Sequence[bytes]) -> None:
        super().__init__((w, i) for i, w in enumerate(head))
        self.n_head = len(head)
        self.ends = {s: len(head) + i for i, s in enumerate(suffixes)}
        self.rest = len(head) + len(suffixes)

    def __missing__(self, word: bytes) -> int:
        found = self.ends.get(word[-3:], self.rest)
        if len(self) < self.n_head + HELD:
            self[word] = found
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


@dataclass
class BrownModel:
    """All that scoring needs; ``counts`` (word, n) is the written table of all words, the rest is bounded."""

    counts: DataFrame
    tokens: int
    vocabulary: int
    head: dict[bytes, int]
    head_least: int  # words counted at least so often are in the head
    suffixes: list[bytes]
    classes: np.ndarray  # by place
    transitions: np.ndarray  # log10, (class, next class)
    class_size: np.ndarray  # log10 of tokens + words + 1 by class


def _sums(table: DataFrame, work: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(code, n) added up over what ``work`` makes of each batch of the table's (code, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(work(batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += len(held[-1][0])
            if size > HELD_BIGRAMS:
                held, size = [_added(held)], 0
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], names=["code", "n"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _added(held)], names=["code", "n"])

    return table.mapInArrow(run, "code long, n long")


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    code, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else np.zeros(0, np.int64)
    return code[first], np.add.reduceat(n, first) if len(code) else n


def _matrix(table: DataFrame, of: np.ndarray, size: int) -> np.ndarray:
    """Bigram counts between groups of places, ``of`` being the group of each: ``size`` squared numbers, added up in Spark."""
    m = len(of)
    rows = _sums(table, lambda code, n: (of[code // m] * size + of[code % m], n)).groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size, np.int64)
    out[rows.column("code").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(size, size)


def count_bigrams(docs: DataFrame, text_col: str, head: list[bytes], suffixes: list[bytes]) -> DataFrame:
    """(code, n) of all pairs of neighbouring places, each text's end before and after it; code is place * places + next place."""
    m = len(head) + len(suffixes) + 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, held, size = Places(head, suffixes), [], 0

        def out() -> pa.RecordBatch:
            code, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["code", "n"])

        for batch in batches:
            for text in batch.column(0):
                at = places.of([END, *words_of(text.as_py()), END])
                held.append(at[:-1] * m + at[1:])
                size += len(at)
                if size > HELD_BIGRAMS:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return docs.select(F.col(text_col).alias("text")).mapInArrow(work, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def own_moves(bigrams: DataFrame, classes: np.ndarray, k: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, their best classes) of the places from ``first`` to ``last`` (not included), each by its own neighbours while all others stay."""
    m, width = len(classes), 2 * k + 1
    by_class = _matrix(bigrams, classes, k).astype(np.float64)

    def cells(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = code // m, code % m
        moves = lambda x: (x >= first) & (x < last)
        self_, after, before = moves(a) & (a == b), moves(b) & (a != b), moves(a) & (a != b)
        codes = (a[self_] * width + 2 * k, b[after] * width + classes[a[after]], a[before] * width + k + classes[b[before]])
        return np.concatenate(codes), np.concatenate((n[self_], n[after], n[before]))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]  # all partitions together hold at most the head's words times ``width``
        if not parts:
            return
        code, n = _added(parts)
        at, start = np.unique(code // width, return_index=True)
        found = np.zeros(len(at), np.int64)
        for i, (place, lo, hi) in enumerate(zip(at.tolist(), start.tolist(), [*start[1:].tolist(), len(code)], strict=True)):
            mine = np.zeros(width)
            mine[code[lo:hi] % width] = n[lo:hi]
            left, right, own, a = mine[:k], mine[k : 2 * k], float(mine[2 * k]), int(classes[place])
            table, row, col = by_class.copy(), by_class.sum(1), by_class.sum(0)
            _shift(table, row, col, a, left, right, own, -1)
            gain = move_gain(table, row, col, left, right, own)
            found[i] = int(gain.argmax()) if gain.max() > gain[a] + 1e-9 else a
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found)], names=["place", "class"])

    summed = _sums(bigrams, cells).repartition(F.floor(F.col("code") / width)).groupBy("code", F.floor(F.col("code") / width)).agg(F.sum("n").alias("n"))
    rows = summed.select("code", "n").mapInArrow(best, "place long, class long").toArrow()  # at most HEAD rows
    return rows.column("place").to_numpy(), rows.column("class").to_numpy()


def train(docs: DataFrame, text_col: str = "text", core: int = CORE, suffixes: int = SUFFIXES, classes: int = CLASSES, head: int = HEAD, word_sweeps: int = WORD_SWEEPS) -> BrownModel:
    """Learns from all rows of ``docs``."""
    spark = docs.sparkSession
    counts = materialise(_count_words(docs, text_col), "word_counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    # The head: the most frequent words, equal counts by the word. A histogram of some hundred bins tells the bin in which the bound falls.
    bins = counts.groupBy(F.floor(F.log2("n") * 16).alias("bin")).agg(F.min("n").alias("least"), F.count("*").alias("words")).orderBy(F.desc("bin")).collect()
    least, size, cut = (total["n"] or 0) + 1, 0, []
    for b in bins:
        if size + b["words"] > head:
            cut = counts.where((F.col("n") >= b["least"]) & (F.col("n") < least)).orderBy(F.desc("n"), "word").limit(head - size).collect()
            break
        size, least = size + b["words"], b["least"]
    rows = counts.where(F.col("n") >= least).toArrow()  # at most ``head`` rows, with those that were cut
    in_head = [*zip(rows.column("word").to_pylist(), rows.column("n").to_pylist(), strict=True), *((bytes(r["word"]), r["n"]) for r in cut)]
    in_head.sort(key=lambda x: (-x[1], x[0]))
    least = cut[-1]["n"] + 1 if cut else least
    words = [w for w, _ in in_head]
    outside = counts.join(F.broadcast(spark.createDataFrame([(w,) for w in words[:core]], "word binary")), "word", "left_anti")  # at most ``core`` rows
    ends = outside.where(F.length("word") > 0).groupBy(F.substring("word", -3, 3).alias("s")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "s").limit(suffixes).collect()
    endings = [bytes(r["s"]) for r in ends]
    bigrams = materialise(count_bigrams(docs, text_col, words, endings), "bigrams")
    # First step: the core's words and the endings; a head word outside the core stands for its ending.
    n_core = min(core, len(words))
    symbols = Places(words[:n_core], endings)
    of = np.concatenate((symbols.of(words), np.arange(n_core, symbols.rest + 1)))
    table = _matrix(bigrams, of, symbols.rest + 1)
    order = np.argsort(-table.sum(0), kind="stable")
    by_symbol = np.zeros(len(table), np.int64)
    by_symbol[order] = exchange_classes(table[np.ix_(order, order)], classes)
    k = int(by_symbol.max()) + 1
    by_place = by_symbol[of]
    for _ in range(word_sweeps):
        place, best = own_moves(bigrams, by_place, k, n_core, len(words))
        moved = by_place[place] != best
        by_place = by_place.copy()
        by_place[place] = best
        if not moved.any():
            break
    by_class = _matrix(bigrams, by_place, k)
    share = (by_class.sum(0) + 1) / (by_class.sum() + k)
    transitions = np.log10((by_class + BACKOFF * share) / (by_class.sum(1, keepdims=True) + BACKOFF))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, tokens, kinds = Places(words, endings), np.zeros(k, np.int64), np.zeros(k, np.int64)
        for batch in batches:
            at = by_place[places.of(batch.column(0).to_pylist())]
            tokens += np.bincount(at, batch.column(1).to_numpy(), k).astype(np.int64)
            kinds += np.bincount(at, minlength=k)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(tokens), pa.array(kinds)], names=["class", "tokens", "words"])

    class_size = np.ones(k)
    for r in counts.select("word", "n").mapInArrow(sizes, "class long, tokens long, words long").groupBy("class").agg(F.sum("tokens").alias("t"), F.sum("words").alias("w")).collect():  # a row a class
        class_size[r["class"]] += r["t"] + r["w"]
    return BrownModel(counts, total["n"], total["v"], dict(in_head), least, endings, by_place, transitions, np.log10(class_size))


def score(docs: DataFrame, model: BrownModel, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with n_tokens, n_known, train_tokens, base_score, score and perplexity."""
    broadcast = docs.sparkSession.sparkContext.broadcast((list(model.head), np.log10(np.fromiter(model.head.values(), np.float64, len(model.head)) + 1), model.suffixes, model.classes, model.transitions, model.class_size))  # the head is bounded
    added = ("n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
    rest = docs.drop(*added)
    rid, own_text, known, counted, modelled, rare_words, rare_times, more, seen = private(rest, "rid", "text", "known", "counts", "model", "words", "times", "more", "seen")
    rest = rest.withColumn(rid, F.monotonically_increasing_id())
    keep = [c for c in rest.columns if c != text_col]
    local = [F.lit(0).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias(known), F.lit(0.0).alias(counted), F.lit(0.0).alias(modelled), F.array(F.lit(b"")).alias(rare_words), F.array(F.lit(0).cast("long")).alias(rare_times)]
    schema = rest.select(*keep, *local).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, log_count, suffixes, classes, transitions, class_size = broadcast.value
        places = Places(head, suffixes)
        start = classes[places[END]]
        for batch in batches:
            k = batch.schema.names.index(own_text)
            rows = []
            for text in batch.column(k):
                words = [*words_of(text.as_py()), END]
                at = places.of(words)
                inside = at < len(head)
                cls = classes[at]
                model_score = float(transitions[np.concatenate(([start], cls[:-1])), cls].sum() - class_size[cls].sum())
                rare = Counter(compress(words, (~inside).tolist()))
                rows.append((len(words), int(inside.sum()), float(log_count[at[inside]].sum()), model_score, list(rare.keys()), list(rare.values())))
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64())]
            cols = [c for i, c in enumerate(batch.columns) if i != k]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))] if rows else [*cols, *(pa.array([], t) for t in kinds)], names=schema.fieldNames())

    own = materialise(rest.select(*keep, F.col(text_col).alias(own_text)).mapInArrow(work, schema), "scored")
    rare = own.select(F.col(rid).alias("rid"), F.explode(F.arrays_zip(F.col(rare_words).alias("word"), F.col(rare_times).alias("times"))).alias("x")).select("rid", "x.word", "x.times")
    found = rare.join(model.counts.where(F.col("n") < model.head_least), "word")
    sums = found.groupBy(F.col("rid").alias(rid)).agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias(more), F.sum("times").alias(seen))
    out = own.drop(rare_words, rare_times).join(sums, rid, "left")
    counts_sum = F.col(counted) + F.coalesce(more, F.lit(0.0))
    space = float(np.log10(model.tokens + model.vocabulary + 1))
    out = out.withColumns({"n_known": F.col(known) + F.coalesce(seen, F.lit(0)), "train_tokens": F.lit(model.tokens).cast("long"), "base_score": counts_sum - F.col("n_tokens") * F.lit(space), "score": counts_sum + F.col(modelled)})
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))).drop(rid, known, counted, modelled, more, seen)
