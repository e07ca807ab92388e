"""Runs of repeated words, found by the grouping phase of Baier's suffix sorting.

The grouping phase takes suffixes group by group, the highest first. A group holds the suffixes that
begin with one Lyndon word; when it is taken, that word is the longest Lyndon word at each of its places,
so its end is the Lyndon array there, and no suffix sorting has to follow. The suffix just before a taken
one is extended by the taken word, and those of a group that were extended move to its upper end, in the
order of what they were extended by.

Groups are taken many at a time: all down to the highest one that holds a suffix whose successor is
higher and still open. Nothing that is taken together extends another, so this is the same order of
work; about the square root of the words as many steps are left, each over whole arrays. Texts of a batch
are handled as one, divided by a symbol below all words.

Both orders of the words are run. By the runs theorem every run with period q repeats, under one of the two
orders, a Lyndon word of q words that is the longest one at its places. So a run of exponent e shows as
ceil(e) - 1 equal groups in a row, and the longest common extensions of two neighbouring ones to the left
and to the right give its start and length.

Equal words in a row before an extended one (``u u u v``) are extended at once where what follows is lower.

A text is one task's work, with about 150 bytes of memory a word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of the texts that are handled as one.
BATCH_WORDS = 1 << 18
#: Longer inputs have numbers that do not fit in one sort key.
PACKED = 1 << 20
Run = tuple[int, int, int]


def _breaks(apart: np.ndarray) -> np.ndarray:
    """Where pieces start, by whether each element but the first is apart from the one before; the length comes last."""
    return np.concatenate(([0], apart.nonzero()[0] + 1, [len(apart) + 1]))


def _sorted_classes(keys: Sequence[np.ndarray], packed: bool) -> tuple[np.ndarray, np.ndarray]:
    """(order, whether an element but the first differs from the one before) by three keys, the first most significant."""
    if packed:
        key = keys[0].astype(np.int64)
        for k in keys[1:]:
            key <<= 21
            key |= k
        order = key.argsort(kind="stable")
        key = key[order]
        return order, key[1:] != key[:-1]
    order = np.lexsort(keys[::-1])
    apart = np.zeros(len(order) - 1, bool)
    for key in keys:
        apart |= key[order][1:] != key[order][:-1]
    return order, apart


def _unrolled(before: np.ndarray, base: np.ndarray, new: np.ndarray, low: int, suffixes: np.ndarray, group: np.ndarray, succ: np.ndarray, pred: np.ndarray, end: np.ndarray, done: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(before, base, new) with all of the equal words that stand in a row before an extended one of the highest open group.

    For u u u v each u is extended by all that follows it; one after the other would take a step a word.
    If nothing lies between that group and what was taken, and what follows v is lower than u, then the
    last words are known: u v, u u v, and so on, each below the one before.
    """
    highest = int(base[-1])
    start = int(base.searchsorted(highest))
    ends = before[start:]
    extended = np.sort(ends)
    plain = lambda x: extended[np.minimum(extended.searchsorted(x), len(ends) - 1)] != x
    chained = (group[pred[ends]] == highest) & plain(pred[ends])
    if not chained.any() or (chained & (group[succ[ends]] >= highest)).any():
        return before, base, new
    members = np.sort(suffixes[highest:low])
    rows = _breaks((pred[members[1:]] != members[:-1]) | ~plain(members[:-1]))
    last = members.searchsorted(ends[chained])
    first = rows[rows.searchsorted(last, "right") - 1]
    count, after = last - first, succ[ends[chained]]
    which = np.arange(len(last)).repeat(count)
    depth = np.arange(len(which)) - (np.cumsum(count) - count).repeat(count) + 1
    there = members[last[which] - depth]
    end[there] = after[which]
    end[ends[chained]] = after
    done[there] = done[ends[chained]] = True
    heads = members[first]  # only these stay open
    done[heads] = False
    succ[heads], pred[after] = after, heads
    label = np.concatenate(([0], new[start:].cumsum()))[chained.nonzero()[0]][which]
    order = np.lexsort((label, -depth))
    label, depth = label[order], depth[order]
    apart = (label[1:] != label[:-1]) | (depth[1:] != depth[:-1])
    edge = new[start - 1 : start] if start else new[:0]
    joined = np.concatenate((new[: max(0, start - 1)], edge, apart, [True], new[start:]))
    return np.concatenate((before[:start], there[order], ends)), np.concatenate((base[:start], np.full(len(there), highest, base.dtype), ends * 0 + highest)), joined


def lyndon_groups(letters: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(end, group) of each place: the end of the longest Lyndon word there, and a number that equal such words share.

    ``letters`` are positive numbers in the order of the words, with 0 between texts, at the start and at
    the end; ``order`` sorts them. Places with 0 have no end.
    """
    n = len(letters)
    packed = n <= PACKED
    suffixes = order.astype(np.int32)
    at = np.empty(n, np.int32)
    at[suffixes] = np.arange(n, dtype=np.int32)
    sizes = np.bincount(letters)
    starts = (np.cumsum(sizes) - sizes).astype(np.int32)
    group = starts[letters]
    size = np.zeros(n + 1, np.int32)
    size[starts[sizes > 0]] = sizes[sizes > 0]
    succ, pred = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    end, moved, done = np.zeros(n, np.int32), np.zeros(n, bool), np.zeros(n, bool)
    top, floor, width = n, int(sizes[0]), 64
    while top > floor:
        low = int(group[suffixes[max(floor, top - width)]])
        taken = suffixes[low:top]
        own = group[taken]
        open_ends = ((group[succ[taken]] > own) & ~done[taken]).nonzero()[0]
        if len(open_ends):
            lowest = int(own[open_ends[-1]])
            cut = lowest + int(size[lowest]) - low
            taken, low = taken[cut:], low + cut
            width = len(taken) + len(taken) // 2 + 16
        else:
            width *= 2
        top = low
        taken = np.sort(taken[~done[taken]])
        if not len(taken):
            continue
        ends = succ[taken]
        end[taken] = ends
        apart = taken[1:] != ends[:-1]  # the next taken one does not follow at once
        block = _breaks(apart)
        before, after = pred[taken[block[:-1]]], ends[block[1:] - 1]
        succ[before], pred[after] = after, before
        real = (letters[before] > 0).nonzero()[0]
        if not len(real):
            continue
        # What each is extended by: equal words in a row count as one piece with a number.
        word = group[taken]
        piece = _breaks(apart | (word[1:] != word[:-1]))
        lead = piece.searchsorted(block)
        pieces, lead, before = (lead[1:] - lead[:-1])[real], lead[:-1][real], before[real]
        value, times = word[piece[:-1]], piece[1:] - piece[:-1]
        base = group[before]
        sort, new = _sorted_classes((base, value[lead], times[lead]), packed)
        level = 1
        while (more := pieces > level).any():
            label = np.concatenate(([0], new.cumsum()))
            rank = np.empty(len(sort), np.int64)
            rank[sort] = label
            if not (more & (np.bincount(label)[rank] > 1)).any():
                break
            nth = np.where(more, lead + level, 0)
            sort, new = _sorted_classes((rank, np.where(more, value[nth] + 1, 0), np.where(more, times[nth], 0)), packed)
            level += 1
        # Those of a group that were extended move to its upper end.
        before, base = before[sort], base[sort]
        if int(base[-1]) + int(size[base[-1]]) == low:
            before, base, new = _unrolled(before, base, new, low, suffixes, group, succ, pred, end, done)
        heads = _breaks(base[1:] != base[:-1])
        count, old = heads[1:] - heads[:-1], base[heads[:-1]]
        lower = old + size[old] - count
        target = (lower - heads[:-1]).repeat(count) + np.arange(len(base))
        marks = _breaks(new)
        span, named = marks[1:] - marks[:-1], target[marks[:-1]]
        size[old] -= count.astype(np.int32)
        size[named] = span
        group[before] = named.repeat(span)
        source = at[before]
        gap = source[source < lower.repeat(count)]
        if len(gap):
            moved[before] = True
            there = suffixes[target]
            stay = there[~moved[there]]
            moved[before] = False
            suffixes[gap], at[stay] = stay, gap
        suffixes[target], at[before] = before, target
    return end, group


def common_extension(letters: np.ndarray, a: int, b: int, step: int) -> int:
    """How many letters from a and from b on are equal, forwards (step 1) or backwards (-1); 0 in ``letters`` ends it."""
    n, width = 0, 32
    while True:
        x = letters[a + n : a + n + width] if step > 0 else letters[max(0, a - n - width + 1) : a - n + 1][::-1]
        y = letters[b + n : b + n + width] if step > 0 else letters[max(0, b - n - width + 1) : b - n + 1][::-1]
        m = min(len(x), len(y))
        apart = np.flatnonzero((x[:m] != y[:m]) | (x[:m] == 0))
        if len(apart):
            return n + int(apart[0])
        if m < width:
            return n + m
        n, width = n + m, width * 2


def runs_of(letters: np.ndarray, exponent: int = 4, least: int = 6) -> list[Run]:
    """(start, length, period) of all runs of at least ``least`` letters and ``exponent`` periods, in order.

    ``letters`` as in ``lyndon_groups``; ``exponent`` is 2 or more.
    """
    up = np.argsort(letters, kind="stable")
    zeros = int((letters == 0).sum())
    down = np.concatenate([up[:zeros], up[zeros:][::-1]])
    found: set[Run] = set()
    for order, text in ((up, letters), (down, np.where(letters > 0, letters.max() + 1 - letters, 0))):
        end, group = lyndon_groups(text, order)
        here = np.flatnonzero((letters > 0) & (letters[end] > 0))
        here = here[group[here] == group[end[here]]]
        period = end[here] - here
        previous = np.maximum(here - period, 0)
        heads = here[~((end[previous] == here) & (group[previous] == group[here]))] if exponent > 2 else here
        for i in heads.tolist():
            p = int(end[i]) - i
            j, copies = i + p, 2
            while copies < exponent - 1 and group[end[j]] == group[i] and letters[end[j]] > 0:
                j, copies = int(end[j]), copies + 1
            if copies >= exponent - 1:
                right, left = common_extension(letters, i, i + p, 1), common_extension(letters, i - 1, i + p - 1, -1)
                if left + right + p >= max(least, exponent * p):
                    found.add((i - left, left + right + p, p))
        if exponent == 2:  # one Lyndon word is enough
            for i in np.flatnonzero((letters > 0) & (letters[end] > 0)).tolist():
                p = int(end[i]) - i
                right, left = common_extension(letters, i, i + p, 1), common_extension(letters, i - 1, i + p - 1, -1)
                if left + right >= p and left + right + p >= least:
                    found.add((i - left, left + right + p, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _divided(letters: np.ndarray, exponent: int, least: int) -> np.ndarray:
    """``letters`` with 0 for those that no such run can hold: a run has each of its words ``exponent`` times at least, and ``least`` words."""
    out = letters.copy()
    text = np.cumsum(letters == 0)
    _, key, count = np.unique(text * np.int64(int(letters.max()) + 1) + letters, return_inverse=True, return_counts=True)
    out[count[key] < exponent] = 0
    gaps = np.flatnonzero(out == 0)
    short = np.flatnonzero(np.diff(gaps) <= least)
    for shift in range(1, least):  # the up to least - 1 words of a short piece
        inside = gaps[short] + shift
        out[inside[inside < gaps[short + 1]]] = 0
    return out


def runs_of_texts(texts: Sequence[list[bytes]], exponent: int = 4, least: int = 6) -> list[list[Run]]:
    """The runs of each text, a list of words; all texts share one pass.

    Words that a text has less than ``exponent`` times are in no run, so they divide it like its ends do, and
    only the pieces between them are grouped.
    """
    known: dict[bytes, int] = {}
    for words in texts:
        known.update(dict.fromkeys(words, 0))
    names = np.random.default_rng(len(known)).permutation(len(known)) + 1  # any order serves; a mixed one leaves few steps
    known = dict(zip(known, names.tolist(), strict=True))
    sizes = np.array([len(w) for w in texts])
    starts = np.cumsum(sizes + 1) - sizes
    letters = np.zeros(int(sizes.sum()) + len(texts) + 1, np.int32)
    for start, words in zip(starts.tolist(), texts, strict=True):
        letters[start : start + len(words)] = np.fromiter(map(known.__getitem__, words), np.int32, len(words))
    divided = _divided(letters, exponent, least)
    kept = np.flatnonzero((divided > 0) | (np.append(divided[1:], 1) > 0))  # a piece and the 0 before it
    dense = np.append(divided[kept], 0)
    present = np.zeros(int(dense.max()) + 1, np.int32)
    present[dense] = 1
    out: list[list[Run]] = [[] for _ in texts]
    for start, length, period in runs_of((np.cumsum(present) - 1)[dense] if present[0] else dense, exponent, least):
        start = int(kept[start])
        i = int(np.searchsorted(starts, start, "right")) - 1
        out[i].append((start - int(starts[i]), length, period))
    return out


def without_repeats(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(kept).tolist()]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, exponent: int = 4, least: int = 6, rewrite: Callable[[list[bytes], int | None], list[bytes]] | None = None, rewrite_col: str | None = None) -> DataFrame:
    """(id, n_words, runs, collapsed) of each row: runs of words as (start, length, period) by start, then period, and the text without their repeats.

    Words are runs of characters other than blanks, as they are written; ``collapsed`` has the words that
    stay with one blank between them. ``rewrite`` may change a row's words first; it gets them and the value
    of the long column ``rewrite_col``.

    Defined results: null and empty texts have no words, no runs and an empty text; null and repeated ids
    are rows of their own; an empty table gives an empty table; other columns are dropped.
    """

    def slices(batch: pa.RecordBatch) -> Iterator[tuple[int, list[list[bytes]]]]:
        start, texts, total = 0, [], 0
        extra = batch.column(2).to_pylist()
        for i, text in enumerate(batch.column(1)):
            raw = text.as_py()
            words = raw.encode("utf-8").split() if raw else []
            words = rewrite(words, extra[i]) if rewrite else words
            if texts and total + len(words) > BATCH_WORDS:
                yield start, texts
                start, texts, total = i, [], 0
            texts.append(words)
            total += len(words)
        if texts:
            yield start, texts

    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in slices(batch):
                runs = runs_of_texts(texts, exponent, least)
                rows = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in found] for found in runs]
                left = [b" ".join(without_repeats(w, r)) for w, r in zip(texts, runs, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), pa.array([len(w) for w in texts], pa.int64()), pa.array(rows, kind), pa.array(left, pa.string())], names=["id", "n_words", "runs", "collapsed"])

    id_kind = docs.schema[id_col].dataType.simpleString()
    extra = F.col(rewrite_col).cast("long") if rewrite_col else F.lit(None).cast("long")
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), extra.alias("extra"))
    return chosen.mapInArrow(work, f"id {id_kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string").withColumnRenamed("id", id_col)
