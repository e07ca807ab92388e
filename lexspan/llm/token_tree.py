"""Edit-aware token counts: a segment tree over the pre-tokens of each document.

A byte-pair tokenizer splits a text into pre-tokens by a pattern and encodes each alone, so a text's
count is the sum over its pre-tokens. Leaves of the tree are runs of about ``LEAF`` pre-tokens with
their numbers of characters and tokens; inner nodes hold sums. An edit walks down by characters,
splits anew only from the last pre-token border at least two characters before it (what the pattern
can look ahead past a border) to the first border that the old split also had, re-encodes those
pre-tokens and updates the sums above the leaves it touched. Text beyond that border splits as before.
A leaf that edits have grown to over twice its size is split in place; whatever the size of an edit or
of a pre-token, the rest of the document is not encoded again.

The tree is kept as two columns, characters and tokens by leaf, next to the text; a leaf's own
pre-tokens are found again from its text when an edit comes near. Work is row by row, without a shuffle
but for joining a table of edits. A document's edits are applied in the order of their array, each to
the text as the one before left it.

Defined results: a null text is empty (no leaf, 0 tokens); a null or empty list of edits changes
nothing; an edit outside the text is moved to its nearest end, a null replacement is empty, and a null
edit is skipped; rows that repeat an id keep trees of their own; an empty table gives an empty table;
special-token strings are ordinary text; columns named like an output are replaced.
"""

from __future__ import annotations

import base64
import functools
import re
import unicodedata
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import private

LEAF = 16
#: Borders this close to the end of what was read may move with what follows.
AHEAD = 8
VOCABULARY = "byte_bpe_50k.tiktoken"
Edit = tuple[int, int, str]


# The same split for Python's own, faster expressions: right for texts without the characters of _odd().
_PLAIN = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


@functools.cache
def _odd() -> re.Pattern[str]:
    """Characters that Python's \\w, \\d and \\s class otherwise: numbers that are no digits, four control characters, and to be safe all beyond the first plane."""
    odd = [c for c in range(0x10000) if (ch := chr(c)).isalnum() and (kind := unicodedata.category(ch))[0] != "L" and kind != "Nd"]
    return re.compile("[\x1c-\x1f\U00010000-\U0010ffff" + "".join(map(chr, odd)) + "]")


class _Counts(dict):
    """Tokens of a pre-token; a bounded number of answers is kept."""

    def __init__(self, encoding: tiktoken.Encoding) -> None:
        super().__init__()
        self.encoding = encoding

    def __missing__(self, piece: str) -> int:
        if len(self) > 500_000:
            self.clear()
        n = self[piece] = len(self.encoding.encode_ordinary(piece))
        return n


class Tokenizer:
    """Splits by the pattern and counts the tokens of a pre-token."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.count = _Counts(self.encoding).__getitem__

    def split(self, text: str) -> list[str]:
        odd = any(c in text for c in "\x1c\x1d\x1e\x1f") if text.isascii() else _odd().search(text)
        return self.pattern.findall(text) if odd else _PLAIN.findall(text)


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    """One tokenizer a process."""
    return Tokenizer(path)


class TokenTree:
    """Sums of characters and tokens over the leaves, in heap order, with the leaves' texts."""

    def __init__(self, tok: Tokenizer, texts: list[str], tokens: list[int]) -> None:
        self.tok, self.texts = tok, texts
        self.reencoded = self.updated = 0
        self.width = 1
        while self.width < max(1, len(texts)):
            self.width *= 2
        pad = [0] * (self.width - len(tokens))
        self.tokens = [0] * self.width + tokens + pad
        self.chars = [0] * self.width + list(map(len, texts)) + pad
        for i in range(self.width - 1, 0, -1):
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]

    @classmethod
    def build(cls, tok: Tokenizer, text: str) -> TokenTree:
        pieces = tok.split(text)
        counts = list(map(tok.count, pieces))
        cuts = range(0, len(pieces), LEAF)
        return cls(tok, ["".join(pieces[k : k + LEAF]) for k in cuts], [sum(counts[k : k + LEAF]) for k in cuts])

    @classmethod
    def load(cls, tok: Tokenizer, text: str, leaf_chars: list[int], leaf_tokens: list[int]) -> TokenTree:
        texts, at = [], 0
        for n in leaf_chars:
            texts.append(text[at : at + n])
            at += n
        return cls(tok, texts, list(leaf_tokens))

    def text(self) -> str:
        return "".join(self.texts)

    def leaf_at(self, at: int) -> tuple[int, int]:
        """(leaf, characters before it) that holds character ``at``; the last leaf for the text's end."""
        i, before = 1, 0
        while i < self.width:
            i *= 2
            if at >= before + self.chars[i] and self.chars[i + 1]:
                before += self.chars[i]
                i += 1
        return i - self.width, before

    def set_leaf(self, leaf: int, text: str, tokens: int) -> None:
        self.texts[leaf] = text
        i = leaf + self.width
        self.chars[i], self.tokens[i] = len(text), tokens
        self.updated += 1
        while i > 1:
            i //= 2
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
            self.updated += 1

    def borders(self, text: str, after: str) -> list[int]:
        """Ends of a leaf's pre-tokens; ``after`` is what follows the leaf, as far as the pattern looks."""
        ends = []
        for m in self.tok.pattern.finditer(text + after):
            ends.append(m.end())
            if m.end() >= len(text):
                break
        return ends

    def edit(self, at: int, drop: int, put: str) -> None:
        if not self.texts:
            fresh = TokenTree.build(self.tok, put)
            self.__dict__.update(fresh.__dict__ | {"reencoded": self.reencoded + self.tok_pieces(put), "updated": self.updated + 2 * fresh.width})
            return
        at = min(max(at, 0), self.chars[1])
        end = min(max(at + drop, at), self.chars[1])
        # Left: the last border two or more characters before the edit.
        first, before = self.leaf_at(max(at - 2, 0))
        ends = [0, *self.borders(self.texts[first], "".join(self.texts[first + 1 : first + 3])[:64])]
        keep = max(e for e in ends if before + e <= max(at - 2, 0))
        start = before + keep
        # Right: grow the window leaf by leaf until a new border is an old one at or after the edit's end.
        last, last_before = self.leaf_at(end)
        while True:
            window_old = "".join(self.texts[first : last + 1])
            final = last + 1 >= len(self.texts)
            tail = window_old[end - before :]
            new = window_old[keep : at - before] + put + tail
            shift = len(put) - (end - at)
            old_ends = {before + keep}
            pos = keep
            for m in self.tok.pattern.finditer(window_old, keep):
                pos = m.end()
                old_ends.add(before + pos)
            pieces, stop = [], None
            look = 0 if final else AHEAD
            for m in self.tok.pattern.finditer(new):
                pieces.append(m.group())
                there = start + m.end() - shift  # in old coordinates
                if m.end() > len(new) - look:
                    break
                if there >= end and there in old_ends and m.end() >= at - start + len(put) and there <= before + len(window_old) - look:
                    stop = there
                    break
            if stop is not None:
                break
            if final:
                pieces, stop = self.tok.pattern.findall(new), before + len(window_old)
                break
            last += 1
        head = [self.texts[first][a:b] for a, b in zip(ends, ends[1:], strict=False) if b <= keep]
        # The suffix of the leaf that holds the common border stays; the leaves between are emptied.
        holder, holder_before = self.leaf_at(stop)
        holder = max(holder, first)
        rest = self.pieces_of(self.texts[holder][stop - (before if holder == first else holder_before) :], holder)
        self.reencoded += len(head) + len(pieces) + len(rest)
        own = [*head, *pieces, *rest] if holder == first else [*head, *pieces]
        if holder != first:
            for k in range(first + 1, holder):
                if self.texts[k]:
                    self.set_leaf(k, "", 0)
            self.set_leaf(holder, "".join(rest), sum(map(self.tok.count, rest)))
        if len(own) > 2 * LEAF:
            self.split_leaf(first, own)
        else:
            self.set_leaf(first, "".join(own), sum(map(self.tok.count, own)))

    def split_leaf(self, leaf: int, pieces: list[str]) -> None:
        """Puts leaves of LEAF pre-tokens in the place of one; the other leaves move with their sums, and empty ones go. Nothing else is encoded."""
        counts = list(map(self.tok.count, pieces))
        cuts = range(0, len(pieces), LEAF)
        leaves = list(zip(self.texts, self.tokens[self.width :], strict=False))
        leaves[leaf : leaf + 1] = [("".join(pieces[k : k + LEAF]), sum(counts[k : k + LEAF])) for k in cuts]
        kept = [x for x in leaves if x[0]]
        fresh = TokenTree(self.tok, [t for t, _ in kept], [n for _, n in kept])
        self.__dict__.update(fresh.__dict__ | {"reencoded": self.reencoded, "updated": self.updated + 2 * fresh.width})

    def tok_pieces(self, text: str) -> int:
        return len(self.tok.pattern.findall(text))

    def pieces_of(self, rest: str, leaf: int) -> list[str]:
        """Pre-tokens of the end of a leaf from a border on."""
        ends = [0, *self.borders(rest, "".join(self.texts[leaf + 1 : leaf + 3])[:64])] if rest else [0]
        return [rest[a : min(b, len(rest))] for a, b in zip(ends, ends[1:], strict=False)]


def default_vocabulary() -> str:
    return public_tokenizers.path(VOCABULARY)


def build_trees(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``docs`` with leaf_chars, leaf_tokens and n_tokens."""
    path = vocabulary or default_vocabulary()
    rest = docs.drop("leaf_chars", "leaf_tokens", "n_tokens")
    empty = F.array(F.lit(0))
    schema = rest.select("*", empty.alias("leaf_chars"), empty.alias("leaf_tokens"), F.lit(0).cast("long").alias("n_tokens")).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in batches:
            trees = [TokenTree.build(tok, t.as_py() or "") for t in batch.column(batch.schema.names.index(text_col))]
            chars = pa.array([[len(x) for x in t.texts] for t in trees], pa.list_(pa.int32()))
            tokens = pa.array([t.tokens[t.width : t.width + len(t.texts)] for t in trees], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, chars, tokens, pa.array([t.tokens[1] for t in trees], pa.int64())], names=schema.fieldNames())

    return rest.mapInArrow(work, schema)


def apply_edits(trees: DataFrame, text_col: str = "text", edits_col: str = "edits", vocabulary: str | None = None, edits_of: Callable[[str | None], list[dict[str, int | str]]] | None = None) -> DataFrame:
    """The edits are a column of arrays (at, drop, put), or what ``edits_of`` makes of a text. Gives ``trees`` with text, leaves and n_tokens as the edits leave them, and n_tokens_before, n_edits, n_reencoded (pre-tokens of the touched leaves, counted anew) and n_nodes (updated)."""
    path = vocabulary or default_vocabulary()
    rest = trees.drop("n_tokens_before", "n_edits", "n_reencoded", "n_nodes", "n_chars")
    added = ("n_chars", "n_tokens_before", "n_edits", "n_reencoded", "n_nodes")
    schema = rest.drop(edits_col).select("*", *[F.lit(0).cast("long").alias(c) for c in added]).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in batches:
            cols = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            texts, chars, tokens, totals, extra = [], [], [], [], []
            given = cols.get(edits_col) if edits_of is None else None
            for i, (text, leaf_chars, leaf_tokens) in enumerate(zip(cols[text_col], cols["leaf_chars"], cols["leaf_tokens"], strict=True)):
                whole = text.as_py()
                todo = edits_of(whole) if edits_of else [e for e in given[i].as_py() or () if e is not None]
                counts = leaf_tokens.as_py()
                before = sum(counts)
                if todo:
                    tree = TokenTree.load(tok, whole or "", leaf_chars.as_py(), counts)
                    for e in todo:
                        tree.edit(e["at"] or 0, e["drop"] or 0, e["put"] or "")
                    texts.append(tree.text())
                    chars.append(list(map(len, tree.texts)))
                    tokens.append(tree.tokens[tree.width : tree.width + len(tree.texts)])
                    totals.append(tree.tokens[1])
                    extra.append((tree.chars[1], before, len(todo), tree.reencoded, tree.updated))
                else:
                    texts.append(whole)
                    chars.append(leaf_chars.as_py())
                    tokens.append(counts)
                    totals.append(before)
                    extra.append((len(whole or ""), before, 0, 0, 0))
            new = {text_col: pa.array(texts, pa.string()), "leaf_chars": pa.array(chars, pa.list_(pa.int32())), "leaf_tokens": pa.array(tokens, pa.list_(pa.int32())), "n_tokens": pa.array(totals, pa.int64())}
            new |= {c: pa.array(v, pa.int64()) for c, v in zip(added, zip(*extra, strict=True) if extra else [[]] * len(added), strict=True)}
            yield pa.RecordBatch.from_arrays([new.get(c, cols.get(c)) for c in schema.fieldNames()], names=schema.fieldNames())

    return rest.mapInArrow(work, schema)


def attach_edits(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with the edits of a table (id, seq, at, drop, put) as an array in the order of seq; a document's edits are held together."""
    own_id, own_edits = private(docs, "id", "edits")
    listed = edits.groupBy(F.col(id_col).alias(own_id)).agg(F.array_sort(F.collect_list(F.struct("seq", "at", "drop", "put"))).alias(own_edits))
    array = F.transform(own_edits, lambda e: F.struct(e["at"].alias("at"), e["drop"].alias("drop"), e["put"].alias("put")))
    return docs.join(listed, F.col(id_col).eqNullSafe(F.col(own_id)), "left").withColumn("edits", array).drop(own_id, own_edits)


# Clean-up edits: what a masking pass would change.
_MAIL = re.compile(r"[\w.+-]+@[\w-]+\.[\w.-]+")
_OTHER = re.compile(r"(?P<IP>\b\d{1,3}(?:\.\d{1,3}){3}\b)|(?P<NUMBER>\+?\d[\d ()-]{6,}\d)|(?P<JUNK>[#*$%&|<>]{3,})")
_STARTS = re.compile(r"[0-9#*$%&|<>]")


def masking_edits(text: str | None) -> list[dict[str, int | str]]:
    """E-mail addresses, IPv4 addresses and long numbers become tags, runs of symbols go; last first, so that places stay right."""
    found: list[dict[str, int | str]] = []
    mails = [m.span() for m in _MAIL.finditer(text)] if text and "@" in text else []
    if mails or text and _STARTS.search(text):
        found = [{"at": a, "drop": b - a, "put": "<MAIL>"} for a, b in mails]
        found += [{"at": m.start(), "drop": m.end() - m.start(), "put": "" if m.lastgroup == "JUNK" else f"<{m.lastgroup}>"} for m in _OTHER.finditer(text) if not any(a < m.end() and m.start() < b for a, b in mails)]
        found.sort(key=lambda e: -e["at"])
    return found
