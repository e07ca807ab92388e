"""Chat formatting by incremental black-box rendering.

A template is any function from a list of turns to a text. It is rendered on each prefix of a
conversation; what an output adds to the one before is the span of its last turn. An output that
does not begin with the one before shows a template that rewrites history. The place of a turn's
text inside its span is found by rendering once more with a probe in place of the text.

Turns are dealt by conversation and sorted, and one pass over the sorted rows holds one
conversation at a time, whose turns have to be together for any black-box template. The result has
a row per turn, never one whole-conversation text. The work is the sum of the prefixes' lengths, as
the method implies.

Defined results: a null role or text counts as empty; a row with a null conv_id belongs to no other
and is a conversation of one turn; rows are ordered by turn (nulls first), ties by role, then text;
repeated rows are turns of their own; an empty table gives an empty table; other columns are dropped.
For a turn that rewrites history, ``piece`` is what follows the first changed character, and its loss
span is null. A turn under the loss whose text cannot be located has a null span too and says so in
``unlocated``. Reading back needs pieces that stand: a conversation with a rewritten turn has null
digests and loss, and the number of its rewritten turns.
"""

from __future__ import annotations

import hashlib
import os.path
import re
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A private-use character that stands in for a turn's text.
PROBE = "\ue000"
#: Turns or characters after which rows are handed on.
FLUSH_TURNS, FLUSH_CHARS = 4096, 8 << 20

# The control strings of InstTemplate: < or [ before one of these. A backslash after the first character hides them in texts.
_CONTROL = re.compile(r"([<\[])(/?(?:s>|INST\]|ROLE\]))")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


class Template(Protocol):
    """Renders a list of (role, text); ``read`` undoes it for the piece of one turn."""

    def render(self, turns: list[tuple[str, str]]) -> str: ...

    def read(self, piece: str) -> tuple[str, str]: ...

    def unescape(self, text: str) -> str: ...


class InstTemplate:
    """``<s>[INST] user [/INST] assistant </s>``; other roles as ``[ROLE] role [/ROLE] text </s>``."""

    def escape(self, text: str) -> str:
        return _CONTROL.sub(r"\1\\\2", text.replace("\\", "\\\\"))

    def unescape(self, text: str) -> str:
        return _ESCAPED.sub(r"\1", text)

    def render(self, turns: list[tuple[str, str]]) -> str:
        out = []
        for role, text in turns:
            if role == "user":
                out.append(f"<s>[INST] {self.escape(text)} [/INST]")
            elif role == "assistant":
                out.append(f" {self.escape(text)} </s>")
            else:
                out.append(f"[ROLE] {self.escape(role)} [/ROLE] {self.escape(text)} </s>")
        return "".join(out)

    def read(self, piece: str) -> tuple[str, str]:
        if piece.startswith("<s>[INST] ") and piece.endswith(" [/INST]"):
            return "user", self.unescape(piece[10:-8])
        if piece.startswith("[ROLE] ") and piece.endswith(" </s>"):
            role, _, text = piece[7:-5].partition(" [/ROLE] ")
            return self.unescape(role), self.unescape(text)
        if piece.startswith(" ") and piece.endswith(" </s>"):
            return "assistant", self.unescape(piece[1:-5])
        raise ValueError(f"not a rendered turn: {piece[:60]!r}")


def common_prefix(a: str, b: str) -> int:
    return len(os.path.commonprefix((a, b)))


def locate(render: Callable[[list[tuple[str, str]]], str], turns: list[tuple[str, str]], before: str, now: str) -> tuple[int, int] | None:
    """Start and end, in ``now``, of the last turn's text as rendered; None where the probe cannot tell."""
    probed = render([*turns[:-1], (turns[-1][0], PROBE)])
    at = probed.find(PROBE, len(before))
    if at < 0 or probed.count(PROBE, len(before)) != 1:
        return None
    tail = len(probed) - at - 1
    end = len(now) - tail
    return (at, end) if at <= end and now[:at] == probed[:at] and now[end:] == probed[at + 1 :] else None


def render_conversations(turns: DataFrame, template: Template | None = None, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """A row per turn: conv_id, turn, ordinal, role, piece, span_start, span_end, loss_start, loss_end, rewrites, unlocated."""
    template = template or InstTemplate()
    types = {f.name: f.dataType for f in turns.schema}
    schema = T.StructType(
        [T.StructField("conv_id", types["conv_id"]), T.StructField("turn", types["turn"]), T.StructField("ordinal", T.LongType()), T.StructField("role", T.StringType()), T.StructField("piece", T.StringType())]
        + [T.StructField(k, T.LongType()) for k in ("span_start", "span_end", "loss_start", "loss_end")]
        + [T.StructField(k, T.BooleanType()) for k in ("rewrites", "unlocated")]
    )
    names = schema.fieldNames()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = None
        rows: list[tuple[Any, ...]] = []
        key: Any = work  # no conversation yet
        held: list[tuple[str, str]] = []
        before, size = "", 0
        for batch in batches:
            arrow = arrow or pa.schema([pa.field("conv_id", batch.schema.field("conv_id").type), pa.field("turn", batch.schema.field("turn").type), pa.field("ordinal", pa.int64()), pa.field("role", pa.string()), pa.field("piece", pa.string()), *[pa.field(k, pa.int64()) for k in names[5:9]], pa.field("rewrites", pa.bool_()), pa.field("unlocated", pa.bool_())])
            for conv, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True):
                if conv is None or conv != key:
                    key, held, before = conv, [], ""
                held.append((role or "", text or ""))
                now = template.render(held)
                rewrites = not now.startswith(before)
                start = common_prefix(before, now) if rewrites else len(before)
                loss = locate(template.render, held, before, now) if role in loss_roles and not rewrites else None
                rows.append((conv, turn, len(held) - 1, role or "", now[start:], start, len(now), *(loss or (None, None)), rewrites, role in loss_roles and not loss and not rewrites))
                before, size = now, size + len(now) - start
                if len(rows) >= FLUSH_TURNS or size >= FLUSH_CHARS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    by_conversation = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text")).otherwise(F.xxhash64("conv_id"))
    dealt = turns.select("conv_id", "turn", "role", "text").repartition(by_conversation).sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(work, schema)


def read_back(rendered: DataFrame, template: Template | None = None) -> DataFrame:
    """Digest of each conversation, from the rendered pieces alone: takes them in the order in which ``render_conversations`` leaves them."""
    template = template or InstTemplate()
    key_type = rendered.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", key_type), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType()), T.StructField("rewritten_turns", T.LongType()), T.StructField("unlocated_turns", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: Any = None
        whole = loss = None
        n = chars = end = rewritten = unlocated = 0
        done: list[tuple[Any, ...]] = []
        key_arrow = pa.int64()

        def close() -> None:
            read = (whole.hexdigest(), chars, loss.hexdigest()) if not rewritten else (None, None, None)
            done.append((key, n, *read, end, rewritten, unlocated))

        def out() -> pa.RecordBatch:
            kinds = [key_arrow, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=schema.fieldNames())

        for batch in batches:
            key_arrow = batch.schema.field("conv_id").type
            for conv, ordinal, piece, start, stop, a, b, rewrites, lost in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ordinal == 0:
                    if whole is not None:
                        close()
                    key, whole, loss, n, chars, rewritten, unlocated = conv, hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0
                n, end, rewritten, unlocated = n + 1, stop, rewritten + rewrites, unlocated + lost
                if rewritten:
                    continue
                role, text = template.read(piece)
                whole.update(f"{role}\n{text}\n".encode())
                if a is not None:
                    own = template.unescape(piece[a - start : b - start])
                    chars += len(own)
                    loss.update(own.encode())
            if len(done) >= FLUSH_TURNS:
                yield out()
                done = []
        if whole is not None:
            close()
        if done:
            yield out()

    return rendered.select("conv_id", "ordinal", "piece", "span_start", "span_end", "loss_start", "loss_end", "rewrites", "unlocated").mapInArrow(work, schema)
