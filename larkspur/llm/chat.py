"""Chat formatting: a finite-state machine over roles, driven by a declarative template.

A template gives, by role, the text before and after a turn, whether the turn's text is under the loss
mask, and which role may follow which. The machine reads a conversation's turns in order and writes, per turn, segments
of text with a loss flag each. Text that looks like a control string of the template is escaped, reversibly:
each backslash is doubled, and a control string gets `\\-` after its first character; so a control string
in the output always marks a turn.

One shuffle by conversation and a sort within partitions, then a stream in constant memory: of a
conversation only the machine's state and running digests are held, so one that holds a third of all rows needs no
more memory than a short one.

Defined results: turns go by (turn, role, text), nulls first; a null text is empty; a null or unknown role is
formatted by the template's `other` turn and makes the conversation invalid; a null conv_id is a conversation like any
other; an empty table gives no rows. Repeated rows are turns each; a very long text is one turn. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS, BYTES = 2000, 8 << 20  # most of a batch that goes out
BREAK = "\\n"  # a line feed within a role that no template knows


@dataclass(frozen=True)
class Turn:
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    turns: dict[str, Turn]
    other: Turn  # before ends with the role, escaped, and a line feed
    follows: dict[str, tuple[str, ...]]  # "" is the start
    ends: tuple[str, ...] = ("assistant",)
    controls: tuple[str, ...] = field(default=())


INST = Template(
    turns={
        "system": Turn("<<SYS>>", "<</SYS>>"),
        "user": Turn("<s>[INST]", "[/INST]"),
        "assistant": Turn("<|reply|>", "</s>", loss=True),
    },
    other=Turn("<|role|>", "<|end|>"),
    follows={"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    controls=("<<SYS>>", "<</SYS>>", "<s>", "</s>", "[INST]", "[/INST]", "<|reply|>", "<|role|>", "<|end|>"),
)


def escape(text: str, template: Template) -> str:
    out = text.replace("\\", "\\\\")
    for mark in template.controls:
        out = out.replace(mark, f"{mark[0]}\\-{mark[1:]}")
    return out


def unescape(text: str) -> str:
    return re.sub(r"\\([\\n-])", lambda m: {"\\": "\\", "n": "\n", "-": ""}[m[1]], text)


def segments(role: str | None, text: str | None, template: Template) -> list[tuple[str, bool]]:
    """A turn as (text, under the loss mask)."""
    body = escape(text or "", template)
    if role in template.turns:
        t = template.turns[role]
        return [(t.before, False), (body, t.loss), (t.after, False)]
    return [(f"{template.other.before}{escape(role or '', template).replace(chr(10), BREAK)}\n{body}{template.other.after}", False)]


def read_back(parts: list[str], template: Template) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    whole = "".join(parts)
    for role, t in template.turns.items():
        if whole.startswith(t.before):
            return role, unescape(whole[len(t.before) : len(whole) - len(t.after)])
    role, _, body = whole[len(template.other.before) : len(whole) - len(template.other.after)].partition("\n")
    return unescape(role), unescape(body)


_NONE = object()


def _format(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, index, valid = _NONE, "", 0, True
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for c, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "text")), strict=True):
                if conv is _NONE or c != conv:
                    conv, state, index, valid = c, "", 0, True
                valid = valid and role in template.follows.get(state, ())
                parts = segments(role, text, template)
                out.append((c, index, [p for p, _ in parts], [x for _, x in parts], valid, role in template.ends))
                state, index = role, index + 1
                size += len(text or "")
                if len(out) >= ROWS or size >= BYTES:
                    yield _batch(out)
                    out, size = [], 0
            yield _batch(out)

    return run


_FORMATTED = pa.schema([("conv_id", pa.int64()), ("turn_index", pa.int64()), ("segments", pa.list_(pa.string())), ("loss", pa.list_(pa.bool_())), ("valid_so_far", pa.bool_()), ("may_end", pa.bool_())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_FORMATTED)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _FORMATTED, strict=True)], schema=_FORMATTED)


def format_chats(df: DataFrame, template: Template = INST) -> DataFrame:
    """A row per turn, in order within partitions: conv_id, turn_index, segments, loss (a flag per segment), valid_so_far
    (the machine has taken every turn up to this one), may_end."""
    rows = df.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(_format(template), "conv_id long, turn_index long, segments array<string>, loss array<boolean>, valid_so_far boolean, may_end boolean")


def _digest(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, held = _NONE, None

        def row():
            return [conv, held["n"], held["turns"].hexdigest(), held["chars"], held["loss"].hexdigest(), held["formatted"], held["valid"] and held["end"]]

        for batch in batches:
            out = []
            for c, parts, flags, valid, end in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "segments", "loss", "valid_so_far", "may_end")), strict=True):
                if conv is _NONE or c != conv:
                    if held:
                        out.append(row())
                    conv, held = c, {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "formatted": 0}
                role, text = read_back(parts, template)
                held["n"] += 1
                held["turns"].update(f"{role}\n{text}\n".encode())
                for part, flag in zip(parts, flags, strict=True):
                    held["formatted"] += len(part)
                    if flag:
                        plain = unescape(part)
                        held["chars"] += len(plain)
                        held["loss"].update(plain.encode())
                held["valid"], held["end"] = valid, end
            yield _digests(out)
        if held:
            yield _digests([row()])

    return run


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])


def _digests(rows: list) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_DIGEST)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _DIGEST, strict=True)], schema=_DIGEST)


def chat_digests(formatted: DataFrame, template: Template = INST) -> DataFrame:
    """Read back from what format_chats() returns; needs its order, so nothing may be shuffled in between."""
    return formatted.mapInArrow(_digest(template), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
