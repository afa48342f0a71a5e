"""Chat formatting with a black-box template, and the loss mask found by rendering prefixes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Message = tuple[str, str]
Template = Callable[[list[Message]], str]

_UNESCAPE = re.compile(r"\\(.)", re.S)
_ROLE = re.compile(r"<turn ((?:\\.|[^\\>])*)>\n", re.S)
_TEXT = re.compile(r"((?:\\.|[^\\<])*)\n</turn>\n", re.S)


def escape(text: str) -> str:
    """No control string of the template is left: each begins with ``<`` or ``#``."""
    return text.replace("\\", "\\\\").replace("<", "\\<").replace("#", "\\#")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def turn_template(messages: list[Message]) -> str:
    """``<turn role>``, the text, ``</turn>``, each on its line."""
    return "".join(f"<turn {escape(role).replace('>', chr(92) + '>')}>\n{escape(text)}\n</turn>\n" for role, text in messages)


def parse(formatted: str) -> list[Message]:
    """Roles and texts, read back from :func:`turn_template`'s output."""
    out, at = [], 0
    while at < len(formatted):
        role = _ROLE.match(formatted, at)
        text = _TEXT.match(formatted, role.end())
        out.append((unescape(role[1]), unescape(text[1])))
        at = text.end()
    return out


@dataclass(frozen=True)
class Span:
    """Where a turn stands in the whole output, and the text inside it."""

    start: int
    end: int
    text_start: int
    text_end: int


def common_prefix(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:  # the longest equal beginning, by halving
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def locate(messages: list[Message], template: Template) -> tuple[str, list[Span | None], bool]:
    """The whole output, each turn's span, and whether the template rewrites history.

    The template is only ever called. Prefixes of the conversation are rendered one
    after the other; where the output of a prefix begins with that of the one
    before, what follows is the new turn. Two more renderings with probes for the
    turn's text tell what the template puts around it. A turn after which earlier
    output changes has no span, and neither have those before it, whose places
    in the whole output are then not known.
    """
    before, spans, rewrites = template([]), [], False
    for n, (role, _) in enumerate(messages, 1):
        out = template(messages[:n])
        if not out.startswith(before):
            rewrites = True
            spans = [None] * n
        else:
            probes = [template([*messages[: n - 1], (role, p)])[len(before) :] for p in ("a", "b")]
            head = common_prefix(*probes)
            tail = common_prefix(probes[0][head:][::-1], probes[1][head:][::-1])
            spans.append(Span(len(before), len(out), len(before) + head, len(out) - tail))
        before = out
    return before, spans, rewrites


def format_conversations(conversations: DataFrame, template: Template = turn_template, loss_role: str = "assistant") -> DataFrame:
    """``(conv_id, formatted, turns, mask, rewrites)``: a row per conversation.

    ``conversations(conv_id, turn, role, text)``; turns are in order of turn, role
    and text, nulls first, so repeated rows are turns of their own. A null text or
    role is empty. ``turns`` are the spans ``(role, start, end)``; ``mask`` the spans
    ``(start, end)`` of the texts of ``loss_role``, all in code points of
    ``formatted``. A turn whose span is not known has nulls and no mask. Rows of a
    null conv_id are one conversation. Other columns are not looked at; an empty
    table gives an empty one. A conversation is rendered by one task, as the
    template needs it whole.
    """
    turns = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    gathered = conversations.select("conv_id", "turn", "role", "text").groupBy("conv_id").agg(turns.alias("turns"))
    span = pa.struct([("role", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    mask = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("turns", pa.list_(span)), ("mask", pa.list_(mask)), ("rewrites", pa.bool_())])

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, places, masks, changed = [], [], [], []
            for rows in batch.column("turns").to_pylist():
                messages = [(r["role"], r["text"]) for r in rows]
                formatted, spans, rewrites = locate(messages, template)
                out.append(formatted)
                places.append([{"role": r, "start": s and s.start, "end": s and s.end} for (r, _), s in zip(messages, spans, strict=True)])
                masks.append([{"start": s.text_start, "end": s.text_end} for (r, _), s in zip(messages, spans, strict=True) if s and r == loss_role])
                changed.append(rewrites)
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id").cast(pa.int64()), pa.array(out, pa.string()), pa.array(places, pa.list_(span)), pa.array(masks, pa.list_(mask)), pa.array(changed)],
                schema=schema,
            )

    return gathered.mapInArrow(
        render,
        "conv_id long, formatted string, turns array<struct<role:string,start:long,end:long>>, mask array<struct<start:long,end:long>>, rewrites boolean",
    )


def digest(formatted: DataFrame) -> DataFrame:
    """What the output says, read back from it: turns, masked texts, lengths."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
        for batch in batches:
            rows = []
            for text, mask in zip(batch.column("formatted").to_pylist(), batch.column("mask").to_pylist(), strict=True):
                turns = parse(text)
                loss = "".join(unescape(text[m["start"] : m["end"]]) for m in mask)
                rows.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    return formatted.select("conv_id", "formatted", "mask").mapInArrow(
        read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
