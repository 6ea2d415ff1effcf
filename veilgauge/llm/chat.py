"""Chat formatting with a template that is a black box: turns are located by rendering successive prefixes.

A template is anything with ``render(turns) -> str`` for a list of ``(role, text)``. A conversation of *n* turns is rendered with its first
1, 2, ... *n* turns. If an output begins with the one before, the rest is the span of its last turn. If it does not, the template has rewritten
history: the conversation is marked and gets no spans. Where the text lies inside its span is found in the same way, by rendering the turn with two
different one-letter texts and comparing what they share on either side.

Rendering prefixes takes time in the square of a conversation's turns, as any method does that may only call ``render``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]


class Template(Protocol):
    def render(self, turns: Sequence[Turn]) -> str: ...


class MarkedTurns:
    """``### role: text </turn>`` on a line of its own. Control strings cannot come from a text: the characters they begin with are written as
    a backslash and a letter, and backslashes are doubled, so that every text can be read back."""

    CODES = {"\\": "\\\\", "<": "\\l", "#": "\\h", ":": "\\c"}
    NAMES = {v: k for k, v in CODES.items()}

    def escape(self, text: str, role: bool = False) -> str:
        return re.sub(r"[\\<#:]" if role else r"[\\<#]", lambda m: self.CODES[m[0]], text)

    def unescape(self, text: str) -> str:
        return re.sub(r"\\.", lambda m: self.NAMES[m[0]], text)

    def render(self, turns: Sequence[Turn]) -> str:
        return "".join(f"### {self.escape(role, True)}: {self.escape(text)} </turn>\n" for role, text in turns)

    def parse(self, turn: str) -> Turn:
        """Role and text of one rendered turn."""
        role, text = turn.removeprefix("### ").removesuffix(" </turn>\n").split(": ", 1)
        return self.unescape(role), self.unescape(text)


def _shared(a: str, b: str) -> int:
    """Length of the common beginning."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
    return lo


def locate(template: Template, turns: Sequence[Turn]) -> tuple[str, list[tuple[int, int, int, int]] | None]:
    """The whole output, and for each turn its span and the span of its text in it; None if an output does not go on from the one before."""
    spans, before = [], template.render([])
    for n, (role, text) in enumerate(turns, 1):
        now = template.render(turns[:n])
        if not now.startswith(before):
            return template.render(turns), None
        one, two = (template.render([*turns[: n - 1], (role, probe)]) for probe in "ab")
        head, tail = _shared(one, two), _shared(one[::-1], two[::-1])
        if head < len(before) or one[:head] != now[:head] or one[len(one) - tail :] != now[len(now) - tail :] or head + tail > len(now):
            return template.render(turns), None
        spans.append((len(before), len(now), head, len(now) - tail))
        before = now
    return before, spans


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[Turn]]]:
    """Conversations of a sorted stream of rows."""
    first, now, turns = True, None, []
    for batch in batches:
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
            if not first and conv != now:
                yield now, turns
                turns = []
            first, now = False, conv
            turns.append((role or "", text or ""))
    if not first:
        yield now, turns


FORMATTED = "conv_id long, formatted string, rewrites boolean, turns array<struct<start long, end long>>, loss array<struct<start long, end long>>"
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _format(template: Template, learned: frozenset):
    def record(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.string(), pa.bool_(), SPANS, SPANS)
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["conv_id", "formatted", "rewrites", "turns", "loss"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for conv, turns in _groups(batches):
            text, spans = locate(template, turns)
            whole = [{"start": s[0], "end": s[1]} for s in spans or ()]
            loss = [{"start": s[2], "end": s[3]} for s, turn in zip(spans or (), turns) if turn[0] in learned]
            rows.append((conv, text, spans is None, whole, loss))
            size += len(text)
            if size >= 2**22:
                yield record(rows)
                rows, size = [], 0
        if rows:
            yield record(rows)

    return run


def format_conversations(rows: DataFrame, template: Template | None = None, learned: Sequence[str] = ("assistant",)) -> DataFrame:
    """``conv_id, formatted, rewrites, turns, loss``: one row for each conversation of ``rows`` (``conv_id, turn, role, text``).

    ``turns`` are the character spans of the turns, ``loss`` those of the texts of the ``learned`` roles. ``rewrites`` says that the template
    changed earlier output or does not place texts as such; then there are no spans.

    Turns are ordered by ``turn``, null first, then role and text; rows given twice are two turns. Null roles and texts are empty. A null ``conv_id`` is
    one conversation. Other columns are not read. No rows in, no rows out.
    """
    ordered = rows.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(_format(template or MarkedTurns(), frozenset(learned)), FORMATTED)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    template = MarkedTurns()
    for batch in batches:
        out = []
        for conv, text, turns, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "turns", "loss"))):
            read = [template.parse(text[s["start"] : s["end"]]) for s in turns]
            learned = "".join(template.unescape(text[s["start"] : s["end"]]) for s in loss)
            plain = "".join(f"{role}\n{said}\n" for role, said in read)
            digest = [hashlib.sha256(x.encode()).hexdigest() for x in (plain, learned)]
            out.append((conv, len(read), digest[0], len(learned), digest[1], len(text)))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        columns = list(zip(*out)) if out else [()] * len(names)
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the outputs of the default template say: all turns, and all text under the loss mask."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.mapInArrow(_read_back, schema)
