"""Chat formatting: a state machine over roles, and text segments with loss flags from a declarative template.

Turns of a conversation are taken in order of (turn, role, text). The machine checks each role against the
one before and tells the first turn that breaks the order; such conversations are formatted like any other
and flagged. Each turn becomes three segments: the template's opening, the text, the template's closing.
Control strings inside a text get a backslash after their first character (one more if some are there
already), so only the template's own are exact, and taking one backslash away gives the text back.

Work streams through rows sorted by conversation: a conversation of any length needs the memory of a turn.
A conversation's digest is a hash over its turns in order, so one conversation is read by one task.

Defined cases: null text is empty. A null role is written with a marker of its own and reads back as null;
an unknown role is written by name. A null ``conv_id`` is a conversation of its own; null turns come first.
Repeated rows are turns of their own. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binwright.llm.common import ship, text_or_empty


@dataclass(frozen=True)
class Turn:
    """How a role is written: opening and closing strings, and whether its text counts for the loss."""

    opening: str
    closing: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Roles by name, the roles that may follow each (None: at the start), and the markers of other roles."""

    turns: dict[str, Turn]
    order: dict[str | None, tuple[str, ...]]
    named: tuple[str, str] = ("[ROLE]", "[/ROLE]")
    nobody: str = "[NONE]"
    closing: str = "[/TURN]"
    controls: tuple[str, ...] = field(default=())

    def pattern(self, least: int) -> re.Pattern:
        """A control string with at least that many backslashes after its first character."""
        ends = "|".join(f"(?<={re.escape(c[0])})\\\\{{{least},}}{re.escape(c[1:])}" for c in self.controls)
        return re.compile(ends)

    def escape(self, text: str) -> str:
        return self._all.sub(lambda m: "\\" + m[0], text)

    def unescape(self, text: str) -> str:
        return self._escaped.sub(lambda m: m[0][1:], text)

    def __post_init__(self):
        object.__setattr__(self, "_all", self.pattern(0))
        object.__setattr__(self, "_escaped", self.pattern(1))
        object.__setattr__(self, "_exact", re.compile("|".join(map(re.escape, sorted(self.controls, key=len, reverse=True)))))


INSTRUCT = Template(
    turns={
        "system": Turn("<<SYS>>", "<</SYS>>"),
        "user": Turn("[INST] ", " [/INST]"),
        "assistant": Turn("<s>", "</s>", loss=True),
    },
    order={None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    controls=("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[NONE]", "[/TURN]"),
)

SEGMENTS = "conv_id long, turn_no long, part string, text string, loss boolean, valid boolean"


def format_conversations(conversations: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Segments in order within each partition: conv_id, turn_no, part, text, loss, valid (so far)."""
    ship(conversations.sparkSession)
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), text_or_empty().alias("text"),
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, valid, n = object(), None, True, 0
        for batch in batches:
            out = []
            for now, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if now != conv:
                    conv, state, valid, n = now, None, True, 0
                valid, state = valid and role in template.order.get(state, ()), role
                how = template.turns.get(role)
                if how is None:
                    opening = template.nobody if role is None else template.named[0] + template.escape(role) + template.named[1]
                    how = Turn(opening, template.closing)
                out.append((conv, n, "open", how.opening, False, valid))
                out.append((conv, n, "text", template.escape(text), how.loss, valid))
                out.append((conv, n, "close", how.closing, False, valid))
                n += 1
            yield _batch(out, SEGMENTS)

    return ordered.mapInArrow(run, SEGMENTS)


TYPES = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(f.split() for f in schema.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, TYPES[k]) for c, k in zip(columns, kinds, strict=True)], list(names))


class _Reader:
    """Reads the formatted text of one conversation, piece by piece, as turns."""

    def __init__(self, template: Template):
        self.template, self.rest = template, ""
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def feed(self, text: str) -> None:
        self.rest += text
        self.chars += len(text)
        while (turn := self._turn()) is not None:
            role, body = turn
            self.n_turns += 1
            self.turns.update(f"{'' if role is None else role}\n{body}\n".encode("utf-8", "surrogatepass"))

    def feed_loss(self, text: str) -> None:
        text = self.template.unescape(text)
        self.loss_chars += len(text)
        self.loss.update(text.encode("utf-8", "surrogatepass"))

    def _turn(self) -> tuple[str | None, str] | None:
        """The first turn of what is unread, if it is complete."""
        t, at = self.template, self.rest
        opener = t._exact.match(at)
        if not opener:
            if at and not any(c.startswith(at) for c in t.controls):
                raise ValueError(f"no turn starts at {at[:40]!r}")
            return None
        if opener[0] == t.named[0]:
            end = t._exact.search(at, opener.end())
            if not end:
                return None
            role, start, closing = t.unescape(at[opener.end() : end.start()]), end.end(), t.closing
        elif opener[0] == t.nobody:
            role, start, closing = None, opener.end(), t.closing
        else:
            role, how = next((r, h) for r, h in t.turns.items() if h.opening.strip() == opener[0])
            start, closing = len(how.opening), how.closing
        end = t._exact.search(at, start)
        if not end:
            return None
        stop = end.start() - (len(closing) - len(closing.lstrip()))
        if end[0] != closing.strip():
            raise ValueError(f"{end[0]} closes a turn of {role}")
        self.rest = at[end.end() :]
        return role, t.unescape(at[start:stop])


REPORT = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def read_back(segments: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Per conversation, from the formatted text and the loss mask alone. Segments must come in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, reader, valid, any_rows = None, None, True, False

        def row():
            if reader.rest:
                raise ValueError(f"conversation {conv} ends inside a turn")
            return (conv, reader.n_turns, reader.turns.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.chars, valid)

        for batch in batches:
            out = []
            for now, text, loss, ok in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss", "valid")), strict=True):
                if not any_rows or now != conv:
                    if any_rows:
                        out.append(row())
                    conv, reader, any_rows = now, _Reader(template), True
                reader.feed(text)
                if loss:
                    reader.feed_loss(text)
                valid = ok
            yield _batch(out, REPORT)
        if any_rows:
            yield _batch([row()], REPORT)

    return segments.mapInArrow(run, REPORT)


ORACLE = r"""
WITH all_rows AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), r AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before,
    length(text) + len(regexp_extract_all(text, '(<|\[)\\*(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|ROLE\]|/ROLE\]|NONE\]|/TURN\])'))
      + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 END AS chars
  FROM all_rows
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars,
  bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before = 'system' THEN role = 'user'
    WHEN before = 'user' THEN role = 'assistant' ELSE role = 'user' END) AS valid
FROM r GROUP BY conv_id
"""
