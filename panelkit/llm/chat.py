"""Conversations to training text: a state machine over roles, segments with loss flags.

The template is data: for each role an opening and a closing string, whether the
text between counts for the loss, and which roles may follow which. A control string
inside a text gets an escape character after its first character, and escape
characters are doubled, so texts come back exactly and no text can close its turn.

Work is one shuffle by conversation and one sort; turns then stream through a task
row by row, so a conversation of any length needs the memory of one batch. The order
of a conversation, and a digest over it, are sequential by nature.

Defined results: a null text or role counts as empty; a null turn comes first; equal
turns are ordered by role, then text, and all are kept; a role the template does not
name is written in the general form and is a violation of the turn order; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START = ""


@dataclass(frozen=True)
class Template:
    """``forms``: role -> (opening, closing). ``loss``: roles whose text is learned.
    ``follows``: role before ("" at the start) -> roles that may come next. ``other``
    opens a role without a form; its name stands before ``other_end``."""

    forms: dict[str, tuple[str, str]]
    loss: frozenset[str]
    follows: dict[str, frozenset[str]]
    final: frozenset[str]
    other: str = "[ROLE]"
    other_end: str = "[/ROLE]"
    other_close: str = "[/TURN]"
    escape: str = "\\"
    _made: dict = field(default_factory=dict, compare=False, repr=False)

    def _tools(self) -> dict:
        if not self._made:
            controls = [c for pair in self.forms.values() for c in pair] + [self.other, self.other_end, self.other_close]
            if any(not c or self.escape in c for c in controls) or len({o for o, _ in self.forms.values()}) < len(self.forms):
                raise ValueError("control strings must be filled, free of the escape character, and openings distinct")
            firsts = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in sorted(set(controls)))
            openings = {o: (r, c) for r, (o, c) in self.forms.items()} | {self.other: (None, self.other_close)}
            self._made.update(
                hide=re.compile(firsts), openings=openings,
                opening=re.compile("|".join(map(re.escape, sorted(openings, key=len, reverse=True)))),
                show=re.compile(re.escape(self.escape) + "(.)", re.S), lone=re.escape(self.escape))
        return self._made

    def hidden(self, text: str) -> str:
        """The text with its control strings broken by an escape character."""
        tools = self._tools()
        return tools["hide"].sub(lambda m: m[0] + self.escape, text.replace(self.escape, self.escape * 2))

    def shown(self, text: str) -> str:
        return self._tools()["show"].sub(lambda m: m[1], text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """The pieces that a turn is written as: (string, counts for the loss)."""
        if role in self.forms:
            opening, closing = self.forms[role]
        else:
            opening, closing = self.other + self.hidden(role) + self.other_end, self.other_close
        return [(opening, False), (self.hidden(text), role in self.loss), (closing, False)]

    def read(self, formatted: str) -> Iterator[tuple[str, str, bool]]:
        """(role, text, counts for the loss) of each turn in a formatted string."""
        tools, at = self._tools(), 0
        while at < len(formatted):
            m = tools["opening"].match(formatted, at)
            if not m:
                raise ValueError(f"no turn opens at {at}")
            role, closing = tools["openings"][m[0]]
            at = m.end()
            if role is None:
                end = formatted.index(self.other_end, at)
                role, at = self.shown(formatted[at:end]), end + len(self.other_end)
            end = formatted.index(closing, at)
            yield role, self.shown(formatted[at:end]), role in self.loss
            at = end + len(closing)


INSTRUCT = Template(
    forms={"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")},
    loss=frozenset({"assistant"}),
    follows={START: frozenset({"system", "user"}), "system": frozenset({"user"}),
             "user": frozenset({"assistant"}), "assistant": frozenset({"user"})},
    final=frozenset({"assistant"}),
)


class Order:
    """The state machine: the state is the role before; violations are counted."""

    def __init__(self, template: Template):
        self.template, self.state, self.violations = template, START, 0

    def step(self, role: str) -> bool:
        right = role in self.template.follows.get(self.state, ())
        self.violations += not right
        self.state = role
        return right

    def end(self) -> bool:
        return self.violations == 0 and self.state in self.template.final


def _ordered(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    plain = rows.select(
        rows[conv].cast("long").alias("conv"), rows[turn].cast("long").alias("turn"),
        F.coalesce(rows[role].cast("string"), F.lit("")).alias("role"),
        F.coalesce(rows[text].cast("string"), F.lit("")).alias("text"))
    return plain.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")


def _turns(batches) -> Iterator[tuple[object, str, str]]:
    for batch in batches:
        yield from zip(batch["conv"].to_pylist(), batch["role"].to_pylist(), batch["text"].to_pylist(), strict=True)


def segments_frame(rows: DataFrame, template: Template = INSTRUCT, conv: str = "conv_id",
                   turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per text segment: conv_id, segment (from 0), role, content, loss, and
    in_order (false where the turn may not follow the one before)."""

    def run(batches):
        out, now, k, order = [], object(), 0, None
        for c, r, t in _turns(batches):
            if c != now or order is None:
                now, k, order = c, 0, Order(template)
            right = order.step(r)
            for content, loss in template.segments(r, t):
                out.append((c, k, r, content, loss, right))
                k += 1
            if len(out) >= 3000:
                yield _batch(out, _SEGMENT)
                out = []
        if out:
            yield _batch(out, _SEGMENT)

    return _ordered(rows, conv, turn, role, text).mapInArrow(
        run, "conv_id long, segment long, role string, content string, loss boolean, in_order boolean")


_SEGMENT = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("role", pa.string()),
                      ("content", pa.string()), ("loss", pa.bool_()), ("in_order", pa.bool_())])
_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                     ("loss_chars", pa.int64()), ("loss_sha256", pa.string()),
                     ("formatted_chars", pa.int64()), ("in_order", pa.bool_())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class Digest:
    """Reads formatted turns back and sums them up."""

    def __init__(self, conv, template: Template):
        self.conv, self.template, self.order = conv, template, Order(template)
        self.turns = self.loss_chars = self.chars = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str) -> None:
        self.chars += len(formatted)
        for role, text, loss in self.template.read(formatted):
            self.order.step(role)
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
            if loss:
                self.loss_chars += len(text)
                self.loss.update(text.encode())

    def row(self) -> tuple:
        return (self.conv, self.turns, self.all.hexdigest(), self.loss_chars,
                self.loss.hexdigest(), self.chars, self.order.end())


def digest_frame(rows: DataFrame, template: Template = INSTRUCT, conv: str = "conv_id",
                 turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation, read back from its formatted string: conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars, in_order (the turn order
    was right throughout and ended in a final role)."""

    def run(batches):
        out, now = [], None
        for c, r, t in _turns(batches):
            if now is None or c != now.conv:
                if now is not None:
                    out.append(now.row())
                now = Digest(c, template)
                if len(out) >= 1000:
                    yield _batch(out, _DIGEST)
                    out = []
            now.add("".join(s for s, _ in template.segments(r, t)))
        if now is not None:
            out.append(now.row())
        if out:
            yield _batch(out, _DIGEST)

    return _ordered(rows, conv, turn, role, text).mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long, in_order boolean")
