"""Chat formatting: a finite-state machine over roles checks the turn order, a declarative template gives text segments with loss flags.

Turns of a conversation meet in one partition, sorted; a task then goes through them one at a time and holds the machine's
state, never a conversation. So one very long conversation costs time in its task but no memory.

Control strings inside texts are escaped: the template's escape character is doubled, and comes after the first character
of each place where a control string starts. No control string is left in an escaped text, and taking escapes off gives the text.

Turns of one conversation are in order of turn, ties in order of role, then text, nulls first; a null text or role counts as empty.
Rows with a null conversation id form a conversation of their own. Repeated rows are turns of their own. Roles
that the template doesn't know are formatted with its general markers and make the conversation invalid, as does any turn that
the machine has no transition for; invalid conversations are formatted all the same and flagged.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Template:
    """Markers before and after each role's text; whether its text counts for the loss; which role may follow which."""

    markers: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("<<SYS>>\n", "\n<</SYS>>\n"), "user": ("[INST] ", " [/INST]"), "assistant": (" ", "</s>")})
    loss: frozenset[str] = frozenset({"assistant"})
    controls: tuple[str, ...] = ("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "</s>", "<|role|>", "<|text|>", "<|end|>")
    other: tuple[str, str, str] = ("<|role|>", "<|text|>", "<|end|>")
    escape: str = "␛"
    transitions: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: frozenset[str] = frozenset({"assistant"})

    def check(self) -> None:
        """Raise ValueError unless formatted text can be read back."""
        markers = [m for pair in self.markers.values() for m in pair] + list(self.other)
        if len(self.escape) != 1 or any(self.escape in m for m in (*markers, *self.controls)):
            raise ValueError("the escape character must not be in a control string")
        for c in self.controls:
            for k in range(1, len(c)):
                if any(m.startswith(c[k:]) or c[k:].startswith(m) for m in markers if m.strip()):
                    raise ValueError(f"a text's end and a marker could make {c!r}")
        for _, end in (*self.markers.values(), ("", self.other[2]), ("", self.other[1])):
            if not any(c in end for c in self.controls):
                raise ValueError("each closing marker needs a control string")
        starts = [a for a, _ in self.markers.values()] + [self.other[0]]
        if any(a != b and a.startswith(b) for a in starts for b in starts):
            raise ValueError("opening markers must not begin each other")

    def escaped(self, text: str) -> str:
        text = text.replace(self.escape, self.escape * 2)
        if not any(c in text for c in self.controls):
            return text
        return re.sub("(?=" + "|".join(map(re.escape, self.controls)) + ")(.)", lambda m: m[1] + self.escape, text, flags=re.S)

    def unescaped(self, text: str) -> str:
        if self.escape not in text:
            return text
        e = re.escape(self.escape)
        return re.sub(f"{e}({e}?)", r"\1", text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """(text, loss flag) of one turn."""
        if role in self.markers:
            before, after = self.markers[role]
        else:
            before, after = self.other[0] + self.escaped(role) + self.other[1], self.other[2]
        return [(before, False), (self.escaped(text), role in self.loss), (after, False)]

    def read(self, buffer: str) -> tuple[str, str, int] | None:
        """Role, text and length of the first turn in formatted text; None if it has no whole turn."""
        openings = {a: (role, b) for role, (a, b) in self.markers.items()}
        for start in sorted([*openings, self.other[0]], key=len, reverse=True):
            if not buffer.startswith(start):
                continue
            at = len(start)
            if start == self.other[0]:
                to = buffer.find(self.other[1], at)
                if to < 0:
                    return None
                role, end, at = self.unescaped(buffer[at:to]), self.other[2], to + len(self.other[1])
            else:
                role, end = openings[start]
            to = buffer.find(end, at)
            if to < 0:
                return None
            return role, self.unescaped(buffer[at:to]), to + len(end)
        return None


SEGMENTS = (("segment", T.LongType()), ("text", T.StringType()), ("loss", T.BooleanType()), ("last", T.BooleanType()), ("valid", T.BooleanType()))


def format_chats(df: DataFrame, template: Template | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Segments of all conversations: id, ``segment`` (from 0), ``text``, ``loss``, ``last``; on the last segment ``valid`` says whether the machine accepts.

    Rows of a conversation are next to each other and in order within a partition; a conversation's formatted text is its segments' concatenation.
    """
    template = template or Template()
    template.check()
    work = df.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{turn_col}`").alias("__turn"), F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("__role"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"))
    dealt = work.repartition(partitions, id_col) if partitions else work.repartition(id_col)
    dealt = dealt.sortWithinPartitions(id_col, "__turn", "__role", "__text").select(id_col, "__role", "__text")
    schema = T.StructType([work.schema[id_col], *[T.StructField(*f) for f in SEGMENTS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, state, number, good = None, "", 0, True
        held: list[tuple] = []
        id_type = None

        def made(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            types = (id_type, pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=schema.names)

        def close() -> None:
            if held and open_ is not None:
                held[-1] = (*held[-1][:4], True, good and state in template.final)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for conv, role, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if open_ is None or open_[0] != conv:
                    close()
                    open_, state, number, good = (conv,), "", 0, True
                if len(held) >= 4096:
                    yield made(held)
                    held = []
                good = good and role in template.transitions.get(state, ())
                state = role
                for part, loss in template.segments(role, text):
                    held.append((conv, number, part, loss, False, None))
                    number += 1
        close()
        if held:
            yield made(held)

    return dealt.mapInArrow(run, schema)


DIGESTS = (("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType()), ("valid", T.BooleanType()))


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """Parse formatted conversations (as ``format_chats`` gives them) back; one row of counts and digests for each."""
    template = template or Template()
    id_col = segments.columns[0]
    schema = T.StructType([segments.schema[id_col], *[T.StructField(*f) for f in DIGESTS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns, loss = hashlib.sha256(), hashlib.sha256()
        n = chars = loss_chars = 0
        buffer = ""
        for batch in batches:
            out = []
            for conv, _, text, flagged, last, valid in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                chars += len(text)
                buffer += text
                if flagged:
                    plain = template.unescaped(text)
                    loss_chars += len(plain)
                    loss.update(plain.encode())
                while buffer and (turn := template.read(buffer)):
                    n += 1
                    turns.update(f"{turn[0]}\n{turn[1]}\n".encode())
                    buffer = buffer[turn[2] :]
                if last:
                    if buffer:
                        raise ValueError(f"conversation {conv!r} can't be read back")
                    out.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, valid))
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                    n = chars = loss_chars = 0
            types = (batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            columns = list(zip(*out, strict=True)) if out else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=schema.names)

    return segments.mapInArrow(run, schema)
