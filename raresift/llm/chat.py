"""Chat formatting: a finite-state machine over roles, a declarative template, text segments with loss flags."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raresift.llm.words import slices

SEGMENTS = "conv_id long, segment long, turn long, role string, text string, loss boolean, state string"


@dataclass(frozen=True)
class Template:
    """What surrounds a turn, which roles are learned, and which role may follow which.

    ``open`` contains {role}. Inside texts and roles, ``escape`` goes before itself, before every character of
    ``marks`` and before ``close``, so that neither mark can appear there and the text can be read back.
    """

    open: str = "### {role}: "
    close: str = "</turn>"
    after: str = "\n"
    escape: str = "\\"
    marks: str = "#"
    learned: tuple[str, ...] = ("assistant",)
    start: str = "start"
    moves: dict[str, dict[str, str]] = field(default_factory=lambda: {
        "start": {"system": "system", "user": "user"},
        "system": {"user": "user"},
        "user": {"assistant": "assistant", "tool": "tool"},
        "tool": {"assistant": "assistant", "tool": "tool"},
        "assistant": {"user": "user", "tool": "tool"},
    })
    final: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        before, role, after = self.open.partition("{role}")
        if not role or not self.close or len(self.escape) != 1 or self.escape in self.open + self.close:
            raise ValueError("a template needs {role}, a closing mark and an escape character found in neither")
        if not set(before) & set(self.marks) or not after or after[0] not in self.marks + ":":
            raise ValueError("what opens a turn must hold a marked character, and what ends its role must begin with one or a colon")

    def quote(self, text: str) -> str:
        e = self.escape
        text = text.replace(e, e + e)
        for c in self.marks:
            text = text.replace(c, e + c)
        return text.replace(self.close, e + self.close)

    def quote_role(self, role: str) -> str:
        """Roles are escaped as texts are, and their colons too, as a colon ends the role in ``open``."""
        return self.quote(role).replace(":", self.escape + ":")

    def _until(self, text: str, at: int, mark: str) -> int:
        """Where ``mark`` first stands at or after ``at`` behind an even number of escapes; -1 if nowhere. Linear, as every run of
        escapes belongs to one place."""
        found = text.find(mark, at)
        while found >= 0:
            i = found
            while i > at and text[i - 1] == self.escape:
                i -= 1
            if (found - i) % 2 == 0:
                return found
            found = text.find(mark, found + 1)
        return -1

    def parse(self, turn: str) -> tuple[str, str] | None:
        """Role and text, still escaped, of one formatted turn; None if it is none."""
        before, after = self.open.split("{role}")
        end = self.close + self.after
        if not turn.startswith(before):
            return None
        role = self._until(turn, len(before), after)
        text = self._until(turn, role + len(after), end) if role >= 0 else -1
        return (turn[len(before):role], turn[role + len(after):text]) if text >= 0 and text + len(end) == len(turn) else None

    def unquote(self, text: str) -> str:
        return re.sub(re.escape(self.escape) + "(.)", r"\1", text, flags=re.S)


def _sorted_turns(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Turns of a conversation together in one task, in order, never gathered in memory."""
    turns = df.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                      F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
                      F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_chat(df: DataFrame, template: Template | None = None, conv_col: str = "conv_id", turn_col: str = "turn",
                role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Segments of every conversation, in order: opening mark, text, closing mark; the text segment of a learned role
    has ``loss`` true. Their texts one after another are the formatted conversation.

    ``state`` is the machine's state after the turn; "invalid" from the first turn that no move allows, which does
    not keep the turn from being formatted. A last segment of empty text closes every conversation with state
    "accepted" or "rejected" (an invalid turn, or an end in a state that is not final).

    One shuffle by conversation and a sort in the tasks; rows are streamed, so memory is bounded by an Arrow batch and a few
    copies of the longest turn, however long a conversation is. A conversation's turns must meet in one task, as turn order and the digests of
    its formatted text are sequential; nothing of it is collected there.

    Null texts and roles are empty strings (an empty role is no allowed move); rows with a null conv_id form one
    conversation of null id; null turns come first; equal turns are ordered by role and text, repeated rows stay; an
    empty table gives no row; other columns are ignored.
    """
    t = template or Template()
    before, after = t.open.split("{role}")

    def run(batches):
        conv, state, number, started = None, t.start, 0, False
        rows: list[tuple] = []

        def end():
            verdict = "accepted" if state in t.final else "rejected"
            return (conv, number, None, None, "", False, verdict)

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(
                    (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string()))],
                names=["conv_id", "segment", "turn", "role", "text", "loss", "state"])

        for part in (x for batch in batches for x in slices(batch, "text")):
            size = 0
            for c, turn, role, text in zip(*(part.column(x).to_pylist() for x in ("conv_id", "turn", "role", "text"))):
                if not started or c != conv:
                    if started:
                        rows.append(end())
                    conv, state, number, started = c, t.start, 0, True
                state = t.moves.get(state, {}).get(role, "invalid")
                for piece, loss in ((before + t.quote_role(role) + after, False), (t.quote(text), role in t.learned),
                                    (t.close + t.after, False)):
                    rows.append((c, number, turn, role, piece, loss, state))
                    number += 1
                size += len(text)
                if size > 4 << 20:
                    yield out()
                    rows, size = [], 0
            if rows:
                yield out()
                rows = []
        if started:
            rows.append(end())
            yield out()

    turns = _sorted_turns(df, conv_col, turn_col, role_col, text_col)
    return turns.mapInArrow(run, SEGMENTS)


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation from the segments of ``format_chat`` alone, which must come as it returns them: turns
    and texts are parsed out of the formatted text again and unescaped.

    Digests are fed turn by turn, so a conversation is never held whole. n_turns, turns_sha256 (role, newline, text,
    newline of every turn), loss_chars and loss_sha256 (code points and digest of all unescaped text under the loss
    mask), formatted_chars, accepted. An empty table gives no row.
    """
    t = template or Template()

    def run(batches):
        rows: list[tuple] = []
        conv, started = None, False
        n = turns = loss = loss_chars = chars = pending = None

        def begin():
            return 0, hashlib.sha256(), hashlib.sha256(), 0, 0, []

        for part in (x for batch in batches for x in slices(batch, "text")):
            for c, text, masked, state in zip(*(part.column(x).to_pylist() for x in ("conv_id", "text", "loss", "state"))):
                if not started or c != conv:
                    conv, started = c, True
                    n, turns, loss, loss_chars, chars, pending = begin()
                chars += len(text)
                if masked:
                    plain = t.unquote(text)
                    loss_chars += len(plain)
                    loss.update(plain.encode("utf-8"))
                if state in ("accepted", "rejected"):
                    if pending:
                        raise ValueError(f"conversation {conv} ends inside a turn")
                    rows.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, state == "accepted"))
                    started = False
                    continue
                pending.append(text)
                if text == t.close + t.after:  # an escaped text never equals the closing mark
                    found = t.parse("".join(pending))
                    if found is None:
                        raise ValueError(f"conversation {conv}: a turn can't be read back")
                    for part in found:
                        turns.update(t.unquote(part).encode("utf-8"))
                        turns.update(b"\n")
                    n, pending = n + 1, []
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(
                        (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()))],
                    names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "accepted"])
                rows = []

    return segments.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                                    "loss_sha256 string, formatted_chars long, accepted boolean")
