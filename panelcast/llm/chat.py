"""Chat formatting that a deterministic parser turns back into the same turns."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Control strings, fixed by the template. A rendered text contains none of them but the template's own.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
ASSISTANT = "assistant"
_TAILS = "|".join(re.escape(c[1:]) for c in CONTROLS)
_GUARD = re.compile(rf"([<\[])(\\*)({_TAILS})")
_UNGUARD = re.compile(rf"([<\[])\\(\\*)({_TAILS})")


def escaped(text: str) -> str:
    """One more backslash behind the first character of each control string, escaped ones included."""
    return _GUARD.sub(r"\1\\\2\3", text)


def unescaped(text: str) -> str:
    return _UNGUARD.sub(r"\1\2\3", text)


@dataclass(frozen=True)
class Turn:
    """A rendered turn: its piece of the formatted conversation and where the text lies in it."""

    piece: str
    start: int
    end: int
    level: int


def _render(role: str, text: str, level: int) -> Turn:
    """turn := "<s>" level " [INST] " role-length ":" role " [/INST]" text "</s>" """
    name, body = role, text
    for _ in range(level):
        name, body = escaped(name), escaped(body)
    head = f"<s>{level} [INST] {len(name)}:{name} [/INST]"
    return Turn(f"{head}{body}</s>", len(head), len(head) + len(body), level)


_HEAD = re.compile(r"<s>(\d+) \[INST\] (\d+):")


def parsed(piece: str, at: int = 0) -> Iterator[tuple[str, str, int, int]]:
    """Role, text, and start and end of the text, of each turn of a formatted conversation.

    The parser looks at nothing but the formatted text: a header, the role by its length, and
    the text up to the next closing mark. Anything else raises ValueError.
    """
    while at < len(piece):
        head = _HEAD.match(piece, at)
        if not head:
            raise ValueError(f"no turn begins at {at}")
        level, begin = int(head[1]), head.end()
        role_end = begin + int(head[2])
        if not piece.startswith(" [/INST]", role_end):
            raise ValueError(f"the role does not end at {role_end}")
        start = role_end + len(" [/INST]")
        end = piece.find("</s>", start)
        if end < 0:
            raise ValueError(f"the turn at {at} does not end")
        role, text = piece[begin:role_end], piece[start:end]
        if any(c in text for c in CONTROLS) or any(c in role for c in CONTROLS):
            raise ValueError(f"a control string inside the turn at {at}")
        for _ in range(level):
            role, text = unescaped(role), unescaped(text)
        yield role, text, start, end
        at = end + len("</s>")


def rendered(role: str | None, text: str | None, deepest: int = 4) -> Turn:
    """The turn at the lowest escape level whose reparse gives back exactly this role and text."""
    role, text = role or "", text or ""
    for level in range(deepest + 1):
        turn = _render(role, text, level)
        try:
            back = list(parsed(turn.piece))
        except ValueError:
            continue
        if back == [(role, text, turn.start, turn.end)]:
            return turn
    raise ValueError("the turn does not survive the round trip")


def formatted(turns: DataFrame) -> DataFrame:
    """Each row of conv_id, turn, role, text with its rendered piece.

    Rows are rendered one by one, so a long conversation is spread over many tasks; the formatted
    conversation is the concatenation of its pieces by turn. Adds piece, text_start, text_end
    (code points in the piece), escape_level and loss (is the text of an assistant).

    A null text or role is empty, also in the returned columns; a null turn comes first. Equal turns stay separate
    rows. An empty table gives no rows. Other columns are not read.
    """
    rows = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles = batch.column(2).to_pylist()
            made = [rendered(r, t) for r, t in zip(roles, batch.column(3).to_pylist(), strict=True)]
            numbers = [pa.array([getattr(m, name) for m in made], pa.int32()) for name in ("start", "end", "level")]
            columns = [*batch.columns, pa.array([m.piece for m in made], pa.string()), *numbers, pa.array([r == ASSISTANT for r in roles], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "piece", "text_start", "text_end", "escape_level", "loss"])

    conv = dict(rows.dtypes)["conv_id"]
    schema = f"conv_id {conv}, turn long, role string, text string, piece string, text_start int, text_end int, escape_level int, loss boolean"
    return rows.mapInArrow(render, schema)


class _Digest:
    """What is read back from the pieces of one conversation, piece by piece."""

    def __init__(self, conv):
        self.conv, self.turns, self.loss_chars, self.chars, self.levels = conv, 0, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, piece: str, start: int, end: int, loss: bool) -> None:
        ((role, text, s, e),) = parsed(piece)
        if (s, e) != (start, end) or (role == ASSISTANT) != loss:
            raise ValueError("the mask does not lie on the text")
        self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        if loss:
            self.loss.update(text.encode("utf-8", "surrogatepass"))
            self.loss_chars += len(text)
        self.turns += 1
        self.chars += len(piece)
        self.levels += piece.startswith("<s>0 ") is False

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.levels


def read_back(pieces: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed from its rendered pieces only.

    The rows of a conversation are sorted in the shuffle and stream through one task, since a
    digest is a sequence; the task holds one Arrow batch and two digest states at a time, however long the
    conversation. Rows with the same turn follow each other by piece.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Digest | None = None
        done: list[tuple] = []
        for batch in batches:
            for conv, piece, start, end, loss in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4, 5)), strict=True):
                if now is None or now.conv != conv:
                    if now is not None:
                        done.append(now.row())
                    now = _Digest(conv)
                now.add(piece, start, end, loss)
            if done:
                yield _batch(done)
                done = []
        if now is not None:
            yield _batch([now.row()])

    rows = pieces.select(F.col("conv_id").cast("long"), "turn", "piece", "text_start", "text_end", "loss")
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "piece")
    return dealt.mapInArrow(
        digest,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, escaped_turns long",
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string() if name.endswith("sha256") else pa.int64() for name in NAMES]
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=NAMES)


NAMES = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "escaped_turns"]
