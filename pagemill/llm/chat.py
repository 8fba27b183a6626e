"""Chat formatting: a finite-state machine over roles, driven by a declarative template.

Turns are sorted within hashed partitions and pass through the machine one by one, so
a conversation of any length needs no more memory than one turn. Each turn gives
three segments: its head, its text and its tail. Only the text of the template's loss
roles carries the loss flag. Control strings in texts are escaped by one back slash
between '<' and '|', which is taken out again on reading.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks around turns, the roles trained on, and the machine: state to role to next state."""

    head: str = "<|im_start|>"
    head_end: str = "\n"
    tail: str = "<|im_end|>\n"
    loss_roles: frozenset[str] = frozenset({"assistant"})
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "briefed", "user": "asked"},
            "briefed": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    final: frozenset[str] = frozenset({"answered"})


CHATML = Template()
BROKEN = "broken"
MARK = re.compile(r"<(\\*)\|")
ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return MARK.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


SEGMENTS = "conv_id long, segment long, kind string, text string, loss boolean, state string, final boolean"


def to_segments(turns: DataFrame, template: Template = CHATML) -> DataFrame:
    """Segments of turns(conv_id, turn, role, text), those of a conversation together and in order.

    conv_id, segment (from 0), kind (head, text, tail), text, loss, state (of the
    machine after the turn; 'broken' from the first role out of order on) and final
    (whether the conversation may end there). Turns are ordered by turn, then role and
    text; null turns come first. Null roles and texts are empty. Rows with a null
    conv_id are one conversation. Repeated rows are repeated turns. Other columns are
    left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, number = object(), "start", 0
        for batch in batches:
            rows: list[tuple] = []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if conv != now:
                    now, state, number = conv, "start", 0
                state = template.moves.get(state, {}).get(role, BROKEN)
                done = state in template.final
                parts = (
                    ("head", template.head + escape_role(role) + template.head_end, False),
                    ("text", escape(text), role in template.loss_roles),
                    ("tail", template.tail, False),
                )
                for kind, piece, loss in parts:
                    rows.append((conv, number, kind, piece, loss, state, done))
                    number += 1
                if len(rows) >= 3000:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)

    kinds = pa.schema(
        [("conv_id", pa.int64()), ("segment", pa.int64()), ("kind", pa.string()), ("text", pa.string())]
        + [("loss", pa.bool_()), ("state", pa.string()), ("final", pa.bool_())]
    )

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    rows = turns.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(run, SEGMENTS)


def read_back(segments: DataFrame, template: Template = CHATML) -> DataFrame:
    """What a reader of the formatted text finds, a row per conversation.

    conv_id, n_turns, turns_sha256 (of role, line feed, text, line feed of each turn),
    loss_chars and loss_sha256 (of the unescaped text under the loss flag),
    formatted_chars, state and final (after the last turn). segments must come in the
    order of to_segments, as it leaves them; their hashes are carried along, the texts
    are not gathered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_ = None, None
        for batch in batches:
            rows = []
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "segment", "text", "loss", "state", "final", "kind"))
            for conv, segment, text, loss, state, done, kind in zip(*columns, strict=True):
                if open_ is None or segment == 0:
                    if open_ is not None:
                        rows.append(_row(now, open_))
                    now, open_ = conv, {"turns": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "n": 0, "chars": 0}
                open_["chars"] += len(text)
                open_ |= {"state": state, "final": done}
                if kind == "head":
                    assert text.startswith(template.head) and text.endswith(template.head_end)
                    role = unescape_role(text[len(template.head) : len(text) - len(template.head_end)])
                    open_["turns"] += 1
                    open_["all"].update(f"{role}\n".encode("utf-8", "surrogatepass"))
                elif kind == "text":
                    plain = unescape(text)
                    data = plain.encode("utf-8", "surrogatepass")
                    open_["all"].update(data)
                    open_["all"].update(b"\n")
                    if loss:
                        open_["loss"].update(data)
                        open_["n"] += len(plain)
            yield _batch(rows)
        if open_ is not None:
            yield _batch([_row(now, open_)])

    def _row(conv: int | None, x: dict) -> tuple:
        return conv, x["turns"], x["all"].hexdigest(), x["n"], x["loss"].hexdigest(), x["chars"], x["state"], x["final"]

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "state", "final"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_()]

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return segments.mapInArrow(
        run,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long, state string, final boolean",
    )
