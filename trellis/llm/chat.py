"""Chat formatting with prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context,
and only that reply under the loss mask (a span of code points). A conversation that
does not end with an assistant turn also gives one example without a target, so that
no turn is lost.

Template, per turn::

    ### role: text
    </turn>

Control strings inside a text are escaped with backslashes: n backslashes before
``###`` or ``</turn>`` become 2n + 1, which is undone exactly. Roles are
percent-encoded. A line break stands before the closing mark, so a text's own
trailing backslashes never touch it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, SEP, CLOSE = "### ", ": ", "\n</turn>\n"
TARGET_ROLE = "assistant"
_RAW = re.compile(r"(\\*)(###|</turn>)")
_ESCAPED = re.compile(r"(\\+)(###|</turn>)")


def escape(text: str) -> str:
    return _RAW.sub(lambda m: "\\" * (2 * len(m[1]) + 1) + m[2], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" * ((len(m[1]) - 1) // 2) + m[2], text)


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and the span of its (escaped) text in it."""
    head = OPEN + quote(role, safe="") + SEP
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) per turn, read back from formatted text."""
    turns, at = [], 0
    while at < len(formatted):
        end = formatted.index(CLOSE, at)
        role, _, body = formatted[at + len(OPEN) : end].partition(SEP)
        turns.append((unquote(role), unescape(body)))
        at = end + len(CLOSE)
    return turns


EXAMPLES = "conv_id long, n_context long, target boolean, formatted string, loss_start long, loss_end long, last boolean"


def expand(conversations: DataFrame) -> DataFrame:
    """Examples of ``conversations`` (conv_id, turn, role, text).

    Columns: ``conv_id``, ``n_context`` (turns before the target), ``target``, ``formatted``,
    ``loss_start``/``loss_end`` (code points of ``formatted``; equal in an example
    without target), ``last`` (the example that holds the whole conversation).

    Turns are ordered by (turn, role, text), nulls first; null role or text counts as
    empty; null conv_id is one conversation of its own; repeated rows are repeated
    turns; an empty table gives no rows; other columns are ignored. An example holds
    its whole context by definition, so it is as long as its conversation.

    The rows of a conversation meet by hash and are sorted there (Spark's sort spills);
    Python streams over them and keeps one conversation's text.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(b.column(i).to_pylist() for i in range(4)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("n_context", pa.int64()), ("target", pa.bool_()), ("formatted", pa.string()),
                            ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("last", pa.bool_())])
        out, held, conv, context, size = [], 0, object(), [], 0
        pending = None  # (start, end) of the newest turn if it is a target

        def close(last: bool) -> None:
            nonlocal held
            if pending is not None or last:
                start, end = pending or (0, 0)
                out.append({"conv_id": conv, "n_context": len(context) - (pending is not None), "target": pending is not None,
                            "formatted": "".join(context), "loss_start": start, "loss_end": end, "last": last})
                held += size

        for conv_id, _, role, text in rows(batches):
            role, text = role or "", text or ""
            if conv_id != conv:
                if context:
                    close(True)
                conv, context, size, pending = conv_id, [], 0, None
            elif context:
                close(False)
            if held > 8 << 20:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, held = [], 0
            turn, a, b = render_turn(role, text)
            pending = (size + a, size + b) if role == TARGET_ROLE else None
            context.append(turn)
            size += len(turn)
        if context:
            close(True)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, EXAMPLES)


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation what its examples hold: ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars`` (code points of all its examples) and ``n_examples`` (with a target)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                row = {"conv_id": r["conv_id"], "n_context": r["n_context"], "chars": len(r["formatted"]),
                       "loss": unescape(r["formatted"][r["loss_start"] : r["loss_end"]]), "target": r["target"],
                       "n_turns": None, "turns_sha256": None}
                if r["last"]:
                    turns = parse(r["formatted"])
                    row["n_turns"] = len(turns)
                    row["turns_sha256"] = hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in turns).encode()).hexdigest()
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("conv_id", pa.int64()), ("n_context", pa.int64()), ("chars", pa.int64()), ("loss", pa.string()),
                        ("target", pa.bool_()), ("n_turns", pa.int64()), ("turns_sha256", pa.string())])
    each = examples.mapInArrow(run, "conv_id long, n_context long, chars long, loss string, target boolean, n_turns long, turns_sha256 string")
    in_order = F.sort_array(F.collect_list(F.when(F.col("target"), F.struct("n_context", "loss"))))
    return (
        each.groupBy("conv_id")
        .agg(
            F.max("n_turns").alias("n_turns"),
            F.max("turns_sha256").alias("turns_sha256"),
            F.array_join(F.transform(in_order, lambda x: x["loss"]), "").alias("loss"),
            F.sum("chars").alias("formatted_chars"),
            F.count_if("target").alias("n_examples"),
        )
        .select(
            "conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"),
            F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars", "n_examples",
        )
    )
