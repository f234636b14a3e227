"""Fill-in-the-middle examples from texts stored as seekable compressed frames.

A text is stored as independent zstandard frames of at most ``FRAME_BYTES`` with the numbers
of units and of code points before each. A unit is a run of ASCII letters or any other
single code point. Two keyed draws cut the text at units; only the frames that hold a cut are
opened, all others go into the output as they are, in the output's order. Zstandard frames
in a row are one stream, so the output is read (for its text or its digest) frame by frame.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import materialise, text_or_empty

FRAME_BYTES = 64 << 10
LEVEL = 3
#: Bytes of texts that are looked at together.
TOGETHER = 4 << 20
READ_BYTES = 1 << 20
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of a hundred texts so many are not transformed; of a hundred others so many put the suffix first.
PLAIN_PERCENT = 10
SPM_PERCENT = 20

STORED = "key string, n long, marked boolean, units array<long>, chars array<long>, frames array<binary>"
MADE = "key string, n long, form string, prefix_chars long, middle_chars long, output binary"


def _marks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of UTF-8: is it an ASCII letter, does it begin a code point."""
    return ((data | np.uint8(32)) - np.uint8(97)) < 26, (data & np.uint8(0xC0)) != 0x80


def unit_starts(data: np.ndarray, after_letter: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """For each byte: does it begin a unit, does it begin a code point. ``after_letter``: the byte before was a letter."""
    letter, lead = _marks(data)
    again = np.empty(len(data), bool)
    again[:1] = after_letter
    again[1:] = letter[:-1]
    return lead & ~(letter & again), lead


def frame_ends(data: np.ndarray, frame_bytes: int) -> list[int]:
    """Ends of the frames of one text: every ``frame_bytes`` at most, never inside a code point."""
    ends, at = [], 0
    while len(data) - at > frame_bytes:
        end = at + frame_bytes
        while end > at + 1 and data[end] & 0xC0 == 0x80:
            end -= 1
        ends.append(end)
        at = end
    return [*ends, len(data)] if len(data) else []


def _long_text(data: np.ndarray, frame_bytes: int, squeeze) -> tuple[list[int], list[int], list[bytes], int]:
    """Units and code points before each frame, the frames, and the number of units; one frame at a time."""
    units, chars, frames, n, c, at, letter = [], [], [], 0, 0, 0, False
    for end in frame_ends(data, frame_bytes):
        part = data[at:end]
        starts, lead = unit_starts(part, letter)
        units.append(n)
        chars.append(c)
        frames.append(squeeze(part.tobytes()))
        n, c, letter, at = n + int(np.count_nonzero(starts)), c + int(np.count_nonzero(lead)), bool(_marks(part[-1:])[0][0]), end
    return units, chars, frames, n


def _text_column(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a binary column without nulls."""
    col = batch.column(i)
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buffer = col.buffers()[2]
    return offsets, np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.empty(0, np.uint8)


def store(df: DataFrame, text_col: str = "text", key: Column | None = None, frame_bytes: int = FRAME_BYTES, level: int = LEVEL) -> DataFrame:
    """One row a text: ``key, n, marked, units, chars, frames``, written in the shared folder.

    ``key`` (default: ``doc_id``; null: empty) names the text and seeds its draws. ``n``: units; ``marked``: the text holds one
    of the three marks; ``units`` and ``chars``: those before each frame. Null text is
    empty and has no frames; repeated rows are stored each; an empty table gives an empty store;
    no other column is read, so names cannot clash.
    """
    key = F.col("doc_id") if key is None else key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=level).compress
        for whole in batches:
            step = max(1, TOGETHER // max(1, whole.column(1).nbytes // max(1, len(whole))))
            for first in range(0, len(whole), step):
                b = whole.slice(first, step)
                offsets, data = _text_column(b, 1)
                size = np.diff(offsets)
                starts_at, rows = offsets[:-1], []
                short = (size > 0) & (size <= frame_bytes)
                n_units = np.zeros(len(size), np.int64)
                if short.any():
                    lo, hi = int(offsets[0]), int(offsets[-1])
                    if (size <= frame_bytes).all():  # counted together
                        part = data[lo:hi]
                        letter, lead = _marks(part)
                        again = np.empty(len(part), bool)
                        again[1:] = letter[:-1]
                        again[starts_at[short] - lo] = False
                        n_units[short] = np.add.reduceat(lead & ~(letter & again), starts_at[short] - lo, dtype=np.int64)
                    else:
                        for i in np.flatnonzero(short):
                            n_units[i] = np.count_nonzero(unit_starts(data[offsets[i] : offsets[i + 1]])[0])
                for i, n in enumerate(n_units.tolist()):
                    text = data[offsets[i] : offsets[i + 1]]
                    if short[i]:
                        rows.append((n, [0], [0], [squeeze(text.tobytes())]))
                    else:
                        units, chars, frames, n = _long_text(text, frame_bytes, squeeze)
                        rows.append((n, units, chars, frames))
                n, units, chars, frames = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(n, pa.int64()), b.column(2), pa.array(units, pa.list_(pa.int64())), pa.array(chars, pa.list_(pa.int64())),
                     pa.array(frames, pa.list_(pa.binary()))],
                    names=["key", "n", "marked", "units", "chars", "frames"],
                )

    text = text_or_empty(text_col)
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(text, F.lit(mark.decode()))
    rows = df.select(F.coalesce(key.cast("string"), F.lit("")).alias("key"), text.cast("binary").alias("data"), marked.alias("marked"))
    return materialise(rows.mapInArrow(run, STORED), "text-frames", compression="none")


def cut_at(unit: int, row: dict, expand) -> tuple[int, bytes, int, int]:
    """Where unit ``unit`` begins: its frame, that frame's bytes, the offset there, and the code points before it in the text.

    The end of the text is a place after the last frame.
    """
    if unit >= row["n"]:
        return len(row["frames"]), b"", 0, -1
    f = int(np.searchsorted(row["units"], unit, side="right")) - 1
    text = expand(row["frames"][f])
    starts, lead = unit_starts(np.frombuffer(text, dtype=np.uint8))
    places = np.flatnonzero(starts)
    held = (row["units"][f + 1] if f + 1 < len(row["units"]) else row["n"]) - row["units"][f]
    if len(places) > held:  # the frame begins inside a run of letters that an earlier frame began
        places = places[1:]
    at = int(places[unit - row["units"][f]])
    return f, text, at, row["chars"][f] + int(np.count_nonzero(lead[:at]))


def _between(row: dict, a: tuple, b: tuple) -> list[tuple[bool, bytes]]:
    """Pieces of the text from cut ``a`` to cut ``b``: (whole frame or not, its bytes or those of an opened frame)."""
    if a[0] == b[0]:
        return [(False, a[1][a[2] : b[2]])]
    whole = a[0] + 1 if a[2] else a[0]
    head = [(False, a[1][a[2] :])] if a[2] else []
    tail = [(False, b[1][: b[2]])] if b[2] else []
    return [*head, *((True, x) for x in row["frames"][whole : b[0]]), *tail]


def _joined(pieces: list[tuple[bool, bytes]], squeeze) -> bytes:
    """Frames in a row; neighbouring opened pieces share a new frame."""
    out, loose = [], []
    for whole, data in [*pieces, (True, b"")]:
        if not whole:
            loose.append(data)
            continue
        if any(loose):
            out.append(squeeze(b"".join(loose)))
        loose = []
        out.append(data)
    return b"".join(out)


def example(row: dict, h: list[int], squeeze, expand) -> tuple[str, int | None, int | None, bytes]:
    """Form, code points of prefix and middle, and the output's frames of one stored text."""
    n = row["n"]
    if n == 0 or row["marked"] or h[2] % 100 >= 100 - PLAIN_PERCENT:
        return "plain", None, None, b"".join(row["frames"])
    first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = cut_at(first, row, expand), cut_at(second, row, expand)
    start, end = (0, b"", 0, 0), (len(row["frames"]), b"", 0, -1)
    if a[0] == 0 or b[0] == 0:  # the first frame is open: its bytes before the cut are at hand
        start = (0, (a if a[0] == 0 else b)[1], 0, 0)
    prefix, middle, suffix = _between(row, start, a), _between(row, a, b), _between(row, b, end)
    total = None
    if -1 in (a[3], b[3]):  # a cut at the end: the code points of the whole text
        last = np.frombuffer(expand(row["frames"][-1]), dtype=np.uint8)
        total = row["chars"][-1] + int(np.count_nonzero(_marks(last)[1]))
    before_a, before_b = (total if x[3] < 0 else x[3] for x in (a, b))
    mark = lambda m: [(False, m)]
    if h[3] % 100 < SPM_PERCENT:
        form, pieces = "spm", [*mark(SUFFIX), *suffix, *mark(PREFIX), *prefix, *mark(MIDDLE), *middle]
    else:
        form, pieces = "psm", [*mark(PREFIX), *prefix, *mark(SUFFIX), *suffix, *mark(MIDDLE), *middle]
    return form, before_a, before_b - before_a, _joined(pieces, squeeze)


def transform(stored: DataFrame, level: int = LEVEL) -> DataFrame:
    """``key, n, form, prefix_chars, middle_chars, output``: one example a stored text; ``output`` is a row of zstandard frames.

    The draws are the first four groups of eight hex digits of the SHA-256 of ``1:`` and the key. An
    empty text, one that holds a mark and a tenth of the others stay plain, with null lengths.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, expand = zstandard.ZstdCompressor(level=level).compress, zstandard.ZstdDecompressor().decompress
        for whole in batches:
            for first in range(0, len(whole), 256):
                b = whole.slice(first, 256)
                made = []
                for row in b.to_pylist():
                    digest = hashlib.sha256(f"1:{row['key']}".encode()).digest()
                    made.append(example(row, [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)], squeeze, expand))
                form, p, m, out = zip(*made)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(form), pa.array(p, pa.int64()), pa.array(m, pa.int64()), pa.array(out, pa.binary())],
                    names=["key", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return stored.mapInArrow(run, MADE)


def streamed(output: bytes) -> Iterator[bytes]:
    """The bytes of frames in a row, a bounded part at a time."""
    reader = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(output), read_across_frames=True)
    while part := reader.read(READ_BYTES):
        yield part


def rebuilt(output: bytes, form: str) -> bytes:
    """The text from an output and its form."""
    data = b"".join(streamed(output))
    if form == "plain":
        return data
    if form == "psm":
        prefix, _, rest = data.removeprefix(PREFIX).partition(SUFFIX)
        suffix, _, middle = rest.partition(MIDDLE)
    else:
        suffix, _, rest = data.removeprefix(SUFFIX).partition(PREFIX)
        prefix, _, middle = rest.partition(MIDDLE)
    return prefix + middle + suffix


def _per_output(made: DataFrame, columns: list[tuple[str, str]], of) -> DataFrame:
    """``made`` with ``output`` replaced by ``columns``, the values of ``of(output, form)``."""
    kept = [c for c in made.columns if c != "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, len(whole), 256):
                b = whole.slice(first, 256)
                form, output = b.column(b.schema.get_field_index("form")), b.column(b.schema.get_field_index("output"))
                values = [of(o, f) for o, f in zip(output.to_pylist(), form.to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(b.schema.get_field_index(c)) for c in kept), *(pa.array(v, pa.string()) for v in zip(*values))],
                    names=[*kept, *(c for c, _ in columns)],
                )

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema if f.name != "output"), *(f"{c} {t}" for c, t in columns)])
    return made.mapInArrow(run, schema)


def texts(made: DataFrame) -> DataFrame:
    """Examples with ``output`` as text and the ``text`` rebuilt from it."""
    return _per_output(made, [("output", "string"), ("text", "string")], lambda o, f: (b"".join(streamed(o)).decode(), rebuilt(o, f).decode()))


def digests(made: DataFrame) -> DataFrame:
    """Examples with the SHA-256 of their output (read frame by frame) and of the text rebuilt from it."""

    def of(output: bytes, form: str) -> tuple[str, str]:
        h = hashlib.sha256()
        for part in streamed(output):
            h.update(part)
        return h.hexdigest(), hashlib.sha256(rebuilt(output, form)).hexdigest()

    return _per_output(made, [("output_sha256", "string"), ("restored_sha256", "string")], of)
