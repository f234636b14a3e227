"""Packing along a space-filling curve.

A document's tokens are hashed into signed directions and summed, so its vector is the
projection of its hashed bag of tokens to ``DIMS`` dimensions; scaled and squashed to
[0, 1) the point gets a Hilbert key of ``BITS`` bits a dimension. Documents are range
partitioned and sorted by that key, and each partition cuts its run of tokens into
sequences, so neighbours on the curve share sequences. What remains at the end of a
partition is cut into sequences whose lengths are powers of two (these need no padding).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import materialise
from trellis.llm.tokens import encoded

SEQUENCE = 1024
ROW_TOKENS = 1024  # a document's ids travel in rows of at most so many
DIMS, BITS = 3, 16
SEED = 0x9E3779B97F4A7C15


def directions(n: int, dims: int = DIMS) -> np.ndarray:
    """A sign per hashed token and dimension (int8), from an integer hash of the token id."""
    with np.errstate(over="ignore"):
        h = (np.arange(n, dtype=np.uint64) + np.uint64(1)) * np.uint64(SEED)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return np.stack([((h >> np.uint64(17 + 11 * d)) & np.uint64(1)).astype(np.int8) * 2 - 1 for d in range(dims)], axis=1)


def points(ids: list[np.ndarray], table: np.ndarray) -> np.ndarray:
    """Coordinates in [0, 1) of each document; one without tokens lies in the middle."""
    out = np.zeros((len(ids), table.shape[1]))
    for i, x in enumerate(ids):
        if len(x):
            v = table[x].sum(axis=0, dtype=np.int64)
            out[i] = v / math.sqrt(len(x))
    # the scaled sums are spread like a normal variable about a drift; the logistic curve evens them out
    return np.clip(1 / (1 + np.exp(-out / 4)), 0, 1 - 2**-53)


def hilbert(coords: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Distance along the Hilbert curve (signed 64-bit, bits * dims <= 63) of integer points, one per row.

    Works on all points at once, from the highest bit down: exchange or invert the lower
    bits of the axes as the curve turns, then read the Gray-coded bits crosswise.
    """
    x = coords.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            turn = (x[i] & q) != 0
            swap = np.where(turn, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(turn, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[dims - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def tokenized(df: DataFrame, path: str, id_col: str, text_col: str, eos: int, added_tokens: bool = False) -> DataFrame:
    """``doc_id, start, doc_tokens, ids, key``: the ids of each document (unsigned 16-bit little-endian, end mark
    included) in rows of at most ``ROW_TOKENS``, with the Hilbert key of the whole document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = directions(1 << 16)
        end = np.array([eos], dtype="<u2").tobytes()
        for b, ids in encoded(batches, path, added_tokens=added_tokens):
            where = points([np.frombuffer(x, dtype="<u2") for x in ids], table)
            key = hilbert((where * (1 << BITS)).astype(np.int64))
            rows = [
                (doc, at // 2, len(x) // 2 + 1, (x + end)[at : at + 2 * ROW_TOKENS], k)
                for doc, x, k in zip(b.column(0).to_pylist(), ids, key.tolist())
                for at in range(0, len(x) + 2, 2 * ROW_TOKENS)
            ]
            cols = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()))],
                names=["doc_id", "start", "doc_tokens", "ids", "key"],
            )

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, start long, doc_tokens long, ids binary, key long"
    )


PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class _Sequences:
    """Cuts a run of tokens into sequences: ``room`` tokens fit the open one."""

    def __init__(self, first: int, size: int):
        self.next, self.size = first, size
        self.id, self.offset = first, 0

    def place(self, n: int) -> Iterator[tuple[int, int, int]]:
        """(sequence, offset, length) of the pieces of ``n`` more tokens."""
        while n:
            take = min(n, self.size - self.offset)
            yield self.id, self.offset, take
            n, self.offset = n - take, self.offset + take
            if self.offset == self.size:
                self.id, self.offset = self.id + 1, 0


def powers(n: int) -> list[int]:
    """n as a falling list of powers of two."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE, eos: int = 0,
         added_tokens: bool = False) -> DataFrame:
    """Pieces of sequences, one row each: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids``.

    ``path``: a ``tokenizers`` file; with ``added_tokens`` its added tokens in a text stand for their ids. Each document's ids are followed by ``eos``; each id is
    in exactly one piece; a sequence is gapless from offset 0 and holds ``size`` ids or a
    power of two. ``ids`` are unsigned 16-bit, little-endian.

    Null text is an empty text (its end mark alone); repeated rows are packed each; null
    ids stay null; ties on the curve are ordered by id and ids; an empty table gives no
    rows; other columns are ignored. A very long document travels in many rows.
    """
    docs = materialise(tokenized(df, path, id_col, text_col, eos, added_tokens), "token-ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seqs = _Sequences(TaskContext.get().partitionId() << 40, size)
        tail: list[tuple] = []  # pieces of the open sequence

        def rows(found: list[tuple]) -> pa.RecordBatch:
            doc, start, length, total, seq, offset, ids = zip(*found)
            return pa.RecordBatch.from_arrays(
                [*(pa.array(x, pa.int64()) for x in (doc, start, length, total, seq, offset)), pa.array(ids, pa.binary())],
                names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )

        for b in batches:
            for i in range(0, b.num_rows, 512):
                part, out = b.slice(i, 512), []
                for doc, first, total, ids in zip(*(part.column(c).to_pylist() for c in range(4))):
                    at = 0
                    for seq, offset, n in seqs.place(len(ids) // 2):
                        if tail and tail[0][4] != seq:
                            out += tail
                            tail = []
                        tail.append((doc, first + at, n, total, seq, offset, ids[2 * at : 2 * (at + n)]))
                        at += n
                if out:
                    yield rows(out)
        if tail and sum(x[2] for x in tail) != size:
            whole, tail, seq = tail, [], tail[0][4]
            room = powers(sum(x[2] for x in whole))
            offset = 0
            for doc, start, n, total, _, _, ids in whole:
                at = 0
                while at < n:
                    take = min(n - at, room[0] - offset)
                    tail.append((doc, start + at, take, total, seq, offset, ids[2 * at : 2 * (at + take)]))
                    at, offset = at + take, offset + take
                    if offset == room[0]:
                        room, offset, seq = room[1:], 0, seq + 1
        if tail:
            yield rows(tail)

    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = docs.repartitionByRange(n, "key", "doc_id", "start").sortWithinPartitions("key", "doc_id", "start", "ids")
    return ranged.select("doc_id", "start", "doc_tokens", "ids").mapInArrow(run, PIECES)


def id_digests(pieces: DataFrame) -> DataFrame:
    """Pieces with ``ids_crc32`` (of the ids as unsigned 32-bit little-endian) instead of ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crc = [zlib.crc32(np.frombuffer(x, dtype="<u2").astype("<u4").tobytes()) for x in b.column(6).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(crc, pa.int64())], names=[*b.schema.names[:6], "ids_crc32"])

    return pieces.mapInArrow(run, PIECES.replace("ids binary", "ids_crc32 long"))
