"""Training-order materialisation: fixed-stride binary shards in a keyed random order.

All tokens form one stream (the documents by id, an end mark after each) that is cut into
sequences of ``length`` ids. A keyed Feistel permutation with cycle-walking sends the
number of a sequence to its global slot, so the order is random, needs no sort key, and
both directions can be computed anywhere. Shard s holds slots [s * per_shard,
(s + 1) * per_shard); slot k lies at byte (k mod per_shard) * stride of its shard, so a
reader can go on at any slot.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import materialise, scratch_path
from trellis.llm.tokens import encoded

LENGTH = 1024
PER_SHARD = 4096
ROUNDS = 6
#: Tasks of a shuffle at most; with more shards a task has several.
MOST_TASKS = 100_000


class Feistel:
    """Keyed permutation of 0..n-1: a balanced network on the next even number of bits, walked until it lands below n."""

    def __init__(self, n: int, key: str, rounds: int = ROUNDS):
        self.n = n
        self.half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = [
            np.uint64(int.from_bytes(hashlib.sha256(f"{key}:{i}".encode()).digest()[:8], "little")) for i in range(rounds)
        ]

    def _mix(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (x + key) * np.uint64(0xFF51AFD7ED558CCD)
            h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return (h ^ (h >> np.uint64(29))) & self.mask

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for key in reversed(self.keys) if back else self.keys:
            if back:
                left, right = right ^ self._mix(left, key), left
            else:
                left, right = right, left ^ self._mix(right, key)
        return (left << np.uint64(self.half)) | right

    def _walk(self, values, back: bool) -> np.ndarray:
        out = self._once(np.asarray(values, dtype=np.uint64), back)
        while (outside := out >= np.uint64(self.n)).any():
            out[outside] = self._once(out[outside], back)
        return out.astype(np.int64)

    def slot(self, number) -> np.ndarray:
        return self._walk(number, False)

    def number(self, slot) -> np.ndarray:
        return self._walk(slot, True)


ROWS = "part int, at long, id string, n long, digest long, ids binary"


def token_rows(df: DataFrame, path: str, text_col: str, id_col: str, eos: int, added_tokens: bool = False) -> DataFrame:
    """``part, at, id, n, digest, ids``: the tokens of each row with the end mark, their number and digest, and the place of the row: the
    partition it was read in, and the rows before it there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, part, at = np.array([eos], dtype="<u2").tobytes(), TaskContext.get().partitionId(), 0
        for b, ids in encoded(batches, path, added_tokens=added_tokens):
            ids = [x + end for x in ids]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), part, np.int32)), pa.array(at + np.arange(len(ids))), b.column(1), pa.array([len(x) // 2 for x in ids], pa.int64()),
                 pa.array([xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                names=["part", "at", "id", "n", "digest", "ids"],
            )
            at += len(ids)

    return df.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("string").alias("id")).mapInArrow(run, ROWS)


def stream_starts(rows: DataFrame, folder: str) -> int:
    """Write where each row of ``rows`` begins in the stream, one file of whole numbers for each ``part`` of ``rows``; returns the tokens of all.

    The stream's order is that of ids (whole numbers first, by value; of equal ones by their tokens), whatever the partitions.
    Ranges of ids are summed in their tasks, and each range's sums go on from those of the ranges before it: one number a range
    reaches the driver.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, total = TaskContext.get().partitionId(), 0
        for b in batches:
            ends = total + np.cumsum(b.column(2).to_numpy())
            starts = np.concatenate(([total], ends[:-1])) if len(ends) else ends
            total = int(ends[-1]) if len(ends) else total
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.full(len(ends), place, np.int32)), pa.array(starts), pa.array(ends)],
                                             names=["part", "at", "place", "start", "upto"])

    order = [F.expr("try_cast(id AS long)").isNull().alias("a"), F.expr("try_cast(id AS long)").alias("b"), "id", "digest"]
    keyed = rows.select("part", "at", "n", *order).repartitionByRange("a", "b", "id", "digest").sortWithinPartitions("a", "b", "id", "digest")
    sums = materialise(keyed.select("part", "at", "n").mapInArrow(add, "part int, at long, place int, start long, upto long"), "stream-sums")
    before, total = {}, 0
    for r in sorted(sums.groupBy("place").agg(F.max("upto").alias("n")).collect(), key=lambda r: r["place"]):
        before[r["place"]], total = total, total + r["n"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        held, parts = None, []

        def close() -> None:
            with fs.open_output_stream(f"{root}/{held}", compression=None) as out:  # a repeated task writes the same again
                out.write(np.concatenate(parts).astype("<i8").tobytes())

        for b in batches:
            part, place = b.column(0).to_numpy(), b.column(1).to_numpy()
            starts = b.column(2).to_numpy() + np.array([before[p] for p in place.tolist()], dtype=np.int64)
            bounds = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
            for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if part[i] != held:
                    if parts:
                        close()
                    held, parts = int(part[i]), []
                parts.append(starts[i:j])
        if parts:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32())], names=["done"])

    back = sums.select("part", "place", "start", "at").repartition("part").sortWithinPartitions("part", "at")
    back.select("part", "place", "start").mapInArrow(write, "done int").count()
    return total


MANIFEST = "shard long, file string, sequences long, bytes long"


def write_shards(
    df: DataFrame, path: str, folder: str, key: str, text_col: str = "text", id_col: str = "doc_id", length: int = LENGTH, per_shard: int = PER_SHARD,
    eos: int = 50256, added_tokens: bool = False,
) -> DataFrame:
    """Write the shards of ``df`` below ``folder``; returns the manifest ``shard, file, sequences, bytes``.

    ``path``: a ``tokenizers`` file with ids under 65,536; with ``added_tokens`` its added
    tokens in a text stand for their ids (``eos`` too, which then also counts as an end mark). The last sequence is filled up
    with ``eos``. Only files in the manifest count: names hold the task attempt, so a
    repeated task leaves no half shard. The order of documents in the stream is that of
    their ids, so the shards depend on the rows and the key alone, not on files or partitions;
    the permutation makes the sequences' order random. Null text is an empty text (its end
    mark alone); null ids come last, equal ones by their tokens; repeated rows are written each;
    an empty table gives an empty manifest; other columns are ignored.
    """
    rows = materialise(token_rows(df, path, text_col, id_col, eos, added_tokens), "token-rows")
    starts_folder = scratch_path(df.sparkSession, "stream-starts")
    total = stream_starts(rows, starts_folder)
    n = -(-total // length)
    stride = 2 * length
    permute = Feistel(max(n, 1), key)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        fs, root = pafs.FileSystem.from_uri(starts_folder)
        held, starts = None, None
        for b in batches:
            at_of, pieces, numbers = [], [], []
            for part, row, ids in zip(*(b.column(i).to_pylist() for i in range(3))):
                if part != held:  # a task reads few parts, each in a row
                    with fs.open_input_file(f"{root}/{part}") as f:
                        held, starts = part, np.frombuffer(f.read(), dtype="<i8").tolist()
                i, size, at = 0, len(ids) // 2, starts[row]
                while i < size:
                    number, inside = divmod(at + i, length)
                    take = min(size - i, length - inside)
                    numbers.append(number)
                    at_of.append(2 * inside)
                    pieces.append(ids[2 * i : 2 * (i + take)])
                    i += take
            slot = permute.slot(numbers) if numbers else np.empty(0, np.int64)
            byte = slot % per_shard * stride + np.array(at_of, dtype=np.int64)
            shard = slot // per_shard
            order = np.argsort(shard, kind="stable")
            bounds = np.flatnonzero(np.diff(shard[order], prepend=-1, append=-1))
            rows = []
            for i, j in zip(bounds[:-1], bounds[1:]):  # a batch's pieces of one shard travel as one squeezed row
                mine = order[i:j]
                found = [pieces[k] for k in mine]
                head = np.column_stack([byte[mine], [len(x) for x in found]]).astype("<i8")
                rows.append((int(shard[mine[0]]), len(mine), squeeze.compress(head.tobytes() + b"".join(found))))
            cols = list(zip(*rows)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], names=["shard", "n", "pieces"]
            )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        expand = zstandard.ZstdDecompressor()
        shard, buffer, done = None, None, []

        def close() -> None:
            name = f"shard-{shard:08d}-{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}.bin"
            with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(buffer)
            done.append((shard, f"{folder}/{name}", len(buffer) // stride, len(buffer)))

        for b in batches:
            for s, n_pieces, data in zip(*(b.column(i).to_pylist() for i in range(3))):
                if s != shard:
                    if shard is not None:
                        close()
                    shard = s
                    held = min(per_shard, n - s * per_shard)
                    buffer = bytearray(np.full(held * length, eos, dtype="<u2").tobytes())
                data = expand.decompress(data)
                at = 16 * n_pieces
                for byte, size in np.frombuffer(data, dtype="<i8", count=2 * n_pieces).reshape(-1, 2).tolist():
                    buffer[byte : byte + size] = data[at : at + size]
                    at += size
        if shard is not None:
            close()
        cols = list(zip(*done)) if done else [[], [], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())],
            names=["shard", "file", "sequences", "bytes"],
        )

    shards = max(1, -(-n // per_shard))
    tasks = min(shards, MOST_TASKS)
    pieces = rows.select("part", "at", "ids").mapInArrow(cut, "shard long, n long, pieces binary")
    ranged = pieces.repartitionById(tasks, F.floor(F.col("shard") * tasks / shards).cast("int")).sortWithinPartitions("shard")
    return materialise(ranged.mapInArrow(write, MANIFEST), "shard-manifest")


def read_sequences(manifest: DataFrame, key: str, length: int = LENGTH, per_shard: int = PER_SHARD, from_slot: int = 0) -> DataFrame:
    """``slot, number, shard, byte, ids`` of the sequences from ``from_slot`` on; a shard is read from the first byte needed."""
    stride = 2 * length
    total = int(manifest.agg(F.coalesce(F.sum("sequences"), F.lit(0))).first()[0])
    permute = Feistel(max(total, 1), key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                first = max(0, from_slot - r["shard"] * per_shard)
                fs, name = pafs.FileSystem.from_uri(r["file"])
                with fs.open_input_file(name) as f:
                    f.seek(first * stride)
                    for i in range(first, r["sequences"], 1024):
                        m = min(1024, r["sequences"] - i)
                        data = f.read(m * stride)
                        at = np.arange(i, i + m, dtype=np.int64)
                        slot = r["shard"] * per_shard + at
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(slot), pa.array(permute.number(slot)), pa.array(np.full(m, r["shard"])), pa.array(at * stride),
                             pa.array([data[k * stride : (k + 1) * stride] for k in range(m)], pa.binary())],
                            names=["slot", "number", "shard", "byte", "ids"],
                        )

    needed = manifest.filter(F.col("shard") * per_shard + F.col("sequences") > from_slot)
    first, tasks = from_slot // per_shard, max(1, min(-(-total // per_shard) - from_slot // per_shard, MOST_TASKS))
    dealt = needed.repartitionById(tasks, F.pmod(F.col("shard") - first, F.lit(tasks)).cast("int"))  # a shard a task
    return dealt.mapInArrow(run, "slot long, number long, shard long, byte long, ids binary")


def sequence_digests(sequences: DataFrame) -> DataFrame:
    """Sequences with ``n_tokens`` and ``ids_crc32`` instead of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(4).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:4], pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64())],
                names=["slot", "number", "shard", "byte", "n_tokens", "ids_crc32"],
            )

    return sequences.mapInArrow(run, "slot long, number long, shard long, byte long, n_tokens long, ids_crc32 long")


def round_trip(df: DataFrame, path: str, key: str, **how) -> DataFrame:
    """Write shards below the shared folder and read every sequence back."""
    return read_sequences(write_shards(df, path, scratch_path(df.sparkSession, "shards"), key, **how), key)
