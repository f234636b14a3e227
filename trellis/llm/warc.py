"""WARC archives: a writer with one gzip member per record and a splittable reader.

Reading does not need an index and does not give a file to one task: files are cut
into byte ranges; each task looks for the gzip magic in its range, checks a candidate
by decoding the member and its WARC header, and owns the records that *start* in its
range (the last one is read on beyond the end).
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import materialise, numbered, scratch_path, slices

# Fixed values of the format.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:x-page:"

ARCHIVE_BYTES = 256 << 20
SPLIT_BYTES = 32 << 20
READ_BYTES = 256 << 10
#: Tasks that read at most; with more byte ranges a task has several.
MOST_TASKS = 100_000

RECORD = "file string, offset long, record_type string, record_id string, target_uri string, refers_to string, " \
    "payload_digest string, payload_bytes long, payload binary"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id, url, payload: bytes, record_type: str, refers_to) -> bytes:
    """One WARC record: a response, or a revisit that keeps the HTTP head and drops the body."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if record_type == "revisit" else http + payload
    head = [
        ("WARC-Type", record_type),
        ("WARC-Record-ID", f"<{ID_PREFIX}{'' if page_id is None else page_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", "sha1:" + sha1_base32(payload)),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        head.append(("WARC-Target-URI", " ".join(url.split())))
    if record_type == "revisit":
        head.append(("WARC-Refers-To", f"<{ID_PREFIX}{'' if refers_to is None else refers_to}>"))
        head.append(("WARC-Profile", PROFILE))
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def _member(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(pages: DataFrame, folder: str, level: int = 3, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives below ``folder`` (any file system that Arrow opens); returns the manifest ``file, bytes, records``.

    ``pages``: page_id, url, html, record_type, refers_to. Each partition writes its own
    archives, starting a new one after ``archive_bytes``. Names hold the task attempt, and
    only files that the manifest lists count, so a repeated or lost task leaves no half archive.
    Null html is an empty payload, a null url or id an empty field; repeated rows give a record each; an
    empty table gives an empty manifest; other columns are ignored.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, name, size, n, done = None, "", 0, 0, []
        for batch in slices(batches, "html"):
            for row in batch.to_pylist():
                if out is None:
                    name = f"part-{ctx.partitionId():06d}-{len(done):04d}-{ctx.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
                    out, size, n = fs.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                data = _member(
                    record_bytes(row["page_id"], row["url"], (row["html"] or "").encode(), row["record_type"], row["refers_to"]),
                    level,
                )
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= archive_bytes:
                    out.close()
                    done.append((name, size, n))
                    out = None
        if out is not None:
            out.close()
            done.append((name, size, n))
        yield pa.RecordBatch.from_arrays(
            [pa.array([f"{folder}/{d[0]}" for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()),
             pa.array([d[2] for d in done], pa.int64())],
            names=["file", "bytes", "records"],
        )

    cols = pages.select(F.col("page_id").cast("long"), "url", "html", "record_type", F.col("refers_to").cast("long"))
    return materialise(cols.mapInArrow(write, "file string, bytes long, records long"), "warc-manifest")


def members(handle, start: int, size: int) -> Iterator[tuple[int, bytes, int]]:
    """Gzip members from ``start`` on as (offset, content, offset after it); ends at the first that
    is damaged or doesn't hold a WARC record."""
    at, position, block = start, start, b""
    while at < size:
        z, parts, length = zlib.decompressobj(31), [], 0
        while not z.eof:
            if not block:
                handle.seek(position)
                block = handle.read(min(READ_BYTES, size - position))
                position += len(block)
                if not block:
                    return
            try:
                parts.append(z.decompress(block))
            except zlib.error:
                return
            block = z.unused_data
            length += len(parts[-1])
            if length >= len(VERSION) and len(parts) == 1 and not parts[0].startswith(b"WARC/"):
                return
        content = b"".join(parts)
        if not content.startswith(b"WARC/"):
            return
        yield at, content, position - len(block)
        at = position - len(block)


def first_member(handle, start: int, end: int, size: int) -> int | None:
    """Offset of the first member that starts in [start, end): the magic, a member that decodes whole
    and holds a WARC record, and after it the magic again or the file's end."""
    for at in range(start, end, READ_BYTES):
        handle.seek(at)
        block = handle.read(min(READ_BYTES, end - at) + len(MAGIC) - 1)
        i = block.find(MAGIC)
        while i >= 0:
            for _, _, after in members(handle, at + i, size):
                handle.seek(after)
                if after == size or handle.read(len(MAGIC)) == MAGIC:
                    return at + i
                break
            i = block.find(MAGIC, i + 1)
    return None


def records_in(handle, start: int, end: int, size: int) -> Iterator[tuple[int, bytes]]:
    """Records that start in [start, end), whole, with their offsets."""
    at = first_member(handle, start, end, size)
    if at is None:
        return
    for offset, content, after in members(handle, at, size):
        if offset >= end:
            return
        yield offset, content
        at = after
    if at < min(end, size):
        raise ValueError(f"damaged member at byte {at}")


def parse_record(data: bytes) -> dict:
    """Fields of one record. Payload: the HTTP body; its length is the HTTP Content-Length."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        fields[k.strip().lower()] = v.strip()
    block = rest[: int(fields.get("content-length", len(rest)))]
    http, _, body = block.partition(b"\r\n\r\n")
    length = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(body))
    name = lambda x: x.strip("<>").removeprefix(ID_PREFIX) if x is not None else None
    return {
        "record_type": fields.get("warc-type"),
        "record_id": name(fields.get("warc-record-id")),
        "target_uri": fields.get("warc-target-uri"),
        "refers_to": name(fields.get("warc-refers-to")),
        "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:"),
        "payload_bytes": length,
        "payload": None if fields.get("warc-type") == "revisit" else body,
    }


def read_archives(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Every record of the archives ``files`` (file, bytes), one row each, read by byte ranges.

    An empty list of files gives no rows; a member that starts as a WARC record but is
    damaged fails the read (it isn't skipped).
    """
    schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()),
                        ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()),
                        ("payload_bytes", pa.int64()), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = pafs.FileSystem.from_uri(row["file"])
                with fs.open_input_file(path) as handle:
                    rows, held = [], 0
                    for at, data in records_in(handle, row["start"], row["end"], row["bytes"]):
                        rows.append({"file": row["file"], "offset": at} | parse_record(data))
                        held += len(data)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    step = F.lit(split_bytes).cast("long")
    ranges = files.filter("bytes > 0").select(
        "file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, step)).alias("start")
    ).withColumn("end", F.least(F.col("start") + step, "bytes"))
    n = files.agg(F.coalesce(F.sum(F.ceil(F.col("bytes") / step)), F.lit(0))).first()[0]
    tasks = max(1, min(int(n), MOST_TASKS))
    dealt = numbered(ranges, "file", "start", label="byte-ranges").repartitionById(tasks, F.pmod("rank", F.lit(tasks)).cast("int"))  # a range a task
    return dealt.drop("rank").mapInArrow(read, RECORD)


def mark_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) with ``record_type`` and ``refers_to``.

    Of pages with equal payloads of at least ``least_bytes`` the smallest page_id is the
    response, the others revisit it. Null html is an empty payload; repeated rows of the
    smallest page_id are all responses; a null page_id revisits any other.
    """
    pages = pages.select("page_id", "url", "html")
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    key = [F.sha1(body).alias("sha"), F.octet_length(body).alias("size"), F.xxhash64(body).alias("xx")]
    marks = materialise(pages.select("page_id", *key).distinct(), "payloads")
    first = marks.groupBy("sha", "size", "xx").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    later = (
        marks.join(first.filter(F.col("n") > 1), ["sha", "size", "xx"])
        .filter((F.col("size") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first")))
        .select(F.col("page_id").alias("__id"), F.col("sha").alias("__sha"), "first")
    )
    return pages.join(later, F.col("page_id").eqNullSafe(F.col("__id")) & (F.sha1(body) == F.col("__sha")), "left").select(
        "page_id", "url", "html",
        F.when(F.col("__sha").isNull(), "response").otherwise("revisit").alias("record_type"),
        F.col("first").alias("refers_to"),
    )


def round_trip(pages: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Write ``pages`` as archives below the shared folder and read them back."""
    files = write_archives(mark_revisits(pages), scratch_path(pages.sparkSession, "warc"))
    return read_archives(files, split_bytes)


def payload_digests(records: DataFrame) -> DataFrame:
    """Per record ``page_id, payload_bytes, payload_digest, record_type, refers_to``; of responses the
    length and digest are computed from the payload that was read."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            num = lambda x: int(x) if x not in (None, "") else None
            whole = [r["payload"] is not None for r in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([num(r["record_id"]) for r in rows], pa.int64()),
                    pa.array([len(r["payload"]) if w else r["payload_bytes"] for r, w in zip(rows, whole)], pa.int64()),
                    pa.array([sha1_base32(r["payload"]) if w else r["payload_digest"] for r, w in zip(rows, whole)], pa.string()),
                    pa.array([r["record_type"] for r in rows], pa.string()),
                    pa.array([num(r["refers_to"]) for r in rows], pa.int64()),
                ],
                names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
            )

    return records.select("record_id", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to").mapInArrow(
        digest, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )
