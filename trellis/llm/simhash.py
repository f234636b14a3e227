"""SimHash near-duplicates by anchor-point covering.

Two fingerprints of 64 bits link when they differ in at most ``max_bits`` positions.
The positions are dealt into ``blocks`` blocks, so a linked pair differs in at most
``t = max_bits // blocks`` positions of some block. In each block the anchors are the
words of a linear covering code of radius 1 (its check columns run through all nonzero
syndromes): every value has an anchor at distance <= 1, and a value that differs from
it in at most t positions lies within 1 + t of that anchor. Each distinct fingerprint
is replicated to all anchors within 1 + t in every block, so each linked pair meets at
one anchor at least, and only fingerprints that share an anchor are compared.

The comparison at an anchor emits a spanning forest of the links it finds (at most one
link fewer than it has members), never all pairs. Anchors with more than ``hot``
members are split: their members are dealt into buckets, and each pair of buckets is a
group of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import materialise, slices, texts_of
from trellis.llm.components import connected_components

SEED = 42
SHINGLE = 4
MAX_BITS = 4
BLOCKS = 3
HOT = 4096


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a text as a signed integer; 0 for a text without words."""
    # bytes.lower and bytes.split know ASCII only: A-Z, and blank with \t \n \v \f \r
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest, n = xxhash.xxh64_intdigest, max(1, len(words) - shingle + 1)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    h = np.fromiter((digest(s, SEED) for s in shingles), dtype="<u8", count=n)
    votes = np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        part = h[i : i + 65536]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * votes > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` (long) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            fp = [fingerprint(t, shingle) for t in texts_of(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, fp long"
    )


def block_bounds(blocks: int = BLOCKS) -> list[tuple[int, int]]:
    """(first bit, width) of each block."""
    cuts = [round(i * 64 / blocks) for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def covering_columns(width: int) -> np.ndarray:
    """Check columns of the code: all nonzero syndromes of the largest r with 2^r - 1 <= width, over again for the rest."""
    r = (width + 1).bit_length() - 1
    return np.array([1 + i % (2**r - 1) for i in range(width)], dtype=np.uint64)


def patterns(width: int, radius: int) -> list[np.ndarray]:
    """For each syndrome the error patterns of weight <= radius that have it: value ^ pattern is an anchor."""
    columns = covering_columns(width)
    found: dict[int, list[int]] = {}
    layer = {(0, 0, -1)}  # (pattern, syndrome, highest position)
    everything = set(layer)
    for _ in range(radius):
        layer = {(p | 1 << i, s ^ int(columns[i]), i) for p, s, top in layer for i in range(top + 1, width)}
        everything |= layer
    for p, s, _ in everything:
        found.setdefault(s, []).append(p)
    r = int(columns.max()).bit_length()
    return [np.array(sorted(found[s]), dtype=np.uint64) for s in range(2**r)]


def anchors(values: np.ndarray, width: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All anchors within ``radius`` of each value: (index of the value, anchor)."""
    syndrome = np.zeros(len(values), np.uint64)
    for i, c in enumerate(covering_columns(width)):
        syndrome ^= ((values >> np.uint64(i)) & np.uint64(1)) * c
    table = patterns(width, radius)
    rows, out = [], []
    for s, errors in enumerate(table):
        at = np.flatnonzero(syndrome == s)
        rows.append(np.repeat(at, len(errors)))
        out.append((values[at][:, None] ^ errors[None, :]).ravel())
    return np.concatenate(rows), np.concatenate(out)


def replicate(prints: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS) -> DataFrame:
    """``anchor, fp``: each fingerprint once per anchor near it (the block's number sits above the anchor's bits)."""
    if 64 // blocks > 40:
        raise ValueError("two blocks at least")
    t = max_bits // blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 8192):
                fp = b.column(0).slice(i, 8192).to_numpy(zero_copy_only=False)
                for k, (first, width) in enumerate(block_bounds(blocks)):
                    part = (fp.view(np.uint64) >> np.uint64(first)) & np.uint64((1 << width) - 1)
                    at, anchor = anchors(part, width, 1 + t)
                    anchor = anchor | np.uint64(k << 40)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(fp[at])], names=["anchor", "fp"])

    return prints.select("fp").mapInArrow(run, "anchor long, fp long")


def forest(members: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links among ``members``: breadth first, each member compared to those not yet reached."""
    left, src, dst = members.view(np.uint64), [], []  # bitwise_count of a signed integer counts its absolute value
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= max_bits
            if near.any():
                hit = left[near]
                left = left[~near]
                queue.extend(hit)
                src.append(np.full(len(hit), x).view(np.int64))
                dst.append(hit.view(np.int64))
    none = np.empty(0, np.int64)
    return (np.concatenate(src), np.concatenate(dst)) if src else (none, none)


def _forests(group: np.ndarray, fp: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Spanning forests of the groups of a run sorted by ``group``; groups without a link are told apart at once."""
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(group)])))
    size_of = np.repeat(sizes, sizes)
    few = (size_of > 1) & (size_of <= 32)
    bits = fp.view(np.uint64)
    g, f, linked = group[few], bits[few], []
    for off in range(1, 32):
        if len(g) <= off:
            break
        linked.append(g[off:][(g[off:] == g[:-off]) & (np.bitwise_count(f[off:] ^ f[:-off]) <= max_bits)])
    linked = set(np.concatenate(linked).tolist()) if linked else set()
    for a, n in zip(starts.tolist(), sizes.tolist()):
        if n <= 32 and group[a] not in linked:
            continue
        f = bits[a : a + n]
        if 32 < n <= 1024 and np.count_nonzero(np.bitwise_count(f[:, None] ^ f[None, :]) <= max_bits) == n:
            continue
        yield forest(fp[a : a + n], max_bits)


def links(placed: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``src, dst``: links that connect, within each (anchor, part), all that the links there connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = np.empty((0, 2), np.int64)
        fps = np.empty(0, np.int64)

        def emit(group: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
            ids = np.cumsum(np.concatenate(([0], (group[1:] != group[:-1]).any(axis=1))))
            for s, d in _forests(ids, f, max_bits):
                if len(s):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(s, d)), pa.array(np.maximum(s, d))], names=["src", "dst"])

        for b in batches:
            key = np.concatenate((key, np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)])))
            fps = np.concatenate((fps, b.column(2).to_numpy(zero_copy_only=False)))
            if not len(key):
                continue
            # the last group may go on in the next batch
            end = int((key != key[-1]).any(axis=1).sum())
            if end:
                yield from emit(key[:end], fps[:end])
                key, fps = key[end:], fps[end:]
        if len(key):
            yield from emit(key, fps)

    return (
        placed.select("anchor", F.col("part").cast("long"), "fp")
        .repartition("anchor", "part")
        .sortWithinPartitions("anchor", "part")
        .mapInArrow(run, "src long, dst long")
        .distinct()
    )


def split_hot(replicas: DataFrame, hot: int = HOT) -> DataFrame:
    """``anchor, part, fp``. An anchor with over ``hot`` members becomes one part per pair of buckets, so
    that every two members still meet and no part holds much more than 2 * ``hot``."""
    sizes = replicas.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > hot)
    sizes = materialise(sizes.withColumn("buckets", F.ceil(F.col("n") / hot).cast("int")).select("anchor", "buckets"), "hot-anchors")
    if sizes.isEmpty():
        return replicas.withColumn("part", F.lit(0))
    bucket = F.pmod(F.xxhash64("fp"), F.col("buckets"))
    pair = lambda i: F.least(bucket, i) * F.col("buckets") + F.greatest(bucket, i)
    parts = F.when(F.col("buckets").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.sequence(F.lit(0).cast("long"), F.coalesce("buckets", F.lit(1)).cast("long") - 1), pair)
    )
    return replicas.join(sizes, "anchor", "left").select("anchor", F.explode(parts).alias("part"), "fp")


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
    max_bits: int = MAX_BITS, blocks: int = BLOCKS, hot: int = HOT,
) -> DataFrame:
    """``doc_id, fp, component_id`` per row: the smallest id that links reach.

    Null text is an empty text; texts without words have fingerprint 0 and link like any
    other; repeated rows share a component; null ids never name a component unless it has
    no other id; an empty table gives no rows; other columns are ignored.
    """
    prints = materialise(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    replicas = materialise(replicate(distinct, max_bits, blocks), "replicas")
    edges = materialise(links(split_hot(replicas, hot), max_bits), "links")
    groups = connected_components(edges)  # node, root
    linked = distinct.join(groups, distinct.fp == groups.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    heads = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = linked.join(heads, "root").select("fp", "component_id")
    return prints.join(labels, "fp").select("doc_id", "fp", "component_id")


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``df`` with one document of each component: that of the smallest id. Rows that share an id stay together
    if one of them stays."""
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    groups = near_duplicates(df, id_col, text_col, **how).groupBy("doc_id").agg(F.bool_or(stays).alias("any"))
    dropped = groups.filter("not any").select(F.col("doc_id").alias("__dropped"))
    return df.join(dropped, F.col(id_col).eqNullSafe(F.col("__dropped")), "left_anti")
