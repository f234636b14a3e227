"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups (rows with equal texts) sorted by size enter the bin with the least remaining
capacity that still holds them. The order of groups of one size does not matter to the bins'
levels, so the packing runs over (size, number of groups): the tightest bin stays the
tightest until it is full, and takes its groups of one size in one step. The remaining
capacities are kept in a balanced tree. Which group goes where follows from the group's number
in the order of sizes, which Spark computes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import join_counted, materialise, numbered, text_or_empty

#: Sizes are told apart by so many leading bits and rounded up beyond them, so at most
#: 2 ** (SIZE_BITS - 1) sizes a power of two reach the driver; those below 2 ** SIZE_BITS are exact.
SIZE_BITS = 16


class Capacities:
    """Remaining capacities of bins as a treap: a search tree by (remaining, bin) that hashed priorities keep balanced."""

    def __init__(self) -> None:
        self.root = None

    @staticmethod
    def _split(node, key):
        """Trees of the keys below ``key`` and of the others."""
        if node is None:
            return None, None
        if node[0] < key:
            low, high = Capacities._split(node[3], key)
            return (node[0], node[1], node[2], low), high
        low, high = Capacities._split(node[2], key)
        return low, (node[0], node[1], high, node[3])

    @staticmethod
    def _merge(low, high):
        if low is None or high is None:
            return low or high
        if low[1] > high[1]:
            return low[0], low[1], low[2], Capacities._merge(low[3], high)
        return high[0], high[1], Capacities._merge(low, high[2]), high[3]

    def add(self, remaining: int, number: int) -> None:
        low, high = self._split(self.root, (remaining, number))
        priority = hashlib.blake2b(str(number).encode(), digest_size=8).digest()
        self.root = self._merge(self._merge(low, ((remaining, number), priority, None, None)), high)

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove the tightest bin that still holds ``least`` (of equals the first): (remaining, bin)."""
        node, found = self.root, None
        while node is not None:
            if node[0][0] >= least:
                found, node = node[0], node[2]
            else:
                node = node[3]
        if found is not None:
            low, rest = self._split(self.root, found)
            self.root = self._merge(low, self._split(rest, (found[0], found[1] + 1))[1])
        return found


Runs = list[tuple[int, int, int]]


def best_fit_decreasing(classes: list[tuple[int, int]], capacity: int, opened: int = 0) -> tuple[Runs, int]:
    """Bins of ``capacity`` for ``classes`` of (size over 0, number of items).

    Returns runs (size, number of items, bin) by falling size, and the number of bins. New bins are numbered from
    ``opened``. An item over ``capacity`` gets a bin of its own.
    """
    bins, runs = Capacities(), []
    for size, count in sorted(classes, reverse=True):
        while count:
            left, number = bins.take(size) or (max(capacity, size), opened)
            opened += number == opened
            n = min(count, left // size)
            runs.append((size, n, number))
            bins.add(left - n * size, number)
            count -= n
    return runs, opened


def near_equal(classes: list[tuple[int, int]], shards: int) -> Runs:
    """Runs that fill ``shards`` bins as evenly as the items allow.

    An item over the mean of what is left gets a bin of its own; for the others the least capacity is searched with which
    best fit needs no more bins than there are.
    """
    own: Runs = []
    rest = sorted(classes)
    total = sum(s * n for s, n in rest)
    while rest and len(own) < shards - 1 and rest[-1][0] * (shards - len(own)) > total:
        size, count = rest.pop()
        own.append((size, 1, len(own)))
        total -= size
        if count > 1:
            rest.append((size, count - 1))
    if not rest:
        return own
    bins = shards - len(own)
    low = max(-(-total // bins), rest[-1][0])
    high = low + rest[-1][0]  # a bin is left behind only with less room than the item that did not fit
    best = None
    while low < high or best is None:
        middle = (low + high) // 2
        runs, n = best_fit_decreasing(rest, middle, len(own))
        if n <= shards:
            best, high = runs, middle
        elif low >= high:
            low, high = high, 2 * high
        else:
            low = middle + 1
    return own + best


def _size_class(size: Column) -> Column:
    """Size, rounded up to ``SIZE_BITS`` leading bits."""
    drop = F.greatest(F.length(F.bin(size)) - SIZE_BITS, F.lit(0))
    return F.when(size < 1 << SIZE_BITS, size).otherwise(
        F.call_function("shiftleft", F.call_function("shiftright", size + F.call_function("shiftleft", F.lit(1).cast("long"), drop) - 1, drop), drop)
    )


def _placed(groups: DataFrame, runs: Runs) -> DataFrame:
    """``shard`` of each group by its number in the order of sizes (``rank``)."""
    ends = np.cumsum([n for _, n, _ in runs])
    bins = np.array([b for _, _, b in runs], dtype=np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank = b.column(2).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bins[np.searchsorted(ends, rank, side="right")])], names=["text_sha", "n", "shard"])

    return groups.select("text_sha", "n", "rank").mapInArrow(run, "text_sha binary, n long, shard int")


def _rows(df: DataFrame, text_col: str, *more: Column) -> DataFrame:
    text = text_or_empty(text_col)
    return df.select(*more, (F.octet_length(text).cast("long") + 1).alias("size"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("text_sha"))


def _group_shards(rows: DataFrame, shards: int, capacity: int | None) -> DataFrame:
    """``text_sha, n, shard``: of every different text its SHA-256, its number of rows, and its shard."""
    groups = rows.groupBy("text_sha").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    groups = numbered(groups.select("text_sha", "n", (-_size_class(F.col("size"))).alias("falling")), "falling", "text_sha", label="groups")
    classes = [(-r["falling"], r["count"]) for r in groups.groupBy("falling").count().collect()]
    runs = best_fit_decreasing(classes, capacity)[0] if capacity is not None else near_equal(classes, shards)
    return materialise(_placed(groups, runs), "group-shards")


def assign(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", shards: int = 8, capacity: int | None = None) -> DataFrame:
    """``id_col, size, text_crc32, shard, slot`` of every row of ``df``; ``slot`` counts from 0 in each shard, by id.

    With ``capacity`` (bytes) as few shards of that size as best fit needs, else ``shards`` shards as even as the groups
    allow. A row's size is its text's UTF-8 bytes and one more. Rows with equal texts are a group and share a shard; a
    group over the capacity, or over an even share, has a shard of its own. Null text is an empty text; null ids come first;
    repeated rows get a slot each, in any order; an empty table gives no rows; no other column is read, so names
    cannot clash.
    """
    crc = F.crc32(text_or_empty(text_col).cast("binary")).alias("text_crc32")
    rows = materialise(_rows(df, text_col, F.col(id_col).alias("id"), crc), "sized-rows")
    placed = join_counted(rows, _group_shards(rows, shards, capacity), "text_sha", "n", rows.count())
    ranked = numbered(placed.select("shard", "id", "text_crc32", "size"), "shard", "id", "text_crc32", label="shard-rows")
    first = ranked.groupBy("shard").agg(F.min("rank").alias("first"))
    out = ranked.join(F.broadcast(first), "shard")  # a row a shard
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("rank") - F.col("first")).alias("slot"))


def write_shards(df: DataFrame, folder: str, text_col: str = "text", shards: int = 8, capacity: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet below ``folder``, a folder ``shard=<n>`` for each shard; returns the written table.

    All columns of ``df`` are kept (it must not have one named ``shard``); the cases are those of ``assign``.
    """
    keyed = df.withColumn("__sha", F.unhex(F.sha2(text_or_empty(text_col).cast("binary"), 256)))
    rows = materialise(_rows(df, text_col), "sized-rows")
    groups = _group_shards(rows, shards, capacity).withColumnsRenamed({"text_sha": "__sha", "n": "__n"})
    placed = join_counted(keyed, groups, "__sha", "__n", rows.count()).select("shard", *df.columns)
    placed.write.partitionBy("shard").parquet(folder)
    return df.sparkSession.read.parquet(folder)
