"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# A word is a run of characters that are neither blank nor one of \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/llm-{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage like ``checkpoint()`` but stays columnar: later passes read
    only the columns they need, and a lost executor costs no recomputation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("overwrite").option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order: str, label: str) -> DataFrame:
    """``df`` with ``rank``: the rows' numbers from 0 in the order of the columns ``order``.

    Rows are range-partitioned and sorted, written, and each partition's numbers go on from the
    counts of the partitions before it, so no task sees more than its range. Only one count
    a partition reaches the driver. Rows equal in ``order`` are numbered in any order.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialise(ranged.withColumn("__row", F.monotonically_increasing_id()), label)
    counts = rows.groupBy(F.shiftright("__row", 33).alias("__part")).agg(F.count("*").alias("n")).collect()
    before, total = [], 0
    for r in sorted(counts, key=lambda r: r["__part"]):
        before.append((r["__part"], total))
        total += r["n"]
    starts = F.broadcast(spark.createDataFrame(before, "__part long, __before long"))
    place = F.col("__before") + F.col("__row").bitwiseAND((1 << 33) - 1)
    return rows.withColumn("__part", F.shiftright("__row", 33)).join(starts, "__part").withColumn("rank", place).drop("__part", "__row", "__before")


#: A key is hot from so many rows on, or from this share of all rows if that is more; so at most HOT_KEYS keys are hot.
HOT_ROWS = 1024
HOT_KEYS = 4096


def join_counted(left: DataFrame, right: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Inner equi-join of ``left`` to ``right`` on ``key``, where ``right`` has one row a key and holds in ``n`` how
    many of the ``total`` rows of ``left`` have it.

    Rows of hot keys stay where they are and meet a broadcast of at most ``HOT_KEYS`` rows of ``right``; the others
    are shuffled, so no task gets more than a hot key's least number of rows of one key.
    """
    least = max(HOT_ROWS, -(-total // HOT_KEYS))
    hot = F.broadcast(right.filter(F.col(n) >= least))
    cold = left.join(F.broadcast(right.filter(F.col(n) >= least).select(key)), key, "left_anti")
    return left.join(hot, key).unionByName(cold.join(right.filter(F.col(n) < least), key))


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder that no remaining plan reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` where the text is pure ASCII)."""
    return F.when(F.length(col) == F.octet_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, UPPER.lower()))


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """Column of strings with nulls as empty texts."""
    return [t if t is not None else "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], name: str, max_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that the text column of each holds about ``max_bytes`` (one row at least)."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(name))
        if not len(col):
            continue
        per_row = max(1, col.nbytes // len(col))
        step = max(1, max_bytes // per_row)
        for i in range(0, len(col), step):
            yield batch.slice(i, step)
