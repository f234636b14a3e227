"""Bulk HTML jobs (EXT1-EXT6, PRS4/PRS5): Arrow-batched ``mapInArrow`` passes.

The parse runs per row inside executor tasks; Spark partitions the work. Only the
needed columns enter the Python worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellis.functions import html as H
from trellis.session import broadcast_if_small, cut_lineage, ship_package


def _schema_of(df: DataFrame, cols) -> list[T.StructField]:
    return [df.schema[c] for c in cols]


#: Characters (bytes) of HTML that are parsed together: what a worker holds besides the Arrow batch itself.
TOGETHER = 4 << 20


def _dealt(df: DataFrame) -> DataFrame:
    """The rows over as many tasks as the session has shuffle partitions: parsing takes far longer than reading, and a small
    file with very many rows is read by one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def _slices(batches: Iterator[pa.RecordBatch], col: str) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Parts of Arrow batches that hold about ``TOGETHER`` bytes of ``col`` (one row at least), with its values."""
    for whole in batches:
        i = whole.schema.get_field_index(col)
        step = max(1, TOGETHER * len(whole) // max(1, whole.column(i).nbytes))
        for at in range(0, len(whole), step):
            part = whole.slice(at, step)
            yield part, part.column(i).to_pylist()


def _with_parsed(df: DataFrame, col: str, fields: list[T.StructField], types: list[pa.DataType], parsed: Callable) -> DataFrame:
    """``df`` with ``fields`` appended: ``parsed`` gives their values for one HTML text; null ones stay null."""
    names = [*df.columns, *(f.name for f in fields)]

    def run(batches):
        for b, texts in _slices(batches, col):
            found = [parsed(h) if h is not None else (None,) * len(types) for h in texts]
            new = [pa.array([x[i] for x in found], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=names)

    ship_package(df.sparkSession)
    return _dealt(df).mapInArrow(run, T.StructType([*df.schema.fields, *fields]))


def html_text(df: DataFrame, col: str, out: str = "text") -> DataFrame:
    """EXT1/PRS5: visible text of an HTML column, appended as ``out``."""
    return _with_parsed(df, col, [T.StructField(out, T.StringType())], [pa.string()], lambda h: (H.visible_text(h),))


def html_blocks(df: DataFrame, col: str, out: str = "blocks") -> DataFrame:
    """PRS4: ``ARRAY<STRING>`` of block texts (p, h1..h6) per row."""
    return _with_parsed(df, col, [T.StructField(out, T.ArrayType(T.StringType()))], [pa.list_(pa.string())], lambda h: (H.text_blocks(h),))


def html_text_and_blocks(df: DataFrame, col: str, text_out: str = "text", blocks_out: str = "blocks") -> DataFrame:
    """EXT1 + PRS4 in one parse per row: visible text and block texts."""

    def parsed(h):
        root = H.parse(h)
        return root.text(), H.blocks_of(root)

    fields = [T.StructField(text_out, T.StringType()), T.StructField(blocks_out, T.ArrayType(T.StringType()))]
    return _with_parsed(df, col, fields, [pa.string(), pa.list_(pa.string())], parsed)


CELL_FIELDS = [
    T.StructField("table_no", T.IntegerType()),
    T.StructField("row_no", T.IntegerType()),
    T.StructField("col_no", T.IntegerType()),
    T.StructField("header", T.StringType()),
    T.StructField("value", T.StringType()),
]


def html_tables(df: DataFrame, col: str, keys: list[str]) -> DataFrame:
    """EXT2-EXT4 in long form: one row per body cell,
    ``keys + (table_no, row_no, col_no, header, value)``."""
    schema = T.StructType(_schema_of(df, keys) + CELL_FIELDS)
    names = [f.name for f in schema.fields]

    def run(batches):
        for b, texts in _slices(batches, col):
            of, cells = [], []
            for i, h in enumerate(texts):
                if h is not None:
                    found = list(H.tables(h))
                    of.extend([i] * len(found))
                    cells.extend(found)
            of = pa.array(of, pa.int64())
            new = [pa.array([c[j] for c in cells], pa.int32() if j < 3 else pa.string()) for j in range(len(CELL_FIELDS))]
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(of) for k in range(len(keys))), *new], names=names)

    ship_package(df.sparkSession)
    return _dealt(df.select(*keys, col)).mapInArrow(run, schema)


def table_rows(cells: DataFrame, keys: list[str]) -> DataFrame:
    """EXT4: one ``MAP<header, value>`` per body row."""
    return cells.groupBy(*keys, "table_no", "row_no").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("header", "value")))).alias("row"))


def number_results(df: DataFrame, query_col: str, order_cols: list[str]) -> DataFrame:
    """EXT5: results numbered 1..n per query over an explicit order; nulls come first, equal rows follow in any order.

    The rows are written once with an id of their own. The keys and ids are range partitioned and
    numbered inside their partition; the counts of the partitions before it (one row per query and
    partition) are added, and the other columns are joined back by id, so no task sorts a whole
    result set."""
    keys = [query_col, *order_cols]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()))
    ranged = cut_lineage(rows.select(*keys, "_row").repartitionByRange(n, *keys, "_row").withColumn("_part", F.spark_partition_id()))
    before = F.sum("_n").over(Window.partitionBy(query_col).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = (ranged.groupBy(query_col, "_part").agg(F.count(F.lit(1)).alias("_n"))
               .select(F.col(query_col).alias("_query"), F.col("_part").alias("_of"), F.coalesce(before, F.lit(0)).alias("_before")))
    inside = F.row_number().over(Window.partitionBy(query_col, "_part").orderBy(*order_cols, "_row"))
    same = F.col(query_col).eqNullSafe(F.col("_query")) & (F.col("_part") == F.col("_of"))
    numbered = ranged.withColumn("_inside", inside).join(broadcast_if_small(offsets), same)
    numbered = numbered.select("_row", (F.col("_before") + F.col("_inside")).alias("result_no"))
    return rows.join(numbered, "_row").select(*keys, *[c for c in df.columns if c not in keys], "result_no")


def bindings_map(df: DataFrame, cols: list[str]) -> DataFrame:
    """EXT6: a result row as a name -> string map, unbound variables omitted."""
    m = F.map_from_arrays(F.array(*[F.lit(c) for c in cols]), F.array(*[F.col(c).cast("string") for c in cols]))
    return df.withColumn("bindings", F.map_filter(m, lambda k, v: v.isNotNull()))
