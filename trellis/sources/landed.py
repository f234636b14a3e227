"""Landed API responses (SRC1-SRC3).

Layout: one row per response ``(snapshot_date, label, request_id, parent_key,
page_no, ok, body)``; ``body`` is the raw JSON text. Read as JSON lines or parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellis.session import with_once

LANDED_SCHEMA = T.StructType([
    T.StructField("snapshot_date", T.DateType()),
    T.StructField("label", T.StringType()),
    T.StructField("request_id", T.StringType()),
    T.StructField("parent_key", T.StringType()),
    T.StructField("page_no", T.IntegerType()),
    T.StructField("ok", T.BooleanType()),
    T.StructField("body", T.StringType()),
])


def read_raw(spark: SparkSession, path: str, label: str | None = None, fmt: str = "json") -> DataFrame:
    """SRC1: landed responses with ``doc`` = parsed body (bad JSON -> NULL)."""
    reader = spark.read.schema(LANDED_SCHEMA)
    df = reader.json(path) if fmt == "json" else reader.format(fmt).load(path)
    if label is not None:
        df = df.where(F.col("label") == label)
    return parse_bodies(df)


def parse_bodies(df: DataFrame) -> DataFrame:
    return with_once(df, "doc", F.try_parse_json("body"))


def flatten_responses(df: DataFrame) -> DataFrame:
    """SRC2: items of ``results[]``; else of ``value[]``; else the body itself is one item.

    Output ``(snapshot_date, label, request_id, parent_key, page_no, item_no, item)``.
    """
    results = F.try_variant_get("doc", "$.results", "array<variant>")
    value = F.try_variant_get("doc", "$.value", "array<variant>")
    items = F.coalesce(results, value, F.array(F.col("doc")))
    keep = [c for c in ("snapshot_date", "label", "request_id", "parent_key", "page_no") if c in df.columns]
    return (df.where(F.col("doc").isNotNull())
            .select(*keep, F.posexplode(items).alias("item_no", "item")))


def drop_incomplete_chains(df: DataFrame) -> DataFrame:
    """SRC3: a request chain with any failed or unparsable page yields no rows."""
    good = (df.groupBy("request_id")
            .agg(F.bool_and(F.coalesce(F.col("ok") & F.col("doc").isNotNull(), F.lit(False))).alias("_all_ok"))
            .where("_all_ok").select("request_id"))
    return df.join(good, "request_id", "left_semi")


def landed_items(spark: SparkSession, path: str, label: str | None = None, fmt: str = "json") -> DataFrame:
    """SRC1 -> SRC3 -> SRC2 in one plan."""
    return flatten_responses(drop_incomplete_chains(read_raw(spark, path, label, fmt)))
