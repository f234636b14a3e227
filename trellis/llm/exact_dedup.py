"""Exact deduplication by content-defined chunk recipes (DataFrame functions only).

A text is lower-cased (A-Z only) and cut where its content says so: after at least
``MIN_CHUNK`` characters at the next sentence end or line break, at the latest after
``MAX_CHUNK``. Every distinct chunk is moved once, to check that its 64-bit digest
names one chunk only; digests that fail get a second part that tells their chunks
apart. A document is then its recipe, the ordered list of verified identifiers, and
two documents are equal exactly when their recipes are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellis.llm.common import ascii_lower, materialise, text_or_empty

MIN_CHUNK, MAX_CHUNK = 1024, 8192


def chunks(text: Column, smallest: int = MIN_CHUNK, largest: int = MAX_CHUNK) -> Column:
    """Chunks of a text, in order; their concatenation is the text. Empty text: no chunk."""
    return F.regexp_extract_all(
        text, F.lit(rf"(?s).{{{smallest},{largest - 1}}}?[.!?\n]|.{{1,{largest}}}"), 0
    )


def recipes(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = F.xxhash64,
    smallest: int = MIN_CHUNK,
    largest: int = MAX_CHUNK,
) -> DataFrame:
    """One row per input row: ``doc_id``, ``text_sha256`` of the normalised text, ``recipe``.

    ``recipe`` is an array of (digest, ordinal); the ordinal is 0 unless different
    chunks share the digest, and then numbers those chunks.
    """
    norm = df.select(F.col(id_col).alias("doc_id"), ascii_lower(text_or_empty(text_col)).alias("norm"))
    store = materialise(
        norm.select(
            "doc_id",
            F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
            F.transform(
                chunks(F.col("norm"), smallest, largest), lambda c: F.struct(digest(c).alias("digest"), c.alias("chunk"))
            ).alias("chunks"),
        ),
        "chunks",
    )
    parts = store.select(F.explode("chunks").alias("c")).select("c.digest", "c.chunk")
    # every distinct chunk moves once; digests that name two chunks are (almost always) none
    clashes = materialise(
        parts.distinct().groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest"), "clashes"
    )
    if clashes.isEmpty():
        plain = F.transform("chunks", lambda c: F.struct(c["digest"].alias("digest"), F.lit(0).alias("ordinal")))
        return store.select("doc_id", "text_sha256", plain.alias("recipe"))
    per_digest = Window.partitionBy("digest").orderBy("chunk")
    named = materialise(
        parts.join(clashes, "digest", "left_semi").distinct().withColumn("ordinal", F.row_number().over(per_digest)), "named"
    )
    rows = materialise(store.withColumn("row", F.monotonically_increasing_id()), "numbered")
    ids = (
        rows.select("row", F.posexplode("chunks").alias("pos", "c"))
        .select("row", "pos", "c.digest", "c.chunk")
        .join(named, ["digest", "chunk"], "left")
        .groupBy("row")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "digest", F.coalesce("ordinal", F.lit(0)).alias("ordinal")))).alias("ids"))
    )
    recipe = F.transform("ids", lambda x: F.struct(x["digest"].alias("digest"), x["ordinal"].alias("ordinal")))
    none = F.array().cast("array<struct<digest:bigint,ordinal:int>>")
    return (
        rows.select("row", "doc_id", "text_sha256")
        .join(ids, "row", "left")
        .select("doc_id", "text_sha256", F.coalesce(recipe, none).alias("recipe"))
    )


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Per row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``keep_id`` is the largest id among equal texts. Defined cases: a null text is an
    empty text, and all empty texts are equal; a null id never wins over another id;
    repeated rows (same id, same text) count each and stay or go together; an empty
    table gives no rows; other columns are ignored.
    """
    listed = materialise(recipes(df, id_col, text_col, **how), "recipes").withColumn("recipe_hash", F.xxhash64("recipe"))
    groups = listed.groupBy("recipe_hash", "recipe").agg(
        F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")
    )
    return listed.join(groups, ["recipe_hash", "recipe"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` without the rows whose text another row repeats under a larger id. Rows that share an id stay
    together if one of them stays."""
    groups = exact_groups(df, id_col, text_col).groupBy("doc_id").agg(F.bool_or("kept").alias("any"))
    dropped = groups.filter("not any").select(F.col("doc_id").alias("__dropped"))
    return df.join(dropped, F.col(id_col).eqNullSafe(F.col("__dropped")), "left_anti")
