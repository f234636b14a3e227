"""A text index kept up to date by immutable segments (IDX3).

An update writes one segment: postings of the entries that are new, marks of those that are
gone, and signed counts (documents, tokens, document frequencies) of both. Nothing written
before is touched. A numbered manifest (:mod:`trellis.sources.versions`) names the segments of a state, so readers see
whole updates only. Opening adds the counts up and leaves marked entries out; weights follow from the merged counts, so the
result is that of indexing the whole graph again. :func:`merge` writes one segment of what is live.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis import vocab as V
from trellis.functions.text import tokens
from trellis.operators.index import TextIndex, entry_parts, index_entries, term_counts, weigh
from trellis.session import stored
from trellis.sources import versions

def _folders(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    n, named = versions.latest(spark, path)
    return n, [f"{path}/data/{named[k]}" for k in sorted(named)]


def _union(spark: SparkSession, folders: list[str], part: str) -> DataFrame:
    return spark.read.parquet(*[f"{f}/{part}" for f in folders])


def _live(spark: SparkSession, folders: list[str], part: str) -> DataFrame:
    """Rows of a part whose entries no later segment marks as gone. A segment's number rides with its rows: an entry that went
    and came back lives in the later segment."""
    rows, marks = None, None
    for i, f in enumerate(folders):
        r = spark.read.parquet(f"{f}/{part}").withColumn("_at", F.lit(i))
        m = spark.read.parquet(f"{f}/gone").withColumn("_gone", F.lit(i))
        rows, marks = (r, m) if rows is None else (rows.unionByName(r), marks.unionByName(m))
    last = marks.groupBy("entry_id", "s").agg(F.max("_gone").alias("_gone"))
    return rows.join(last, ["entry_id", "s"], "left").where(F.col("_gone").isNull() | (F.col("_at") >= F.col("_gone"))).drop("_at", "_gone")


def _write(spark: SparkSession, path: str, base: int, added: DataFrame, gone: DataFrame, gone_postings: DataFrame, gone_entries: DataFrame, replace: bool = False) -> int:
    """Write a segment and the manifest that names it; ``replace``: it alone."""
    folder = uuid.uuid4().hex
    at = f"{path}/data/{folder}"
    added.write.parquet(f"{at}/entries")
    added = spark.read.parquet(f"{at}/entries")
    term_counts(added, entry_parts(added)).write.parquet(f"{at}/postings")
    gone.select("entry_id", "s").write.parquet(f"{at}/gone")
    postings = spark.read.parquet(f"{at}/postings")
    sign = lambda df, n: df.select("field", "term", F.lit(n).cast("long").alias("n"))
    df = sign(postings, 1).unionByName(sign(gone_postings, -1)).groupBy("field", "term").agg(F.sum("n").alias("df")).where("df <> 0")
    df.write.parquet(f"{at}/df")
    length = F.size(tokens(F.col("value"))).cast("long")
    size = lambda e, n: e.select("field", F.lit(n).cast("long").alias("n_docs"), (length * n).alias("n_tokens"))
    stats = size(added, 1).unionByName(size(gone_entries, -1)).groupBy("field").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    stats.write.parquet(f"{at}/stats")
    named = {} if replace else (versions._manifest(spark, path, base) if base else {})
    n = max(versions.numbers(spark, path), default=0) + 1
    if versions.latest(spark, path)[0] != base or not versions._create(spark, path, n, named | {f"{n:012d}": folder}):
        raise versions.Conflict(f"the index was updated since version {base}")
    return n


def update(spark: SparkSession, path: str, graph: DataFrame, fields: dict[str, str] | None = None) -> int:
    """Bring the index at ``path`` to the state of ``graph``; returns the version. Only entries that came or went are tokenised and
    written; whole entries of both states are compared by id and subject. Nothing changed: no new version."""
    base, folders = _folders(spark, path)
    entries = index_entries(graph, fields)
    if not folders:
        none = entries.where(F.lit(False))
        return _write(spark, path, 0, entries, none, none.select("field", F.col("value").alias("term")), none)
    live = _live(spark, folders, "entries")
    added = stored(entries.join(live.select("entry_id", "s"), ["entry_id", "s"], "left_anti"))
    gone = stored(live.join(entries.select("entry_id", "s"), ["entry_id", "s"], "left_anti"))
    if added.isEmpty() and gone.isEmpty():
        return base
    gone_postings = _live(spark, folders, "postings").join(gone.select("entry_id", "s"), ["entry_id", "s"], "left_semi")
    return _write(spark, path, base, added, gone, gone_postings, gone)


def merge(spark: SparkSession, path: str) -> int:
    """One segment of all live entries instead of many."""
    base, folders = _folders(spark, path)
    live = stored(_live(spark, folders, "entries"))
    none = live.where(F.lit(False))
    return _write(spark, path, base, live, none, none.select("field", F.col("value").alias("term")), none, replace=True)


def open_index(spark: SparkSession, path: str, k1: float = V.BM25_K1, b: float = V.BM25_B) -> TextIndex:
    """The newest state as the tables that searches read."""
    _, folders = _folders(spark, path)
    if not folders:
        raise ValueError(f"no index at {path}")
    entries, postings = _live(spark, folders, "entries"), _live(spark, folders, "postings")
    term_df = _union(spark, folders, "df").groupBy("field", "term").agg(F.sum("df").alias("df")).where("df > 0")
    stats = _union(spark, folders, "stats").groupBy("field").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs > 0")
    stats = stats.select("field", "n_docs", (F.col("n_tokens") / F.col("n_docs")).alias("avg_dl"))
    return TextIndex(entries, weigh(postings, term_df, stats, k1, b), term_df, stats, k1, b)
