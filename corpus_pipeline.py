"""Corpus pipeline: five training-data operators in a row over ``documents``.

Each stage is written as Parquet below the shared checkpoint folder and read again, so a
lost executor or a failed stage never repeats the stages before it. Every stage but the
last returns the columns of its input.

Every stage reads ``doc_id`` and ``text`` and hands the other columns on, whatever their names.
Null texts count as empty ones: they are not toxic, but fail the base rules of the quality stage.
Rows that share a doc_id stay or go together in the two dedup stages; repeated rows are rows of
their own in the others. A null doc_id is never preferred to another. An empty table goes through
all stages. Columns that start with two underscores are the operators' own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trellis.llm import exact_dedup, packing, quality, simhash, toxicity
from trellis.llm.common import materialise
from trellis.session import ship_package


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays under 0.5."""
    ship_package(spark)
    return toxicity.toxicity_filter(docs, toxicity.train(docs, _labels(spark, sf_dir)))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the decision list learned from the labels of these documents."""
    labels = _labels(spark, sf_dir).select("doc_id", "quality")
    labelled = docs.select("doc_id", "text").join(labels, "doc_id")
    stats = materialise(quality.text_stats(labelled).drop("text"), "labelled-counts")
    return quality.quality_filter(docs, quality.learn(stats))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact_dedup.exact_dedup(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id."""
    ship_package(spark)
    return simhash.near_dedup(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, neighbours on the curve together."""
    import public_tokenizers

    ship_package(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), added_tokens=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("quality_rules", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("packing", packing_stage),
]

# A trained classifier, a learned decision list and XXH64 fingerprints are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
