"""trellis: knowledge-graph build and batch search on PySpark.

Typical use::

    from trellis import build, search_build, present, searches
    b = build(spark, "/data/landed-or-tables")          # store, closure, types, index (once)
    res = search_build(b, searches(spark, ["pump seal", "invoice"]))
    present(res).show()
"""

from pyspark.sql import DataFrame, SparkSession

from trellis.operators.present import present
from trellis.operators.search import page, result_counts, search, search_build
from trellis.plans.build import build, build_cached, open_store, persist_build


def searches(spark: SparkSession, texts: list[str]) -> DataFrame:
    """A batch of keyword searches from user input: ``(query_id, text)``."""
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "query_id string, text string")


__all__ = ["build", "build_cached", "open_store", "persist_build", "search", "search_build", "page", "result_counts",
           "present", "searches"]
