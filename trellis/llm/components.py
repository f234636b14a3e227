"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import materialise


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to its smallest neighbour (or itself)."""
    both = _both(edges)
    least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
    return both.join(least, "src").filter("dst > src").select(F.col("m").alias("src"), "dst").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.col("dst").alias("node"), F.col("src").alias("low"))  # src < dst
    least = down.groupBy("node").agg(F.min("low").alias("m"))
    moved = down.join(least, "node").filter("low <> m").select(F.col("m").alias("src"), F.col("low").alias("dst"))
    return moved.unionAll(least.select(F.col("m").alias("src"), F.col("node").alias("dst"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (src, dst: long); root is the smallest node of its component.

    Stars are built from minima and joins alone, so no node's neighbours are gathered in
    one place; every round is written to the shared folder. Self links are ignored.
    """
    edges = edges.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    edges = materialise(edges, "edges")
    state = None
    while True:
        edges = materialise(_small_star(_large_star(edges)), "stars")
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    roots = edges.select(F.col("dst").alias("node"), F.col("src").alias("root"))
    return roots.unionAll(edges.select(F.col("src").alias("node"), F.col("src").alias("root")).distinct())
