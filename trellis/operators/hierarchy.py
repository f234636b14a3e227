"""Class and property hierarchies as one graph: subsumption and equivalence edges together.

Equivalences, and subsumption in a circle, make strongly connected components: all their
members have the same members above and below. Components are found first, the closure
runs on the graph between components alone, and members come back with one join, so a
circle of n names costs n rows instead of n * n on the way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.operators.closure import transitive_closure
from trellis.session import cut_lineage


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges between nodes that can lie on a circle: those of nodes that nothing reaches, or that reach nothing, go
    layer by layer."""
    n = edges.count()
    while n:
        inner = edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
        inner = inner.join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b")
        inner = cut_lineage(inner)
        m = inner.count()
        if m == n:
            break
        edges, n = inner, m
    return edges


def _least_forward(edges: DataFrame) -> DataFrame:
    """``node, color``: the least node that reaches each node (itself included). Only nodes whose color fell pass it on."""
    colors = cut_lineage(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("color", F.col("node")))
    changed = colors
    while True:
        passed = changed.join(edges, F.col("node") == F.col("a")).groupBy(F.col("b").alias("node")).agg(F.min("color").alias("lower"))
        changed = cut_lineage(passed.join(colors, "node").where(F.col("lower") < F.col("color")).select("node", F.col("lower").alias("color")))
        if changed.isEmpty():
            return colors
        colors = cut_lineage(colors.join(changed.withColumnRenamed("color", "lower"), "node", "left")
                             .select("node", F.coalesce("lower", "color").alias("color")))


def _back_to_roots(edges: DataFrame, colors: DataFrame) -> DataFrame:
    """``node, component``: nodes that reach the node of their color, within the color. These are the colors' components."""
    back = edges.join(colors.select(F.col("node").alias("a"), F.col("color").alias("ca")), "a").join(
        colors.select(F.col("node").alias("b"), F.col("color").alias("cb")), "b")
    back = cut_lineage(back.where(F.col("ca") == F.col("cb")).select("a", "b", F.col("ca").alias("component")))
    found = frontier = cut_lineage(colors.where(F.col("node") == F.col("color")).select("node", F.col("color").alias("component")))
    while True:
        new = frontier.select(F.col("node").alias("b")).join(back, "b").select(F.col("a").alias("node"), "component").distinct()
        frontier = cut_lineage(new.join(found, "node", "left_anti"))
        if frontier.isEmpty():
            return found
        found = cut_lineage(found.unionByName(frontier))


def strong_components(edges: DataFrame, src: str = "sub", dst: str = "sup") -> DataFrame:
    """``node, component`` for every node of ``edges``; a component is named by its least node.

    The least node that reaches a node colors it; the nodes of a color that reach its
    namesake are one component; they leave the graph, and the rest is colored again. Nulls and loops are no edges.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    e = cut_lineage(e.distinct())
    nodes = e.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    left, done = _trimmed(cut_lineage(e.where("a <> b"))), None
    while not left.isEmpty():
        found = _back_to_roots(left, _least_forward(left))
        done = found if done is None else done.unionByName(found)
        gone = found.select("node")
        left = left.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b")
        left = _trimmed(cut_lineage(left))
    if done is None:
        return nodes.withColumn("component", F.col("node"))
    return nodes.join(done, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


class Hierarchy:
    """Names in components (``members``: node, component) and the components above each (``above``: component, upper, depth)."""

    def __init__(self, edges: DataFrame, src: str = "sub", dst: str = "sup"):
        e = cut_lineage(edges.select(F.col(src).alias("sub"), F.col(dst).alias("sup")).where("sub IS NOT NULL AND sup IS NOT NULL").distinct())
        self.members = cut_lineage(strong_components(e))
        of = lambda col: self.members.select(F.col("node").alias(col), F.col("component").alias(f"{col}_c"))
        between = e.join(of("sub"), "sub").join(of("sup"), "sup").select(F.col("sub_c").alias("child"), F.col("sup_c").alias("parent"))
        above = transitive_closure(between.where("child <> parent"))
        self.above = above.select(F.col("desc").alias("component"), F.col("anc").alias("upper"), "depth")

    def supers(self) -> DataFrame:
        """``sub, sups``: an array of all names above each name, those of its own component included where it has several."""
        sets = self.members.groupBy("component").agg(F.collect_list("node").alias("nodes"))
        own = sets.select("component", F.when(F.size("nodes") > 1, F.col("nodes")).otherwise(F.array().cast("array<string>")).alias("nodes"))
        upper = self.above.join(sets.withColumnRenamed("component", "upper"), "upper").select("component", "nodes")
        every = own.unionByName(upper).groupBy("component").agg(F.array_sort(F.flatten(F.collect_list("nodes"))).alias("sups"))
        return self.members.join(every, "component").where(F.size("sups") > 0).select(F.col("node").alias("sub"), "sups")

    def pairs(self) -> DataFrame:
        """``sub, sup``: every name with every name above it."""
        return self.supers().select("sub", F.explode("sups").alias("sup"))


def both_ways(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Equivalence pairs as edges in both directions."""
    return pairs.select(F.col(a).alias("sub"), F.col(b).alias("sup")).unionByName(pairs.select(F.col(b).alias("sub"), F.col(a).alias("sup")))
