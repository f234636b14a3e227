"""GRF7 / INF1: one-or-more property path as a fixpoint of joins.

``edges(child, parent)`` -> ``closure(desc, anc, depth)``, set semantics, safe on
cycles (a node on a cycle reaches itself, as ``+`` demands), ``depth`` = the
shortest path length.

Semi-naive rounds first: the new frontier joins the edge table, an anti-join drops
pairs already seen, and writing each round's pairs keeps lineage one round deep (a lost
executor recomputes at most one round). When every node has at most one parent, a
pair can only repeat after some node has reached itself (a cycle), so until such a
pair appears the rounds skip the distinct and the anti-join entirely. Page/comment trees are shallow, so this
usually ends in a few rounds. A chain still growing after ``plain_rounds`` switches
to path doubling (closure joined with itself, minimum depth kept): log2 of the
remaining length in rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.session import cut_lineage, stored

PLAIN_ROUNDS = 8


def _edges(edges: DataFrame, child: str, parent: str) -> DataFrame:
    return (
        edges.select(F.col(child).alias("desc"), F.col(parent).alias("anc"))
        .where(F.col("desc").isNotNull() & F.col("anc").isNotNull())
        .distinct()
    )


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def transitive_closure(edges: DataFrame, child: str = "child", parent: str = "parent", doubling: bool = False,
                       plain_rounds: int = PLAIN_ROUNDS) -> DataFrame:
    base = _edges(edges, child, parent)
    if doubling:
        return _doubling(cut_lineage(base.withColumn("depth", F.lit(1))))
    # hash-partitioned by the join key once; each round then shuffles only its frontier
    step = cut_lineage(base.select(F.col("desc").alias("_mid"), F.col("anc").alias("_next")).repartition("_mid"))
    frontier = stored(base.withColumn("depth", F.lit(1)))
    # at most one parent per node (trees, chains): paths are unique, so a pair can only
    # repeat after some node has reached itself; until then no distinct, no anti-join
    functional = base.groupBy("desc").count().where(F.col("count") > 1).isEmpty()
    looped = functional and not frontier.where(F.col("desc") == F.col("anc")).isEmpty()
    rounds = [frontier]
    seen = frontier
    depth = 1
    while True:
        if depth >= plain_rounds:
            return _doubling(cut_lineage(_union(rounds)))
        depth += 1
        new = frontier.join(step, frontier["anc"] == step["_mid"], "inner").select("desc", F.col("_next").alias("anc"))
        if not functional or looped:
            new = new.distinct().join(seen.select("desc", "anc"), ["desc", "anc"], "left_anti")
        new = stored(new.withColumn("depth", F.lit(depth)))
        # one small job over the checkpoint: is the round empty, did a node reach itself
        st = new.agg(F.count(F.lit(1)).alias("n"), F.max((F.col("desc") == F.col("anc")).cast("int")).alias("loop")).first()
        if st["n"] == 0:
            return _union(rounds)
        if functional and not looped:
            looped = bool(st["loop"])
        rounds.append(new)
        seen = seen.unionByName(new)
        frontier = new


def _doubling(clo: DataFrame) -> DataFrame:
    """C <- min-depth(C U C o C) until no pair is added. Pairs whose shortest path is
    at most twice the longest settled one get their exact depth each round."""
    n = clo.count()
    while True:
        a = clo.select(F.col("desc"), F.col("anc").alias("_mid"), F.col("depth").alias("d1"))
        b = clo.select(F.col("desc").alias("_mid"), F.col("anc"), F.col("depth").alias("d2"))
        pairs = a.join(b, "_mid").select("desc", "anc", (F.col("d1") + F.col("d2")).alias("depth"))
        nxt = cut_lineage(clo.unionByName(pairs).groupBy("desc", "anc").agg(F.min("depth").alias("depth")))
        m = nxt.count()
        if m == n:
            return nxt
        clo, n = nxt, m
