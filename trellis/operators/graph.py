"""Graph operators over quads ``(g, s, p, o, o_kind, o_lang)`` (GRF1-GRF6, GRF8-GRF10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis import vocab as V

QUAD_COLUMNS = ("g", "s", "p", "o", "o_kind", "o_lang")


def as_quads(triples: DataFrame, g: str) -> DataFrame:
    return triples.select(F.lit(g).alias("g"), "s", "p", "o", "o_kind", "o_lang")


def assemble_graphs(named: dict[str, DataFrame]) -> DataFrame:
    """Quads of several named graphs, each graph a set (one shuffle for all)."""
    out = None
    for g, triples in named.items():
        q = as_quads(triples, g)
        out = q if out is None else out.unionByName(q)
    return out.distinct()


def first_rows(triples: DataFrame) -> DataFrame:
    """Triples as :func:`assemble_store` takes those of its first graph when they lie in buckets."""
    return triples.select("s", "p", "o", "o_kind", "o_lang", F.lit(1).alias("_bit"))


def assemble_store(named: dict[str, DataFrame], buckets: int | None = None) -> DataFrame:
    """Both views of the store from one shuffle: one row per distinct triple with a
    bit mask of the named graphs holding it (``g_mask``, bit i = i-th name of
    ``named``). Use :func:`store_union` and :func:`store_quads` to read it.

    With ``buckets``, the first graph is a table of :func:`first_rows` in as many buckets by subject: the others are dealt to
    them, and equal triples meet where they lie."""
    names = list(named)
    first = named[names[0]] if buckets else None
    out = None
    for i, (g, triples) in enumerate(named.items()):
        if first is not None and i == 0:
            continue
        t = triples.select("s", "p", "o", "o_kind", "o_lang", F.lit(1 << i).alias("_bit"))
        out = t if out is None else out.unionByName(t)
    if first is not None:
        out = first if out is None else first.unionByName(out.repartition(buckets, "s"))
    agg = out.groupBy("s", "p", "o", "o_kind", "o_lang").agg(F.bit_or("_bit").alias("g_mask"))
    return agg.withMetadata("g_mask", {"graphs": names})


def store_union(store: DataFrame) -> DataFrame:
    """GRF1 on the store: every triple once."""
    return store.select("s", "p", "o", "o_kind", "o_lang")


def store_quads(store: DataFrame) -> DataFrame:
    """The store as quads ``(g, s, p, o, o_kind, o_lang)``."""
    names = store.schema["g_mask"].metadata["graphs"]
    member = F.array(*[F.when(F.col("g_mask").bitwiseAND(F.lit(1 << i)) != 0, F.lit(n)) for i, n in enumerate(names)])
    return store.select(F.explode(F.filter(member, lambda x: x.isNotNull())).alias("g"), "s", "p", "o", "o_kind", "o_lang")


def named_graph(quads: DataFrame, g: str) -> DataFrame:
    """GRF2: a partition filter when quads are stored ``partitionBy("g")``."""
    return quads.where(F.col("g") == g).select("s", "p", "o", "o_kind", "o_lang")


def union_graph(quads: DataFrame) -> DataFrame:
    """GRF1: default graph of every read: all named graphs, duplicates removed."""
    return quads.select("s", "p", "o", "o_kind", "o_lang").distinct()


def distinct_subjects(quads: DataFrame) -> DataFrame:
    """GRF3."""
    return quads.select("s").distinct()


def values_of(quads: DataFrame, predicate: str, name: str = "o") -> DataFrame:
    """GRF8: one row per (subject, value) of one predicate."""
    return quads.where(F.col("p") == predicate).select("s", F.col("o").alias(name)).distinct()


def match(quads: DataFrame, patterns: list[tuple[str, str, str]], optional: list[tuple[str, str, str]] = ()) -> DataFrame:
    """GRF4/GRF5: basic graph pattern. A pattern is ``(?s, predicate IRI, ?o)`` where
    variables start with ``?``; patterns join on shared variable names (each pattern
    must share one with those before it: no cartesian products), OPTIONAL ones
    left-outer."""

    def one(pat):
        sv, pred, ov = pat
        d = quads.where(F.col("p") == pred).select("s", "o").distinct()
        cols = []
        if sv.startswith("?"):
            cols.append(F.col("s").alias(sv[1:]))
        else:
            d = d.where(F.col("s") == sv)
        if ov.startswith("?"):
            cols.append(F.col("o").alias(ov[1:]))
        else:
            d = d.where(F.col("o") == ov)
        return d.select(*cols)

    out = None
    for pat in patterns:
        d = one(pat)
        if out is None:
            out = d
        else:
            keys = [c for c in d.columns if c in out.columns]
            if not keys:
                raise ValueError(f"pattern {pat} shares no variable with the earlier ones")
            out = out.join(d, keys, "inner")
    for pat in optional:
        d = one(pat)
        keys = [c for c in d.columns if c in out.columns]
        out = out.join(d, keys, "left")
    return out


def entity_table(quads: DataFrame, predicates: dict[str, str], required: tuple[str, ...] = ()) -> DataFrame:
    """GRF6: one wide row per subject; multi-valued predicates multiply rows as
    OPTIONAL patterns do. ``predicates`` maps output column -> predicate IRI."""
    req = [n for n in predicates if n in required]
    rows = quads.where(F.col("p").isin(list(predicates.values()))) if req else quads
    # one grouping by subject instead of a join for each predicate; values in structs, as sets leave out plain nulls
    value = lambda pred: F.collect_set(F.when(F.col("p") == pred, F.struct("o")))
    out = rows.where(F.col("s").isNotNull()).groupBy("s").agg(*[value(pred).alias(name) for name, pred in predicates.items()])
    for name in req:
        out = out.where(F.size(name) > 0)
    for name in predicates:  # a subject's values of one predicate at a time
        out = out.withColumn(name, F.explode_outer(name))
    return out.select("s", *[F.col(name)["o"].alias(name) for name in predicates])


def graph_sizes(quads: DataFrame) -> DataFrame:
    """GRF9: triples per named graph."""
    return quads.groupBy("g").agg(F.count(F.lit(1)).alias("n_triples"))


def graph_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """GRF9: per named graph, triples removed and added between two states of the store."""
    keys = ["g", "s", "p", "o", "o_kind", "o_lang"]
    b = before.select(*keys)
    a = after.select(*keys)

    def minus(x, y):  # null-safe on every key (o_lang is usually null)
        yk = y.select(*[F.col(k).alias("_" + k) for k in keys])
        cond = [x[k].eqNullSafe(yk["_" + k]) for k in keys]
        return x.join(yk, cond, "left_anti")

    removed = minus(b, a).groupBy("g").agg(F.count(F.lit(1)).alias("removed"))
    added = minus(a, b).groupBy("g").agg(F.count(F.lit(1)).alias("added"))
    sizes = a.groupBy("g").agg(F.count(F.lit(1)).alias("n_triples"))
    return (sizes.join(removed, "g", "full").join(added, "g", "full")
            .select("g", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_triples", "removed", "added")]))


BUCKETS = 256
_KEYS = ("g", "s", "p", "o", "o_kind", "o_lang")


def write_buckets(quads: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """GRF9: a state of the store in hash buckets of its quads, with a digest of each bucket beside them.

    The digest of a set is its size and the sums of two hashes of its quads: no order, and no sort to make it."""
    rows = quads.select(*_KEYS).distinct().withColumn("h", F.xxhash64(*_KEYS))
    rows = rows.withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
    rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/quads")
    bucket_digests(quads.sparkSession.read.parquet(f"{path}/quads")).write.parquet(f"{path}/digests")


def bucket_digests(rows: DataFrame) -> DataFrame:
    """``bucket, n, a, b`` of bucketed quads."""
    second = F.xxhash64(F.lit(1), *[F.coalesce(c, F.lit("")) for c in _KEYS]).cast("decimal(38,0)")
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("a"), F.sum(second).alias("b"))


def changed_buckets(spark: SparkSession, before: str, after: str) -> list[int]:
    """Buckets whose digests differ between two written states (one row a bucket reaches the driver)."""
    b = spark.read.parquet(f"{before}/digests").select("bucket", F.struct("n", "a", "b").alias("x"))
    a = spark.read.parquet(f"{after}/digests").select("bucket", F.struct("n", "a", "b").alias("y"))
    return sorted(r["bucket"] for r in b.join(a, "bucket", "full").where(~F.col("x").eqNullSafe(F.col("y"))).select("bucket").collect())


def bucket_delta(spark: SparkSession, before: str, after: str) -> DataFrame:
    """GRF9: quads removed and added (``change``) between two written states. Only buckets with other digests are read."""
    changed = changed_buckets(spark, before, after)
    read = lambda path: spark.read.parquet(f"{path}/quads").where(F.col("bucket").isin(changed))

    def minus(x, y, change):
        yk = y.select("bucket", "h", *[F.col(k).alias(f"_{k}") for k in _KEYS])
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in _KEYS]
        cond = (x["bucket"] == yk["bucket"]) & (x["h"] == yk["h"])
        for c in same:
            cond = cond & c
        return x.join(yk, cond, "left_anti").select(F.lit(change).alias("change"), *_KEYS)

    return minus(read(before), read(after), "removed").unionByName(minus(read(after), read(before), "added"))


def run_selects(spark: SparkSession, quads: DataFrame, selects: dict[str, str], views: dict[str, DataFrame] = None) -> dict[str, DataFrame]:
    """GRF10: user SELECTs (Spark SQL) over the union graph and extra views."""
    union_graph(quads).createOrReplaceTempView("quads")
    for name, df in (views or {}).items():
        df.createOrReplaceTempView(name)
    return {name: spark.sql(sql) for name, sql in selects.items()}
