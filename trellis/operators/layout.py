"""A stored graph laid out by graph and predicate, with statistics and characteristic sets (GRF2, GRF4-GRF6).

Quads lie in a folder for each graph and, inside, for each frequent predicate; rare predicates
share folders by hash, so their number stays bounded. A read of one graph or one predicate is a
partition filter. Beside them stand the counts of every predicate and the characteristic set of
every subject, the set of predicates it has: how many subjects answer a star of patterns is known
without reading a triple, and the star itself is one scan of its predicates' folders and one grouping by subject
instead of a join for each pattern.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.operators import graph
from trellis.session import broadcast_if_small, cut_lineage, stored

#: Predicates with folders of their own, the most frequent; folders that all others share.
OWN_FOLDERS, SHARED_FOLDERS = 200, 56
_TRIPLE = ("s", "p", "o", "o_kind", "o_lang")


@dataclass
class Store:
    """``quads`` (with ``g`` and ``folder``), ``predicates`` (p, folder, n, n_subjects, n_objects; of the union graph), ``sets`` (set_id,
    predicates, n_subjects) and ``members`` (s, set_id)."""

    quads: DataFrame
    predicates: DataFrame
    sets: DataFrame
    members: DataFrame

    def folders(self, predicates: list[str]) -> dict[str, int]:
        """Folder of each predicate; one that the store does not hold has none."""
        return {r["p"]: r["folder"] for r in self.predicates.where(F.col("p").isin(predicates)).select("p", "folder").collect()}

    def named_graph(self, g: str) -> DataFrame:
        """GRF2: one graph, by a partition filter."""
        return self.quads.where(F.col("g") == g).select(*_TRIPLE)

    def _rows(self, predicates: list[str]) -> DataFrame:
        """Quads with these predicates, from their folders alone."""
        folders = sorted(set(self.folders(predicates).values()))
        return self.quads.where(F.col("folder").isin(folders) & F.col("p").isin(predicates))

    def with_predicates(self, predicates: list[str]) -> DataFrame:
        """Triples of the union graph with these predicates, from their folders alone."""
        return self._rows(predicates).select(*_TRIPLE).distinct()

    def values_of(self, predicate: str, name: str = "o") -> DataFrame:
        """GRF8."""
        return graph.values_of(self.with_predicates([predicate]), predicate, name)

    def match(self, patterns: list[tuple[str, str, str]], optional: list[tuple[str, str, str]] = ()) -> DataFrame:
        """GRF4, GRF5: :func:`trellis.operators.graph.match` over the folders of the patterns' predicates, patterns in the order of
        :meth:`ordered`."""
        wanted = [p for _, p, _ in [*patterns, *optional]]
        return graph.match(self.with_predicates(wanted), self.ordered(patterns), list(optional))

    def ordered(self, patterns: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
        """The pattern with the fewest rows to expect first, then always the smallest that shares a variable with those before. A fixed
        subject or object divides a predicate's rows by the number of its different ones."""
        stats = {r["p"]: r for r in self.predicates.where(F.col("p").isin([p for _, p, _ in patterns])).collect()}

        def expected(pattern):
            s, p, o = pattern
            if p not in stats:
                return 0.0
            n = stats[p]["n"]
            return n / (1 if s.startswith("?") else stats[p]["n_subjects"]) / (1 if o.startswith("?") else stats[p]["n_objects"])

        left, out, known = sorted(patterns, key=lambda x: (expected(x), patterns.index(x))), [], set()
        while left:
            near = [x for x in left if not known or known & {v for v in (x[0], x[2]) if v.startswith("?")}]
            pick = (near or left)[0]
            left.remove(pick)
            out.append(pick)
            known |= {v for v in (pick[0], pick[2]) if v.startswith("?")}
        return out

    def star_count(self, predicates: list[str]) -> int:
        """Subjects that have all of the predicates, from the characteristic sets alone."""
        has_all = F.size(F.array_intersect("predicates", F.array(*map(F.lit, predicates)))) == len(set(predicates))
        return int(self.sets.where(has_all).agg(F.coalesce(F.sum("n_subjects"), F.lit(0))).first()[0])

    def star(self, predicates: dict[str, str], required: tuple[str, ...] = ()) -> DataFrame:
        """GRF6: ``s`` and a column for each name -> predicate of subjects that have the ``required`` ones (all if none is named); several
        values multiply rows, a missing one is null. One scan, one grouping by subject; no joins but that with the subjects whose set fits."""
        required = required or tuple(predicates)
        needed = sorted({predicates[n] for n in required})
        fits = F.size(F.array_intersect("predicates", F.array(*map(F.lit, needed)))) == len(needed)
        subjects = self.members.join(broadcast_if_small(self.sets.where(fits).select("set_id")), "set_id", "left_semi").select("s")
        rows = self._rows(list(predicates.values())).select("s", "p", "o").join(subjects, "s", "left_semi")
        # sets: a triple in several graphs, or with several languages, is one value
        out = rows.groupBy("s").agg(*[F.collect_set(F.when(F.col("p") == p, F.col("o"))).alias(n) for n, p in predicates.items()])
        for n in predicates:  # a subject's values of one predicate at a time
            out = out.withColumn(n, F.explode_outer(n))
        return out.select("s", *predicates)


def write_store(quads: DataFrame, path: str, own: int = OWN_FOLDERS, shared: int = SHARED_FOLDERS) -> Store:
    """Write quads (g, s, p, o, o_kind, o_lang; a set) below ``path``, a new folder, and open the store."""
    spark = quads.sparkSession
    # one shuffle of the texts gives each triple once with its graphs; all later steps read what it wrote. It is by predicate and a
    # salt of the subject: a hot predicate's rows are dealt over many tasks, and a task's rows go to few folders
    salt = F.pmod(F.xxhash64("s"), F.lit(8 * int(spark.conf.get("spark.sql.shuffle.partitions", "200")))).alias("salt")
    dealt = quads.select("g", *_TRIPLE, salt).repartition("p", "salt")
    triples = stored(dealt.groupBy(*_TRIPLE, "salt").agg(F.collect_set(F.struct("g")).alias("graphs")).drop("salt"))
    # texts are counted by their digests
    text = F.when(F.length("o") > 64, F.sha2("o", 256)).otherwise(F.col("o"))
    keys = triples.select("s", "p", text.alias("o"))
    counts = keys.groupBy("p").agg(F.count("*").alias("n"), F.count_distinct("s").alias("n_subjects"), F.count_distinct("o").alias("n_objects"))
    counts = cut_lineage(counts)
    frequent = counts.orderBy(F.desc("n"), "p").limit(own).select("p").collect()  # at most ``own`` names
    number = spark.createDataFrame([(r["p"], i) for i, r in enumerate(frequent)], "p string, own int")
    folder = F.coalesce("own", F.pmod(F.xxhash64("p"), F.lit(shared)).cast("int") + own).alias("folder")
    counts.join(F.broadcast(number), "p", "left").select("p", folder, "n", "n_subjects", "n_objects").write.parquet(f"{path}/predicates")
    laid = triples.join(F.broadcast(number), "p", "left").select(F.inline("graphs"), folder, *_TRIPLE)
    laid.sortWithinPartitions("g", "folder", "p", "s").write.partitionBy("g", "folder").option("compression", "zstd").parquet(f"{path}/quads")
    own_sets = triples.select("s", "p").groupBy("s").agg(F.array_sort(F.collect_set("p")).alias("predicates"))  # a subject's predicates, not its triples
    own_sets = stored(own_sets.withColumn("set_id", F.xxhash64("predicates")))
    own_sets.select("s", "set_id").write.parquet(f"{path}/members")
    own_sets.groupBy("set_id", "predicates").agg(F.count("*").alias("n_subjects")).write.parquet(f"{path}/sets")
    return open_store(spark, path)


def open_store(spark: SparkSession, path: str) -> Store:
    r = spark.read
    return Store(r.parquet(f"{path}/quads"), r.parquet(f"{path}/predicates"), r.parquet(f"{path}/sets"), r.parquet(f"{path}/members"))
