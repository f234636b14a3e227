"""Inference as table jobs (INF1-INF5), materialised once per build.

The axiom tables (class edges, property axioms) are ontology-sized: their size is
measured before they are broadcast. Data-sized inputs are always shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis import vocab as V
from trellis.operators.closure import transitive_closure
from trellis.operators.hierarchy import Hierarchy, both_ways
from trellis.session import broadcast_if_small, cut_lineage


def ontology_frames(spark: SparkSession, ns: str = V.NS) -> dict[str, DataFrame]:
    """The built-in ontology as tables (class edges, labels, property axioms)."""
    edges = spark.createDataFrame([(ns + a, ns + b) for a, b in V.CLASS_EDGES], "sub string, sup string")
    labels = spark.createDataFrame([(ns + c, t, l) for c, t, l in V.CLASS_LABELS], "iri string, text string, lang string")
    axioms = spark.createDataFrame([(ns + p, k, a) for p, k, a in V.PROPERTY_AXIOMS], "p string, kind string, arg string")
    return {"class_edges": edges, "labels": labels, "prop_axioms": axioms}


def ontology_triples(frames: dict[str, DataFrame]) -> DataFrame:
    """Ontology graph: subClassOf edges, class labels, class typing."""
    edges = frames["class_edges"].select(
        F.col("sub").alias("s"), F.lit(V.RDFS_SUBCLASS).alias("p"), F.col("sup").alias("o"),
        F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_lang"))
    labels = frames["labels"].select(
        F.col("iri").alias("s"), F.lit(V.RDFS_LABEL).alias("p"), F.col("text").alias("o"),
        F.lit("literal").alias("o_kind"), F.col("lang").alias("o_lang"))
    return edges.unionByName(labels)


def class_hierarchy(class_edges: DataFrame, axioms: DataFrame | None = None) -> Hierarchy:
    """INF1 + INF4: subclass edges and the ``equivalentClass`` axioms as one hierarchy."""
    edges = class_edges.select("sub", "sup")
    if axioms is not None:
        edges = edges.unionByName(both_ways(axioms.where(F.col("kind") == "equivalentClass"), "p", "arg"))
    return Hierarchy(edges)


def class_closure(class_edges: DataFrame, axioms: DataFrame | None = None) -> DataFrame:
    """INF1: (sub, sup), transitive over the class hierarchy, equivalent classes (of ``axioms``) included; classes of
    a circle are also above themselves."""
    return class_hierarchy(class_edges, axioms).pairs()


def infer_types(types: DataFrame, class_clo: DataFrame) -> DataFrame:
    """INF2: ``types(s, cls)`` plus every superclass; a set."""
    supers = broadcast_if_small(class_clo.groupBy("sub").agg(F.collect_set("sup").alias("sups")).withColumnRenamed("sub", "cls"))
    every = F.concat(F.array("cls"), F.coalesce("sups", F.array().cast("array<string>")))
    return types.select("s", "cls").join(supers, "cls", "left").select("s", F.explode(every).alias("cls")).distinct()


def rdfs_rules(triples: DataFrame, axioms: DataFrame) -> DataFrame:
    """INF3: sub-property, domain and range rules to a fixpoint.

    ``axioms(p, kind, arg)`` with kind in subPropertyOf, domain, range. Range of a
    literal adds nothing. Returns the input triples plus inferred ones, a set.
    """
    sub_prop = axioms.where(F.col("kind") == "subPropertyOf").select(F.col("p").alias("_p"), F.col("arg").alias("_sup"))
    sub_prop_clo = transitive_closure(sub_prop, "_p", "_sup").select(F.col("desc").alias("_p"), F.col("anc").alias("_sup"))
    sub_prop_clo = broadcast_if_small(sub_prop_clo)
    dom = broadcast_if_small(axioms.where(F.col("kind") == "domain").select(F.col("p").alias("_p"), F.col("arg").alias("_c")))
    rng = broadcast_if_small(axioms.where(F.col("kind") == "range").select(F.col("p").alias("_p"), F.col("arg").alias("_c")))
    base = triples.select("s", "p", "o", "o_kind", "o_lang")
    lifted = base.join(sub_prop_clo, base["p"] == sub_prop_clo["_p"]).select("s", F.col("_sup").alias("p"), "o", "o_kind", "o_lang")
    all_t = base.unionByName(lifted)
    typed_dom = all_t.join(dom, all_t["p"] == dom["_p"]).select(
        "s", F.lit(V.RDF_TYPE).alias("p"), F.col("_c").alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_lang"))
    typed_rng = all_t.where(F.col("o_kind") == "iri").join(rng, all_t["p"] == rng["_p"]).select(
        F.col("o").alias("s"), F.lit(V.RDF_TYPE).alias("p"), F.col("_c").alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_lang"))
    # sub-property closure is already transitive, so one application reaches the fixpoint
    return all_t.unionByName(typed_dom).unionByName(typed_rng).distinct()


def property_axioms(triples: DataFrame, axioms: DataFrame) -> DataFrame:
    """INF4: inverse, symmetric, transitive properties; equivalent classes/properties.

    ``axioms(p, kind, arg)`` kinds: inverseOf, symmetric, transitive,
    equivalentProperty, equivalentClass. Returns input plus inferred triples.
    """
    base = triples.select("s", "p", "o", "o_kind", "o_lang")
    iri = base.where(F.col("o_kind") == "iri")
    out = base
    inv = axioms.where(F.col("kind") == "inverseOf").select(F.col("p").alias("_a"), F.col("arg").alias("_b"))
    inv = broadcast_if_small(inv.unionByName(inv.select(F.col("_b").alias("_a"), F.col("_a").alias("_b"))))
    out = out.unionByName(iri.join(inv, iri["p"] == inv["_a"]).select(
        F.col("o").alias("s"), F.col("_b").alias("p"), F.col("s").alias("o"), "o_kind", "o_lang"))
    sym = broadcast_if_small(axioms.where(F.col("kind") == "symmetric").select(F.col("p").alias("_a")))
    out = out.unionByName(iri.join(sym, iri["p"] == sym["_a"]).select(
        F.col("o").alias("s"), "p", F.col("s").alias("o"), "o_kind", "o_lang"))
    eqp = axioms.where(F.col("kind") == "equivalentProperty").select(F.col("p").alias("_a"), F.col("arg").alias("_b"))
    eqp = broadcast_if_small(eqp.unionByName(eqp.select(F.col("_b").alias("_a"), F.col("_a").alias("_b"))))
    out = out.unionByName(base.join(eqp, base["p"] == eqp["_a"]).select("s", F.col("_b").alias("p"), "o", "o_kind", "o_lang"))
    eqc = axioms.where(F.col("kind") == "equivalentClass").select(F.col("p").alias("_a"), F.col("arg").alias("_b"))
    eqc = broadcast_if_small(eqc.unionByName(eqc.select(F.col("_b").alias("_a"), F.col("_a").alias("_b"))))
    typed = base.where(F.col("p") == V.RDF_TYPE)
    out = out.unionByName(typed.join(eqc, typed["o"] == eqc["_a"]).select("s", "p", F.col("_b").alias("o"), "o_kind", "o_lang"))
    for row_p in [r["p"] for r in axioms.where(F.col("kind") == "transitive").select("p").distinct().collect()]:
        # the list of transitive properties is ontology-sized; each closure is a distributed job
        edges = iri.where(F.col("p") == row_p).select(F.col("s").alias("child"), F.col("o").alias("parent"))
        clo = transitive_closure(edges)
        out = out.unionByName(clo.select(F.col("desc").alias("s"), F.lit(row_p).alias("p"), F.col("anc").alias("o"),
                                         F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_lang")))
    return out.distinct()


def property_lifts(axioms: DataFrame) -> DataFrame:
    """``p, q, flip, literal``: every property q that a triple of p also holds under, with subject and object exchanged or
    not; those of literal objects, which cannot be subjects, are listed apart.

    Sub-, equivalent, inverse and symmetric properties are edges between properties read forwards ("+") and
    backwards ("-"), for literals as they are ("="); the closure of that graph (ontology-sized) holds every chain of
    such axioms, so one join lifts a triple through all of them."""
    turned = F.create_map(*[F.lit(x) for x in ("+", "-", "-", "+")])
    ax = axioms.select("p", "kind", "arg", F.explode(F.array(*map(F.lit, "+-="))).alias("g"))
    edge = lambda df, a, g, b, h: df.select(F.concat(g, F.col(a)).alias("sub"), F.concat(h, F.col(b)).alias("sup"))
    of = lambda *kinds: ax.where(F.col("kind").isin(*kinds))
    g, back = F.col("g"), turned[F.col("g")]
    edges = (edge(of("subPropertyOf", "equivalentProperty"), "p", g, "arg", g).unionByName(edge(of("equivalentProperty"), "arg", g, "p", g))
             .unionByName(edge(of("inverseOf"), "p", g, "arg", back)).unionByName(edge(of("inverseOf"), "arg", g, "p", back))
             .unionByName(edge(of("symmetric"), "p", g, "p", back)))
    pairs = Hierarchy(edges).pairs().where((F.substring("sub", 1, 1) != "-") & (F.col("sub") != F.col("sup")))
    name = lambda col: F.substring(F.col(col), F.lit(2), F.length(col))
    first = lambda col, c: F.substring(col, 1, 1) == c
    return pairs.select(name("sub").alias("p"), name("sup").alias("q"), first("sup", "-").alias("flip"), first("sub", "=").alias("literal"))


TRIPLE = ("s", "p", "o", "o_kind", "o_lang")


def infer_fixpoint(triples: DataFrame, axioms: DataFrame, class_edges: DataFrame | None = None, rounds: list | None = None) -> DataFrame:
    """INF1-INF4 until nothing is added: sub-, equivalent, inverse, symmetric and transitive properties, domains, ranges,
    subclasses and equivalent classes. Returns the input triples plus inferred ones, a set.

    Semi-naive: a round joins only the triples that the last one added with the axiom tables (whose closures are
    taken once, before) and, under transitive properties, with the edges there are. What it makes is compared with
    the store and written to the checkpoint folder. ``rounds``, if given, gets (triples joined, triples made, triples
    new) of each. Rules only add triples over the nodes and properties there are, so the rounds end."""
    lifts = broadcast_if_small(cut_lineage(property_lifts(axioms)))
    edges = class_edges if class_edges is not None else axioms.select(F.col("p").alias("sub"), F.col("arg").alias("sup")).where(F.lit(False))
    supers = broadcast_if_small(cut_lineage(class_hierarchy(edges, axioms).supers()).withColumnRenamed("sub", "o"))
    of = lambda kind: axioms.where(F.col("kind") == kind)
    ends = of("domain").select("p", F.col("arg").alias("cls"), F.lit(False).alias("at_object")).unionByName(
        of("range").select("p", F.col("arg").alias("cls"), F.lit(True).alias("at_object")))
    ends = broadcast_if_small(cut_lineage(ends.distinct()))
    transitive = cut_lineage(of("transitive").select("p").distinct())
    chains = not transitive.isEmpty()
    transitive = broadcast_if_small(transitive)
    iri = F.col("o_kind") == "iri"
    no_lang = F.lit(None).cast("string").alias("o_lang")

    def derived(new: DataFrame) -> DataFrame:
        """What the axioms make of triples: lifted ones, types of their ends, classes above. One pass, no shuffle."""
        up = new.join(lifts, "p").where(F.col("literal") != iri)
        up = up.select(F.when(F.col("flip"), F.col("o")).otherwise(F.col("s")).alias("s"), F.col("q").alias("p"),
                       F.when(F.col("flip"), F.col("s")).otherwise(F.col("o")).alias("o"), "o_kind", F.when(~F.col("flip"), F.col("o_lang")).alias("o_lang"))
        every = new.unionByName(up)
        typed = every.join(ends, "p").where(~F.col("at_object") | iri).select(
            F.when(F.col("at_object"), F.col("o")).otherwise(F.col("s")).alias("s"), F.lit(V.RDF_TYPE).alias("p"), F.col("cls").alias("o"),
            F.lit("iri").alias("o_kind"), no_lang)
        types = every.unionByName(typed).where(F.col("p") == V.RDF_TYPE)
        above = types.join(supers, "o").select("s", "p", F.explode("sups").alias("o"), "o_kind", "o_lang")
        return up.unionByName(typed).unionByName(above)

    def longer(new: DataFrame, store: DataFrame) -> DataFrame:
        """Chains of two edges of a transitive property with a new edge among them."""
        old = store.where(iri).join(transitive, "p").select("p", "s", "o")
        new = new.where(iri).join(transitive, "p").select("p", "s", "o")
        ahead = new.select("p", "s", F.col("o").alias("m")).join(old.select("p", F.col("s").alias("m"), "o"), ["p", "m"])
        behind = old.select("p", "s", F.col("o").alias("m")).join(new.select("p", F.col("s").alias("m"), "o"), ["p", "m"])
        return ahead.unionByName(behind).select("s", "p", "o", F.lit("iri").alias("o_kind"), no_lang)

    new = cut_lineage(triples.select(*TRIPLE).distinct())
    store = new
    while True:
        made = derived(new)
        if chains:
            made = made.unionByName(longer(new, store))
        made = made.distinct()
        known = store.select(*[F.col(c).alias(f"_{c}") for c in TRIPLE])
        same = (F.col("s") == F.col("_s")) & (F.col("p") == F.col("_p")) & (F.col("o") == F.col("_o")) & (F.col("o_kind") == F.col("_o_kind")) & \
            F.col("o_lang").eqNullSafe(F.col("_o_lang"))
        if rounds is not None:
            made = cut_lineage(made)
            rounds.append((new.count(), made.count()))
        fresh = cut_lineage(made.join(known, same, "left_anti"))
        if rounds is not None:
            rounds[-1] += (fresh.count(),)
        if fresh.isEmpty():
            return store
        store, new = store.unionByName(fresh), fresh


def expand_references(references: DataFrame, types: DataFrame, class_clo: DataFrame) -> DataFrame:
    """INF5 (opt-in): an artifact referencing an instance of class C also references
    C and every superclass of C, so a class label match scores the artifact.

    ``references(s, o)`` -> ``references(s, o)`` plus class nodes.
    """
    t = types.select(F.col("s").alias("_inst"), F.col("cls").alias("_cls"))
    clo = broadcast_if_small(class_clo.select(F.col("sub").alias("_cls"), F.col("sup").alias("_sup")))
    inst = t.unionByName(t.join(clo, "_cls").select("_inst", F.col("_sup").alias("_cls")))
    refs = references.select(F.col("s").alias("_src"), F.col("o").alias("_inst"))
    via = refs.join(inst, "_inst").select(F.col("_src").alias("s"), F.col("_cls").alias("o"))
    return references.select("s", "o").unionByName(via).distinct()
