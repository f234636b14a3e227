"""The knowledge-graph build as one set of lazy plans, with actions only where a
fixpoint needs them (closure rounds) or a broadcast needs a measured size.

``build(spark, sf_dir)`` -> :class:`KnowledgeBuild`, whose parts past the store are made when first read: quads (four named graphs),
the ancestor closure, inferred types, the entity view used by search, and the text
index. ``persist_build`` writes all of it once (quads ``partitionBy("g")``), so later
searches read tables instead of recomputing them.
"""

from __future__ import annotations

import json
from functools import cache
from types import FunctionType

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis import vocab as V
from trellis.functions.iri import local_name
from trellis.operators import enrich, graph, inference, mapping
from trellis.operators.closure import transitive_closure
from trellis.operators.index import TextIndex, build_index, materialise_index
from trellis.plans import fixtures
from trellis.session import broadcast_if_small, bucket_count, bucketed, cut_lineage, laid, stored


class KnowledgeBuild:
    """The parts of a build. ``contents`` is (s, content_id, content): the entity view carries only ids; ``graph`` is the union graph
    with inferred triples (what searches see); ``buckets`` is in how many buckets by subject its tables lie (None: they do not).

    A part may be given as a function without arguments: it is made when it is first read, and kept, so that who counts
    triples waits for no closure or index."""

    quads: DataFrame
    closure: DataFrame
    types: DataFrame
    entities: DataFrame
    references: DataFrame
    index: TextIndex
    contents: DataFrame
    graph: DataFrame
    buckets: int | None

    def __init__(self, quads, closure, types, entities, references, index, contents=None, graph=None, buckets=None):
        self._parts = {"quads": quads, "closure": closure, "types": types, "entities": entities, "references": references,
                       "index": index, "contents": contents, "graph": graph, "buckets": buckets}

    def __getattr__(self, name: str):
        parts = self.__dict__.get("_parts", {})
        if name not in parts:
            raise AttributeError(name)
        part = parts[name]
        self.__dict__[name] = part() if isinstance(part, FunctionType) else part
        return self.__dict__[name]


def ancestor_edges(g: DataFrame) -> DataFrame:
    return g.where(F.col("p") == V.ANCESTOR).select(F.col("s").alias("child"), F.col("o").alias("parent"))


def content_dictionary(g: DataFrame) -> DataFrame:
    """``s, content_id, content``: every subject's contents with their ids. Searches group and shuffle ids instead of long texts and
    join the text back once per output row; the id is half a SHA-256, so equal ids mean equal texts. Texts stay where their
    subject lies."""
    return g.where((F.col("p") == V.CONTENT) & F.col("o").isNotNull()).select("s", content_id(F.col("o")).alias("content_id"), F.col("o").alias("content")).distinct()


def content_id(text):
    return F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16)


def entity_view(g: DataFrame, closure: DataFrame, types: DataFrame, contents: DataFrame | None = None, buckets: int | None = None) -> DataFrame:
    """Per node: link (required), optional single-valued properties (multi-valued
    ones multiply rows, as OPTIONAL does), type local names (required, inferred
    included), and (depth, title, link) of the transitive ancestors that have both.
    With a content dictionary, contents are ids. ``buckets``: the graph and the types lie by subject in so many."""
    values = g
    if contents is not None:  # ids instead of texts
        values = g.withColumn("o", F.when(F.col("p") == V.CONTENT, F.hex(content_id(F.col("o")))).otherwise(F.col("o")))
    props = graph.entity_table(
        values,
        {"link": V.LINK, "title": V.TITLE, "content": V.CONTENT, "email": V.EMAIL,
         "creationTime": V.CREATION_TIME, "lastUpdateTime": V.LAST_UPDATE_TIME},
        required=("link",),
    )
    tnames = types.groupBy("s").agg(F.collect_set(local_name(F.col("cls"))).alias("types_arr"))
    a_title = graph.values_of(g, V.TITLE, "a_title")
    a_link = graph.values_of(g, V.LINK, "a_link")
    # ancestors are usually far fewer than the pairs: then their titles come to the pairs
    named = a_title.join(a_link, "s").withColumnRenamed("s", "anc").join(closure.select("anc").distinct(), "anc", "left_semi")
    pairs = closure.select(F.col("desc").alias("s"), "anc", "depth").join(broadcast_if_small(stored(named)), "anc").drop("anc")
    anc = (
        (pairs.repartition(buckets, "s") if buckets else pairs)
        .groupBy("s")
        .agg(F.collect_set(F.struct("depth", F.col("a_title").alias("title"), F.col("a_link").alias("link"))).alias("ancestors"))
    )
    empty = F.array().cast("array<struct<depth:int,title:string,link:string>>")
    if contents is not None:
        props = props.withColumn("content_id", F.unhex("content")).drop("content")
    content_col = "content_id" if contents is not None else "content"
    return (
        props.join(tnames, "s")
        .join(anc, "s", "left")
        .select("s", "link", "title", content_col, "email", "creationTime", "lastUpdateTime", "types_arr",
                F.coalesce("ancestors", empty).alias("ancestors"))
    )


def knowledge_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.map_entities(fixtures.entity_frames(spark, sf_dir))


def knowledge_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`knowledge_triples` without duplicates."""
    return mapping.map_entities_set(fixtures.entity_frames(spark, sf_dir))


def _axioms_can_add(axioms: DataFrame) -> tuple[bool, bool]:
    """Both checks below in one small job over the (ontology-sized) axiom table."""
    rdfs = (F.col("kind").isin("subPropertyOf", "domain")
            | ((F.col("kind") == "range") & ~F.col("arg").startswith("http://www.w3.org/2001/XMLSchema#")))
    owl = F.col("kind").isin("inverseOf", "symmetric", "transitive", "equivalentProperty", "equivalentClass")
    row = axioms.agg(F.max(rdfs.cast("int")).alias("r"), F.max(owl.cast("int")).alias("o")).first()
    return bool(row["r"]), bool(row["o"])


def build(spark: SparkSession, sf_dir: str, **how) -> KnowledgeBuild:
    """:func:`build_graph` over the driver tables (entities and terms of ``plans/fixtures.py``)."""
    return build_graph(spark, fixtures.entity_frames(spark, sf_dir), fixtures.term_frame(spark, sf_dir), **how)


def build_graph(spark: SparkSession, entities: dict[str, DataFrame], terms: DataFrame, mention_strategy: str = "auto",
                index_fields: dict[str, str] | None = None, expand_references: bool = False,
                ontology: dict[str, DataFrame] | None = None) -> KnowledgeBuild:
    """The build from any source. ``entities``: unified frames by label (as ``plans.raw.unified``
    gives, scalars); ``terms``: ``(s, title)`` of the content graph.

    ``ontology``: frames from :func:`trellis.sources.ontology.read_ontology` (class
    edges, labels, property axioms); the built-in ontology when omitted.
    ``expand_references`` (INF5, opt-in): an artifact referencing an instance of a
    class also references that class and its superclasses, so class labels score it."""
    # mapped once: both mention linking and the store read it
    buckets = bucket_count(list(entities.values()))
    knowledge = bucketed(graph.first_rows(mapping.map_entities_dealt(entities, buckets)), "s", buckets, dealt=True)
    onto = ontology or inference.ontology_frames(spark)
    ontology = inference.ontology_triples(onto)
    content = fixtures.term_triples(terms)
    links = enrich.link_mentions(
        enrich.artifacts_from_graph(knowledge), enrich.terms_from_graph(content), strategy=mention_strategy)
    reference = enrich.mention_triples(links)
    # the store: written once, read by every later step (below the checkpoint folder, so a
    # lost executor never re-runs mapping or mention linking), in buckets by subject like the
    # knowledge triples: what goes by subject later is done where it lies
    store = graph.assemble_store({
        V.GRAPH_KNOWLEDGE: knowledge, V.GRAPH_ONTOLOGY: ontology,
        V.GRAPH_CONTENT: content, V.GRAPH_REFERENCE: reference,
    }, buckets)
    store = bucketed(store, "s", buckets, dealt=True).withMetadata("g_mask", store.schema["g_mask"].metadata)
    quads = graph.store_quads(store)

    @cache
    def added() -> bool:
        return any(_axioms_can_add(onto["prop_axioms"]))

    def union() -> DataFrame:
        g = graph.store_union(store)
        # INF1-INF4 only for ontologies whose rules can add triples (the built-in one has datatype ranges alone)
        return inference.infer_fixpoint(g, onto["prop_axioms"], onto["class_edges"]) if added() else g

    def direct() -> DataFrame:
        return b.graph.where(F.col("p") == V.RDF_TYPE).select("s", F.col("o").alias("cls"))

    @cache
    def classes() -> DataFrame:
        return cut_lineage(inference.class_closure(onto["class_edges"], onto["prop_axioms"]))

    def references() -> DataFrame:
        refs = b.graph.where(F.col("p") == V.REFERENCE).select("s", "o")
        return cut_lineage(inference.expand_references(refs, direct(), classes())) if expand_references else refs

    b = KnowledgeBuild(
        quads, lambda: transitive_closure(ancestor_edges(b.graph)), lambda: laid(inference.infer_types(direct(), classes()), b.buckets, dealt=False),
        lambda: laid(entity_view(b.graph, b.closure, b.types, b.contents, b.buckets), b.buckets), references,
        lambda: materialise_index(build_index(b.graph, index_fields, lying=bool(b.buckets)), b.buckets), lambda: content_dictionary(b.graph), union,
        lambda: None if added() else buckets)
    return b


_BUILDS: dict = {}


def _input_stamp(spark: SparkSession, sf_dir: str) -> tuple:
    """(name, size, mtime) of every input file, through Hadoop's FileSystem (any store)."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return tuple(sorted((st.getPath().getName(), st.getLen(), st.getModificationTime()) for st in fs.listStatus(path)))


FULL_FIELDS = {"title": V.TITLE, "label": V.RDFS_LABEL, "content": V.CONTENT}
_FULL: dict = {}


def full_index(spark: SparkSession, sf_dir: str) -> TextIndex:
    """IDX5: index of title, label and whole content over the cached build, made once."""
    b = build_cached(spark, sf_dir)
    if id(b) not in _FULL:
        _FULL.clear()
        _FULL[id(b)] = (b, materialise_index(build_index(b.graph, FULL_FIELDS, lying=bool(b.buckets)), b.buckets))
    return _FULL[id(b)][1]


def build_cached(spark: SparkSession, sf_dir: str, mention_strategy: str = "auto") -> KnowledgeBuild:
    """The store is built once and searched many times: reuse a build of the same
    application over unchanged inputs (its tables live in the checkpoint folder)."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), mention_strategy, _input_stamp(spark, sf_dir))
    b = _BUILDS.get(key)
    if b is None:
        _BUILDS.clear()  # one build at a time
        b = _BUILDS[key] = build(spark, sf_dir, mention_strategy=mention_strategy)
    return b


def persist_build(b: KnowledgeBuild, path: str) -> KnowledgeBuild:
    """Write every build output once and return a build that reads them back."""
    from trellis.operators.index import read_index, write_index
    spark = b.quads.sparkSession
    b.quads.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("g").parquet(f"{path}/quads")
    b.closure.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{path}/closure")
    b.types.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{path}/types")
    b.entities.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{path}/entities")
    b.references.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{path}/references")
    write_index(b.index, f"{path}/index")
    if b.contents is not None:
        b.contents.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{path}/contents")
    if b.graph is not None:
        b.graph.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{path}/graph")
    r = spark.read
    return KnowledgeBuild(r.parquet(f"{path}/quads"), r.parquet(f"{path}/closure"), r.parquet(f"{path}/types"),
                          r.parquet(f"{path}/entities"), r.parquet(f"{path}/references"),
                          read_index(spark, f"{path}/index", b.index.k1, b.index.b),
                          r.parquet(f"{path}/contents") if b.contents is not None else None,
                          r.parquet(f"{path}/graph") if b.graph is not None else None)


def _stamp_file(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/inputs.json")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _stored_stamp(spark: SparkSession, path: str) -> str | None:
    """What the store at ``path`` was built from; None if there is none or its build did not end."""
    fs, p = _stamp_file(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def open_store(spark: SparkSession, sf_dir: str, path: str, **build_args) -> KnowledgeBuild:
    """IDX3 "built once, skipped if present": read the persisted store at ``path`` when it was built whole from the same
    files (name, size, time of change) with the same arguments, else build from ``sf_dir`` and persist it there.

    The note of the inputs goes before a build and comes after it, so neither a changed input nor a
    broken build is answered from the old store."""
    from trellis.operators.index import read_index
    stamp = json.dumps([_input_stamp(spark, sf_dir), sorted((k, str(v)) for k, v in build_args.items())])
    if _stored_stamp(spark, path) != stamp:
        fs, p = _stamp_file(spark, path)
        fs.delete(p, False)
        persist_build(build(spark, sf_dir, **build_args), path)
        out = fs.create(p, True)
        out.write(bytearray(stamp.encode()))
        out.close()
    r = spark.read
    return KnowledgeBuild(r.parquet(f"{path}/quads"), r.parquet(f"{path}/closure"), r.parquet(f"{path}/types"),
                          r.parquet(f"{path}/entities"), r.parquet(f"{path}/references"),
                          read_index(spark, f"{path}/index"), r.parquet(f"{path}/contents"),
                          r.parquet(f"{path}/graph"))
