"""SRC4: ontology classes, labels and property axioms from RDF/XML with Spark's
built-in XML source (``rowTag`` per element kind; attributes arrive as ``_rdf:about``,
``_rdf:resource``, ``_xml:lang``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RES = T.ArrayType(T.StructType([T.StructField("_rdf:resource", T.StringType())]))
_LBL = T.ArrayType(T.StructType([T.StructField("_VALUE", T.StringType()), T.StructField("_xml:lang", T.StringType())]))

CLASS_SCHEMA = T.StructType([
    T.StructField("_rdf:about", T.StringType()),
    T.StructField("rdfs:subClassOf", _RES),
    T.StructField("owl:equivalentClass", _RES),
    T.StructField("rdfs:label", _LBL),
])
PROP_SCHEMA = T.StructType([
    T.StructField("_rdf:about", T.StringType()),
    T.StructField("rdf:type", _RES),
    T.StructField("rdfs:domain", _RES),
    T.StructField("rdfs:range", _RES),
    T.StructField("rdfs:subPropertyOf", _RES),
    T.StructField("owl:inverseOf", _RES),
    T.StructField("owl:equivalentProperty", _RES),
    T.StructField("rdfs:label", _LBL),
])
_KIND_BY_TYPE = {
    "http://www.w3.org/2002/07/owl#SymmetricProperty": "symmetric",
    "http://www.w3.org/2002/07/owl#TransitiveProperty": "transitive",
    "http://www.w3.org/2002/07/owl#FunctionalProperty": "functional",
    "http://www.w3.org/2002/07/owl#AsymmetricProperty": "asymmetric",
    "http://www.w3.org/2002/07/owl#IrreflexiveProperty": "irreflexive",
}


def _read(spark, path, tag, schema):
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def read_ontology(spark: SparkSession, paths: str | list[str]) -> dict[str, DataFrame]:
    """``class_edges(sub, sup)``, ``labels(iri, text, lang)``, ``prop_axioms(p, kind, arg)``."""
    paths = paths if isinstance(paths, list) else [paths]
    classes = _read(spark, paths, "owl:Class", CLASS_SCHEMA)
    edges = classes.select(F.col("`_rdf:about`").alias("sub"), F.explode("`rdfs:subClassOf`").alias("x")).select(
        "sub", F.col("x.`_rdf:resource`").alias("sup")).where(F.col("sup").isNotNull())
    props = None
    for tag in ("owl:ObjectProperty", "owl:DatatypeProperty"):
        d = _read(spark, paths, tag, PROP_SCHEMA)
        props = d if props is None else props.unionByName(d)
    labels = (classes.select(F.col("`_rdf:about`").alias("iri"), "`rdfs:label`")
              .unionByName(props.select(F.col("`_rdf:about`").alias("iri"), "`rdfs:label`"))
              .select("iri", F.explode("`rdfs:label`").alias("l"))
              .select("iri", F.col("l._VALUE").alias("text"), F.col("l.`_xml:lang`").alias("lang")))
    axioms = None
    for col, kind in (("rdfs:domain", "domain"), ("rdfs:range", "range"), ("rdfs:subPropertyOf", "subPropertyOf"),
                      ("owl:inverseOf", "inverseOf"), ("owl:equivalentProperty", "equivalentProperty"),
                      ("owl:equivalentClass", "equivalentClass")):
        a = (classes if kind == "equivalentClass" else props).select(F.col("`_rdf:about`").alias("p"), F.explode(f"`{col}`").alias("x")).select(
            "p", F.lit(kind).alias("kind"), F.col("x.`_rdf:resource`").alias("arg")).where(F.col("arg").isNotNull())
        axioms = a if axioms is None else axioms.unionByName(a)
    type_kind = F.create_map(*[x for k, v in _KIND_BY_TYPE.items() for x in (F.lit(k), F.lit(v))])
    typed = props.select(F.col("`_rdf:about`").alias("p"), F.explode("`rdf:type`").alias("x")).select(
        "p", type_kind[F.col("x.`_rdf:resource`")].alias("kind"), F.lit(None).cast("string").alias("arg")
    ).where(F.col("kind").isNotNull())
    return {"class_edges": edges, "labels": labels, "prop_axioms": axioms.unionByName(typed)}
