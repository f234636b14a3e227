"""MAP1-MAP8, GRF1-GRF9, INF1-INF5."""

from pyspark.sql import functions as F

from trellis import vocab as V
from trellis.operators import graph, inference
from trellis.operators.closure import transitive_closure
from trellis.operators.mapping import ENTITY_RULES, map_entities, map_to_triples

NS = V.NS


def _pairs(df):
    return {(r["desc"], r["anc"], r["depth"]) for r in df.collect()}


def test_mapping_cases(spark):
    pages = spark.createDataFrame(
        [("p1", "Ada L", "", "Pump guide", None, ["a", "b"]),
         ("p1", "Ada L", "", "Pump guide", None, ["a", "b"])],
        "_id string, author string, ancestor string, title string, link string, content array<string>")
    t = map_to_triples(pages, ENTITY_RULES["pages"]).distinct()
    got = {(r["p"], r["o"]) for r in t.collect()}
    assert (V.AUTHOR, NS + "Ada%20L") in got            # blank in a name template
    assert not any(p == V.ANCESTOR for p, _ in got)      # empty ancestor -> no triple (M1)
    assert not any(p == V.LINK for p, _ in got)          # null source -> no triple (MAP5)
    assert {o for p, o in got if p == V.CONTENT} == {"a", "b"}  # array -> one triple each (MAP6)
    assert (V.RDF_TYPE, NS + "Page") in got and (V.REFLEXIVE, NS + "p1") in got
    assert t.count() == len(got)                         # duplicates removed (set semantics)


def test_missing_label_is_skipped(spark):
    users = spark.createDataFrame([("Ada",)], "name string")
    t = map_entities({"users": users})
    assert t.where(F.col("p") == V.RDF_TYPE).first()["o"] == NS + "Person"


def test_closure_cycle_self_edge_and_depth(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "c"), ("d", "a")], "child string, parent string")
    got = _pairs(transitive_closure(e))
    assert ("a", "a", 2) in got and ("b", "b", 2) in got   # a node on a cycle reaches itself
    assert ("c", "c", 1) in got
    assert ("d", "b", 2) in got and ("d", "a", 1) in got
    assert len(got) == 7


def test_closure_long_chain_both_strategies(spark):
    n = 150
    e = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(n)], "child string, parent string")
    plain = _pairs(transitive_closure(e))
    doubled = _pairs(transitive_closure(e, doubling=True))
    assert len(plain) == n * (n + 1) // 2
    assert plain == doubled
    assert ("n0", f"n{n}", n) in plain


def test_class_closure_and_type_inference(spark):
    onto = inference.ontology_frames(spark)
    clo = inference.class_closure(onto["class_edges"])
    types = spark.createDataFrame([("x", NS + "Page"), ("y", NS + "Person")], "s string, cls string")
    got = {(r["s"], r["cls"]) for r in inference.infer_types(types, clo).collect()}
    assert got == {("x", NS + "Page"), ("x", NS + "ConfluenceContent"), ("y", NS + "Person")}


def test_rdfs_rules(spark):
    t = spark.createDataFrame([("a", NS + "sub", "b", "iri", None), ("a", NS + "name", "A", "literal", None)],
                              "s string, p string, o string, o_kind string, o_lang string")
    ax = spark.createDataFrame([(NS + "sub", "subPropertyOf", NS + "super"), (NS + "super", "domain", NS + "Thing"),
                                (NS + "super", "range", NS + "Other"), (NS + "name", "range", NS + "Lit")],
                               "p string, kind string, arg string")
    got = {(r["s"], r["p"], r["o"]) for r in inference.rdfs_rules(t, ax).collect()}
    assert ("a", NS + "super", "b") in got
    assert ("a", V.RDF_TYPE, NS + "Thing") in got and ("b", V.RDF_TYPE, NS + "Other") in got
    assert not any(o == NS + "Lit" for _, _, o in got)   # range of a literal adds nothing


def test_property_axioms(spark):
    t = spark.createDataFrame([("a", NS + "next", "b", "iri", None), ("b", NS + "next", "c", "iri", None),
                               ("a", NS + "knows", "b", "iri", None), ("a", V.RDF_TYPE, NS + "Page", "iri", None)],
                              "s string, p string, o string, o_kind string, o_lang string")
    ax = spark.createDataFrame([(NS + "next", "transitive", None), (NS + "knows", "symmetric", None),
                                (NS + "next", "inverseOf", NS + "prev"), (NS + "Page", "equivalentClass", NS + "Doc")],
                               "p string, kind string, arg string")
    got = {(r["s"], r["p"], r["o"]) for r in inference.property_axioms(t, ax).collect()}
    assert ("a", NS + "next", "c") in got
    assert ("b", NS + "knows", "a") in got
    assert ("b", NS + "prev", "a") in got
    assert ("a", V.RDF_TYPE, NS + "Doc") in got


def test_reference_expansion(spark):
    onto = inference.ontology_frames(spark)
    clo = inference.class_closure(onto["class_edges"])
    refs = spark.createDataFrame([("doc", "p1")], "s string, o string")
    types = spark.createDataFrame([("p1", NS + "Page")], "s string, cls string")
    got = {r["o"] for r in inference.expand_references(refs, types, clo).collect()}
    assert got == {"p1", NS + "Page", NS + "ConfluenceContent"}


def test_graph_ops(spark):
    t1 = spark.createDataFrame([("a", V.TITLE, "A", "literal", None), ("a", V.LINK, "l", "literal", None)],
                               "s string, p string, o string, o_kind string, o_lang string")
    t2 = spark.createDataFrame([("a", V.TITLE, "A", "literal", None), ("a", V.TITLE, "A2", "literal", None)],
                               "s string, p string, o string, o_kind string, o_lang string")
    q = graph.assemble_graphs({"knowledge": t1, "content": t2})
    assert q.count() == 4
    assert graph.union_graph(q).count() == 3
    assert graph.named_graph(q, "content").count() == 2
    assert graph.distinct_subjects(q).count() == 1
    assert {(r["g"], r["n_triples"]) for r in graph.graph_sizes(q).collect()} == {("knowledge", 2), ("content", 2)}
    star = graph.entity_table(graph.union_graph(q), {"link": V.LINK, "title": V.TITLE}, required=("link",))
    assert star.count() == 2  # two titles multiply rows, as OPTIONAL does
    m = graph.match(graph.union_graph(q), [("?s", V.LINK, "?l")], optional=[("?s", V.TITLE, "?t")])
    assert m.count() == 2


def test_store_views_and_delta(spark):
    t1 = spark.createDataFrame([("a", V.TITLE, "A", "literal", None), ("b", V.TITLE, "B", "literal", None)],
                               "s string, p string, o string, o_kind string, o_lang string")
    t2 = spark.createDataFrame([("a", V.TITLE, "A", "literal", None)], "s string, p string, o string, o_kind string, o_lang string")
    store = graph.assemble_store({"knowledge": t1, "content": t2})
    assert graph.store_union(store).count() == 2
    quads = graph.store_quads(store)
    assert {(r["g"], r["s"]) for r in quads.collect()} == {("knowledge", "a"), ("knowledge", "b"), ("content", "a")}
    after = quads.where("s = 'a'").unionByName(spark.createDataFrame(
        [("content", "c", V.TITLE, "C", "literal", None)], "g string, s string, p string, o string, o_kind string, o_lang string"))
    d = {r["g"]: (r["n_triples"], r["removed"], r["added"]) for r in graph.graph_delta(quads, after).collect()}
    assert d == {"knowledge": (1, 1, 0), "content": (2, 0, 1)}


def test_closure_functional_graph_ending_in_a_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "c"), ("x", "a")], "child string, parent string")
    got = _pairs(transitive_closure(e))
    want = {("a", "b", 1), ("a", "c", 2), ("a", "d", 3), ("b", "c", 1), ("b", "d", 2), ("c", "d", 1), ("d", "c", 1),
            ("c", "c", 2), ("d", "d", 2), ("x", "a", 1), ("x", "b", 2), ("x", "c", 3), ("x", "d", 4)}
    assert got == want
