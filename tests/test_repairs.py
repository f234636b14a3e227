"""Cases the registered queries do not reach: window borders, empty titles, clause-only searches,
rewritten indexes, deep HTML, N-Triples forms, rule chains."""

import random

import pytest
from pyspark.sql import functions as F

from trellis import vocab as V
from trellis.functions import html as H
from trellis.operators import enrich, extract, index, inference, search
from trellis.sources import ontology, triples


def test_links_survive_every_window_border(spark, monkeypatch):
    monkeypatch.setattr(enrich, "CHUNK_CHARS", 8)
    arts = spark.createDataFrame([(f"a{i}", "x" * i + "İİ" + "y" * 9) for i in range(14)], "artifact string, text string")
    terms = spark.createDataFrame([("t", "İİ"), ("u", "İ")], "term string, title string")
    for strategy in ("broadcast", "blocking", "signatures"):
        got = {(r.artifact, r.term) for r in enrich.link_mentions(arts, terms, strategy).collect()}
        assert got == {(f"a{i}", t) for i in range(14) for t in "tu"}, strategy


def test_many_empty_titles_link_everything_in_both_strategies(spark):
    arts = spark.createDataFrame([("a", "one"), ("b", "")], "artifact string, text string")
    terms = spark.range(20000).select(F.col("id").cast("string").alias("term"), F.lit("").alias("title"))
    for strategy in ("broadcast", "blocking", "signatures"):
        assert enrich.link_mentions(arts, terms, strategy).count() == 40000


def _index(spark, rows):
    g = spark.createDataFrame([(s, V.TITLE, t, "literal", None) for s, t in rows], "s string, p string, o string, o_kind string, o_lang string")
    return index.build_index(g)


def test_clause_only_searches(spark):
    idx = _index(spark, [("n1", "pump seal ring"), ("n2", "seal the pump"), ("n3", "valve")])
    q = spark.createDataFrame([("m", "", ["Seal"], [], None), ("p", "", [], [], "pump seal"), ("x", "", ["seal"], ["ring"], None), ("none", "", [], [], None)],
                              "query_id string, text string, must array<string>, must_not array<string>, phrase string")
    got = {(r.query_id, r.s) for r in search.text_match(idx, q).collect()}
    assert got == {("m", "n1"), ("m", "n2"), ("p", "n1"), ("x", "n2")}


def test_rewriting_an_index_replaces_it(spark, tmp_path):
    path = f"file:{tmp_path}/index"
    for mode in ("dynamic", "static"):
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)
        index.write_index(_index(spark, [("old", " ".join(f"w{i}" for i in range(60)))]), path)
        index.write_index(_index(spark, [("new", "pump")]), path)
        assert [(r.s, r.term) for r in index.read_index(spark, path).postings.collect()] == [("new", "pump")]
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")


def test_deep_documents():
    deep = "<div>" * 10000 + "x" + "</div>" * 10000
    assert H.visible_text(deep) == "x" and H.text_blocks("<body>" + deep + "<p> y </p>") == ["y"]
    assert H.visible_text("a \t b<br>c&nbsp;d") == "a b c\xa0d"


def test_ntriples_forms(spark, tmp_path):
    f = tmp_path / "a.nt"
    f.write_text('<a> <b> "c" . # note\n<a><b>"tight".\n# comment\n\n_:x <b> <o> .\n<a> <b> "t\\b\\f\\u00e9"@en-GB .\n')
    got = {(r.s, r.o, r.o_lang) for r in triples.read_ntriples(spark, f"file:{f}").collect()}
    assert got == {("a", "c", None), ("a", "tight", None), ("_:x", "o", None), ("a", "t\b\f\xe9", "en-GB")}
    f.write_text('<a> <b> "c" .\n<a> <b> broken\n')
    with pytest.raises(Exception, match="not a triple"):
        triples.read_ntriples(spark, f"file:{f}").select("p").count()


def test_rules_chain_to_a_fixpoint(spark):
    t = spark.createDataFrame([("1", "P", "2", "iri", None), ("2", "Q", "3", "iri", None), ("3", "R", "4", "iri", None)],
                              "s string, p string, o string, o_kind string, o_lang string")
    axioms = spark.createDataFrame([("P", "transitive", None), ("P", "equivalentProperty", "Q"), ("R", "inverseOf", "P"), ("P", "range", "C")], "p string, kind string, arg string")
    got = {(r.s, r.p, r.o) for r in inference.infer_fixpoint(t, axioms).collect()}
    assert {("1", "P", "3"), ("1", "Q", "3"), ("3", "R", "1"), ("4", "P", "3"), ("3", V.RDF_TYPE, "C")} <= got


def test_results_are_numbered_in_order_without_one_big_sort(spark):
    rng = random.Random(1)
    rows = [(f"q{i % 3}", k, f"c{k}") for i, k in enumerate(rng.sample(range(10000), 500))]
    df = extract.number_results(spark.createDataFrame(rows, "q string, k int, content string"), "q", ["k"])
    assert "SinglePartition" not in df._jdf.queryExecution().toString()
    for q in ("q0", "q1", "q2"):
        want = [k for p, k, _ in sorted(rows) if p == q]
        got = [(r.k, r.content) for r in df.filter(F.col("q") == q).orderBy("result_no").collect()]
        assert got == [(k, f"c{k}") for k in want]
        assert [r.result_no for r in df.filter(F.col("q") == q).orderBy("result_no").collect()] == list(range(1, len(want) + 1))


def test_equivalences_are_read_from_files(spark, tmp_path):
    f = tmp_path / "o.owl"
    f.write_text('<rdf:RDF xmlns:rdf="r" xmlns:owl="o" xmlns:rdfs="s">'
                 '<owl:Class rdf:about="A"><owl:equivalentClass rdf:resource="B"/></owl:Class>'
                 '<owl:ObjectProperty rdf:about="P"><owl:equivalentProperty rdf:resource="Q"/>'
                 '<rdf:type rdf:resource="http://www.w3.org/2002/07/owl#FunctionalProperty"/></owl:ObjectProperty></rdf:RDF>')
    got = {tuple(r) for r in ontology.read_ontology(spark, f"file:{f}")["prop_axioms"].collect()}
    assert got == {("A", "equivalentClass", "B"), ("P", "equivalentProperty", "Q"), ("P", "functional", None)}


def test_triples_of_repeated_subjects_are_a_set(spark):
    """Rows of a subject lie together once, by one shuffle of rows; duplicates within and between them go."""
    from trellis.operators import mapping
    users = spark.createDataFrame([("a", "x@e", "l1"), ("a", "x@e", "l1"), ("a", None, "l2"), ("b", "y@e", None), (None, "z@e", "l"), ("c", "", "l1")],
                                  "name string, email string, link string")
    teams = spark.createDataFrame([("a", ["n", "n", "m"]), ("t", ["n", "n"])], "_id string, name array<string>")
    frames = {"users": users, "teams": teams}
    rules = {k: mapping.ENTITY_RULES[k] for k in frames}
    whole, got = mapping.map_entities(frames, rules), mapping.map_entities_set(frames, rules)
    assert got.columns == whole.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, whole.distinct().collect()))
    assert whole.count() > got.count()


def test_usual_ntriples_lines_read_as_by_the_pattern(spark, tmp_path):
    from trellis.sources import triples
    f = tmp_path / "usual.nt"
    f.write_text('<s> <p> <o> .\n<s> <p> "a > b <c> ." .\n<s> <p> "" .\n<s> <p> <> .\n<s> <p> "q\\"uote" .\n<s> <p> "x" . # "y" .\n'
                 '<s>  <p> "two blanks" .\n<s> <p> "t"^^<d> .\n<s> <p> "l"@en .\n<s> <p> _:b .\n_:a <p> <o> . # c> .\n# <c> <c> <c> .\n\n<s x> <p> " " .\n')
    got = sorted((r.s, r.o, r.o_kind, r.o_lang or "", r.o_dtype or "") for r in triples.read_ntriples(spark, f"file:{f}").collect())
    assert got == sorted([("s", "o", "iri", "", ""), ("s", "a > b <c> .", "literal", "", ""), ("s", "", "literal", "", ""), ("s", "", "literal", "", ""),
                          ("s", 'q"uote', "literal", "", ""), ("s", "x", "literal", "", ""), ("s", "two blanks", "literal", "", ""),
                          ("s", "t", "literal", "", "d"), ("s", "l", "literal", "en", ""), ("s", "_:b", "iri", "", ""), ("_:a", "o", "iri", "", ""),
                          ("s x", " ", "literal", "", "")])
    for bad in ('<s> <p> " .', '<s> <p> "a"b" .', "<s> <p> <a>b> ."):
        f.write_text(bad + "\n")
        with pytest.raises(Exception, match="not a triple"):
            triples.read_ntriples(spark, f"file:{f}").collect()
