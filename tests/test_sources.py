"""SRC1-SRC5, SNK1-SNK4, NRM1-NRM12."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from trellis import vocab as V
from trellis.operators import normalize as N
from trellis.sources import landed, ontology, sinks, triples


def _landed_rows():
    return [
        ("2024-03-05", "pages", "r1", "S1", 0, True, json.dumps({"results": [{"id": "p1", "x": {"id": 2}}], "_links": {}})),
        ("2024-03-05", "pages", "r1", "S1", 1, True, json.dumps({"results": [{"id": "p2"}, 5]})),
        ("2024-03-05", "pages", "r2", "S1", 0, True, json.dumps({"results": [{"id": "p3"}]})),
        ("2024-03-05", "pages", "r2", "S1", 1, False, None),                     # failed page -> chain dropped
        ("2024-03-05", "pages", "r3", "S1", 0, True, "{bad json"),               # bad JSON -> chain dropped
        ("2024-03-05", "teams", "r4", None, 0, True, json.dumps({"id": "t1", "@odata.type": "x"})),
        ("2024-03-05", "channels", "r5", "t1", 0, True, json.dumps({"value": [{"id": "c1"}], "@odata.nextLink": None})),
    ]


def test_landed_read_flatten_and_chains(spark):
    d = tempfile.mkdtemp(prefix="trellis-test-")
    path = os.path.join(d, "landed.json")
    with open(path, "w") as f:
        for r in _landed_rows():
            f.write(json.dumps(dict(zip(["snapshot_date", "label", "request_id", "parent_key", "page_no", "ok", "body"], r))) + "\n")
    raw = landed.read_raw(spark, path)
    assert raw.where(F.col("doc").isNull()).count() == 2
    items = landed.flatten_responses(landed.drop_incomplete_chains(raw))
    got = sorted((r["request_id"], r["page_no"], r["item_no"]) for r in items.collect())
    assert got == [("r1", 0, 0), ("r1", 1, 0), ("r1", 1, 1), ("r4", 0, 0), ("r5", 0, 0)]
    clean = N.clean_items(items)
    docs = {r["_json"] for r in clean.collect()}
    assert '{"_id":"p1","x":{"_id":2}}' in docs              # renamed at every depth
    assert '{"_id":"t1","odatatype":"x"}' in docs             # @odata.x -> odatax
    assert clean.count() == 4                                 # the bare 5 is not an object


def _items(spark, label, rows):
    df = spark.createDataFrame([(label, f"r{i}", pk, 0, i, j) for i, (pk, j) in enumerate(rows)],
                               "label string, request_id string, parent_key string, page_no int, item_no int, j string")
    return N.clean_items(df.select("label", "request_id", "parent_key", "page_no", "item_no", F.parse_json("j").alias("item")))


def test_normalize_confluence_chain(spark):
    spaces = N.normalize_spaces(_items(spark, "spaces", [(None, '{"id":1,"key":"S1","_expandable":{"homepage":"/x/home1"}}')]))
    pages = N.normalize_pages(_items(spark, "pages", [
        ("S1", '{"id":"home1","ancestors":[]}'),
        ("S1", '{"id":"p1","ancestors":[{"id":"home1"},{"id":"p0"}],"children":{"comment":{"size":2}}}'),
        ("S1", '{"id":"p2","ancestors":[],"children":{"comment":{"size":0}}}'),
        ("S1", '{"id":"p3"}'),
        ("S9", '{"id":"p4"}'),
    ]), spaces)
    got = {r["_json"]: dict(r["ext"]) for r in pages.collect()}
    assert len(got) == 3                                       # home page dropped, unknown space dropped
    anc = {json.loads(k)["_id"]: v["ancestor"] for k, v in got.items()}
    assert anc == {"p1": "p0", "p2": "", "p3": ""}
    assert all(v["spaceId"] == "home1" for v in got.values())
    comments = N.normalize_comments(_items(spark, "comments", [("p1", '{"id":"c1"}'), ("p2", '{"id":"c2"}')]), pages)
    ext = [dict(r["ext"]) for r in comments.collect()]
    assert ext == [{"pageId": "p1", "spaceId": "home1"}]       # only pages with comments are asked


def test_normalize_users_posts_channels(spark):
    users = N.normalize_users(_items(spark, "users", [
        ("g1", '{"displayName":"A","personalSpace":{"k":1}}'), ("g2", '{"displayName":"A","personalSpace":{"k":1}}'),
        ("g1", '{"displayName":"B"}')]))
    assert users.count() == 1
    posts = N.normalize_posts(_items(spark, "posts", [(None, '{"id":"m1","messageType":"message"}'),
                                                      (None, '{"id":"m2","messageType":"systemEventMessage"}')]))
    assert posts.count() == 1
    teams = _items(spark, "teams", [(None, '{"id":"t1"}')])
    ch = N.normalize_channels(_items(spark, "channels", [("t1", '{"id":"c1"}'), ("t9", '{"id":"c9"}')]), teams)
    assert [dict(r["ext"]) for r in ch.collect()] == [{"teamId": "t1"}]
    cdf = N.retrieval_counts({"users": users, "none": users.where("false")})
    assert {r["label"]: r["n"] for r in cdf.collect()} == {"users": 1, "none": 0}
    assert N.warn_zero_counts(cdf) == ["none"]


def test_triples_ontology_and_sinks(spark):
    d = tempfile.mkdtemp(prefix="trellis-test-")
    nt = os.path.join(d, "g.nt")
    with open(nt, "w") as f:
        f.write('<http://e.org/a> <http://e.org/p> <http://e.org/b> .\n')
        f.write('<http://e.org/a> <http://e.org/t> "Pump \\"x\\" guide"@en .\n')
        f.write('# comment\n')
        f.write('<http://e.org/a> <http://e.org/n> "5"^^<http://www.w3.org/2001/XMLSchema#int> .\n')
        f.write('<http://e.org/a> <http://e.org/u> "caf\\u00E9 \\U0001F600 \\uD83D\\uDE00 b\\\\u0041" .\n')
    t = {(r["s"], r["p"], r["o"], r["o_kind"], r["o_lang"]) for r in triples.read_ntriples(spark, nt).collect()}
    assert ("http://e.org/a", "http://e.org/p", "http://e.org/b", "iri", None) in t
    assert ("http://e.org/a", "http://e.org/t", 'Pump "x" guide', "literal", "en") in t
    assert ("http://e.org/a", "http://e.org/n", "5", "literal", None) in t
    assert ("http://e.org/a", "http://e.org/u", "caf\u00e9 \U0001F600 \U0001F600 b\\u0041", "literal", None) in t

    owl = os.path.join(d, "o.owl")
    with open(owl, "w") as f:
        f.write('<?xml version="1.0"?>\n<rdf:RDF xmlns:owl="http://www.w3.org/2002/07/owl#" '
                'xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#">\n'
                '<owl:Class rdf:about="http://e.org/o#Page"><rdfs:subClassOf rdf:resource="http://e.org/o#Content"/>'
                '<rdfs:label xml:lang="en">Page</rdfs:label><rdfs:label xml:lang="de">Seite</rdfs:label></owl:Class>\n'
                '<owl:Class rdf:about="http://e.org/o#Content"/>\n</rdf:RDF>\n')
    o = ontology.read_ontology(spark, owl)
    assert {(r["sub"], r["sup"]) for r in o["class_edges"].collect()} == {("http://e.org/o#Page", "http://e.org/o#Content")}
    assert {(r["text"], r["lang"]) for r in o["labels"].collect()} == {("Page", "en"), ("Seite", "de")}

    quads = spark.createDataFrame([("knowledge", "a", V.TITLE, "A", "literal", None), ("content", "t", V.TITLE, "T", "literal", None)],
                                  "g string, s string, p string, o string, o_kind string, o_lang string")
    store = os.path.join(d, "quads")
    sinks.write_quads(quads, store)
    new = spark.createDataFrame([("t", V.TITLE, "T2", "literal", None)], "s string, p string, o string, o_kind string, o_lang string")
    sinks.replace_graph(spark, store, new, "content")
    back = {(r["g"], r["o"]) for r in spark.read.parquet(store).collect()}
    assert back == {("knowledge", "A"), ("content", "T2")}                 # other graph untouched (SNK3)

    snap = os.path.join(d, "snap")
    df = spark.createDataFrame([("a",)], "x string")
    sinks.write_snapshot(df, snap, "pages", "2024-03-05")
    sinks.write_snapshot(df.union(df), snap, "pages", "2024-03-05")      # same date replaced (SNK1)
    sinks.write_snapshot(df, snap, "pages", "2024-03-06")
    assert spark.read.parquet(snap).count() == 3
    out = os.path.join(d, "export")
    sinks.export_json({"pages": df}, out)
    assert spark.read.json(os.path.join(out, "pages")).count() == 1
    cells = spark.createDataFrame([("q", 1, 0, 1, "A", "1"), ("q", 1, 0, 1, "B", "")],
                                  "query string, result_no int, table_no int, row_no int, header string, value string")
    binds = spark.createDataFrame([("q", 1, {"s": "node1"}), ("q", 2, {"s": "node2"})],
                                  "query string, result_no int, bindings map<string,string>")
    sinks.write_extraction(cells, os.path.join(d, "ext2"), binds)
    lines = sorted((json.loads(x["value"]) for x in spark.read.text(os.path.join(d, "ext2")).collect()),
                   key=lambda o: sorted(o))
    assert lines[0] == {"query": "q", "Result_1": {"s": "node1", "Table_0": [{"A": "1", "B": ""}]}}
    assert lines[1] == {"query": "q", "Result_2": {"s": "node2"}}
    sinks.write_extraction(cells, os.path.join(d, "ext"))
    got = spark.read.json(os.path.join(d, "ext")).first()
    assert got["query"] == "q" and "Result_1" in got.asDict()


def test_items_are_parsed_once(spark):
    from trellis.session import with_once
    df = spark.createDataFrame([('{"id":1,"x":{"id":"a"}}',), ("[1]",), ('"{"',), ('{"id":1,"_id":2}',), ('{"@odata.k":"@odata.v"}',)], "j string")
    clean = N.clean_items(with_once(df, "item", F.parse_json("j")).select("item"))
    assert sorted(r["_json"] for r in clean.collect()) == ['{"_id":1,"x":{"_id":"a"}}', '{"odatak":"odatav"}']
    plan = clean.select("doc")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") + plan.count("parse_json") == 2, plan  # the test's own, and one more
