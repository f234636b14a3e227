"""Phrases by position, bucketed deltas, datatypes, table rules, texts parsed once."""

import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from trellis import vocab as V
from trellis.operators import graph, index, mapping, present, search
from trellis.sources import sinks, triples

TRIPLES = "s string, p string, o string, o_kind string, o_lang string"


def phrase_matches(toks, phrase, slop):
    """Other tokens between, of the match that begins at each place."""
    out = []
    for i, t in enumerate(toks):
        at = i
        if not phrase or t != phrase[0]:
            continue
        for w in phrase[1:]:
            at = next((j for j in range(at + 1, len(toks)) if toks[j] == w), None)
            if at is None:
                break
        if at is not None and at - i - len(phrase) + 1 <= slop:
            out.append(at - i - len(phrase) + 1)
    return out


@pytest.fixture(scope="module")
def words_index(spark):
    rng = random.Random(6)
    rows = [(f"s{i}", V.TITLE if i % 3 else V.RDFS_LABEL, " ".join(rng.choice("abcde") for _ in range(rng.randrange(30))), "literal", None) for i in range(80)]
    return rows, index.build_index(spark.createDataFrame(rows, TRIPLES))


def test_phrases_equal_brute_force(spark, words_index):
    rows, idx = words_index
    phrases = [("1", "a b", 0), ("2", "a b c", 1), ("3", "a a", 0), ("4", "e", 3), ("5", "c d a b", 4), ("6", "a zebra", 2), ("7", "", 0), ("8", "B  A!", 0)]
    got = {(r.query_id, r.s): (r.n, r.score) for r in search.phrase_match(idx, spark.createDataFrame(phrases, "query_id string, phrase string, slop int")).collect()}
    want = {}
    for q, p, slop in phrases:
        for s, _, value, *_ in rows:
            found = phrase_matches(value.split(), p.lower().replace("!", "").split(), slop)
            if found:
                want[q, s] = len(found)
    assert {k: n for k, (n, _) in got.items()} == want and all(x > 0 for _, x in got.values())
    near, far = sorted(got.items(), key=lambda x: x[1][1])[-1], sorted(got.items(), key=lambda x: x[1][1])[0]
    assert near[1][1] > far[1][1]


def test_stored_positions_are_deltas_and_answer_alike(spark, words_index, tmp_path):
    rows, idx = words_index
    path = f"file:{tmp_path}/index"
    index.write_index(index.with_positions(idx), path)
    back = index.read_index(spark, path)
    ph = spark.createDataFrame([("1", "a b", 1), ("2", "c d", 0)], "query_id string, phrase string, slop int")
    key = lambda m: sorted((r.query_id, r.entry_id, r.n, round(r.score, 9)) for r in m.collect())
    assert key(search.phrase_match(back, ph)) == key(search.phrase_match(idx, ph)) != []
    file = next((tmp_path / "index" / "positions").rglob("part-*.parquet"))
    group = pq.ParquetFile(file).metadata.row_group(0)
    encodings = {group.column(i).path_in_schema: group.column(i).encodings for i in range(group.num_columns)}
    assert "DELTA_BINARY_PACKED" in encodings["pos.list.element"]
    tokens_in_all = sum(len(v.split()) for _, _, v, *_ in rows)
    assert back.positions.select(F.sum(F.size("pos"))).first()[0] == tokens_in_all


def test_changed_buckets_alone_are_read(spark, tmp_path):
    rows = [("g", f"s{i}", "p", f"o{i}", "literal", None if i % 2 else "en") for i in range(400)]
    kind = "g string, " + TRIPLES
    after = [r for r in rows if r[1] not in ("s7", "s8")] + [("g", "new", "p", "x", "iri", None), ("h", "s1", "p", "o1", "literal", None)]
    old, new = f"file:{tmp_path}/old", f"file:{tmp_path}/new"
    graph.write_buckets(spark.createDataFrame(rows + rows[:3], kind), old, 64)
    graph.write_buckets(spark.createDataFrame(after, kind).repartition(3), new, 64)
    assert 1 <= len(graph.changed_buckets(spark, old, new)) <= 4
    delta = graph.bucket_delta(spark, old, new)
    got = sorted((r.change, r.g, r.s, r.o, r.o_kind, r.o_lang) for r in delta.collect())
    assert got == sorted([("removed", "g", "s7", "o7", "literal", None), ("removed", "g", "s8", "o8", "literal", "en"),
                          ("added", "g", "new", "x", "iri", None), ("added", "h", "s1", "o1", "literal", None)], key=str)
    plan = delta._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "bucket" in plan[plan.index("PartitionFilters"):]
    graph.write_buckets(spark.createDataFrame(rows, kind).repartition(5), f"{old}2", 64)
    assert graph.changed_buckets(spark, old, f"{old}2") == [] and graph.bucket_delta(spark, old, f"{old}2").count() == 0


def test_datatypes_survive_files(spark, tmp_path):
    rows = [("a", "p", "1.50", "literal", None, "http://x#decimal"), ("a", "q", 'say "hi"\\ \n', "literal", "en", None), ("a", "r", "b", "iri", None, None), ("a", "s", "", "literal", None, None)]
    df = spark.createDataFrame(rows, TRIPLES + ", o_dtype string")
    sinks.write_ntriples(df, f"file:{tmp_path}/nt")
    back = triples.read_ntriples(spark, f"file:{tmp_path}/nt")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)
    assert sorted(map(tuple, triples.load_triples(spark, f"file:{tmp_path}/nt", "g", "ntriples").drop("g").collect()), key=str) == sorted(rows, key=str)


def test_rules_over_table_rows(spark):
    rows = spark.createDataFrame([({"id": "1", "name": "Ada", "town": "Bath"},), ({"id": "2", "name": ""},), ({"name": "no id"},)], "row map<string,string>")
    rules = [mapping.EntityRules("people", "Person", "id", ((V.TITLE, "literal", "name"), (V.NS + "in", "iri", "town", "town "), (V.NS + "is", "constant_iri", V.NS + "x")), prefix="p")]
    got = {(r.s, r.p, r.o, r.o_kind) for r in mapping.map_rows(rows, rules).collect()}
    one, two = V.NS + "p1", V.NS + "p2"
    assert got == {(one, V.RDF_TYPE, V.NS + "Person", "iri"), (one, V.TITLE, "Ada", "literal"), (one, V.NS + "in", V.NS + "town%20Bath", "iri"), (one, V.NS + "is", V.NS + "x", "iri"),
                   (two, V.RDF_TYPE, V.NS + "Person", "iri"), (two, V.NS + "is", V.NS + "x", "iri")}


def test_a_text_is_parsed_once(spark):
    html = "<p>one</p><p>two</p>"
    rows = [("q", f"l{i}", "t", html if i % 2 else None, None, None, None, "ConfluenceContent, Page" if i % 3 else "Post", "", "", 1.0) for i in range(30)]
    kind = ", ".join(f"{c} {'double' if c == 'totalScore' else 'string'}" for c in search.RESULT_COLUMNS)
    shown = present.present(spark.createDataFrame(rows, kind))
    got = {r.link: r.snippet for r in shown.collect()}
    assert got == {r[1]: ("" if r[3] is None else "one · two" if r[7] != "Post" else "one two") for r in rows}
