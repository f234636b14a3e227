"""Graphs laid out by predicate: partition filters, pattern order, stars from characteristic sets."""

import pytest
from pyspark.sql import functions as F

from trellis.operators import graph, layout

QUADS = "g string, s string, p string, o string, o_kind string, o_lang string"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rows = [("k", f"s{i}", "title", f"t{i % 7}", "literal", None) for i in range(60)]
    rows += [("k", f"s{i}", "link", f"l{i}", "iri", None) for i in range(0, 60, 2)]
    rows += [("k", f"s{i}", "in", f"s{i // 10}", "iri", None) for i in range(60)]
    rows += [("r", f"s{i}", "title", f"t{i % 7}", "literal", None) for i in range(0, 60, 3)]  # again in another graph
    rows += [("r", "s4", "title", "second", "literal", "en"), ("r", "s4", "rare", "x", "literal", None), ("r", "s5", "rarer", "y", "literal", None)]
    df = spark.createDataFrame(rows + rows[:4], QUADS)
    return df, layout.write_store(df, f"file:{tmp_path_factory.mktemp('l')}/s", own=3, shared=2)


def filters(df):
    plan = df._jdf.queryExecution().toString()
    return [line[line.index("PartitionFilters") :] for line in plan.splitlines() if "PartitionFilters" in line]


def test_reads_are_partition_filters(stored):
    df, store = stored
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(store.named_graph("r"), graph.named_graph(df, "r")) and any("g#" in f for f in filters(store.named_graph("r")))
    for p in ("title", "rare", "rarer", "nowhere"):
        assert same(store.values_of(p), graph.values_of(df, p))
        assert p == "nowhere" or any("folder" in f for f in filters(store.values_of(p)))  # without a folder nothing is read


def test_patterns_in_order_of_their_rows(stored):
    df, store = stored
    patterns = [("?c", "in", "?p"), ("?p", "title", "?t"), ("?c", "rare", "?x")]
    assert store.ordered(patterns) == [patterns[2], patterns[0], patterns[1]]
    assert store.ordered([("?a", "title", "?t"), ("?a", "in", "s2")])[0][1] == "in"
    got, want = store.match(patterns, [("?c", "link", "?l")]), graph.match(df, patterns, [("?c", "link", "?l")])
    assert sorted(map(str, got.select(*sorted(got.columns)).collect())) == sorted(map(str, want.select(*sorted(want.columns)).collect())) and got.count() == 1


def test_stars(stored):
    df, store = stored
    names = {"title": "title", "link": "link", "rare": "rare"}
    got = store.star(names, required=("title", "link"))
    want = graph.entity_table(df, names, required=("title", "link"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert store.star_count(["title", "link"]) == 30 == got.select("s").distinct().count()
    assert store.star_count(["title", "rare"]) == 1 and store.star_count(["title", "nowhere"]) == 0
    assert store.star({"title": "title", "none": "nowhere"}).count() == 0
    plan = got._jdf.queryExecution().toString()
    assert "LeftOuter" not in plan and plan.count("FileScan") <= 6
    assert store.sets.agg(F.sum("n_subjects")).first()[0] == 60


def test_a_store_is_written_with_one_shuffle_of_the_texts(spark, tmp_path, monkeypatch):
    """Steps after the first read its Parquet: null languages, a null graph and long texts that agree for 64 characters stay apart."""
    read = []
    keep = layout.stored
    monkeypatch.setattr(layout, "stored", lambda df: read.append(df.columns) or keep(df))
    long_ = "x" * 70
    rows = [("k", "a", "t", long_ + "1", "literal", None), ("r", "a", "t", long_ + "1", "literal", None), ("k", "a", "t", long_ + "2", "literal", "en"),
            (None, "b", "t", long_ + "1", "literal", None)]
    store = layout.write_store(spark.createDataFrame(rows, QUADS), f"file:{tmp_path}/s")
    assert read[0] == ["s", "p", "o", "o_kind", "o_lang", "graphs"] and len(read) == 2
    assert sorted(map(str, store.quads.select("g", "s", "p", "o", "o_kind", "o_lang").collect())) == sorted(map(str, spark.createDataFrame(rows, QUADS).collect()))
    assert [tuple(r) for r in store.predicates.select("p", "n", "n_subjects", "n_objects").collect()] == [("t", 3, 2, 2)]
    assert sorted(r["t"][-1] for r in store.star({"t": "t"}).collect()) == ["1", "1", "2"]
