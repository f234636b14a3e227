"""Tables of a build lie in buckets by subject: what goes by subject is done where it lies, and texts are read by who needs them."""

import pytest
from pyspark.sql import functions as F

from trellis import vocab as V
from trellis.operators import enrich, graph, present, search
from trellis.plans import build as B
from trellis.session import bucketed, joined_in_place

T = "s string, p string, o string, o_kind string, o_lang string"
rows = lambda df: sorted(map(str, df.collect()))


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.fixture(scope="module")
def made(spark):
    kind = ", ".join(f"{c} string" for c in V.UNIFIED_FIELDS)
    page = lambda i, **kw: tuple({"_id": f"p{i}", "title": f"pump {i % 4}", "link": f"L/{i}", "type": "page", **kw}.get(c) for c in V.UNIFIED_FIELDS)
    pages = [page(i, content=("<p>one &amp; two</p>" if i % 3 == 0 else "plain  text" if i % 3 == 1 else None), ancestor=f"p{i // 2}" if i else None) for i in range(24)]
    pages += [page(7, title="pump again", content="other text"), page(7)]
    terms = spark.createDataFrame([(V.NS + "t", "plain"), (V.NS + "p3", "pump 3")], "s string, title string")
    return B.build_graph(spark, {"pages": spark.createDataFrame(pages, kind)}, terms)


def test_a_store_is_grouped_and_joined_where_it_lies(spark, made):
    union = graph.union_graph(made.quads)
    assert exchanges(union) == 0 and union.count() == made.quads.select("s", "p", "o", "o_kind", "o_lang").distinct().count()
    # a triple of two graphs is one of the union and one of each graph
    both = made.quads.where(F.col("s") == V.NS + "p3").where(F.col("p") == V.TITLE)
    assert {r.g for r in both.collect()} == {V.GRAPH_KNOWLEDGE, V.GRAPH_CONTENT}
    assert exchanges(graph.entity_table(made.graph, {"link": V.LINK, "title": V.TITLE}, ("link",))) == 0
    star = joined_in_place(made.entities, made.contents, "content_id", "left")
    assert exchanges(star) == 0
    got = {(r.link, r.title, r.content) for r in star.collect()}
    assert {x for x in got if x[0] == "L/7"} == {("L/7", t, c) for t in ("pump 3", "pump again") for c in ("plain  text", "other text")}
    assert ("L/2", "pump 2", None) in got and ("L/3", "pump 3", "<p>one &amp; two</p>") in got


def test_joins_in_place_are_joins_on_both_columns(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", None), (None, 1)], "s string, k int")
    right = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 1, "z"), ("c", None, "n")], "s string, k int, v string")
    lying = joined_in_place(bucketed(left, "s", 4), bucketed(right, "s", 4), "k", "left")
    assert exchanges(lying) == 0
    assert rows(lying) == rows(left.join(right, ["s", "k"], "left"))


def test_results_without_texts_count_rank_and_show_the_same(spark, made):
    q = spark.createDataFrame([("a", "pump 3 again"), ("b", "pump"), ("c", "nothing")], "query_id string, text string")
    whole, ids = search.search_build(made, q), search.search_build(made, q, texts=False)
    assert "content" not in ids.columns
    assert rows(search.result_counts(whole)) == rows(search.result_counts(ids))
    for n, size in ((1, 3), (2, 5), (1, 40)):  # equal scores without a time: ties go by link and then, for p7, by text
        cols = ["query_id", "rank", "page", "link", "title", "content", "totalScore"]
        top = search.page(ids, n, size, pages_through=True, contents=made.contents)
        assert rows(top.select(cols)) == rows(search.page(whole, n, size, pages_through=True).select(cols))
    assert rows(search.search_build(made, q, limit=4).select("query_id", "link", "content", "rank")) == rows(search.page(whole, 1, 4).select("query_id", "link", "content", "rank"))
    shown = ["query_id", "link", "title", "displayTitle", "source", "snippet", "breadcrumbText"]
    assert rows(present.present(ids, contents=made.contents).select(shown)) == rows(present.present(whole).select(shown))
    assert {r.snippet for r in present.present(ids, contents=made.contents).collect()} == {"one & two", ""}


def test_artifacts_hold_every_title_and_content(spark):
    kg = spark.createDataFrame([("a", V.TITLE, "T", "literal", None), ("a", V.TITLE, "U", "literal", None), ("a", V.CONTENT, "<p>z</p>", "literal", None), ("a", V.CONTENT, "b  c", "literal", None),
                                ("b", V.TITLE, "B", "literal", None), ("c", V.TITLE, "C", "literal", None), ("c", V.CONTENT, " x ", "literal", None), ("d", V.CONTENT, "<i>", "literal", None)], T)
    got = sorted((r.artifact, r.text) for r in enrich.artifacts_from_graph(kg).collect())
    assert got == [("a", "T || b c z"), ("a", "U || b c z"), ("b", "B || "), ("c", "C || x")]
    raw = sorted((r.artifact, r.text) for r in enrich.artifacts_from_graph(kg, content_is_html=False).collect())
    assert raw[0] == ("a", "T || <p>z</p> b c")
