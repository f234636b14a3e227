"""UNI1-UNI6 with the contract lines C1-C9."""

import pytest
from pyspark.sql import functions as F

from trellis.functions.jsonpath import with_paths
from trellis.operators.unify import detect_paths, link_base, scalars, unify, unify_all


def _docs(spark, *jsons):
    rows = [(i, j) for i, j in enumerate(jsons)]
    return spark.createDataFrame(rows, "i int, j string").select("i", F.try_parse_json("j").alias("doc"))


def _path(spark, js, path):
    df = with_paths(_docs(spark, js), "doc", {"v": path})
    r = df.select(F.to_json("v").alias("v")).first()["v"]
    return r


def test_c1_step_on_primitive_keeps_value(spark):
    assert _path(spark, '{"body":"x"}', "body.content") == '"x"'


def test_c2_missing_is_null_and_json_null_is_present(spark):
    assert _path(spark, '{"a":1}', "b.c") is None
    assert _path(spark, '{"a":null}', "a") == "null"
    assert _path(spark, '{"a":null}', "a.b") == "null"


def test_c3_array_step_maps_elements(spark):
    assert _path(spark, '{"a":[{"id":1},{"x":2}]}', "a.id") == "[1,null]"
    # a non-object element abandons the step: the array stays as it was
    assert _path(spark, '{"a":[{"id":1},3]}', "a.id") == '[{"id":1},3]'


def test_c4_star_on_non_array(spark):
    assert _path(spark, '{"a":{"b":1}}', "a[*]") == '{"a":{"b":1}}'
    assert _path(spark, '{"a":[1,2]}', "a[*]") == "[1,2]"
    assert _path(spark, '{"x":1}', "a[*]") is None


def test_c5_nested_star_paths_walk(spark):
    assert _path(spark, '{"a":[{"b":{"c":1}},{"b":{"c":2}}]}', "a[*].b.c") == "[1,2]"


RULES = {"_id": ["_id"], "title": ["title", "subject"], "link": ["_links.webui", "webUrl"],
         "ancestor": ["ancestor", "parents", "more"]}


def test_c6_paths_sampled_from_first_document(spark):
    df = _docs(spark, '{"_id":"a","title":"T"}', '{"_id":"b","title":"U","subject":"S"}')
    present = detect_paths(df, RULES, order_by=["i"])
    assert present == {"_id": ["_id"], "title": ["title"]}
    present_all = detect_paths(df, RULES, sample="all")
    assert present_all["title"] == ["title", "subject"]


def test_c8_combination_rules(spark):
    df = _docs(spark, '{"_id":"a","ancestor":"p0","parents":["p1","p2"],"more":{"k":1}}',
               '{"_id":"b","ancestor":null,"parents":"x","more":7}')
    present = detect_paths(df, RULES, order_by=["i"])
    out = unify(df, RULES, present, keep=["i"]).orderBy("i").collect()
    assert out[0]["ancestor"] == ["p0", "p1", "p2", '{"k":1}']
    # first value JSON null is dropped, later primitives are dropped
    assert out[1]["ancestor"] == []


def test_c9_link_prefix(spark):
    assert link_base("https://wiki.example.org:8443/x/y") == "https://wiki.example.org/wiki"
    df = _docs(spark, '{"_id":"a","_links":{"webui":"/p/1"}}', '{"_id":"b","_links":{"webui":null}}')
    present = detect_paths(df, RULES, order_by=["i"])
    out = scalars(unify(df, RULES, present, keep=["i"], base_url="https://h/wiki")).orderBy("i").collect()
    assert out[0]["link"] == "https://h/wiki/p/1"
    assert out[1]["link"] is None


def test_overrides_read_first(spark):
    df = _docs(spark, '{"_id":"a"}').withColumn("ext", F.create_map(F.lit("ancestor"), F.lit("z")))
    present = detect_paths(df, RULES, overrides="ext", order_by=["i"])
    out = scalars(unify(df, RULES, present, keep=["i"], overrides="ext")).first()
    assert out["ancestor"] == "z"


def test_uni6_fails_only_when_all_fail(spark):
    ok = _docs(spark, '{"_id":"a"}').withColumn("ext", F.create_map().cast("map<string,string>"))
    empty = ok.where("false")
    frames, status = unify_all({"pages": ok, "posts": empty}, RULES, order_by=["i"])
    assert dict(status) == {"pages": True, "posts": False}
    with pytest.raises(RuntimeError):
        unify_all({"posts": empty}, RULES)
    with pytest.raises(RuntimeError):
        unify_all({}, RULES)


def test_only_paths_found_are_read_of_all_rows(spark):
    """The first document's paths are found on it alone, and other rules' paths are not evaluated for the rest."""
    df = spark.createDataFrame([(1, '{"a":{"b":"x"}}'), (2, '{"a":[{"b":"y"},{"c":1}]}'), (3, '{"a":"z"}'), (4, '{"zz":{"b":"w"}}')], "i int, j string")
    df = df.select("i", F.parse_json("j").alias("doc"), F.create_map().cast("map<string,string>").alias("ext"))
    frames, _ = unify_all({"one": df}, {"p": ["a.b"], "q": ["zz.b"]}, order_by=["i"], keep=["i"])
    assert {r.i: (r.p, r.q) for r in frames["one"].collect()} == {1: (["x"], []), 2: (["y"], []), 3: (["z"], []), 4: ([], [])}
    plan = frames["one"]._jdf.queryExecution().optimizedPlan().toString()
    assert "zz" not in plan and "_u1_0" not in plan
