"""Components, hierarchies and semi-naive inference against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from trellis import vocab as V
from trellis.operators import hierarchy, inference

TRIPLES = "s string, p string, o string, o_kind string, o_lang string"
AXIOMS = "p string, kind string, arg string"


def reach(edges):
    """Pairs joined by a way of one or more edges."""
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    found = set()
    for a in out:
        todo = list(out[a])
        while todo:
            b = todo.pop()
            if (a, b) not in found:
                found.add((a, b))
                todo += out.get(b, ())
    return found


@pytest.mark.parametrize("seed,nodes,edges", [(2, 40, 70), (4, 60, 55)])
def test_components_of_random_graphs(spark, seed, nodes, edges):
    rng = random.Random(seed)
    pairs = [(f"n{rng.randrange(nodes)}", f"n{rng.randrange(nodes)}") for _ in range(edges)] + [(f"c{i}", f"c{(i + 1) % 9}") for i in range(9)] + [("n1", "c3"), ("x", "x")]
    df = spark.createDataFrame(pairs + [(None, "n1"), ("n1", None)], "sub string, sup string")
    got = {r.node: r.component for r in hierarchy.strong_components(df).collect()}
    ways = reach(pairs)
    names = {x for p in pairs for x in p}
    assert got == {a: min([a, *(b for b in names if (a, b) in ways and (b, a) in ways)]) for a in names}
    above = {(r.sub, r.sup) for r in hierarchy.Hierarchy(df).pairs().collect()}
    assert above == {(a, b) for a, b in ways if a != b or any((a, c) in ways and (c, a) in ways for c in names - {a})}


def test_no_edges(spark):
    empty = spark.createDataFrame([], "sub string, sup string")
    assert hierarchy.strong_components(empty).count() == 0 and hierarchy.Hierarchy(empty).pairs().count() == 0


def test_equivalence_of_a_superclass(spark):
    t = spark.createDataFrame([("x", V.RDF_TYPE, "C", "iri", None), ("y", V.RDF_TYPE, "T", "iri", None)], TRIPLES)
    edges = spark.createDataFrame([("C", "S"), ("S", "Top")], "sub string, sup string")
    axioms = spark.createDataFrame([("S", "equivalentClass", "T")], AXIOMS)
    got = {(r.s, r.o) for r in inference.infer_fixpoint(t, axioms, edges).collect()}
    assert got == {("x", "C"), ("x", "S"), ("x", "T"), ("x", "Top"), ("y", "T"), ("y", "S"), ("y", "Top")}
    types = t.select("s", F.col("o").alias("cls"))
    assert {tuple(r) for r in inference.infer_types(types, inference.class_closure(edges, axioms)).collect()} == got


def brute_fixpoint(triples, axioms, edges):
    """All rules, one at a time, until nothing is new."""
    known = set(triples)
    of = lambda kind: [(p, a) for p, k, a in axioms if k == kind]
    while True:
        new = set()
        for s, p, o, kind, lang in known:
            iri = kind == "iri"
            for a, b in of("subPropertyOf") + of("equivalentProperty") + [(b, a) for a, b in of("equivalentProperty")]:
                if a == p:
                    new.add((s, b, o, kind, lang))
            for a, b in of("inverseOf") + [(b, a) for a, b in of("inverseOf")]:
                if a == p and iri:
                    new.add((o, b, s, "iri", None))
            if iri and (p, None) in of("symmetric"):
                new.add((o, p, s, "iri", None))
            if iri and (p, None) in of("transitive"):
                new |= {(s, p, z, "iri", None) for y, q, z, k, _ in known if q == p and y == o and k == "iri"}
            new |= {(s, V.RDF_TYPE, c, "iri", None) for q, c in of("domain") if q == p}
            new |= {(o, V.RDF_TYPE, c, "iri", None) for q, c in of("range") if q == p and iri}
            if p == V.RDF_TYPE:
                new |= {(s, p, b, kind, lang) for a, b in list(edges) + of("equivalentClass") + [(y, x) for x, y in of("equivalentClass")] if a == o}
        if new <= known:
            return known
        known |= new


@pytest.mark.parametrize("seed", [1, 3])
def test_fixpoint_equals_rules_one_by_one(spark, seed):
    rng = random.Random(seed)
    props, classes, nodes = ["P", "Q", "R", "T", "U", V.RDF_TYPE], list("ABCDE"), [f"n{i}" for i in range(14)]
    triples = {(rng.choice(nodes), rng.choice(props[:5]), rng.choice(nodes), "iri", None) for _ in range(16)}
    triples |= {(rng.choice(nodes), V.RDF_TYPE, rng.choice(classes), "iri", None) for _ in range(4)}
    triples |= {(rng.choice(nodes), rng.choice(props[:5]), "some text", "literal", rng.choice([None, "en"])) for _ in range(3)}
    kinds = ["subPropertyOf", "equivalentProperty", "inverseOf", "symmetric", "transitive", "domain", "range", "equivalentClass"]
    axioms = []
    for k in rng.sample(kinds, 6):
        if k == "equivalentClass":
            axioms.append((*rng.sample(classes, 1), k, rng.choice(classes)))
        elif k in ("symmetric", "transitive"):
            axioms.append((rng.choice(props[:5]), k, None))
        else:
            axioms.append((rng.choice(props[:5]), k, rng.choice(classes if k in ("domain", "range") else props)))
    edges = [(rng.choice(classes), rng.choice(classes)) for _ in range(4)]
    got = inference.infer_fixpoint(spark.createDataFrame(sorted(triples, key=str), TRIPLES), spark.createDataFrame(axioms, AXIOMS),
                                   spark.createDataFrame(edges, "sub string, sup string")).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute_fixpoint(triples, axioms, edges)


def test_a_round_joins_the_last_rounds_triples_alone(spark):
    """A long chain beside many plain triples: what a round makes follows what the last one added, not the store."""
    chain = [(f"c{i}", "in", f"c{i + 1}", "iri", None) for i in range(32)]
    plain = [(f"x{i}", "likes", f"y{i}", "iri", None) for i in range(3000)]
    axioms = spark.createDataFrame([("in", "transitive", None), ("likes", "domain", "Fan"), ("Fan", "equivalentClass", "Friend")], AXIOMS)
    rounds = []
    out = inference.infer_fixpoint(spark.createDataFrame(chain + plain, TRIPLES), axioms, rounds=rounds)
    assert out.count() == 33 * 32 // 2 + 3000 * 3
    assert [r[0] for r in rounds] == [3032, *(r[2] for r in rounds[:-1])] and rounds[-1][2] == 0
    assert rounds[0][1] == 31 + 6000 and len(rounds) <= 8
    assert all(made <= 31 + 2 * 6000 for _, made, _ in rounds) and all(made <= 33 * 32 for _, made, _ in rounds[2:])
