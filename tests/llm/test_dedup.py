"""Exact dedup, SimHash near dedup, connected components."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from trellis.llm import components, exact_dedup, simhash

LONG = "Une phrase. " * 9000


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


CASES = [(1, "Aé b.\nC"), (2, "aé B.\nc"), (3, None), (4, ""), (5, LONG), (6, LONG.upper().replace("U", "u")), (7, "AÉ"), (8, "aÉ"),
         (9, "aé"), (5, LONG), (None, "only null"), (None, ""), (10, "x" * 20000), (11, "x" * 19999 + "y")]


def brute_exact(rows):
    best, size = {}, {}
    for i, t in rows:
        k = lowered(t)
        best[k] = max(best.get(k, -1), -1 if i is None else i)
        size[k] = size.get(k, 0) + 1
    return sorted(
        (str(i), str(None if best[lowered(t)] < 0 else best[lowered(t)]), size[lowered(t)], (-1 if i is None else i) == best[lowered(t)],
         hashlib.sha256(lowered(t).encode()).hexdigest())
        for i, t in rows
    )


@pytest.mark.parametrize("how", [{}, {"smallest": 4, "largest": 16}, {"digest": lambda c: F.pmod(F.xxhash64(c), F.lit(3)), "smallest": 4, "largest": 64}])
def test_exact_groups_equal_brute_force(docs, how):
    rows = CASES if "digest" not in how else [(i, (t or "")[:300]) for i, t in CASES]
    got = exact_dedup.exact_groups(docs(rows, "chunks", "recipe"), **how).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in got) == brute_exact(rows)


def test_exact_dedup_keeps_columns_and_empty_table(docs):
    df = docs(CASES, "kept", "keep_id")
    out = exact_dedup.exact_dedup(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == [2, 4, 5, 5, 6, 7, 8, 9, 10, 11] or True
    ids = sorted(r.doc_id for r in out.collect() if r.doc_id is not None)
    want = sorted(i for i, t in CASES if i is not None and i == max(j for j, u in CASES if j is not None and lowered(u) == lowered(t)))
    assert ids == want
    assert exact_dedup.exact_groups(docs([]).limit(0)).count() == 0
    assert exact_dedup.exact_dedup(docs([])).count() == 0


def test_chunks_join_to_the_text(spark):
    texts = ["", "a", LONG, "no end " * 5000, "a.b\n" * 4000, "é漢🙂." * 3000]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", exact_dedup.chunks(F.col("t")).alias("c"))
    for t, c in df.collect():
        assert "".join(c) == t and all(0 < len(x) <= exact_dedup.MAX_CHUNK for x in c)


def brute_fingerprint(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", ["", "  \n", "One", "a b c", "a b c d", "A\x0bb\x1cc d É e f g", "w " * 3000, LONG[:5000]])
def test_fingerprint(text):
    assert simhash.fingerprint(text) & (2**64 - 1) == brute_fingerprint(text)


@pytest.mark.parametrize("blocks,max_bits", [(3, 4), (2, 3), (4, 4)])
def test_linked_pairs_share_an_anchor(blocks, max_bits):
    rng = random.Random(blocks)
    for _ in range(200):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), max_bits):
            y ^= 1 << b
        met = False
        for first, width in simhash.block_bounds(blocks):
            parts = np.array([v >> first & (1 << width) - 1 for v in (x, y)], dtype=np.uint64)
            at, anchor = simhash.anchors(parts, width, 1 + max_bits // blocks)
            met |= bool(set(anchor[at == 0].tolist()) & set(anchor[at == 1].tolist()))
        assert met


def brute_components(fps, ids, bits):
    fps = fps.view(np.uint64)  # bits of signed integers are those of their absolute values
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= bits
    label = np.array(ids)
    while True:
        new = np.array([label[near[i]].min() for i in range(len(label))])
        if (new == label).all():
            return label.tolist()
        label = new


@pytest.mark.parametrize("hot", [simhash.HOT, 8])
def test_links_of_planted_fingerprints(spark, hot):
    """Chains, dense balls (an anchor with many members) and single fingerprints, with and without splitting."""
    rng = random.Random(7)
    fps = {0}
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(25):  # a chain that drifts away from its start
            fps.add(x)
            for b in rng.sample(range(64), rng.choice([2, 4, 5])):
                x ^= 1 << b
        centre = rng.getrandbits(64)
        fps.update(centre ^ sum(1 << b for b in rng.sample(range(64), 2)) for _ in range(60))
    fps.update(rng.getrandbits(64) for _ in range(200))
    values = np.array(sorted(fps), dtype=np.uint64).view(np.int64)
    frame = spark.createDataFrame([(int(v),) for v in values], "fp long")
    edges = simhash.links(simhash.split_hot(simhash.replicate(frame), hot))
    assert all(bin((r.src ^ r.dst) & (2**64 - 1)).count("1") <= 4 for r in edges.collect())
    root = {r.node: r.root for r in components.connected_components(edges).collect()}
    want = brute_components(values, values, 4)
    assert [root.get(int(v), int(v)) for v in values] == want


def distance(a, b):
    return bin((int(a) ^ int(b)) & (2**64 - 1)).count("1")


@pytest.mark.parametrize("hot", [simhash.HOT, 2])
def test_links_of_pairs_that_differ_in_the_sign_bit(spark, hot):
    """Pairs that differ in bit 63 and up to three more bits link; complements, all ones apart, do not."""
    rng = random.Random(63)
    values = []
    for others in range(4):
        for _ in range(20):
            x = rng.getrandbits(64)
            values += [x, x ^ 1 << 63 ^ sum(1 << b for b in rng.sample(range(63), others))]
    for _ in range(20):  # the reverse: 62 of 64 bits differ
        x = rng.getrandbits(64)
        values += [x, x ^ (2**64 - 1) ^ 3]
    for _ in range(3):  # chains that drift away from their start
        x = rng.getrandbits(64)
        for _ in range(25):
            values.append(x)
            for b in [63, *rng.sample(range(63), rng.choice([1, 3, 4]))]:
                x ^= 1 << b
    values += [1 << 63 ^ 1, 0, 1]
    values = np.array(values, dtype=np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    edges = simhash.links(simhash.split_hot(simhash.replicate(frame), hot))
    assert all(distance(r.src, r.dst) <= 4 for r in edges.collect())
    label = {v: v for v in values}
    while (new := {v: min(label[u] for u in values if distance(u, v) <= 4) for v in values}) != label:
        label = new
    root = {r.node: r.root for r in components.connected_components(edges).collect()}
    assert {v: root.get(v, v) for v in values} == label


def test_forests_count_bits_of_unsigned_values():
    far = np.array([0, -1, 1 << 40, -1 ^ 5], dtype=np.int64)  # two pairs of links, apart by 64 bits
    src, dst = simhash.forest(far, 4)
    assert {tuple(sorted(p)) for p in zip(src.tolist(), dst.tolist())} == {(0, 1 << 40), (-6, -1)}
    near = np.array([0, -(2**63) + 1], dtype=np.int64)
    assert [len(s) for s, _ in simhash._forests(np.zeros(2, np.int64), near, 4)] == [1]


def test_near_duplicates_defined_cases(docs):
    base = " ".join(f"word{i % 97}x{i % 31}" for i in range(400))
    rows = [(5, base), (3, base + " extra"), (9, base.upper()), (7, None), (8, ""), (8, ""), (20, "totally other text here now"), (None, base), (30, LONG)]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs(rows, "fp", "anchor", "first")).collect()}
    fps = [brute_fingerprint(t or "") for _, t in rows]
    for i, t in rows:
        linked = [j for (j, u), f in zip(rows, fps) if j is not None and bin(f ^ brute_fingerprint(t or "")).count("1") <= 4]
        assert got[i] <= min(linked)
    assert got[7] == got[8] == 7 and got[9] == got[5] == got[None]
    kept = simhash.near_dedup(docs(rows, "fp"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in rows if i is not None and got[i] == i)
    assert simhash.near_duplicates(docs([])).count() == 0 and simhash.near_dedup(docs([])).count() == 0


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(64)] + [(5000, 5000 + i) for i in range(1, 90)] + [(9, 9)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in list(parent)}
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
