"""Fill-in-the-middle frames, best-fit shards, cover-tree negatives: against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trellis.llm import bins, cover_tree, middle
from trellis.llm.common import join_counted, numbered, scratch_path

# --- fill in the middle


def brute_middle(key, text):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n, digest = len(units), hashlib.sha256(f"1:{key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


PARTS = st.sampled_from(["a", "Bc", "zzzzzzzzzzzz", "é", "漢", "😀", " ", "\n", "<", "P>", "<S", "1", "\x00"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PARTS, max_size=40).map("".join), st.integers(4, 40), st.integers(0, 10**6))
def test_example_of_any_frames(text, frame_bytes, key):
    squeeze, expand = zstandard.ZstdCompressor().compress, zstandard.ZstdDecompressor().decompress
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    units, chars, frames, n = middle._long_text(data, frame_bytes, squeeze)
    assert b"".join(map(expand, frames)).decode() == text and all(len(expand(f)) <= frame_bytes for f in frames)
    assert all(len(re.findall(r"[A-Za-z]+|[^A-Za-z]", b"".join(map(expand, frames[:i])).decode())) == u for i, u in enumerate(units))
    row = {"n": n, "marked": any(m in text for m in ("<P>", "<S>", "<M>")), "units": units, "chars": chars, "frames": frames}
    digest = hashlib.sha256(f"1:{key}".encode()).digest()
    form, p, m, output = middle.example(row, [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)], squeeze, expand)
    assert (n, form, p, m, b"".join(middle.streamed(output)).decode()) == brute_middle(key, text)
    assert middle.rebuilt(output, form).decode() == text


LONG = "Straße nach Xanadu, mile 12. " * 9000 + "w" * 300_000 + " Ende"
MIDDLE_ROWS = [(i, f"Text number {i}: é漢 {'x' * i}\n") for i in range(120)] + [
    (200, None), (201, ""), (202, "has <S> inside"), (203, LONG), (204, LONG[:70_000]), (203, LONG), (None, "no id here"), (-5, "minus"), (205, "w" * 200_000), (206, "a"), (207, "漢" * 50_000)
]


def test_transform_equals_brute_force(docs):
    made = middle.transform(middle.store(docs(MIDDLE_ROWS, "key", "n", "frames")))
    got = middle.texts(made).collect()
    want = sorted((("" if i is None else str(i), *brute_middle("" if i is None else i, t or "")) for i, t in MIDDLE_ROWS), key=str)
    assert sorted(((r.key, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=str) == want
    assert Counter(r.text for r in got) == Counter(t or "" for _, t in MIDDLE_ROWS)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    dug = middle.digests(made).collect()
    assert Counter(r.output_sha256 for r in dug) == Counter(sha(w[-1]) for w in want)
    assert Counter(r.restored_sha256 for r in dug) == Counter(sha(t or "") for _, t in MIDDLE_ROWS)


def test_only_cut_frames_are_opened():
    squeeze, opened = zstandard.ZstdCompressor().compress, []
    row = dict(zip(("units", "chars", "frames", "n"), middle._long_text(np.frombuffer(("ab " * 20_000).encode(), np.uint8), 1000, squeeze)), marked=False)

    def expand(frame):
        opened.append(frame)
        return zstandard.ZstdDecompressor().decompress(frame)

    middle.example(row, [10_000, 30_000, 0, 50], squeeze, expand)
    assert len(row["frames"]) == 60 and len(opened) == 2


def test_empty_table_of_texts(docs):
    assert middle.digests(middle.transform(middle.store(docs([])))).count() == 0


# --- best fit


def brute_best_fit(items, capacity):
    room, out = [], []
    for s in sorted(items, reverse=True):
        fits = [(r, i) for i, r in enumerate(room) if r >= s]
        i = min(fits)[1] if fits else len(room)
        room += [] if fits else [max(capacity, s)]
        room[i] -= s
        out.append((s, i))
    return out, len(room)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80), st.integers(5, 90), st.integers(1, 9))
def test_runs_equal_item_by_item_best_fit(items, capacity, shards):
    runs, n = bins.best_fit_decreasing(list(Counter(items).items()), capacity)
    assert ([(s, b) for s, k, b in runs for _ in range(k)], n) == brute_best_fit(items, capacity)
    even = bins.near_equal(list(Counter(items).items()), shards)
    levels = Counter()
    for s, k, b in even:
        levels[b] += s * k
    assert Counter({s: n for s, n in Counter(items).items()}) == sum((Counter({s: k}) for s, k, _ in even), Counter())
    assert all(0 <= b < shards for _, _, b in even)
    if items:  # no bin is above an even share by more than the largest item, but for items that are alone
        alone = {b for b in levels if sum(k for _, k, c in even if c == b) == 1}
        assert all(levels[b] <= -(-sum(items) // shards) + 2 * max(items) for b in levels if b not in alone)


def test_capacities_stay_ordered():
    rng, tree, held = random.Random(2), bins.Capacities(), set()
    for i in range(2000):
        least = rng.randrange(300)
        want = min((x for x in held if x[0] >= least), default=None)
        assert tree.take(least) == want
        held.discard(want)
        item = (rng.randrange(300), i)
        tree.add(*item)
        held.add(item)


SHARD_ROWS = [(i, f"text {i % 37} " * (i % 23)) for i in range(500)] + [(i, "copy of one text") for i in range(500, 900)] + [(900, None), (901, ""), (902, LONG), (None, "x"), (903, "é"), (903, "é")]


def check_slots(got, rows):
    size = lambda t: len((t or "").encode()) + 1
    assert sorted(((str(r.doc_id), r.size, r.text_crc32) for r in got)) == sorted((str(i), size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    for shard in {r.shard for r in got}:
        mine = sorted((r.slot, -1 if r.doc_id is None else r.doc_id) for r in got if r.shard == shard)
        assert [s for s, _ in mine] == list(range(len(mine))) and [d for _, d in mine] == sorted(d for _, d in mine)


def test_assign_equals_best_fit_of_groups(docs):
    df = docs(SHARD_ROWS, "shard", "slot", "size", "text_sha")
    groups = Counter()
    for _, t in SHARD_ROWS:
        groups[t or ""] += len((t or "").encode()) + 1
    capacity = 40_000
    got = bins.assign(df, capacity=capacity).collect()
    check_slots(got, SHARD_ROWS)
    wanted, n = brute_best_fit(list(groups.values()), capacity)
    level = Counter()
    for s, b in wanted:
        level[b] += s
    assert sorted(Counter({b: sum(r.size for r in got if r.shard == b) for b in {r.shard for r in got}}).values()) == sorted(level.values()) and len(level) == n
    even = bins.assign(df).collect()
    check_slots(even, SHARD_ROWS)
    text_of = {i: t or "" for i, t in SHARD_ROWS}
    for rows in (got, even):
        shard_of = {}
        for r in rows:
            assert shard_of.setdefault(text_of[r.doc_id], r.shard) == r.shard
    rest = sorted(sum(r.size for r in even if r.shard == b) for b in range(8))[:-1]
    assert rest[-1] - rest[0] <= 16  # all but the shard of the long text
    again = bins.assign(df.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, even))


def test_shards_of_no_rows_and_written_shards(spark, docs):
    assert bins.assign(docs([])).count() == 0
    df = docs(SHARD_ROWS[:50], "slot")
    written = bins.write_shards(df, scratch_path(spark, "t") + "/out", shards=3)
    assert sorted(map(str, written.select(df.columns).collect())) == sorted(map(str, df.collect())) and {r.shard for r in written.collect()} == {0, 1, 2}


@pytest.mark.parametrize("size,want", [(1, 1), (65535, 65535), (65536, 65536), (65537, 65538), (2**40 + 1, 2**40 + 2**25)])
def test_size_classes(spark, size, want):
    assert spark.range(1).select(bins._size_class(F.lit(size).cast("long"))).first()[0] == want


def test_numbered_and_counted_join(spark):
    df = spark.range(3000).select(F.expr("id * 7919 % 3001").alias("x"), F.expr("case when id % 3 = 0 then 'hot' else 'k' || (id % 50) end").alias("key"))
    got = numbered(df, "x", label="t").select("x", "rank").collect()
    assert [r.x for r in sorted(got, key=lambda r: r.rank)] == sorted(r.x for r in got) and sorted(r.rank for r in got) == list(range(3000))
    counts = df.groupBy("key").agg(F.count("*").alias("n"))
    met = join_counted(df, counts, "key", "n", 3000)
    assert met.count() == 3000 and met.filter("key = 'hot'").select("n").distinct().collect()[0].n == 1000
    hot = join_counted(df, counts.withColumn("n", F.col("n") * 5), "key", "n", 3000)  # now over the bound
    assert hot.count() == 3000


# --- cover trees


def brute_first(points, labels, ids, q, k, fits, window):
    rows = []
    for p, label, mine in zip(points, labels, ids):
        score = sum(int(a) * int(b) for a, b in zip(p, q))
        if fits(label) and (window is None or window[0] <= score <= window[1]):
            rows += [(score, i) for i in mine]
    return sorted(rows, key=lambda r: (-r[0], r[1]))[:k]


@pytest.mark.parametrize("seed", range(40))
def test_tree_search_equals_brute_force(seed):
    rng, draw = np.random.default_rng(seed), random.Random(seed)
    n, dims, largest = draw.randrange(1, 300), draw.choice([1, 2, 5, 20]), draw.choice([1, 3, 50, 2**27])
    points = rng.integers(-largest, largest + 1, (n, dims))
    if seed % 3 == 0:  # few different vectors
        points = points[rng.integers(0, max(1, n // 10), n)]
    labels, names = rng.integers(0, 4, n), list(rng.permutation(10 * n))
    ids = [sorted(int(names.pop()) for _ in range(draw.randrange(1, 5))) for _ in range(n)]
    tree = cover_tree.Tree(points, labels, ids, float((points.astype(float) ** 2).sum(1).max()), leaf=draw.choice([1, 4, 30]), fanout=draw.choice([2, 3, 32]))
    lifted = np.column_stack([tree.points.astype(float), np.sqrt(np.maximum(0, (points.astype(float) ** 2).sum(1).max() - (tree.points.astype(float) ** 2).sum(1)))])
    for lo, hi, r, child, end in zip(tree.first, tree.last, tree.radius, tree.child, tree.child_end):
        assert min(np.sqrt(((lifted[lo:hi] - c) ** 2).sum(1)).max() for c in lifted[lo:hi]) <= r + 1e-6 * largest
        if child:
            assert [tree.first[child], tree.last[end - 1]] == [lo, hi]
    k, same = draw.choice([1, 3, 6]), draw.random() < 0.5
    queries, wanted = rng.integers(-largest, largest + 1, (5, dims)), [draw.randrange(5) for _ in range(5)]
    asks = [(i, w) for i, q in enumerate(queries) for w in (cover_tree.NO_WINDOW, *(cover_tree.window_of(int(points[draw.randrange(n)] @ q), 50, 95) for _ in range(3)))]
    got = tree.search(queries, wanted, same, np.array([i for i, _ in asks]), np.array([w[0] for _, w in asks]), np.array([w[1] for _, w in asks]), k)
    assert got == [brute_first(points, labels, ids, queries[i], k, lambda x: (x == wanted[i]) == same, w) for i, w in asks]  # noqa: B023


def test_search_leaves_out_far_nodes():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16)) * 3000
    points = np.floor(np.repeat(centres, 100, axis=0) + rng.normal(size=(4000, 16)) * 20).astype(np.int64)
    tree = cover_tree.Tree(points, np.zeros(4000, int), [[i] for i in range(4000)], float((points**2).sum(1).max()), leaf=50)

    class Counted(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice):
                opened.append(key.stop - key.start)
            return super().__getitem__(key)

    opened = []
    tree.points = tree.points.view(Counted)
    found = tree.search(points[7:8], [0], True, np.array([0]), *(np.array([x]) for x in cover_tree.NO_WINDOW), 5)
    assert found == [brute_first(points, [0] * 4000, [[i] for i in range(4000)], points[7].tolist(), 5, lambda x: True, cover_tree.NO_WINDOW)]
    assert 0 < sum(opened) < 800


def brute_negatives(rows, is_anchor):
    fine = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            fine.append((i, label, tuple(math.floor(256 * x) for x in v)))
    fine = sorted(set(fine))
    dims = max((len(v) for *_, v in fine), default=0)
    fine = [(i, label, v + (0,) * (dims - len(v))) for i, label, v in fine]
    out = []
    for a, label, q in (r for r in fine if is_anchor(r[0])):
        scored = [(-sum(x * y for x, y in zip(q, v)), i, other) for i, other, v in fine]
        near = sorted((s, i) for s, i, other in scored if other == label and i != a)[:5]
        for s, p in near:
            hard = sorted((t, i) for t, i, other in scored if other != label and 50 * -s <= 100 * -t <= 95 * -s)[:3]
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i) in enumerate(hard)]
    return sorted(out)


def embedding_rows():
    rng, draw = np.random.default_rng(11), random.Random(11)
    centres = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in centres[draw.randrange(6)] + rng.normal(size=8) * 0.3], draw.randrange(4)) for i in range(500)]
    rows += [(i, rows[3][1], 1) for i in range(500, 700)]  # copies of one vector, ties in all scores
    rows += [(i, [0.5] * 8, i % 3) for i in range(700, 730)]
    rows += [(730, None, 1), (740, [1.0, None] + [0.0] * 6, 1), (750, [math.nan] * 8, 2), (760, [math.inf] * 8, 2), (770, [1.0] * 8, None), (None, [1.0] * 8, 1),
             (780, [], 1), (790, [0.25, 0.5], 2), (0, rows[0][1], rows[0][2]), (800, [0.0] * 8, 3), (810, [-0.001] * 8, 3)]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, small):
    if small:  # many cells, blocks, packs and copies of trees
        monkeypatch.setattr(cover_tree, "BLOCK_ROWS", (40, 40))
        monkeypatch.setattr(cover_tree, "PACK", 7)
        monkeypatch.setattr(cover_tree, "PACKS_PER_TASK", 2)
    rows = embedding_rows()
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<float>, label int, v string, block int")
    got = cover_tree.hard_negatives(df, F.col("vec_id") % 10 == 0).collect()
    want = brute_negatives([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], c) for i, v, c in rows], lambda i: i % 10 == 0)
    assert len(want) > 300 and sorted(map(tuple, got)) == want


def test_hard_negatives_of_nothing_and_of_huge_norms(spark):
    kind = "vec_id long, embedding array<double>, label int"
    assert cover_tree.hard_negatives(spark.createDataFrame([], kind), F.lit(True)).count() == 0
    with pytest.raises(ArithmeticError):
        cover_tree.hard_negatives(spark.createDataFrame([(1, [1e30], 1)], kind), F.lit(True))
