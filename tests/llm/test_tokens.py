"""Token ids, packing along the curve, training order, sampled segmentations."""

import collections
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trellis.llm import lattice, packing, tokens, training_order
from trellis.llm.common import scratch_path

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BLANK = lattice.BLANK
HARD = ["", " ", "a ", "  a  b \n\n c\t d it's I'll 've.", "<|endoftext|> x", "\x1c c\x1d\x85 d\xa0e", "é ²½ 123abc  ", "\r\n\r\n x", "'s 's",
        "漢字 かな　x", "x, y.z a'. 'll. ?? e.", "ab's, don't.", "🙂🙂 ​z", "w" * 5000, "tab\tlist, of: things; no! yes?"]


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_ids_equal_the_tokenizer(reference, text):
    assert np.frombuffer(tokens.encoder(BPE)(text), dtype="<u2").tolist() == reference(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["word", "d", "'t", "'", " ", "  ", "\n", ".", ",", "!?", "é", "ʯ", "漢", "ª", "²", "7", "_", "(", "İ", "\xa0", ":;"]), max_size=14).map("".join))
def test_ids_of_words_and_marks(reference, text):
    assert np.frombuffer(tokens.encoder(BPE)(text), dtype="<u2").tolist() == reference(text)


def test_ids_while_units_grow_old(reference, monkeypatch):
    monkeypatch.setattr(tokens, "UNITS", 5)
    encode = tokens.encoder(BPE)
    texts = [" ".join(f"word{i * j % 7}, and {i}." for j in range(6)) for i in range(40)]
    assert all(np.frombuffer(encode(t), dtype="<u2").tolist() == reference(t) for t in texts * 2)


def test_ids_of_documents(reference, spark, sf):
    texts = HARD + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    assert all(np.frombuffer(tokens.encoder(BPE)(t), dtype="<u2").tolist() == reference(t) for t in texts)


MARK = "<|endoftext|>"
MARKED = [MARK, f"a {MARK} x", f"{MARK}{MARK}", f" {MARK} \n {MARK}  b ", f"it's{MARK}'s", f"<|{MARK}|> <|endoftext|", f"A{MARK.upper()}"]


@pytest.fixture(scope="module")
def default_reference():
    t = Tokenizer.from_file(BPE)  # as it comes: added tokens in a text are their ids
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.just(MARK), st.sampled_from(HARD[:13]), st.text(max_size=12)), max_size=6))
def test_added_tokens_are_their_ids(default_reference, parts):
    encode = tokens.encoder(BPE, added_tokens=True)
    for text in ["".join(parts), *MARKED]:
        assert np.frombuffer(encode(text), dtype="<u2").tolist() == default_reference(text)


def test_queries_take_added_tokens(spark, docs, default_reference, tmp_path):
    import corpus_pipeline
    from trellis.llm import queries

    rows = list(enumerate([*MARKED, *HARD, MARK * 3000]))
    df = docs(rows)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    ids = {i: np.array(default_reference(t) + [0], dtype="<u4") for i, t in rows}
    for p in queries.op3_hilbert_packing(spark, str(tmp_path)).collect():
        assert p.doc_tokens == len(ids[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes())
    check_pieces(corpus_pipeline.packing_stage(spark, df, "").collect(), rows, default_reference, packing.SEQUENCE)
    total = sum(len(default_reference(t)) + 1 for _, t in rows)
    got = queries.op8_feistel_shards(spark, str(tmp_path)).collect()
    assert len(got) == -(-total // training_order.LENGTH)  # spelled marks would take seven times the sequences
    stream = training_order.round_trip(df, BPE, "k", added_tokens=True).collect()
    marks = sum(default_reference(t).count(50256) + 1 for _, t in rows)
    found = sum(int((np.frombuffer(bytes(r.ids), dtype="<u2") == 50256).sum()) for r in stream)
    assert found == marks + -total % training_order.LENGTH  # the last sequence is filled up


ROWS = [(i, t) for i, t in enumerate(HARD)] + [(100, None), (3, HARD[3]), (None, "no id"), (101, "long text of words. " * 4000)]


def check_pieces(pieces, rows, reference, size):
    want = collections.Counter((i, tuple(reference(t) + [0])) for i, t in rows)
    by_sequence = collections.defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append(p)
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at and len(p.ids) == 2 * p.length and p.length > 0
            at += p.length
        assert at == size or at < size and at & (at - 1) == 0
    got = collections.Counter()
    parts = collections.defaultdict(lambda: collections.defaultdict(list))
    for p in pieces:
        parts[p.doc_id, p.doc_tokens][p.start].append(np.frombuffer(bytes(p.ids), dtype="<u2").tolist())
    for (doc, total), cut in parts.items():
        copies = len(cut[0])
        for _ in range(copies):
            ids = []
            while len(ids) < total:
                ids += cut[len(ids)].pop()
            got[doc, tuple(ids)] += 1
    assert got == want


@pytest.mark.parametrize("size", [16, 1024])
def test_packing(docs, reference, size):
    out = packing.pack(docs(ROWS, "ids", "key", "start"), BPE, size=size).collect()
    check_pieces(out, ROWS, reference, size)
    assert packing.pack(docs([]), BPE).count() == 0


def test_packing_digests(docs, reference):
    pieces = packing.id_digests(packing.pack(docs(ROWS[:6]), BPE)).collect()
    ids = {i: np.array(reference(t) + [0], dtype="<u4") for i, t in ROWS[:6]}
    assert all(p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes()) for p in pieces)


def test_hilbert_steps_are_neighbours():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    key = packing.hilbert(grid, 3)
    assert sorted(key) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_similar_documents_lie_close(reference):
    rng = np.random.default_rng(1)
    table = packing.directions(1 << 16)
    base = [rng.integers(0, 50000, 800) for _ in range(60)]
    near = [np.where(rng.random(800) < 0.02, rng.integers(0, 50000, 800), b) for b in base]
    p = packing.points(base + near, table)
    gap = lambda a, b: np.linalg.norm(a - b)
    assert np.median([gap(p[i], p[60 + i]) for i in range(60)]) < np.median([gap(p[i], p[(i + 1) % 60]) for i in range(60)]) / 3


@pytest.mark.parametrize("n", [1, 2, 3, 64, 1000, 4097])
def test_feistel_is_a_permutation(n):
    f = training_order.Feistel(n, "k")
    slots = f.slot(range(n))
    assert sorted(slots) == list(range(n)) and (f.number(slots) == np.arange(n)).all()
    assert n < 64 or (slots != training_order.Feistel(n, "other").slot(range(n))).any()


def test_shards_round_trip_and_resume(spark, docs, reference):
    how = {"length": 8, "per_shard": 16}
    manifest = training_order.write_shards(docs(ROWS, "ids", "part", "shard"), BPE, scratch_path(spark, "t"), "key", **how)
    got = training_order.read_sequences(manifest, "key", **how).collect()
    n = len(got)
    assert sorted(r.slot for r in got) == sorted(r.number for r in got) == list(range(n))
    assert all(r.shard == r.slot // 16 and r.byte == r.slot % 16 * 16 and len(r.ids) == 16 for r in got)
    stream = np.frombuffer(b"".join(bytes(r.ids) for r in sorted(got, key=lambda r: r.number)), dtype="<u2").tolist()
    found, doc = collections.Counter(), []
    for x in stream:
        if x == 50256:
            found[tuple(doc)] += 1
            doc = []
        else:
            doc.append(x)
    want = collections.Counter(tuple(reference(t)) for _, t in ROWS)
    assert not want - found and set(found - want) <= {()} and sum((found - want).values()) < 8
    late = training_order.read_sequences(manifest, "key", **how, from_slot=n - 19).collect()
    assert sorted((r.slot, bytes(r.ids)) for r in late) == sorted((r.slot, bytes(r.ids)) for r in got if r.slot >= n - 19)
    empty = training_order.write_shards(docs([]), BPE, scratch_path(spark, "t"), "key")
    assert empty.count() == 0 and training_order.read_sequences(empty, "key").count() == 0


def test_shards_depend_on_rows_and_key_alone(spark, docs):
    """The same shards from other partitions of the rows, and a task for each shard that is read."""
    how = {"length": 8, "per_shard": 16}
    found = []
    for n in (1, 4, 7):
        manifest = training_order.write_shards(docs(ROWS).repartition(n), BPE, scratch_path(spark, "t"), "key", **how)
        read = training_order.read_sequences(manifest, "key", **how)
        found.append({r.slot: (r.number, bytes(r.ids)) for r in read.collect()})
        shards = manifest.count()
        assert shards > 20 and read.rdd.getNumPartitions() == read.select(F.spark_partition_id()).distinct().count() == shards
    assert found[0] == found[1] == found[2]
    late = training_order.read_sequences(manifest, "key", **how, from_slot=shards * 16 - 40)
    assert late.rdd.getNumPartitions() == late.select(F.spark_partition_id()).distinct().count() == 3


# -- sampled segmentations


def segmentations(model, text):
    """All segmentations of a short text with their log probabilities, by plain recursion."""
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    spelled = lattice.BLANK + text.replace(" ", lattice.BLANK)
    out = []

    def go(i, ids, lp):
        if i == len(spelled):
            out.append((tuple(ids), lp))
        for j in range(i + 1, len(spelled) + 1):
            k = sp.piece_to_id(spelled[i:j])
            if k != sp.unk_id() and not sp.is_control(k):
                go(j, ids + [k], lp + model.weight[k])
        c = spelled[i : i + 1]
        if c and sp.piece_to_id(c) == sp.unk_id():
            raw = c.encode()
            go(i + 1, ids + [model.byte_ids[b] for b in raw], lp + len(raw) * model.byte_weight)

    go(0, [], 0.0)
    total = math.log(sum(math.exp(x) for _, x in out))
    return {ids: math.exp(x - total) for ids, x in out}


def draw(texts, keys, k, seed=0, alpha=1.0):
    steps = list(lattice.top_k(texts, keys, lattice.pieces(PIECES, alpha), k, seed))
    threshold = steps.pop()
    out = [[] for _ in texts]
    for live, paths, size, whole, value, lat in steps:
        at, ids = lattice._id_lists(paths, lat, live, size)
        for j, d in enumerate(live):
            out[d].append((tuple(ids[at[j] : at[j + 1]].tolist()), whole[d], value[d]))
    return out, threshold


@pytest.mark.parametrize("text", ["the cat", "a  b", "né\nx"])
def test_draws_follow_the_exact_distribution(text):
    p = segmentations(lattice.pieces(PIECES, 0.7), text)
    n = 6000
    out, threshold = draw([text] * n, range(n), 2, alpha=0.7)
    first = collections.Counter(o[0][0] for o in out)
    second = collections.Counter(o[1][0] for o in out)
    for ids, q in p.items():
        assert abs(first[ids] / n - q) < 4 * math.sqrt(q / n) + 1e-3
        q2 = sum(a * q / (1 - a) for i, a in p.items() if i != ids)
        assert abs(second[ids] / n - q2) < 4 * math.sqrt(q2 / n) + 1e-3
    for o, t in zip(out[:500], threshold):
        assert o[0][2] > o[1][2] > t and o[0][0] != o[1][0]
        assert all(math.isclose(math.exp(lp), p[ids], rel_tol=1e-6) for ids, lp, _ in o)
    # importance weights make the sum over the drawn unbiased: the total probability is 1
    estimate = [sum(math.exp(lp) / -math.expm1(-math.exp(lp - t)) for _, lp, _ in o) for o, t in zip(out, threshold)]
    assert abs(np.mean(estimate) - 1) < 5 * np.std(estimate) / math.sqrt(n) + 1e-6


def test_all_segmentations_come_out_once():
    p = segmentations(lattice.pieces(PIECES, 1.0), "the")
    out, threshold = draw(["the"], [1], len(p) + 5)
    assert sorted(o[0] for o in out[0]) == sorted(p) and threshold[0] == -np.inf
    values = [o[2] for o in out[0]]
    assert values == sorted(values, reverse=True)


def test_words_that_differ_after_a_nul_have_lattices_of_their_own():
    texts = ["x\x00y", "x\x00z", "x\x00", "x"]
    out, _ = draw(texts, range(4), 2)
    assert all(lattice.decoded(ids, lattice.pieces(PIECES, 1.0)).decode() == t for t, o in zip(texts, out) for ids, _, _ in o)


def test_samples_of_rows(spark, docs, sf):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).collect()]
    rows = ROWS + [(1000 + i, t) for i, t in enumerate(texts)] + [(2000, "  two blanks"), (2001, f"a{BLANK}b {BLANK}"), (2002, BLANK), (2003, " "), (2004, "\x00 🙂\n")]
    df = docs(rows, "ids", "rank")
    model = lattice.pieces(PIECES, 1.0)
    got = lattice.sample_segmentations(df, PIECES).collect()
    by = collections.defaultdict(dict)
    for r in got:
        by[r.doc_id].setdefault(r["rank"], set()).add((tuple(r.ids), round(r.log_prob, 6), round(r.perturbed, 6), round(r.inclusion, 6)))
    for i, t in rows:
        t = t or ""
        ranks = by[i]
        if not t:
            assert ranks == {1: {((), 0.0, next(iter(ranks[1]))[2], 1.0)}}
            continue
        assert all(lattice.decoded(ids, model).decode() == t for s in ranks.values() for ids, *_ in s)
        assert BLANK in t or all(sp.decode(list(ids)) == t.removeprefix(" ") for s in ranks.values() for ids, *_ in s if t[:1] != " ")
        assert all(0 <= q <= 1 and lp <= 1e-9 for s in ranks.values() for _, lp, _, q in s)
        assert len({ids for s in ranks.values() for ids, *_ in s}) == sum(map(len, ranks.values()))
    text = {r.doc_id: r.text for r in lattice.decode(lattice.sample_segmentations(docs(rows[-9:]), PIECES), PIECES).collect()}
    assert text == {i: t or "" for i, t in rows[-9:]}
    again = lattice.sample_segmentations(df.repartition(3), PIECES).collect()  # other partitions and batches, same draws
    assert sorted((str(r.doc_id), r["rank"], r.ids) for r in again) == sorted((str(r.doc_id), r["rank"], r.ids) for r in got)
    assert lattice.sample_segmentations(docs([]), PIECES).count() == 0


def test_regions_left_out_change_nothing(monkeypatch):
    """The best regions of a text are found among the first steps: with all regions kept the draws are the same."""
    texts = [" ".join(f"some{i}thing{j}" for j in range(3 + 40 * (i % 4))) for i in range(40)]
    fast, bound = draw(texts, range(40), 4)
    monkeypatch.setattr(lattice, "NOISE", np.inf)
    slow, same = draw(texts, range(40), 4)
    assert [[x[0] for x in o] for o in fast] == [[x[0] for x in o] for o in slow] and np.allclose(bound, same)
