"""Sampled segmentations without replacement: Gumbel top-k over the piece lattice.

The lattice of a text holds every way to spell it with the pieces of a public
``sentencepiece`` file (bytes where a character has no piece). A segmentation has the
probability that its pieces' weights give it among all of the text. Adding a Gumbel
variable to each log probability and taking the k largest draws k segmentations without
replacement; perturbed A* search finds them without listing any other. The whole lattice
starts as one region whose largest perturbed value is known in distribution. Popping the
best region draws its best segmentation from the top down and splits what remains: for
each edge on the way, the segmentations that agree up to it and leave it there are a
region, whose largest value is drawn given that it stays below the popped one.

No piece crosses from one word into the next (a word starts at the blank before it; marks that end it are one of their own), so
the lattice is the chain of the lattices of its words; these are built once per distinct
word of a batch, and all texts of a batch take their steps together in numpy.

The file is a byte-pair model: it has merge ranks, not log probabilities. The weights
here are those of Zipf's law over the ranks, ``1 / (rank + SHIFT) ** alpha``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import slices, texts_of

BLANK = "▁"
_LITERAL = "\udc81"  # the same character standing in a text: no text holds a lone surrogate, and no piece holds this one
SHIFT = 2.7
SLICE_BYTES = 3 << 19
NOISE = 37.0  # no Gumbel variable made from ``uniform`` exceeds its mean by so much
_WORD = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
_LETTER, _MARK = "A-Za-zÀ-ÖØ-öø-ʯ", ".,;:!?"
# the same with the marks at a word's end apart, where no piece holds a letter and a mark after it
_WORD_MARKS = re.compile(f"{BLANK}*[{_LETTER}]+(?={BLANK}|[{_MARK}]*(?:{BLANK}|$))|[{_MARK}]+(?={BLANK}|$)|{BLANK}*[^{BLANK}]+|{BLANK}+")


_BASE = np.uint64(0x100000001B3)


class Pieces:
    """Pieces of a model file with their ids and log weights, and by length their hashes to find them in texts."""

    def __init__(self, path: str, alpha: float = 1.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.byte_ids: dict[int, int] = {}
        rows = []
        for i in range(n):
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                continue
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                continue
            if BLANK in piece.lstrip(BLANK):
                raise ValueError(f"piece {piece!r} spans words")
            rows.append((piece, i, min(-sp.get_score(i), float(n))))
        crossing = re.compile(f"[{_LETTER}][{_MARK}]")
        self.split = (_WORD if any(crossing.search(p) for p, _, _ in rows) else _WORD_MARKS).findall
        total = sum((r + SHIFT) ** -alpha for _, _, r in rows)
        self.weight = np.zeros(n)
        by_length: dict[int, list[tuple[str, int]]] = {}
        for piece, i, r in rows:
            self.weight[i] = -alpha * np.log(r + SHIFT) - np.log(total)
            by_length.setdefault(len(piece), []).append((piece, i))
        self.byte_weight = -alpha * np.log(n + SHIFT) - np.log(total)
        self.bytes_of = [b""] * n  # what an id stands for in a text
        for piece, i, _ in rows:
            self.bytes_of[i] = piece.replace(BLANK, " ").encode()
        for byte, i in self.byte_ids.items():
            self.bytes_of[i] = bytes([byte])
        # length -> (sorted hashes, ids, characters, places by upper hash bits); and the bits of all beginnings of pieces
        self.tables = {}
        self.prefixes = {k: np.zeros(1 << 20, bool) for k in range(1, max(by_length) + 1)}
        for size, found in by_length.items():
            codes = np.array([[ord(c) for c in p] for p, _ in found], dtype=np.uint64)
            h = np.zeros(len(found), np.uint64)
            for k in range(size):
                h = self.roll(h, codes[:, k])
                self.prefixes[k + 1][self.slot(h)] = True
            order = np.argsort(h)
            h = h[order]
            place = np.full(1 << 20, -1, np.int32)  # by upper hash bits: the place among the sorted hashes, -2 where several share them
            slots, count = np.unique(self.slot(h), return_counts=True)
            place[self.slot(h)] = np.arange(len(h))
            place[slots[count > 1]] = -2
            self.tables[size] = (h, np.array([i for _, i in found])[order], codes[order], place)
        self.longest = max(self.tables)

    @staticmethod
    def roll(h: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Hash of a string with one more character."""
        with np.errstate(over="ignore"):
            return (h ^ code) * _BASE

    @staticmethod
    def slot(h: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)

    def matches(self, codes: np.ndarray, left: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """(positions, length, piece ids) of all pieces in the characters; ``left``: characters up to the word's end.
        Candidates by hash are compared character by character."""
        at = np.arange(len(codes))
        h = np.zeros(len(codes), np.uint64)
        for size in range(1, self.longest + 1):
            more = left[at] >= size
            at, h = at[more], h[more]
            if not len(at):
                return
            h = self.roll(h, codes[at + size - 1])
            slot = self.slot(h)
            more = self.prefixes[size][slot]  # only what some piece begins with can grow into one
            at, h, slot = at[more], h[more], slot[more]
            if size not in self.tables:
                continue
            hashes, ids, chars, place = self.tables[size]
            k = place[slot]
            maybe = np.flatnonzero(k != -1)
            k = k[maybe]
            shared = np.flatnonzero(k == -2)
            k[shared] = np.minimum(np.searchsorted(hashes, h[maybe[shared]]), len(hashes) - 1)
            same = hashes[k] == h[maybe]
            maybe, k = at[maybe[same]], k[same]
            exact = (codes[maybe[:, None] + np.arange(size)] == chars[k]).all(axis=1)
            yield maybe[exact], size, ids[k[exact]]


@cache
def pieces(path: str, alpha: float) -> Pieces:
    return Pieces(path, alpha)


class Lattices:
    """Lattices of distinct words in flat arrays: nodes are positions, edges are sorted by their start node.

    ``cum`` holds for each edge the running probability at its start node.
    """

    def __init__(self, words: list[str], model: Pieces):
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        self.first = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))  # start node of each word
        nodes = int((lengths + 1).sum())
        self.last = np.zeros(nodes, bool)
        self.last[self.first + lengths] = True
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        left = np.repeat(lengths, lengths) - _runs(lengths)
        node_of = (np.arange(len(codes)) + np.repeat(np.arange(len(words)), lengths)).astype(np.int32)
        found = list(model.matches(codes, left))  # by length, positions rise
        lone = np.ones(len(codes), bool)  # characters that are no piece
        for at, size, _ in found:
            if size == 1:
                lone[at] = False
        lone = np.flatnonzero(lone)
        self.spelled = [[model.byte_ids[b] for b in chr(c).replace(_LITERAL, BLANK).encode("utf-8", "surrogatepass")] for c in codes[lone].tolist()]
        found.append((lone, 1, -1 - np.arange(len(lone))))
        # a node has one edge of each length at most, so edges go straight to their places: shorter ones first, a lone character last
        self.head = np.zeros(nodes + 1, np.int64)
        for at, _, _ in found:
            self.head[node_of[at] + 1] += 1
        self.head = np.cumsum(self.head)
        free = self.head[:-1].copy()
        edges = int(self.head[-1])
        self.start = np.repeat(np.arange(nodes, dtype=np.int32), np.diff(self.head))
        self.end, self.value = np.empty(edges, np.int32), np.empty(edges, np.int32)
        for at, size, ids in found:
            node = node_of[at]
            place = free[node]
            free[node] += 1
            self.end[place], self.value[place] = node + size, ids
        bytes_of = np.array([len(x) for x in self.spelled], dtype=np.int64)
        weight = np.where(self.value >= 0, model.weight[np.maximum(self.value, 0)], 0.0)
        if len(bytes_of):
            weight = np.where(self.value < 0, bytes_of[np.maximum(-1 - self.value, 0)] * model.byte_weight, weight)
        # backward sums, one distance from the word's end at a time (all words at once)
        over = np.repeat((self.first + lengths).astype(np.int32), lengths + 1)  # the end node of each node's word
        distance = over[self.start] - self.start
        back = np.zeros(nodes)
        by_distance = np.argsort(distance.astype(np.uint16) if len(distance) and distance.max() < 1 << 16 else distance, kind="stable")
        bounds = np.flatnonzero(np.diff(distance[by_distance], prepend=-1))
        for a, b in zip(bounds, [*bounds[1:], len(by_distance)]):
            e = by_distance[a:b]
            heads = np.flatnonzero(np.diff(self.start[e], prepend=-1))
            back[self.start[e[heads]]] = np.logaddexp.reduceat(weight[e] + back[self.end[e]], heads)
        self.logp = np.minimum(weight + back[self.end] - back[self.start], 0.0)
        self.p = np.exp(self.logp)
        running = np.cumsum(self.p)
        heads = np.flatnonzero(np.diff(self.start, prepend=-1))
        tails = np.append(heads[1:], len(self.start)) - 1
        before = np.repeat(running[heads] - self.p[heads], np.diff(np.append(heads, len(self.start))))
        self.cum = np.minimum(running - before, 1.0)
        self.cum[tails] = 1.0

    def pick(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The edge of each node where the running probability passes ``u`` (under 1); nodes have few."""
        e = self.head[node]
        on = np.flatnonzero(u >= self.cum[e])
        while len(on):
            e[on] += 1
            on = on[u[on] >= self.cum[e[on]]]
        return e


def uniform(seed: np.ndarray, stream: int, counter: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from integer hashes of (row seed, stream, counter)."""
    with np.errstate(over="ignore"):
        x = seed + np.uint64(stream) * np.uint64(0xD1B54A32D192ED03) + counter.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def _runs(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each length n, joined."""
    total = int(lengths.sum())
    return np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)


class _Paths:
    """Edges of one sample of every text, joined: edges, the word of each, and the texts' bounds."""

    def __init__(self, edges: np.ndarray, word: np.ndarray, bounds: np.ndarray):
        self.edges, self.word, self.bounds = edges, word, bounds


def _descend(lat: Lattices, node: np.ndarray, word: np.ndarray, seed: np.ndarray, stream: int) -> tuple[np.ndarray, np.ndarray]:
    """Random ways from each node to its word's end: edges in order, and the index into ``node`` of each."""
    order = np.argsort(node, kind="stable")  # neighbours in the lattice lie together in memory
    alive = order[~lat.last[node[order]]]
    at = node[alive]
    edges, owner, depth, step = [], [], [], 0
    while len(alive):
        u = uniform(seed[alive], stream, (word[alive] << 20) + step)
        e = lat.pick(at, u)
        edges.append(e)
        owner.append(alive)
        depth.append(np.full(len(alive), step))
        at = lat.end[e]
        on = ~lat.last[at]
        alive, at, step = alive[on], at[on], step + 1
    if not edges:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    edges, owner, depth = map(np.concatenate, (edges, owner, depth))
    count = np.bincount(owner, minlength=len(node))
    place = (np.cumsum(count) - count)[owner] + depth
    out, who = np.empty_like(edges), np.empty_like(owner)
    out[place], who[place] = edges, owner
    return out, who


def top_k(texts: list[str], keys: list[int], model: Pieces, k: int, seed: int = 0) -> Iterator[tuple]:
    """Per rank: (texts that have it, lists of ids as offsets and values, log probability, perturbed value); then the
    thresholds, the largest perturbed value of each text that was not drawn (-inf: nothing is left)."""
    n = len(texts)
    split = [model.split(BLANK + t.replace(BLANK, _LITERAL).replace(" ", BLANK)) if t else [] for t in texts]
    place: dict[str, int] = {}  # not pandas.factorize: it takes strings for equal that agree up to a NUL
    flat = np.array([place.setdefault(w, len(place)) for w in chain.from_iterable(split)], dtype=np.int64)
    lat = Lattices(list(place), model) if place else None
    count = np.array([len(ws) for ws in split], dtype=np.int64)
    doc_of_word = np.repeat(np.arange(n), count)
    word_no = _runs(count)  # number of the word in its text
    with np.errstate(over="ignore"):
        row_seed = np.array([x & (2**64 - 1) for x in keys], dtype=np.uint64) * np.uint64(0xA0761D6478BD642F) + np.uint64(seed)
    top = -np.log(-np.log(uniform(row_seed, 1, np.zeros(n, np.int64))))  # the Gumbel variable of the whole lattice
    starts = lat.first[flat] if lat else flat
    first_word = np.cumsum(count) - count

    # open regions of each text: (value, sample, step, log probability of the prefix, edges left out)
    regions: list[list[tuple]] = [[] for _ in range(n)]
    drawn: list[_Paths] = []
    for rank in range(k):
        if rank == 0:
            live = np.arange(n)
            value, from_step = top.copy(), np.zeros(n, np.int64)
            prefix_p, left_out = np.zeros(n), [()] * n
            edges, who = _descend(lat, starts, word_no, row_seed[doc_of_word], 100) if lat else (flat, flat)
            paths = _Paths(edges, who, np.searchsorted(doc_of_word[who] if lat else flat, np.arange(n + 1)))
        else:
            live = np.array([d for d in range(n) if regions[d]], dtype=np.int64)
            value, from_step, prefix_p, left_out = np.full(n, -np.inf), np.zeros(n, np.int64), np.zeros(n), [()] * n
            if not len(live):
                break
            u = uniform(row_seed, 200 + rank, np.zeros(n, np.int64)).tolist()
            leaves = []  # sample left, its edges before, the edge taken, the word there
            for d in live.tolist():
                best = max(range(len(regions[d])), key=lambda i: regions[d][i][0])
                value[d], s, t, prefix_p[d], left_out[d] = regions[d].pop(best)
                from_step[d] = t
                at = drawn[s].bounds[d] + t
                v = lat.start[drawn[s].edges[at]]
                first = int(lat.head[v])
                p = lat.p[first : lat.head[v + 1]].copy()
                p[[x - first for x in left_out[d]]] = 0
                sums = np.cumsum(p)
                leaves.append((s, first + min(int(np.searchsorted(sums, u[d] * sums[-1], side="right")), len(p) - 1), drawn[s].word[at]))
            s, e, w = (np.array(x, dtype=np.int64) for x in zip(*leaves))
            t = from_step[live]
            rest = first_word[live] + count[live] - w  # the word of the edge and all after it are walked anew
            words = np.repeat(w, rest) + _runs(rest)
            node = starts[words]
            node[np.cumsum(rest) - rest] = lat.end[e]
            more, who = _descend(lat, node, word_no[words] + (1 << 20), row_seed[doc_of_word[words]], 100 + rank)
            of_word = words[who]
            added = np.bincount(doc_of_word[of_word], minlength=n)
            size = np.zeros(n, np.int64)
            size[live] = t + 1
            bounds = np.concatenate(([0], np.cumsum(size + added)))
            edges, word = np.empty(bounds[-1], np.int64), np.empty(bounds[-1], np.int64)
            for k_old in range(rank):  # the edges before, from the sample that each text leaves
                mine = s == k_old
                here = np.repeat(bounds[live[mine]], t[mine]) + _runs(t[mine])
                there = np.repeat(drawn[k_old].bounds[live[mine]], t[mine]) + _runs(t[mine])
                edges[here], word[here] = drawn[k_old].edges[there], drawn[k_old].word[there]
            edges[bounds[live] + t], word[bounds[live] + t] = e, w
            here = np.repeat(bounds[:-1] + size, added) + _runs(added)
            edges[here], word[here] = more, of_word
            paths = _Paths(edges, word, bounds)
        drawn.append(paths)
        size = np.diff(paths.bounds)
        logp = lat.logp[paths.edges] if lat else np.empty(0)
        running = np.empty_like(logp)  # per text, so that a text's sums don't depend on its batch
        for a, b in zip(paths.bounds[:-1].tolist(), paths.bounds[1:].tolist()):
            np.cumsum(logp[a:b], out=running[a:b])
        whole = np.zeros(n)
        whole[size > 0] = running[paths.bounds[1:][size > 0] - 1]
        yield live, paths, size, whole, value, lat
        # regions beside the new sample, from the step where it left the old one
        # a Gumbel variable made from ``uniform`` stays within [-3.6, NOISE] of its location, so a region that lies
        # further behind k + 1 regions of the first steps can't come out on top: leaving it out changes nothing
        reach = np.full(n, -np.inf)
        for d in np.flatnonzero(size - from_step > k + 1).tolist():
            a = paths.bounds[d] + from_step[d]
            b = min(a + 64, paths.bounds[d + 1])
            with np.errstate(divide="ignore"):
                first = running[a : b - 1] + np.log1p(-np.minimum(lat.p[paths.edges[a + 1 : b]], 1.0))
            first = np.sort(first)[-(k + 1)]
            reach[d] = first - np.logaddexp(first - value[d], 3.7) - NOISE if first > -np.inf else -np.inf
        near = np.empty(len(running), bool)  # steps before which the sample's probability is not under that
        near[1:] = (running >= np.repeat(reach, size))[:-1]
        near[paths.bounds[:-1][size > 0]] = True
        for d in np.flatnonzero(from_step).tolist():
            near[paths.bounds[d] : paths.bounds[d] + from_step[d]] = False
        kept = np.flatnonzero(near)
        doc = np.searchsorted(paths.bounds, kept, side="right") - 1
        step, edge = kept - paths.bounds[doc], paths.edges[kept]
        before = np.where(step > 0, running[kept - 1], 0.0)
        heads = np.searchsorted(doc, np.arange(n + 1))
        with np.errstate(divide="ignore"):
            rest = np.log1p(-np.minimum(lat.p[edge], 1.0)) if lat else np.empty(0)
        for d in [d for d in live.tolist() if left_out[d]]:
            a = heads[d]  # the step where the sample left its forerunner
            out = lat.p[list(left_out[d])].sum() + lat.p[edge[a]]
            v = lat.start[edge[a]]
            rest[a] = np.log(1 - out) if out < 1 and len(left_out[d]) + 1 < lat.head[v + 1] - lat.head[v] else -np.inf
        mass = before + rest
        u = uniform(row_seed[doc], 300 + rank, step)
        with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
            # the maximum of the region's Gumbel variables, given that it stays below the value just drawn
            best = mass - np.logaddexp(mass - value[doc], np.log(-np.log(u)))
        best[np.isneginf(mass)] = -np.inf
        for _ in range(k - rank):
            full = np.diff(heads) > 0
            if not full.any():
                break
            most = np.full(n, -np.inf)
            most[full] = np.maximum.reduceat(best, heads[:-1][full])
            hits = np.flatnonzero((best == most[doc]) & ~np.isneginf(best))
            hits = hits[np.concatenate(([True], doc[hits][1:] != doc[hits][:-1]))] if len(hits) else hits
            for i in hits.tolist():
                d = int(doc[i])
                t = int(step[i])
                out = (*(left_out[d] if t == from_step[d] else ()), int(edge[i]))
                regions[d].append((float(best[i]), rank, t, float(mass[i]), out))
            best[hits] = -np.inf
    yield np.array([max((r[0] for r in rs), default=-np.inf) for rs in regions])


def _id_lists(paths: _Paths, lat: Lattices | None, live: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of the texts' id lists."""
    value = lat.value[paths.edges] if lat else np.empty(0, np.int64)  # only these texts have edges
    width = np.ones(len(value), np.int64)
    spelled = np.flatnonzero(value < 0)
    for i in spelled.tolist():
        width[i] = len(lat.spelled[-1 - value[i]])
    out = np.repeat(value, width)
    ends = np.cumsum(width)
    for i in spelled.tolist():
        out[ends[i] - width[i] : ends[i]] = lat.spelled[-1 - value[i]]
    total = np.concatenate(([0], ends))
    return total[np.concatenate(([0], np.cumsum(size[live])))], out


def decoded(ids: list[int], model: Pieces) -> bytes:
    """The text of an id list in UTF-8: its pieces in a row, bytes as they are, without the blank that stands before every text."""
    return b"".join(map(model.bytes_of.__getitem__, ids))[1:]


def decode(samples: DataFrame, path: str) -> DataFrame:
    """``samples`` (with ``ids``) with the ``text`` that each id list spells, exactly, leading blanks too.

    Null ids give a null text; ids that are control or unknown pieces stand for nothing; a column ``text`` is replaced."""
    kept = [c for c in samples.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path, 1.0)
        for whole in batches:
            for at in range(0, len(whole), 512):
                b = whole.slice(at, 512)
                texts = [None if x is None else decoded(x, model).decode() for x in b.column(b.schema.get_field_index("ids")).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in kept), pa.array(texts, pa.string())], names=[*kept, "text"])

    from pyspark.sql.types import StringType, StructType

    return samples.mapInArrow(run, StructType([f for f in samples.schema if f.name != "text"]).add("text", StringType()))


SAMPLES = "doc_id long, rank int, ids array<int>, n_ids int, log_prob double, perturbed double, inclusion double"


def sample_segmentations(
    df: DataFrame, path: str, k: int = 3, id_col: str = "doc_id", text_col: str = "text", seed: int = 0, alpha: float = 1.0
) -> DataFrame:
    """``doc_id, rank, ids, n_ids, log_prob, perturbed, inclusion``: up to ``k`` distinct segmentations per row, best perturbed value first.

    ``inclusion`` is the probability that the segmentation is among the drawn given the
    threshold (the largest perturbed value not drawn): 1 - exp(-exp(log_prob - threshold));
    log_prob - log(inclusion) weighs samples without bias. The draw is a function of the
    row's key, ``seed`` and text, not of partitions or retries (but for the rounding of
    the running sums that a step is looked up in, about one step in 10^9).

    Null and empty texts have one segmentation, the empty one (log_prob 0, inclusion 1); a
    text with fewer than ``k`` segmentations gives all; repeated rows give equal samples; a
    null key counts as 0; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path, alpha)
        for b in slices(batches, "text", SLICE_BYTES):
            ids = b.column(0).to_pylist()
            steps = list(top_k(texts_of(b, "text"), [x or 0 for x in ids], model, k, seed))
            threshold = steps.pop()
            for rank, (live, paths, size, whole, value, lat) in enumerate(steps):
                offsets, values = _id_lists(paths, lat, live, size)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
                with np.errstate(over="ignore"):
                    inclusion = -np.expm1(-np.exp(whole[live] - threshold[live]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[d] for d in live], pa.int64()), pa.array(np.full(len(live), rank + 1), pa.int32()), lists,
                     pa.array(np.diff(offsets), pa.int32()), pa.array(whole[live]), pa.array(value[live]), pa.array(inclusion)],
                    names=["doc_id", "rank", "ids", "n_ids", "log_prob", "perturbed", "inclusion"],
                )

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, SAMPLES)
