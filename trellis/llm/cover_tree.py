"""Hard negatives by exact inner-product search in cover trees.

A candidate x gets one more coordinate, sqrt(M^2 - |x|^2) with M the largest norm, so all candidates lie on
one sphere; a query gets a zero there and keeps its inner products. A node is a ball around one of its
candidates whose radius covers all it holds, so by Cauchy and Schwarz q.x differs from q.centre by |q| times
the radius at most. A search goes down best bound first, leaves out nodes outside its window or under the
scores it already has, and takes exact scores in the leaves.

The top of the tree (a farthest-first net over a bounded sample, with covering radii measured over all rows)
deals the candidates into cells, a cell into blocks of bounded size; each block holds a tree of its own, one
row of a written table. A query meets the blocks of the cells that its bounds admit, by an equi-join.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trellis.llm.common import join_counted, materialise

#: Rows of the sample from which the cells' centres are taken, and cells at most.
SAMPLE = 4096
CELLS = 256
#: Rows of a block: the square root of all rows times 16, within these limits.
BLOCK_ROWS = (4096, 65536)
#: A node with so many candidates or fewer is a leaf; a node has so many children at most.
LEAF = 256
FANOUT = 32
#: Queries that travel in a row; rows of queries that meet one copy of a tree (more queries: more copies); tasks of a search at most.
PACK = 256
PACKS_PER_TASK = 256
MOST_TASKS = 100_000
#: Added to bounds, relative to the products they are made of: more than rounding can take away.
SLACK = 1e-9
#: Squared norms stay below this, so scores fit 64 bits.
LARGEST = 2.0**62


class Tree:
    """Candidates ``points`` (integers), ``labels`` and sorted ``ids`` (a list for each), in the order of the leaves.

    Node i covers the points from ``first[i]`` to ``last[i]`` within ``radius[i]`` of ``centre[i]``; its children, if any, are
    the nodes from ``child[i]`` to ``child_end[i]``. ``norm2``: the squared norm that all candidates are lifted to.
    """

    def __init__(self, points: np.ndarray, labels: np.ndarray, ids: list[list[int]], norm2: float, leaf: int = LEAF, fanout: int = FANOUT):
        exact = norm2 < 2.0**53  # whole numbers that doubles hold
        self.points = points.astype(np.float64 if exact else np.int64)
        lifted = np.column_stack([points.astype(np.float64), np.sqrt(np.maximum(0.0, norm2 - (points.astype(np.float64) ** 2).sum(1)))])
        nodes, order = [[0, 0, len(points), self._far(lifted, 0).max(initial=0.0), 0, 0]], np.arange(len(points))
        at = 0
        while at < len(nodes):  # nodes are appended level by level, children of one node next to each other
            centre, lo, hi, radius = nodes[at][:4]
            if hi - lo > leaf and radius > 0:
                nodes[at][4] = len(nodes)
                held = order[lo:hi].copy()
                for c, mine, r in self._net(lifted, held, centre, radius, fanout):
                    order[lo : lo + len(mine)] = mine
                    nodes.append([c, lo, lo + len(mine), r, 0, 0])
                    lo += len(mine)
                nodes[at][5] = len(nodes)
            at += 1
        self.centre, self.first, self.last, self.radius, self.child, self.child_end = (np.array(x) for x in zip(*nodes))
        self.centres = self.points[self.centre]
        self.lengths = np.sqrt((self.centres.astype(np.float64) ** 2).sum(1))
        self.label_names, codes = np.unique(labels, return_inverse=True)
        self.label_names = self.label_names.tolist()
        self.points, self.labels, self.ids = self.points[order], codes[order], [ids[i] for i in order]

    @staticmethod
    def _far(lifted: np.ndarray, centre: int, held=slice(None)) -> np.ndarray:
        return np.sqrt(((lifted[held] - lifted[centre]) ** 2).sum(1)) * (1 + 1e-12)

    @classmethod
    def _net(cls, lifted, held, centre, radius, fanout):
        """Children of a node: centres farthest from those taken, its own first, until half its radius covers all or there are
        ``fanout``; each candidate goes to the nearest, so a child is smaller than its node."""
        near = cls._far(lifted, centre, held)
        taken, owner = [centre], np.zeros(len(held), np.int64)
        while len(taken) < fanout and near.max() > radius / 2:
            taken.append(int(held[near.argmax()]))
            far = cls._far(lifted, taken[-1], held)
            closer = far < near
            owner[closer], near[closer] = len(taken) - 1, far[closer]
        for i, c in enumerate(taken):
            mine = owner == i
            yield c, held[mine], float(near[mine].max())

    def search(self, queries: np.ndarray, labels: list, same_label: bool, asked: np.ndarray, lowest: np.ndarray, highest: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
        """For each search the first ``k`` (score, id) with a score from ``lowest`` to ``highest``, higher scores first, then smaller ids.

        Search i asks for query ``asked[i]``, among the candidates of its label or of the others. The searches go down together: the
        node with the best bound of any comes first, with those searches that its bounds admit; what a leaf holds
        is scored exactly for all of them at once."""
        kind = self.points.dtype
        none = -np.inf if kind == np.float64 else np.iinfo(np.int64).min
        queries = queries.astype(kind)
        lengths = np.sqrt((queries.astype(np.float64) ** 2).sum(1))
        code = {x: i for i, x in enumerate(self.label_names)}
        wanted = np.array([code.get(x, -1) for x in labels])
        top = np.full((len(asked), k), none, dtype=kind)  # best scores so far
        least = lowest.astype(kind)  # what a candidate must reach
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        heap: list[tuple[float, int, np.ndarray, np.ndarray]] = []

        def push(lo: int, hi: int, searches: np.ndarray) -> None:
            of, where = np.unique(asked[searches], return_inverse=True)
            middle = (self.centres[lo:hi] @ queries[of].T).astype(np.float64)
            reach = (self.radius[lo:hi] + SLACK * (self.lengths[lo:hi] + self.radius[lo:hi]))[:, None] * lengths[of] + SLACK
            most = (middle + reach)[:, where]
            fits = ((middle - reach)[:, where] <= highest[searches]) & (most >= least[searches])
            for node in np.flatnonzero(fits.any(1)).tolist():
                mine = fits[node]
                heapq.heappush(heap, (-float(most[node][mine].max()), lo + node, searches[mine], most[node][mine]))

        push(0, 1, np.flatnonzero(lowest <= highest))
        while heap:
            _, node, searches, most = heapq.heappop(heap)
            searches = searches[most >= least[searches]]
            if not len(searches):
                continue
            if self.child[node]:
                push(int(self.child[node]), int(self.child_end[node]), searches)
                continue
            lo, hi = self.first[node], self.last[node]
            of, where = np.unique(asked[searches], return_inverse=True)
            exact = queries[of] @ self.points[lo:hi].T
            exact[(self.labels[lo:hi] == wanted[of][:, None]) != same_label] = none
            exact = exact[where]
            exact[(exact > highest[searches][:, None]) | (exact < least[searches][:, None])] = none
            best = np.concatenate([top[searches], exact], axis=1)
            top[searches] = best = np.partition(best, best.shape[1] - k, axis=1)[:, best.shape[1] - k :]
            least[searches] = np.maximum(least[searches], best[:, 0])
            row, place = np.nonzero((exact >= least[searches][:, None]) & (exact > none))
            found.append((searches[row], exact[row, place].astype(np.int64), place + lo))
        out: list[list[tuple[int, int]]] = [[] for _ in asked]
        if found:
            who, score, place = (np.concatenate(x) for x in zip(*found))
            for i, s, at in zip(*(x[score >= least[who]].tolist() for x in (who, score, place))):
                out[i] += [(-s, vec_id) for vec_id in self.ids[at][:k]]
        return [[(-s, i) for s, i in sorted(items)[:k]] for items in out]


#: Bounds of a search without a window.
NO_WINDOW = (-(1 << 62), 1 << 62)


def window_of(score: int, low: int, high: int) -> tuple[int, int]:
    """Whole scores s with low * score <= 100 * s <= high * score."""
    return -(-low * score // 100), high * score // 100


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Lists of integers as rows, shorter ones filled up with zeros."""
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]] if len(column) else np.empty(0, np.int64)
    size = np.diff(offsets)
    out = np.zeros((len(size), dims), np.int64)
    if (size == dims).all():
        return flat.astype(np.int64).reshape(len(size), dims)
    out[np.arange(dims) < size[:, None]] = flat
    return out


def _integers(df: DataFrame, anchor: Column, id_col: str, label_col: str, vec_col: str, scale: int) -> DataFrame:
    """Rows that take part: ``vec_id, label, anchor, v`` (integers) and ``norm2``."""
    fine = F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
        F.transform(F.col(vec_col), lambda x: x.cast("double")).alias("raw"),
    ).filter("vec_id IS NOT NULL AND label IS NOT NULL AND raw IS NOT NULL").filter(fine)
    whole = rows.withColumn("whole", F.transform("raw", lambda x: F.floor(F.least(F.greatest(x * scale, F.lit(-(2.0**40))), F.lit(2.0**40))).cast("double")))
    norm2 = F.aggregate("whole", F.lit(0.0), lambda a, x: a + x * x)
    return whole.select("vec_id", "label", "anchor", F.transform("whole", lambda x: x.cast("long")).alias("v"), norm2.alias("norm2"))


def _points(rows: DataFrame, keep: int) -> DataFrame:
    """Each different vector and label once, with its ``keep`` smallest ids: the others of them can be among no first ``keep``."""
    rows = rows.groupBy("vec_id", "label", "v").agg(F.first("norm2").alias("norm2"))
    place = F.row_number().over(Window.partitionBy("v", "label").orderBy("vec_id"))
    least = rows.withColumn("place", place).filter(F.col("place") <= keep)
    return least.groupBy("v", "label").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.first("norm2").alias("norm2"))


class Index:
    """Blocks of cover trees over the candidates ``rows``, as a written table ``cell, block, tree``."""

    def __init__(self, rows: DataFrame, keep: int):
        self.spark = rows.sparkSession
        points = materialise(_points(rows, keep).withColumn("salt", F.xxhash64("v", "label")), "points")
        n, norm2, dims = points.agg(F.count("*"), F.coalesce(F.max("norm2"), F.lit(0.0)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
        if norm2 >= LARGEST:
            raise ArithmeticError(f"scores up to {norm2:.3g} do not fit 64 bits")
        self.dims, self.norm2, norm2 = dims, norm2, float(norm2)
        block_rows = min(max(BLOCK_ROWS[0], 16 * math.isqrt(n)), BLOCK_ROWS[1])
        sample = points.orderBy("salt", "label", "v").limit(SAMPLE).select("v").collect()
        centres = self._centres([list(r["v"]) for r in sample], min(CELLS, max(1, n // block_rows)))
        routed = materialise(self._routed(points, centres), "routed")
        cells = {r["cell"]: r for r in routed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()}
        self.centres = centres[sorted(cells)]
        self.radius = np.array([cells[c]["radius"] for c in sorted(cells)])
        blocks = [-(-cells[c]["n"] // block_rows) for c in sorted(cells)]
        self.blocks = np.array(blocks, dtype=np.int64)  # of each cell
        self.first_block = np.cumsum(self.blocks) - self.blocks
        number = {c: i for i, c in enumerate(sorted(cells))}
        shape = self.spark.createDataFrame([(c, int(self.first_block[i]), int(self.blocks[i])) for c, i in number.items()], "cell int, first long, parts long")
        dealt = routed.join(F.broadcast(shape), "cell").withColumn("block", F.col("first") + F.pmod("salt", "parts")).select("block", "v", "label", "ids")

        def grow(table: pa.Table) -> pa.Table:
            ids = table.column("ids").to_pylist()
            table = table.take(pa.array(sorted(range(len(ids)), key=lambda i: ids[i][0])))
            tree = Tree(_matrix(table.column("v").combine_chunks(), dims), table.column("label").to_numpy(), sorted(ids, key=lambda x: x[0]), norm2)
            return pa.table({"block": table.column("block")[:1], "tree": pa.array([pickle.dumps(tree)], pa.binary())})

        self.trees = materialise(dealt.groupBy("block").applyInArrow(grow, "block long, tree binary"), "cover-trees")

    def _centres(self, sample: list[list[int]], n: int) -> np.ndarray:
        """Farthest-first net of ``n`` points of the sample, lifted."""
        points = np.zeros((max(1, len(sample)), self.dims))
        for i, v in enumerate(sample):
            points[i, : len(v)] = v
        lifted = np.column_stack([points, np.sqrt(np.maximum(0.0, self.norm2 - (points**2).sum(1)))])
        taken, near = [0], Tree._far(lifted, 0)
        while len(taken) < n and near.max() > 0:
            taken.append(int(near.argmax()))
            near = np.minimum(near, Tree._far(lifted, taken[-1]))
        return lifted[taken]

    def _routed(self, points: DataFrame, centres: np.ndarray) -> DataFrame:
        """Candidates with the nearest centre and the distance to it."""
        dims, norm2 = self.dims, self.norm2

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, len(whole), 4096):
                    b = whole.slice(at, 4096)
                    v = _matrix(b.column(0), dims).astype(np.float64)
                    lifted = np.column_stack([v, np.sqrt(np.maximum(0.0, norm2 - (v**2).sum(1)))])
                    cell = np.argmin(-2 * lifted @ centres.T + (centres**2).sum(1), axis=1)
                    far = np.sqrt(((lifted - centres[cell]) ** 2).sum(1)) * (1 + 1e-12)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(far)], names=["v", "label", "ids", "salt", "cell", "far"])

        label = points.schema["label"].dataType.simpleString()
        return points.select("v", "label", "ids", "salt").mapInArrow(run, f"v array<long>, label {label}, ids array<long>, salt long, cell int, far double")

    def search(self, queries: DataFrame, n_queries: int, k: int, same_label: bool, low: int = 0, high: int = 0) -> DataFrame:
        """``qid, mark, score, vec_id``: the first ``k`` candidates of a query and mark in each block it looks into.

        ``queries``: ``qid, label, v``; ``marks`` (scores, each of which asks for the window of ``low`` to ``high`` per cent; null: one
        search without a window and a null mark); ``home``: look into the nearest cell alone, or into all others that may hold scores
        from ``least`` on. Each block's tree is followed in its task by the queries, 256 in a row, that look into it.
        """
        centres, radius, blocks, first_block, dims = self.centres, self.radius, self.blocks, self.first_block, self.dims
        n_packs = -(-n_queries // PACK)
        parts = max(1, -(-n_packs // PACKS_PER_TASK))
        met = "block long, part int, kind int, data binary"

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A row for each block and each pack of queries with one that has to look into it."""
            number = TaskContext.get().partitionId() - 1
            for whole in batches:
                for at in range(0, len(whole), PACK):
                    b, number = whole.slice(at, PACK), number + 1
                    v = _matrix(b.column(2), dims).astype(np.float64)
                    middle = v @ centres[:, :-1].T
                    reach = np.sqrt((v**2).sum(1))[:, None] * (radius + SLACK * (np.sqrt((centres**2).sum(1)) + radius)) + SLACK
                    nearest, wanted, rows = middle.argmax(1), np.zeros(middle.shape, bool), b.to_pylist()
                    for i, r in enumerate(rows):
                        if r["marks"] is not None:
                            for m in r["marks"]:
                                lowest, highest = window_of(m, low, high)
                                wanted[i] |= (lowest <= highest) & (middle[i] + reach[i] >= lowest) & (middle[i] - reach[i] <= highest)
                        elif not r["home"]:
                            wanted[i] = middle[i] + reach[i] >= (-math.inf if r["least"] is None else r["least"])
                        if r["marks"] is None:
                            wanted[i, nearest[i]] = r["home"]
                    items = [(r["qid"], r["label"], r["v"] + [0] * (dims - len(r["v"])), r["marks"]) for r in rows]
                    for cell in np.flatnonzero(wanted.any(0)).tolist():
                        data = pickle.dumps([items[i] for i in np.flatnonzero(wanted[:, cell])])
                        held = range(int(first_block[cell]), int(first_block[cell] + blocks[cell]))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(held, pa.int64()), pa.array([number % parts] * len(held), pa.int32()), pa.array([1] * len(held), pa.int32()),
                             pa.array([data] * len(held), pa.binary())],
                            names=["block", "part", "kind", "data"],
                        )

        def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree = None
            for b in batches:
                for kind, data in zip(b.column(2).to_pylist(), b.column(3)):
                    if kind == 0:
                        tree = pickle.loads(data.as_py())
                        continue
                    qids, labels, vectors, marks = zip(*pickle.loads(data.as_py()))
                    asks = [(i, m) for i, of in enumerate(marks) for m in (of if of is not None else [None])]
                    windows = np.array([NO_WINDOW if m is None else window_of(m, low, high) for _, m in asks], dtype=np.int64)
                    found = tree.search(np.array(vectors, dtype=np.int64), labels, same_label, np.array([i for i, _ in asks]), windows[:, 0], windows[:, 1], k)
                    out = [(qids[i], m, s, j) for (i, m), items in zip(asks, found) for s, j in items]
                    cols = list(zip(*out)) or [[], [], [], []]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["qid", "mark", "score", "vec_id"]
                    )

        asked = queries.select("qid", "label", "v", "marks", "home", "least").repartition(max(1, -(-n_packs // 4)))
        packs = asked.mapInArrow(visit, met)
        trees = self.trees.select("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("kind"), F.col("tree").alias("data"))
        tasks = max(1, min(int(self.blocks.sum()) * parts, MOST_TASKS))
        together = trees.unionAll(packs).repartitionById(tasks, F.pmod(F.col("block") * parts + F.col("part"), F.lit(tasks)).cast("int"))
        found = together.sortWithinPartitions("block", "part", "kind").mapInArrow(descend, "qid string, mark long, score long, vec_id long")
        return found


def _first(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid", "mark").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def hard_negatives(
    df: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", scale: int = 256, positives: int = 5,
    negatives: int = 3, low: int = 50, high: int = 95,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: hard negatives of every row for which ``anchor`` holds.

    A score is the inner product of vectors whose components are floor(scale * x); higher ones come first, ties by smaller id. An
    anchor's positives are its first ``positives`` other rows of its label; for each, the first ``negatives`` rows of other labels whose
    score is ``low`` to ``high`` per cent of the positive's. All rows are searched exactly.

    Rows with a null id, label or vector or a null, infinite or NaN component take no part, nor do they as anchors. Shorter vectors are filled up with zeros;
    rows equal in id, label and vector count once; an anchor without positives or negatives gives no rows, nor does an empty
    table. Squared norms from 2^62 on raise ``ArithmeticError``. Other columns are not read.
    """
    rows = materialise(_integers(df, anchor, id_col, label_col, vec_col, scale), "integers")
    index = Index(rows, max(positives + 1, negatives))
    qid = F.sha2(F.concat_ws(" ", F.col("v").cast("array<string>"), F.col("label").cast("string")), 256)
    anchors = materialise(rows.filter("anchor").select("vec_id", "label", "v", qid.alias("qid")).dropDuplicates(["vec_id", "qid"]), "anchors")
    n = F.count("*").alias("n")
    queries = materialise(anchors.groupBy("qid").agg(F.first("label").alias("label"), F.first("v").alias("v"), n), "queries")
    n_queries, n_anchors = queries.agg(n, F.coalesce(F.sum("n"), F.lit(0))).first()
    none, k = F.lit(None).cast("array<long>").alias("marks"), positives + 1  # the anchor may be among the first

    ask = queries.select("qid", "label", "v", none, F.lit(True).alias("home"), F.lit(None).cast("long").alias("least"))
    home = materialise(_first(index.search(ask, n_queries, k, True), k).drop("rank"), "home-cells")
    least = home.groupBy("qid").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
    ask = queries.select("qid", "label", "v", none, F.lit(False).alias("home")).join(least, "qid", "left")
    found = _first(home.unionAll(index.search(ask, n_queries, k, True)), k)
    found = materialise(found.select("qid", "rank", "score", "vec_id"), "positives")

    marks = found.groupBy("qid").agg(F.collect_set("score").alias("marks"))
    ask = queries.join(marks, "qid").select("qid", "label", "v", "marks", F.lit(False).alias("home"), F.lit(None).cast("long").alias("least"))
    hard = _first(index.search(ask, n_queries, negatives, False, low, high), negatives)

    # what one query found is at most (positives + 1) * negatives rows, which travel as one
    lists = found.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("near"))
    hard = hard.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("mark", "rank", "vec_id", "score"))).alias("hard"))
    answers = queries.select("qid", "n").join(lists, "qid").join(hard, "qid")
    met = join_counted(anchors.select("vec_id", "qid"), answers, "qid", "n", n_anchors)
    near = F.slice(F.filter("near", lambda p: p["vec_id"] != F.col("vec_id")), 1, positives)
    pairs = met.select(F.col("vec_id").alias("anchor_id"), F.explode(near).alias("p"), "hard")
    pairs = pairs.select("anchor_id", "p", F.explode(F.filter("hard", lambda x: x["mark"] == F.col("p.score"))).alias("x"))
    return pairs.select(
        "anchor_id", F.col("p.vec_id").alias("positive_id"), F.col("x.rank").alias("rank"), F.col("x.vec_id").alias("negative_id"),
        F.col("p.score").alias("positive_score"), F.col("x.score").alias("negative_score"),
    )
