"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear support vector machine.

Spans are the words of a text (lower case, marks at the edges removed), words with inner
marks also without them, runs of single characters read as one word, so spelled-out
insults count, and windows of two or three words of a sentence, blanks included, so insults made
of ordinary words count. The kernel of two
spans sums, over all subsequences of three characters that fit a window of ``WINDOW``,
the product of their gap-weighted counts (``DECAY`` to the power of the stretch they
cover): inserted or dropped characters lengthen the stretch and cost a factor, no more.

Training rows are the spans of labelled texts' sentences: every span of a clean document is
negative; a toxic document is positive through its witness, the
span that its label and the machine trained so far support most. A window is a witness only where the label
supports it more than each of its words. Nyström maps a span to
its kernel with the landmarks (whitened), the machine is linear there, and both fold
into one weight per subsequence, which is all that scoring needs. Of a text's windows those are
scored whose first and last word resemble words of the witnesses; the text scores as its best span.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellis.llm.common import materialise, slices, texts_of

WINDOW, DECAY = 6, 0.75
MAX_PER_LABEL = 4000  # documents of each label that training looks at, chosen by id hash
MAX_SPANS = 300_000  # distinct clean words that reach the driver: half the most frequent, half by hash
MAX_WINDOWS = 2_000  # windows of words that may be witnesses: those the labels support most
MAX_CLEAN_WINDOWS = 60_000  # clean windows with a word of those, the most frequent
WINDOW_DOCS = 3  # toxic documents that hold such a window at least
RESEMBLES = 0.6  # kernel with a witness's word from which a word of a window counts as that word
# clean spans in the machine's first round: the most frequent, and others evenly by frequency; those added a round: the worst
FREQUENT, SPREAD, HARD = 2_000, 4_000, 1_500
WITNESSES = 6  # candidate spans per toxic document
LANDMARKS = 160
COST, CLEAN_COST = 10_000.0, 40_000.0  # total weight of toxic and of clean spans in the machine's loss
NO_SPAN = -10.0  # margin of a text without spans
CACHE = 300_000
# characters of spans and landmarks that one step of numpy takes; bytes of text whose spans, or windows, are held at once
PART_CHARS, PART_MARKS = 1 << 16, 256
SCORE_BYTES, CUT_BYTES = 1 << 19, 1 << 19
CUT_TASKS = 24  # tasks that cut the training texts into windows, so that none counts many at once

_EDGE = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum()) + "¡¿«»„“”‘’…–—"
_SPELLED = re.compile(r"(?<!\w)\w(?:[^\w\n]{1,3}\w(?!\w)){2,}")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_NON_WORD = re.compile(r"\W+")


def spans_of(text: str) -> set[str]:
    """Distinct spans of a text."""
    text = text.lower()
    out = {w.strip(_EDGE) for w in set(text.split())}
    out |= {_NON_WORD.sub("", w) for w in out if not w.isalnum()}
    for m in _SPELLED.finditer(text):
        out.add(_NON_WORD.sub("", m[0]))
    out.discard("")
    return out


def _bare(word: str) -> str:
    """A word as windows hold it, without marks."""
    return word if word.isalnum() else _NON_WORD.sub("", word)


def windows_of(text: str, wanted=None) -> set[str]:
    """Windows of two and three words of the text's sentences; with ``wanted`` those whose first and last word it accepts."""
    out = set()
    for sentence in _SENTENCE.split(text.lower()):
        words = [w for w in map(_bare, sentence.split()) if w]
        ends = range(len(words)) if wanted is None else [i for i, w in enumerate(words) if wanted(w)]
        held = set(ends)
        for i in ends:
            for j in (i + 1, i + 2):
                if j in held:
                    out.add(" ".join(words[i : j + 1]))
    return out


def parts(spans: list[str]) -> Iterator[tuple[int, list[str]]]:
    """The spans in runs of about ``PART_CHARS`` characters (one span at least), each with the place of its first."""
    start = chars = 0
    for i, s in enumerate(spans):
        chars += len(s) + 2
        if chars > PART_CHARS and i > start:
            yield start, spans[start:i]
            start, chars = i, len(s) + 2
    if start < len(spans):
        yield start, spans[start:]


def subsequences(spans: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(span index, code, weight) of the gapped triples of all spans, one pattern of gaps at a time.
    Spans carry a mark before and behind, so their edges count as characters."""
    codes = np.frombuffer("".join(f"\x02{s}\x03" for s in spans).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(spans)), [len(s) + 2 for s in spans])
    for j in range(2, WINDOW):
        if len(codes) <= j:
            return
        inside = np.flatnonzero(owner[j:] == owner[:-j])
        first, last, who = codes[inside], codes[inside + j] << np.uint64(42), owner[inside]
        for i in range(1, j):
            yield who, first | codes[inside + i] << np.uint64(21) | last, DECAY ** (j + 1)


def norms(spans: list[str]) -> np.ndarray:
    """Root of the self kernel of every span (equal triples add up before they are squared)."""
    out = np.empty(len(spans))
    step = DECAY ** np.arange(8)
    for i, part in parts(spans):
        # span, hash of the triple and its stretch in one sortable number
        keys = [np.empty(0, np.uint64)]
        for who, code, weight in subsequences(part):
            stretch = np.uint64(round(np.log(weight) / np.log(DECAY)))
            with np.errstate(over="ignore"):
                mixed = (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(23)
            keys.append(who.astype(np.uint64) << np.uint64(44) | mixed << np.uint64(3) | stretch)
        key = np.sort(np.concatenate(keys))
        heads = np.flatnonzero(np.diff(key >> np.uint64(3), prepend=np.uint64(2**61)))
        sums = np.add.reduceat(step[(key & np.uint64(7)).astype(np.int64)], heads) if len(key) else np.empty(0)
        total = np.bincount((key[heads] >> np.uint64(44)).astype(np.int64), weights=sums**2, minlength=len(part))
        out[i : i + len(part)] = np.sqrt(np.maximum(total, DECAY**12))
    return out


def kernel(spans: list[str], landmarks: list[str]) -> np.ndarray:
    """Kernel of every span with every landmark, normed to 1 for equal spans (float32)."""
    out = np.zeros((len(spans), len(landmarks)), np.float32)
    for first in range(0, len(landmarks), PART_MARKS):
        marks = landmarks[first : first + PART_MARKS]
        who, code, weight = (np.concatenate(x) for x in zip(*((w, c, np.full(len(c), v)) for w, c, v in subsequences(marks))))
        keys, at = np.unique(code, return_inverse=True)
        table = np.zeros((len(keys), len(marks)), np.float32)
        np.add.at(table, (at, who), weight / norms(marks)[who])
        columns = out[:, first : first + PART_MARKS]
        for i, part in parts(spans):
            for w, c, v in subsequences(part):
                k = np.minimum(np.searchsorted(keys, c), len(keys) - 1)
                hit = np.flatnonzero(keys[k] == c)
                for j in range(0, len(hit), 1 << 14):
                    some = hit[j : j + (1 << 14)]
                    np.add.at(columns, i + w[some], table[k[some]] * np.float32(v))
    out /= norms(spans)[:, None].astype(np.float32)
    return out


@dataclass
class Model:
    """One weight per subsequence; a document's margin is that of its best span."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    window_words: tuple[str, ...] = ()  # words of the witnesses that are windows
    slope: float = 1.0
    shift: float = 0.0

    def __post_init__(self):
        self.seen = np.zeros(1 << 20, bool)
        if len(self.keys):
            self.seen[self._slot(self.keys)] = True

    @staticmethod
    def _slot(codes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)

    def margins(self, spans: list[str]) -> np.ndarray:
        total = np.zeros(len(spans))
        for i, part in parts(spans) if len(self.keys) else ():
            of_part = total[i : i + len(part)]
            for w, c, v in subsequences(part):
                maybe = np.flatnonzero(self.seen[self._slot(c)])
                c, w = c[maybe], w[maybe]
                k = np.minimum(np.searchsorted(self.keys, c), len(self.keys) - 1)
                hit = self.keys[k] == c
                of_part += np.bincount(w[hit], weights=self.weights[k[hit]] * v, minlength=len(part))
            of_part /= norms(part)
        return total + self.bias


def _resembling(words: list[str], marks: tuple[str, ...]) -> set[str]:
    """Words whose kernel with one of ``marks`` is ``RESEMBLES`` or more."""
    found: set[str] = set()
    for i in range(0, len(words), 2_000):
        part = words[i : i + 2_000]
        found.update(part[j] for j in np.flatnonzero(kernel(part, list(marks)).max(axis=1) >= RESEMBLES))
    return found


def scorer(model: Model):
    """texts -> margins, with the margins of spans kept between calls (a bounded table)."""
    known: dict[str, float] = {}
    like: set[str] = set()  # of the known words those that resemble a witness's

    def learn(new: list[str]) -> None:
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            known.update(zip(part, model.margins(part).tolist()))

    def score(texts: list[str]) -> np.ndarray:
        if len(known) > CACHE:
            known.clear()
            like.clear()
        bags = [spans_of(t) for t in texts]
        new = list(set().union(*bags) - known.keys()) if bags else []
        learn(new)
        if model.window_words:
            like.update(_resembling([w for w in new if w.isalnum()], model.window_words))
            for bag, text in zip(bags, texts):
                if not like.isdisjoint(bag):
                    bag |= windows_of(text, like.__contains__)
            learn(list(set().union(*bags) - known.keys()) if bags else [])
        return np.array([max(map(known.__getitem__, bag), default=NO_SPAN) for bag in bags])

    return score


def svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, steps: int = 60) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss by Newton steps with step halving; y is +1/-1, cost per row."""
    n, d = x.shape
    x1 = np.column_stack([x, np.ones(n)]).astype(np.float64)
    ridge = np.eye(d + 1)
    ridge[d, d] = 1e-6

    def loss(w: np.ndarray) -> float:
        return w @ ridge @ w + cost @ np.maximum(0, 1 - y * (x1 @ w)) ** 2

    w = np.zeros(d + 1)
    now = loss(w)
    for _ in range(steps):
        active = y * (x1 @ w) < 1
        a, c = x1[active], cost[active]
        way = np.linalg.solve(ridge + (a * c[:, None]).T @ a, (a * c[:, None]).T @ y[active]) - w
        size = 1.0
        while size > 1e-4 and (new := loss(w + size * way)) > now:
            size /= 2
        if size <= 1e-4 or now - new < 1e-9 * now:
            break
        w, now = w + size * way, new
    return w[:d], float(w[d])


def _fold(landmarks: list[str], alpha: np.ndarray, bias: float) -> Model:
    who, code, weight = (np.concatenate(x) for x in zip(*((w, c, np.full(len(c), v)) for w, c, v in subsequences(landmarks))))
    keys, at = np.unique(code, return_inverse=True)
    return Model(keys, np.bincount(at, weights=weight / norms(landmarks)[who] * alpha[who]), bias)


def _pick_landmarks(ranked: list[str], most: int) -> list[str]:
    """Spans in order, without those that an earlier one nearly equals."""
    ranked = ranked[: 8 * most]
    if not ranked:
        return []
    k = kernel(ranked, ranked)
    k /= np.sqrt(np.outer(np.diag(k), np.diag(k))) + 1e-9
    kept: list[int] = []
    for i in range(len(ranked)):
        if len(kept) < most and (not kept or k[i, kept].max() < 0.9):
            kept.append(i)
    return [ranked[i] for i in kept]


def disguises(span: str) -> list[str]:
    """Spellings that a reader still takes for the span: marks between all characters, one inserted
    mark or doubled character in the middle, one character masked."""
    if len(span) < 4 or " " in span:
        return []
    m = len(span) // 2
    return [".".join(span), span[:m] + "-" + span[m:], span[:m] + span[m - 1] + span[m:], span[:m] + "*" + span[m + 1 :]]


def fit_spans(bags: list[list[tuple[str, float]]], clean: dict[str, int], rounds: int = 4) -> Model:
    """Machine from toxic documents (candidate spans with their evidence) and clean spans with their document counts.

    A toxic document's witnesses are its spans with at least half of its best evidence; from the
    second round on also those the machine is sure of. Each round trains on the witnesses, their
    disguises (lightly weighted) and clean spans, and adds the clean spans it got most wrong.
    """
    clean_spans = sorted(clean, key=lambda s: (-clean[s], s))
    negatives = clean_spans[:FREQUENT] + clean_spans[FREQUENT :: max(1, len(clean_spans) // SPREAD)]
    flat = sorted({s for b in bags for s, _ in b})
    margin_of: dict[str, float] = {}
    model = None
    for _ in range(rounds):
        count: dict[str, int] = {}
        for b in bags:
            best = max(e for _, e in b)
            for s, e in b:
                if 2 * e >= best or margin_of.get(s, 0.0) >= 1:
                    count[s] = count.get(s, 0) + 1
        positives = sorted(count, key=lambda s: (-count[s], s))
        marks = _pick_landmarks(positives, 3 * LANDMARKS // 4)
        hard = sorted(negatives, key=lambda s: (-margin_of.get(s, 0.0), s))
        marks += [s for s in _pick_landmarks(hard, LANDMARKS // 4) if s not in set(marks)]
        kmm = kernel(marks, marks).astype(np.float64)
        value, vector = np.linalg.eigh((kmm + kmm.T) / 2)
        good = value > 1e-3
        whiten = vector[:, good] / np.sqrt(value[good])
        masked = {d: count[s] ** 0.5 / 8 for s in positives[:LANDMARKS] if count[s] > 1 for d in disguises(s) if d not in clean and d not in count}
        rows = positives + list(masked) + negatives
        y = np.array([1.0] * (len(positives) + len(masked)) + [-1.0] * len(negatives))
        weight = np.array([count[s] ** 0.5 for s in positives] + list(masked.values()) + [min(clean[s], 25) ** 0.5 for s in negatives])
        for sign, total in ((1, COST), (-1, CLEAN_COST)):
            weight[y == sign] *= total / weight[y == sign].sum()
        # one more clean row that shares nothing with any landmark: what is unknown is clean
        x = np.vstack([kernel(rows, marks) @ whiten, np.zeros((1, whiten.shape[1]))])
        v, bias = svm(x, np.append(y, -1.0), np.append(weight, CLEAN_COST / 4))
        model = _fold(marks, whiten @ v, bias)
        margin = np.concatenate([model.margins(clean_spans[i : i + 20_000]) for i in range(0, len(clean_spans), 20_000)])  # a bounded part at a time
        margin_of = dict(zip(clean_spans, margin)) | dict(zip(flat, model.margins(flat)))
        negatives = list(dict.fromkeys(negatives + [clean_spans[i] for i in np.argsort(-margin)[:HARD]]))
    model.window_words = tuple(sorted({w for s in positives if " " in s for w in (s.split()[0], s.split()[-1])}))
    return model


def calibrate(model: Model, margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> Model:
    """Logistic curve over the margins of training documents (Newton, lightly smoothed targets)."""
    pos, neg = (label == 1).sum(), (label == 0).sum()
    target = np.where(label == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.column_stack([margin, np.ones(len(margin))])
    w = np.array([2.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1e-6])
        step = np.linalg.solve(h, x.T @ (weight * (target - p)) - np.array([1e-3, 1e-6]) * w)
        w = w + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    model.slope, model.shift = float(max(w[0], 1e-3)), float(w[1])
    return model


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          max_per_label: int = MAX_PER_LABEL) -> Model | None:
    """Model from the labelled rows that are not held out; None without rows of both labels.

    Bound: at most ``max_per_label`` documents of each label, those of the smallest id hash,
    each distinct text once; to the driver come ``WITNESSES`` spans of each toxic one,
    ``MAX_SPANS`` clean words and ``MAX_CLEAN_WINDOWS`` clean windows. A document with several label rows counts as toxic if one says so.
    """
    spark = df.sparkSession
    marked = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).alias("toxic"))
    marked = marked.join(df.select(F.col(id_col).alias("doc_id")).distinct(), "doc_id").filter(~held_out("doc_id"))
    marked = materialise(marked, "train-labels")
    size = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not size.get(0) or not size.get(1):
        return None
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [marked.filter(F.col("toxic") == t).orderBy(*by_hash).limit(max_per_label) for t in (0, 1)]
    ids = F.broadcast(materialise(chosen[0].unionAll(chosen[1]), "train-ids"))
    sample = (
        df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        .join(ids, "doc_id")
        .withColumn("h", F.xxhash64("text"))
        .dropDuplicates(["toxic", "h"])
    )
    sample = materialise(sample.select("doc_id", "toxic", "text"), "train-texts")

    n_docs = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    odds = F.log((F.col("n1") + 0.5) / (n_docs[1] + 1)) - F.log((F.col("n0") + 0.5) / (n_docs[0] + 1))
    evidence = (F.greatest(odds, F.lit(0.0)) * F.sqrt("n1")).alias("evidence")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", CUT_BYTES):
            count: dict[tuple[str, int], int] = {}
            for toxic, text in zip(b.column(0).to_pylist(), texts_of(b, "text")):
                for s in windows_of(text):
                    count[s, toxic] = count.get((s, toxic), 0) + 1
            spans, toxic = zip(*count) if count else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(spans, pa.string()), pa.array(toxic, pa.int32()), pa.array(count.values(), pa.int64())], names=["span", "toxic", "n"])

    pairs = sample.select(F.col("toxic").cast("int"), "text").repartition(CUT_TASKS).mapInArrow(windows, "span string, toxic int, n long")
    of = lambda t: F.sum(F.when(F.col("toxic") == t, F.col("n")).otherwise(0))
    pairs = materialise(pairs.groupBy("span").agg(of(1).alias("n1"), of(0).alias("n0")), "window-counts").withColumn("evidence", evidence)
    best = pairs.filter((F.col("n1") >= WINDOW_DOCS) & (F.col("evidence") > 0)).orderBy(F.col("evidence").desc(), "span").limit(MAX_WINDOWS)
    chosen = {r["span"] for r in best.select("span").collect()}
    first_last = {w for s in chosen for w in (s.split()[0], s.split()[-1])}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", CUT_BYTES):
            out = [[], [], []]
            for doc, toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts_of(b, "text")):
                spans = set().union(*map(spans_of, _SENTENCE.split(text)))
                if toxic:
                    spans |= windows_of(text, first_last.__contains__) & chosen
                for s in spans:
                    out[0].append(doc)
                    out[1].append(toxic)
                    out[2].append(s)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string())], names=["doc_id", "toxic", "span"])

    spans = materialise(sample.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"), "text").mapInArrow(cut, "doc_id long, toxic int, span string"), "train-spans")
    counts = spans.filter("span not like '% %'").groupBy("span").agg(F.count_if(F.col("toxic") == 1).alias("n1"), F.count_if(F.col("toxic") == 0).alias("n0"))
    counts = materialise(counts.withColumn("evidence", evidence).unionByName(best.select("span", "n1", "n0", "evidence")), "span-counts")
    order = Window.partitionBy("doc_id").orderBy(F.col("evidence").desc(), "span")
    top = (
        spans.filter("toxic = 1").join(counts.filter("n1 > 0"), "span").select("doc_id", "span", "evidence")
        .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= WITNESSES)
        .groupBy("doc_id").agg(F.collect_list(F.struct("span", "evidence")).alias("spans"))
    )
    bags = [{s["span"]: s["evidence"] for s in r["spans"]} for r in top.orderBy("doc_id").collect()]
    # a window that owes its evidence to one of its words says nothing of its own
    bags = [[(s, e) for s, e in b.items() if " " not in s or e > max((b.get(w, 0.0) for w in s.split()))] for b in bags]
    most = max((e for b in bags for _, e in b), default=1.0) or 1.0
    bags = [[(s, e / most) for s, e in b] for b in bags if b]
    words = counts.filter("n0 > 0 and span not like '% %'").select("span", "n0", F.xxhash64("span").alias("h"))
    known = words.orderBy(F.col("n0").desc(), "h").limit(MAX_SPANS // 2).unionAll(words.orderBy("h").limit(MAX_SPANS // 2))
    near = F.split("span", " ")
    marks = F.broadcast(spark.createDataFrame([(w,) for w in sorted(first_last)], "w string"))  # at most 2 * MAX_WINDOWS
    beside = pairs.filter("n0 > 0").select("span", "n0", F.explode(F.array_distinct(near)).alias("w")).join(marks, "w", "left_semi").select("span", "n0").distinct()
    beside = beside.orderBy(F.col("n0").desc(), F.xxhash64("span")).limit(MAX_CLEAN_WINDOWS)
    known = known.select("span", "n0").unionAll(beside).toArrow()
    clean = dict(zip(known.column(0).to_pylist(), known.column(1).to_pylist()))
    if not bags or not clean:
        return None
    model = fit_spans(bags, clean)
    scored = margins(sample, model).select("toxic", "margin").collect()
    label = np.array([r["toxic"] for r in scored])
    share = np.where(label == 1, size[1] / n_docs[1], size[0] / n_docs[0])
    return calibrate(model, np.array([r["margin"] for r in scored]), label, share)


def margins(df: DataFrame, model: Model, text_col: str = "text", out: str = "margin") -> DataFrame:
    """``df`` with the margin of every whole text as column ``out``."""
    state = (model.keys, model.weights, model.bias, model.window_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(Model(*state))
        for b in slices(batches, text_col, SCORE_BYTES):
            texts = [t or "" for t in b.column(b.schema.get_field_index(text_col)).cast(pa.string()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score(texts), pa.float64())], names=[*b.schema.names, out])

    from pyspark.sql.types import DoubleType, StructType

    schema = StructType([*df.schema.fields]).add(out, DoubleType())
    return df.mapInArrow(run, schema)


def score(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row.

    Null and empty texts get the score of a text without spans; repeated rows get equal
    scores; an empty table gives no rows; other columns are ignored; without a model (no
    labelled rows of both kinds) every score is 0.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if model is None:
        p = F.lit(0.0)
        scored = rows
    else:
        scored = margins(rows, model)
        p = 1 / (1 + F.exp(-(F.lit(model.slope) * F.col("margin") + F.lit(model.shift))))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), p.alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )


def toxicity_filter(df: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """Rows of ``df`` whose score stays under 0.5; same columns."""
    if model is None:
        return df
    cut = -model.shift / model.slope
    names = [f"`{c}`" for c in df.columns]
    return margins(df, model, text_col, "__margin").filter(F.col("__margin") < cut).select(*names)
