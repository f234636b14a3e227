"""Quality rules: a learned decision list over text statistics (DataFrame functions only).

``text_stats`` computes the statistics of every whole text with built-in functions.
``learn`` grows and prunes conjunctions of thresholds by sequential covering: each
round counts labels per statistic and bin among the rows that no earlier rule covers
(one aggregation whose result has a row per statistic, bin and label), adds the
literal of the largest information gain, then cuts the conjunction back on rows held
out for pruning. The result is an ordered list that reads as a Spark ``CASE``.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import WORD, let, materialise, text_or_empty

WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
# statistic -> (count, count that it is divided by, if any; 1 at least)
RATIOS = {
    "words": ("n_words", None),
    "word_length": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "mark_share": ("n_marks", "word_chars"),
    "distinct_share": ("n_distinct_words", "n_words"),
}


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows of ``window`` words that occur at least twice in the array.

    Windows are compared by 64-bit hash first; only arrays where two hashes agree
    compare the words themselves, so the count is exact.
    """
    starts = lambda w: F.sequence(F.lit(0), F.size(w) - F.lit(window))

    def covered(sorted_windows: Column) -> Column:
        last = F.size(sorted_windows) - 1
        same = lambda a, b: sorted_windows[a]["k"] == sorted_windows[b]["k"]
        twice = F.filter(
            F.sequence(F.lit(0), last),
            lambda j: F.coalesce((j > 0) & same(F.greatest(j - 1, F.lit(0)), j), F.lit(False))
            | F.coalesce((j < last) & same(j, F.least(j + 1, last)), F.lit(False)),
        )
        places = F.sort_array(F.transform(twice, lambda j: sorted_windows[j]["i"]))
        return F.aggregate(
            places,
            F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("end")),
            lambda a, p: F.struct(
                (a["total"] + window - F.greatest(F.lit(0), a["end"] - p)).alias("total"), (p + window).alias("end")
            ),
            lambda a: a["total"],
        )

    def exact(w: Column) -> Column:
        keyed = F.transform(starts(w), lambda i: F.struct(F.array_join(F.slice(w, i + 1, window), " ").alias("k"), i.alias("i")))
        return let(F.sort_array(keyed), covered)

    def hashed(w: Column) -> Column:
        one = F.transform(w, lambda x: F.xxhash64(x))
        keys = let(one, lambda h: F.transform(starts(h), lambda i: F.xxhash64(F.slice(h, i + 1, window))))
        return let(keys, lambda k: F.size(F.array_distinct(k)) < F.size(k))

    long = F.size(words) > window
    return F.when(long & F.when(long, hashed(words)).otherwise(F.lit(False)), exact(words)).otherwise(F.lit(0).cast("long"))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), 0)


def _stats(text: Column, words: Column) -> dict[str, Column]:
    """Counts of a text (not null) and its words, all long."""
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    lines = F.split(text, "\n", -1)
    stats = {
        "n_words": F.size(words),
        "word_chars": F.aggregate(words, F.lit(0).cast("long"), lambda a, x: a + F.length(x)),
        "n_symbols": count(SYMBOLS),
        "n_lines": F.size(lines),
        "n_dup_lines": let(F.filter(lines, lambda x: x.rlike(WORD)), lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": repeat_words(words),
        "n_upper": count(r"\p{Lu}"),
        "n_digits": count(r"\p{Nd}"),
        "n_marks": count(r"[!?;:]"),
        "n_distinct_words": F.size(F.array_distinct(words)),
    }
    return {k: v.cast("long") for k, v in stats.items()}


def text_stats(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the counts of every whole text as further columns.

    Null text has no words; repeated rows get equal counts; an empty table gives no rows; columns named like a count are
    replaced, and ``__q_text`` and ``__q_words`` are names of this function's own, which do not come out.
    """
    text, words = "__q_text", "__q_words"
    with_words = df.withColumn(text, text_or_empty(text_col)).withColumn(words, _words(F.col(text)))
    return with_words.withColumns(_stats(F.col(text), F.col(words))).drop(text, words)


def base_failed(of: Callable[[str], Column] = F.col) -> Column:
    n, r = of("n_words"), of("n_repeat_words")
    return (n < 20) | (100 * r > 30 * n)


@dataclass(frozen=True)
class Literal:
    stat: str
    above: bool  # value > threshold, else value <= threshold
    threshold: float

    def holds(self, of: Callable[[str], Column] = F.col) -> Column:
        value = ratio(self.stat, of)
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.stat} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass
class DecisionList:
    """Rules in order; the first whose literals all hold rejects the text, none keeps it."""

    rules: list[list[Literal]] = field(default_factory=list)

    def verdict(self, of: Callable[[str], Column] = F.col) -> Column:
        """One conditional expression over the counts that ``of`` names."""
        out = None
        for rule in self.rules:
            met = reduce(lambda a, x: a & x.holds(of), rule, F.lit(True))
            out = F.when(met, F.lit(False)) if out is None else out.when(met, F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))

    def __str__(self) -> str:
        return "\n".join(f"reject if {' and '.join(map(str, r))}" for r in self.rules) + "\nkeep"


def ratio(stat: str, of: Callable[[str], Column] = F.col) -> Column:
    top, bottom = RATIOS[stat]
    return of(top).cast("double") if bottom is None else of(top) / F.greatest(of(bottom), F.lit(1))


def learn(
    stats: DataFrame,
    label: str = "quality",
    id_col: str = "doc_id",
    bins: int = 48,
    max_rules: int = 12,
    max_literals: int = 4,
    min_precision: float = 0.9,
    min_cover: int = 4,
) -> DecisionList:
    """Decision list for rejecting rows with ``label`` 0, from all labelled rows of ``stats`` (counts and label).

    Rows with a null label are ignored; without rows of both labels the list is empty
    (everything is kept). Only aggregates come to the driver: one row per statistic,
    bin and label. A third of the rows, by id hash, is held out for pruning.
    """
    names = list(RATIOS)
    rows = stats.filter(F.col(label).isNotNull()).select(
        (F.col(label) == 0).alias("bad"), (F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(3)) == 0).alias("prune"),
        *[ratio(n).alias(n) for n in names],
    )
    rows = materialise(rows, "labelled-stats")
    points = [i / bins for i in range(1, bins)]
    cuts: dict[str, list[float]] = {}
    picked = rows.agg(
        *[F.percentile_approx(F.when(side, F.col(n)), points, 10000).alias(f"{n}_{i}") for n in names for i, side in enumerate((F.col("bad"), ~F.col("bad")))]
    ).first()
    for n in names:
        cuts[n] = sorted({v for i in (0, 1) for v in (picked[f"{n}_{i}"] or [])})
    if not any(cuts.values()):
        return DecisionList()
    binned = materialise(
        rows.select("bad", "prune", *[_bin(n, cuts[n]).alias(n) for n in names]), "binned-stats"
    )
    found = DecisionList()
    open_rows = F.lit(True)
    for _ in range(max_rules):
        rule: list[tuple[str, bool, int]] = []
        grow = binned.filter(~F.col("prune") & open_rows)
        while len(rule) < max_literals:
            best = _best_literal(grow.filter(_holds(rule)), names, cuts)
            if best is None:
                break
            rule.append(best[0])
            if best[1] >= 0.999:
                break
        if not rule:
            break
        heads = [rule[:i] for i in range(1, len(rule) + 1)]
        tally = binned.filter(open_rows).agg(
            *[F.count_if(_holds(h) & (F.col("bad") == b) & (F.col("prune") == p)).alias(f"c{i}_{int(b)}_{int(p)}")
              for i, h in enumerate(heads) for b in (True, False) for p in (True, False)]
        ).first()
        value = lambda i: (tally[f"c{i}_1_1"] - tally[f"c{i}_0_1"]) / max(1, tally[f"c{i}_1_1"] + tally[f"c{i}_0_1"])
        i = max(range(len(heads)), key=lambda i: (round(value(i), 6), tally[f"c{i}_1_1"], -i))
        pos, neg = (tally[f"c{i}_1_0"] + tally[f"c{i}_1_1"], tally[f"c{i}_0_0"] + tally[f"c{i}_0_1"])
        if pos < min_cover or (pos + 1) / (pos + neg + 2) < min_precision:
            break
        found.rules.append([Literal(n, up, cuts[n][b]) for n, up, b in heads[i]])
        open_rows = open_rows & ~_holds(heads[i])
    return found


def _bin(name: str, cuts: list[float]) -> Column:
    """Number of cuts below the value: value > cuts[b] exactly when bin > b."""
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<double>"), lambda c: c < F.col(name)))


def _holds(rule: list[tuple[str, bool, int]]) -> Column:
    return reduce(lambda a, x: a & ((F.col(x[0]) > x[2]) if x[1] else (F.col(x[0]) <= x[2])), rule, F.lit(True))


def _best_literal(rows: DataFrame, names: list[str], cuts: dict) -> tuple[tuple[str, bool, int], float] | None:
    """Literal of the largest information gain, and its precision."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("stat"), F.col(n).alias("bin")) for n in names])).alias("x")
    counted = rows.select("bad", pairs).groupBy("x.stat", "x.bin", "bad").agg(F.count("*").alias("n")).collect()
    table: dict[str, list[list[int]]] = {n: [[0, 0] for _ in range(len(cuts[n]) + 1)] for n in names}
    for r in counted:
        table[r["stat"]][r["bin"]][bool(r["bad"])] += r["n"]
    neg, pos = (sum(x[i] for x in table[names[0]]) for i in (0, 1))
    if not pos or not neg:
        return None
    base, best = math.log2(pos / (pos + neg)), None
    for n in names:
        low = [0, 0]
        for b in range(len(cuts[n])):
            low = [low[0] + table[n][b][0], low[1] + table[n][b][1]]
            for up, (q, p) in ((False, low), (True, [neg - low[0], pos - low[1]])):
                if p and p + q < pos + neg:
                    gain = p * (math.log2(p / (p + q)) - base)
                    key = (round(gain, 9), p / (p + q))
                    if gain > 1e-9 and (best is None or key > best[0]):
                        best = (key, (n, up, b), p / (p + q))
    return (best[1], best[2]) if best else None


def quality_filter(df: DataFrame, rules: DecisionList, text_col: str = "text") -> DataFrame:
    """Rows of ``df`` that pass the base rules and the list; same columns.

    Null and empty texts fail the base rules; repeated rows stay or go together; an empty table gives no rows; other
    columns, whatever their names, are kept as they are. The whole test is one expression whose parts (text, words, counts) are bound once: as
    columns of their own they would be put into the filter again at each place that names them.
    """
    passes = let(text_or_empty(text_col), lambda t: let(_words(t), lambda w: let(
        F.struct(*[v.alias(k) for k, v in _stats(t, w).items()]),
        lambda s: ~base_failed(lambda name: s[name]) & rules.verdict(lambda name: s[name]))))
    return df.filter(passes)
