"""Quality rules: gradient-boosted trees over document statistics.

Each text gives counts (words, repeats, symbols, letters) and ratios of them.
Trees are boosted on the log loss over binned ratios; on chosen features a
split may only lower the score as the feature grows. The trees are flattened
into numpy arrays of nodes, over which a whole batch walks at once.

Only the fit is bounded: at most ``LABELLED`` labelled documents, taken by a
hash of their id. Every text is measured whole. The verdict keeps a document
unless its score is below a cut that ``KEEP_GOOD`` of the good labelled
documents reach.

Defined results: a null text has no words; repeated rows each get a verdict;
without labels of both kinds the trees keep everything; labels that are null
teach nothing; extra columns are left alone, but those named as an added one
give way to it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, table

LABELLED, KEEP_GOOD = 6000, 0.995
TREES, DEPTH, BINS, RATE, LEAST_ROWS, L2 = 80, 4, 32, 0.15, 12, 2.0
FEATURES = (
    "log_words", "mean_word", "symbols", "dup_lines", "repeats", "upper", "digits", "line_words",
    "distinct", "letters", "marks", "stops",
)
#: Features along which the score may only fall.
FALLING = ("symbols", "dup_lines", "repeats", "marks")
WINDOW, LEAST_WORDS, REPEAT_PERCENT = 8, 20, 30

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
UPPER, DIGITS, LETTERS = (bytes(range(a, b + 1)) for a, b in ((0x41, 0x5A), (0x30, 0x39), (0x61, 0x7A)))
NON_ASCII = bytes(range(0x80, 0x100))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of words found twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    ids = (ids ^ (ids >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    keys = np.zeros(n, np.uint64)
    for j in range(window):
        keys = keys * np.uint64(0xD6E8FEB86659FD93) + ids[j : j + n]
    line = np.sort(keys)
    twice = line[1:][line[1:] == line[:-1]]
    if not len(twice):
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(np.isin(keys, twice))
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def measure(text: str | None) -> tuple[tuple[int, int, int, int, int], list[float]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the features."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    without = lambda drop: len(data) - len(data.translate(None, drop))
    n, chars = len(words), len(text) - without(SPACE)
    symbols = without(SYMBOLS)
    lines = [x for x in data.split(b"\n") if x.strip(SPACE)]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    each = max(1, n)
    size = max(1, chars)
    wide = len(text) - (len(data) - without(NON_ASCII))
    ends = sum(x.rstrip(SPACE)[-1:] in (b".", b"!", b"?") for x in lines)
    values = [
        float(np.log1p(n)), chars / each, symbols / each, dup / max(1, len(lines)), repeat / each, without(UPPER) / size, without(DIGITS) / size, len(lines) / each,
        len(set(words)) / each, (without(LETTERS) + without(UPPER) + wide) / size, data.count(b"!") / each, ends / max(1, len(lines)),
    ]
    return (n, chars, symbols, dup, repeat), values


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat > REPEAT_PERCENT * n_words


@dataclass
class Forest:
    """Flat nodes of all trees: a node's feature (-1 in a leaf), threshold, children and value."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int
    cut: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality for each row."""
        total = np.full(len(x), self.base)
        if len(self.roots) and len(x):
            at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
            row = np.arange(len(x))[:, None]
            for _ in range(self.depth):
                over = x[row, np.maximum(self.feature[at], 0)] > self.threshold[at]
                at = np.where(over, self.right[at], self.left[at])
            total = total + self.value[at].sum(1)
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


def fit_forest(x: np.ndarray, y: np.ndarray, falling: tuple[int, ...], trees: int = TREES, depth: int = DEPTH, keep_good: float = KEEP_GOOD) -> Forest:
    """Boosted trees on the log loss. A split on a falling feature must have the higher value on its left,
    and the middle of both values bounds what stands below, so the whole tree falls along the feature."""
    empty = np.zeros(0)
    if not len(y) or y.min() == y.max():
        return Forest(np.zeros(0, int), np.zeros(0, int), empty, np.zeros(0, int), np.zeros(0, int), empty, 50.0, 0, 0.0)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    base = float(np.log(y.mean() / (1 - y.mean())))
    total = np.full(len(y), base)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def leaf(v: float) -> int:
        k = len(feature)
        feature.append(-1), threshold.append(0.0), left.append(k), right.append(k), value.append(v)
        return k

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        node = lambda a, b: float(np.clip(a / (b + L2), low, high))
        a, b = g[rows].sum(), h[rows].sum()
        own = node(a, b)
        best = (1e-6, -1, -1, 0.0, 0.0)
        gain_of = lambda a, b, v: a * v - 0.5 * (b + L2) * v * v
        if level < depth and len(rows) >= 2 * LEAST_ROWS:
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                bins = binned[rows, f]
                gs, hs, ns = (np.cumsum(np.bincount(bins, w, len(e) + 1))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                vl, vr = np.clip(gs / (hs + L2), low, high), np.clip((a - gs) / (b - hs + L2), low, high)
                gain = gain_of(gs, hs, vl) + gain_of(a - gs, b - hs, vr) - gain_of(a, b, own)
                good = (ns >= LEAST_ROWS) & (len(rows) - ns >= LEAST_ROWS)
                if f in falling:
                    good &= vl >= vr
                gain = np.where(good, gain, -np.inf)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k, float(vl[k]), float(vr[k]))
        if best[1] < 0:
            return leaf(RATE * own)
        _, f, k, vl, vr = best
        me = leaf(0.0)
        go = binned[rows, f] <= k
        middle = (vl + vr) / 2
        bounds = ((middle, high), (low, middle)) if f in falling else ((low, high), (low, high))
        feature[me], threshold[me] = f, float(edges[f][k])
        left[me] = grow(rows[go], g, h, level + 1, *bounds[0])
        right[me] = grow(rows[~go], g, h, level + 1, *bounds[1])
        return me

    everything = np.arange(len(y))
    forest = None
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        roots.append(grow(everything, y - p, p * (1 - p), 0, -10.0, 10.0))
        forest = Forest(np.array(roots[-1:]), *(np.array(v) for v in (feature, threshold, left, right, value)), 0.0, depth, 0.0)
        at = np.full(len(y), roots[-1])
        for _ in range(depth):
            at = np.where(x[everything, np.maximum(forest.feature[at], 0)] > forest.threshold[at], forest.right[at], forest.left[at])
        total = total + forest.value[at]
    forest.roots, forest.base = np.array(roots), base
    good = np.sort(forest.score(x)[y > 0])
    forest.cut = float(min(0.5, good[int((1 - keep_good) * len(good))]))
    return forest


MEASURED = [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]


def learn_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", labelled: int = LABELLED) -> Forest:
    """Fits on at most ``labelled`` labelled documents; the sample of ids is so small that it is broadcast."""
    known = labels.select(labels[id_col].alias("id"), labels[quality_col].cast("double").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    n = known.count()
    share = min(1.0, 1.1 * labelled / n) if n else 0.0
    part = known.where(F.shiftrightunsigned(F.xxhash64("id", F.lit(3)), 1) / F.lit(2.0**63) < share).orderBy(F.xxhash64("id", F.lit(3)), "id", "y").limit(labelled)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).join(F.broadcast(part), "id")

    def make():
        return lambda texts: [[measure(t)[1] for t in texts]]

    found = append_columns(rows, [T.StructField("x", T.ArrayType(T.DoubleType()))], "text", make).select("id", "y", "x").collect()
    found.sort(key=lambda r: (r["id"], r["y"], r["x"]))
    x = np.array([r["x"] for r in found], np.float64).reshape(-1, len(FEATURES))
    return fit_forest(x, np.array([r["y"] > 0.5 for r in found], np.float64), tuple(FEATURES.index(f) for f in FALLING))


def judge_quality(docs: DataFrame, forest: Forest, text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, the five counts, ``base_failed``, ``score`` and ``kept``."""
    state = docs.sparkSession.sparkContext.broadcast(tuple(vars(forest).values()))  # nodes: bounded by TREES and DEPTH
    fields = [*MEASURED, T.StructField("base_failed", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())]

    def make():
        own = Forest(*state.value)

        def judge(texts: list[str | None]) -> list[list]:
            both = [measure(t) for t in texts]
            scores = own.score(np.array([v for _, v in both], np.float64).reshape(-1, len(FEATURES)))
            failed = [base_failed(c[0], c[4]) for c, _ in both]
            kept = [not f and s >= own.cut for f, s in zip(failed, scores.tolist(), strict=True)]
            return [*([c[k] for c, _ in both] for k in range(5)), failed, scores.tolist(), kept]

        return judge

    return append_columns(docs, fields, text_col, make)


def keep_good(docs: DataFrame, forest: Forest, text_col: str = "text") -> DataFrame:
    """The documents that pass, as they were."""
    judged = judge_quality(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("text")), forest)
    return judged.where("kept").select("row.*")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    forest = learn_quality(docs, table(spark, sf_dir, "labels"))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return judge_quality(slim, forest).drop("text")


QUERIES = {"op9_quality_rules": op9_quality_rules}
