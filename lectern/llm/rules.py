"""Quality rules: fixed base rules, then gradient-boosted trees over document statistics.

The statistics come from the whole text, in Arrow batches. The trees are fitted in numpy on a bounded sample of labelled
documents, with monotonic constraints: more repetition, symbols or duplicate lines can never raise a score.
All trees are flattened into arrays of nodes, and a batch walks every tree level by level without a loop over rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import WHITE, training_texts

SYMBOLS = "#*$%&|<>"
#: Labelled documents of either class that the trees are fitted on, at most.
PER_CLASS = 3000
MIN_WORDS = 50
MOST_REPEATED = 50  # per cent
THRESHOLD = 0.3

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_upper", "n_digits", "n_letters", "n_distinct", "n_adjacent", "longest", "n_chars", "n_marks")
COUNTS = BASE + MORE
#: Feature -> (numerator, denominator, direction of its effect on the score; 0 = free)
FEATURES = {
    "words": ("n_words", None, 0),
    "word_length": ("word_chars", "n_words", 0),
    "symbols": ("n_symbols", "n_chars", -1),
    "duplicate_lines": ("n_dup_lines", "n_lines", -1),
    "repeated_words": ("n_repeat_words", "n_words", -1),
    "upper": ("n_upper", "n_letters", 0),
    "digits": ("n_digits", "n_chars", 0),
    "letters": ("n_letters", "n_chars", 0),
    "distinct": ("n_distinct", "n_words", 0),
    "adjacent": ("n_adjacent", "n_words", -1),
    "longest": ("longest", None, 0),
    "line_words": ("n_words", "n_lines", 0),
    "marks": ("n_marks", "n_words", 0),
}
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
_MARKS = b"!?.,;:"


def _only(raw: bytes, keep: bytes) -> int:
    return len(raw) - len(raw.translate(None, keep))


def repeated_words(ids: np.ndarray) -> int:
    """Words inside 3-word windows that occur twice or more, the first occurrence included."""
    n = len(ids)
    if n < 4:  # two windows at least
        return 0
    m = int(ids.max()) + 1
    pairs = ids[:-1] * m + ids[1:]
    if m > 2_000_000:  # m^3 would pass 64 bits: number the pairs first
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    windows = pairs[:-1] * m + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def statistics(text: str) -> tuple[int, ...]:
    """COUNTS of one text. Words are runs of anything but ASCII white space; all is zero for an empty text."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    if n == 0:
        return (0,) * len(COUNTS)
    numbers: dict[bytes, int] = {}
    ids = np.fromiter([numbers.setdefault(w, len(numbers)) for w in words], np.int64, n)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    white = _only(raw, WHITE.encode())
    letters = _only(raw, _LETTERS) + (len(raw) - len(raw.translate(None, bytes(range(128, 256))))) // 2
    return (
        n, len(text) - white, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(ids),
        len(lines), _only(raw, _UPPER), _only(raw, _DIGITS), letters, len(numbers),
        int((ids[1:] == ids[:-1]).sum()), max(map(len, words)), len(text), _only(raw, _MARKS),
    )


_COUNTS = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])


@F.arrow_udf(_COUNTS)
def _statistics(texts: pa.Array) -> pa.Array:
    rows = np.array([statistics(t or "") for t in texts.to_pylist()], np.int64).reshape(-1, len(COUNTS))
    return pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(len(COUNTS))], names=list(COUNTS))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds a struct ``stats``; a null text counts as empty."""
    return docs.withColumn("stats", _statistics(F.col(text)))


def features(counts: np.ndarray) -> np.ndarray:
    """Counts (rows x COUNTS) -> features (rows x FEATURES)."""
    at = {name: k for k, name in enumerate(COUNTS)}
    out = np.empty((len(counts), len(FEATURES)))
    for k, (over, under, _) in enumerate(FEATURES.values()):
        out[:, k] = counts[:, at[over]] / (1 if under is None else np.maximum(counts[:, at[under]], 1))
    return out


@dataclass
class Trees:
    """Flat trees: node k sends a row to ``left[k]`` if feature[k] <= split[k], else to ``right[k]``; a leaf sends it to itself."""

    roots: np.ndarray
    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.split[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.start + self.value[at].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, directions: list[int], rounds: int = 60, depth: int = 3, rate: float = 0.15,
        bins: int = 64, smooth: float = 5.0) -> Trees:
    """Boosted trees for the logistic loss, on histograms of at most ``bins`` quantiles per feature.

    A split on a constrained feature must order its children's values; every child then keeps to its side of
    their middle, so the whole tree is monotonic. No rows, or one class only, give a constant.
    """
    nodes: list[list[float]] = []
    roots = []
    mean = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
    start = float(np.log(mean / (1 - mean)))
    logit = np.full(len(y), start)
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])] if len(y) else []
    codes = [np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)]

    def grow(rows: np.ndarray, left_depth: int, low: float, high: float, gradient, hessian) -> int:
        g, h = gradient[rows].sum(), hessian[rows].sum()
        own = float(np.clip(g / (h + smooth), low, high))
        me = len(nodes)
        nodes.append([0, np.inf, me, me, rate * own])
        best = (1e-6, -1, 0, 0.0, 0.0)
        if left_depth and len(rows) >= 20:
            for k, e in enumerate(edges):
                gs = np.cumsum(np.bincount(codes[k][rows], gradient[rows], len(e) + 1))[:-1]
                hs = np.cumsum(np.bincount(codes[k][rows], hessian[rows], len(e) + 1))[:-1]
                if not len(gs):
                    continue
                a = np.clip(gs / (hs + smooth), low, high)
                b = np.clip((g - gs) / (h - hs + smooth), low, high)
                gain = gs * a - (hs + smooth) * a * a / 2 + (g - gs) * b - (h - hs + smooth) * b * b / 2
                gain -= g * own - (h + smooth) * own * own / 2
                if directions[k]:
                    gain[(b - a) * directions[k] < 0] = -1
                cut = int(np.argmax(gain))
                if gain[cut] > best[0]:
                    best = (gain[cut], k, cut, float(a[cut]), float(b[cut]))
        _, k, cut, a, b = best
        if k < 0:
            return me
        goes = codes[k][rows] <= cut
        middle = (a + b) / 2
        bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}
        (la, ha), (lb, hb) = bounds[directions[k]]
        nodes[me][0], nodes[me][1] = k, edges[k][cut]
        nodes[me][2] = grow(rows[goes], left_depth - 1, la, ha, gradient, hessian)
        nodes[me][3] = grow(rows[~goes], left_depth - 1, lb, hb, gradient, hessian)
        return me

    for _ in range(rounds if len(np.unique(y)) == 2 else 0):
        p = 1 / (1 + np.exp(-logit))
        first = len(nodes)
        roots.append(grow(np.arange(len(y)), depth, -4.0, 4.0, y - p, p * (1 - p)))
        tree = _flat(nodes[first:], [0], depth, 0.0, first)
        logit += tree.value[_leaves(tree, x)[:, 0]]
    return _flat(nodes, roots, depth, start)


def _leaves(tree: Trees, x: np.ndarray) -> np.ndarray:
    at = np.repeat(tree.roots[None, :], len(x), axis=0)
    rows = np.arange(len(x))[:, None]
    for _ in range(tree.depth):
        at = np.where(x[rows, tree.feature[at]] <= tree.split[at], tree.left[at], tree.right[at])
    return at


def _flat(nodes: list, roots: list[int], depth: int, start: float, shift: int = 0) -> Trees:
    table = np.array(nodes, float).reshape(-1, 5)
    whole = lambda k, s=0: table[:, k].astype(np.int64) - s
    return Trees(np.array(roots, np.int64), whole(0), table[:, 1], whole(2, shift), whole(3, shift), table[:, 4], depth, start)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, column: str = "quality") -> Trees:
    """Fits the trees on at most 2 * ``per_class`` labelled documents outside the held-out fold; the driver
    gets a few numbers of each."""
    sample = with_statistics(training_texts(docs, labels, column, per_class)).select("doc_id", "label", "stats.*").toPandas()
    sample = sample.sort_values(["doc_id", *COUNTS])
    x = features(sample[list(COUNTS)].to_numpy(np.int64).reshape(-1, len(COUNTS)))
    return fit(x, sample["label"].to_numpy(float), [d for _, _, d in FEATURES.values()])


def judged(docs: DataFrame, trees: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """Adds the base statistics, base_failed, score and kept to ``docs`` (columns of these names are replaced).

    A null or empty text has no words and fails the base rules. The score of a text that failed is still given. A very long
    text is counted whole, inside its row. A statistic equal to a split goes to its left, a score equal to ``threshold`` is
    kept. Repeated rows get equal results. The names stats and _score are reserved. An empty table gives an empty result.
    """

    @F.arrow_udf(T.DoubleType())
    def score(*counts: pa.Array) -> pa.Array:
        table = np.stack([c.to_numpy(zero_copy_only=False) for c in counts], axis=1)
        return pa.array(trees.score(features(table)))

    n, repeated = F.col("stats.n_words"), F.col("stats.n_repeat_words")
    failed = (n < MIN_WORDS) | (100 * repeated > MOST_REPEATED * n)
    rows = with_statistics(docs).withColumn("_score", score(*[F.col(f"stats.{c}") for c in COUNTS]))
    added = {**{c: F.col(f"stats.{c}") for c in BASE}, "base_failed": failed, "score": F.col("_score"),
             "kept": ~failed & (F.col("_score") >= threshold)}
    return rows.select(*[F.col(c) for c in docs.columns if c not in added], *[v.alias(k) for k, v in added.items()])


def query(spark, folder: str) -> DataFrame:
    from lectern.llm.common import table

    docs = table(spark, folder, "documents")
    trees = train(docs, table(spark, folder, "labels"))
    return judged(docs.select("doc_id", "text"), trees).select("doc_id", *BASE, "base_failed", "kept", "score")
