"""Quality classifier: an additive model with pairwise interactions.

Every document has a few dozen numeric features of its whole text.  Features are binned by
quantiles; boosting goes round the features in turn, each time fitting a tree of four leaves to
the gradient over that feature's bins and adding a small part of it to the feature's look-up
table.  The pairs whose coarse grids explain most of what is left are boosted likewise.  A score is
the logistic of an intercept plus one table entry per feature and pair: vectorised
look-ups and additions.

The model is fitted by the driver on the features (not the texts) of at most ``TRAIN_ROWS``
labelled rows; scoring covers all documents and whole texts, however long.  An empty table gives no row.  Null and empty texts have all-zero features and
are scored like any other.  Without labels of both kinds every score is 0.5 or the share of
the one kind there is.  Only ``doc_id`` and ``text`` are read.  Repeated rows get equal scores.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.common import labelled_sample

TRAIN_ROWS = 20_000
GOOD_AT = 0.7

BINS = 48
PAIR_BINS = 8
PAIRS = 12
ROUNDS = 120
PAIR_ROUNDS = 60
RATE = 0.15
MIN_LEAF = 20
RIDGE = 5.0

FEATURES = (
    "log_words", "mean_word", "long_word", "distinct_words", "top_word", "next_equal", "short_words", "marked_words",
    "capital_words", "upper", "digits", "symbols", "exclamations", "stops", "commas", "non_ascii", "blanks", "line_words",
    "repeated_lines", "byte_entropy", "packed", "word_variety",
)
_SYMBOL_BYTES = np.frombuffer(b"#*$%&|<>~^@\\{}[]_=+", np.uint8)


def measure(text: str | None) -> list[float]:
    """The features of one text, in the order of ``FEATURES``."""
    data = (text or "").encode()
    words = data.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(data)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    letters = max(1, int(counts[65:91].sum() + counts[97:123].sum()))
    common = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [line for line in data.split(b"\n") if line.strip()]
    share = counts[counts > 0] / size
    return [
        math.log1p(n),
        float(lengths.mean()),
        math.log1p(int(lengths.max())),
        len(common) / n,
        max(common.values()) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        float((lengths <= 3).mean()),
        sum(w[-1] in b"!#*$%&|" for w in words) / n,
        sum(map(bytes.isupper, words)) / n,
        int(counts[65:91].sum()) / letters,
        int(counts[48:58].sum()) / size,
        int(counts[_SYMBOL_BYTES].sum()) / size,
        int(counts[33]) / n,
        int(counts[46]) / n,
        int(counts[44]) / n,
        int(counts[128:].sum()) / size,
        int(counts[9:14].sum() + counts[32]) / size,
        math.log1p(n / len(lines)),
        1 - len(set(lines)) / len(lines),
        float(-(share * np.log2(share)).sum()),
        len(zlib.compress(data, 1)) / size,
        math.log1p(len(common)) / math.log1p(n),
    ]


@dataclass(frozen=True)
class AdditiveModel:
    """Look-up tables by feature and by pair of features."""

    intercept: float
    edges: tuple[np.ndarray, ...] = ()
    tables: tuple[np.ndarray, ...] = ()
    pair_edges: tuple[np.ndarray, ...] = ()
    pairs: tuple[tuple[int, int, np.ndarray], ...] = ()

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables)):
            out += table[np.searchsorted(edges, x[:, j], side="right")]
        for a, b, table in self.pairs:
            out += table[
                np.searchsorted(self.pair_edges[a], x[:, a], side="right"),
                np.searchsorted(self.pair_edges[b], x[:, b], side="right"),
            ]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -30, 30)))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _best_cut(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best split of consecutive bins, place 0 if there is none."""
    left_g, left_h, left_n = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    all_g, all_h = g.sum(), h.sum()
    gain = left_g**2 / (left_h + RIDGE) + (all_g - left_g) ** 2 / (all_h - left_h + RIDGE) - all_g**2 / (all_h + RIDGE)
    gain = np.where((left_n >= MIN_LEAF) & (n.sum() - left_n >= MIN_LEAF), gain, -1.0)
    if not len(gain) or gain.max() <= 1e-9:
        return 0.0, 0
    return float(gain.max()), int(gain.argmax()) + 1


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Values per bin of a tree of depth two over one feature's bins."""
    out = np.zeros(len(g))

    def leaf(lo: int, hi: int) -> None:
        out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + RIDGE)

    _, cut = _best_cut(g, h, n)
    for lo, hi in ((0, cut), (cut, len(g))) if cut else ((0, len(g)),):
        _, inner = _best_cut(g[lo:hi], h[lo:hi], n[lo:hi])
        for a, b in ((lo, lo + inner), (lo + inner, hi)) if inner else ((lo, hi),):
            leaf(a, b)
    return out


def _grid_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of a depth-two tree over a pair's grid: one cut of the rows, one of the columns in each part."""
    whole = g.sum() ** 2 / (h.sum() + RIDGE)
    best, out = 0.0, np.zeros(g.shape)
    for cut in range(1, g.shape[0]):
        gain, values = -whole, np.zeros(g.shape)
        for part in (slice(0, cut), slice(cut, None)):
            pg, ph, pn = g[part].sum(0), h[part].sum(0), n[part].sum(0)
            more, inner = _best_cut(pg, ph, pn)
            gain += pg.sum() ** 2 / (ph.sum() + RIDGE) + more
            for cols in (slice(0, inner), slice(inner, None)):
                values[part, cols] = pg[cols].sum() / (ph[cols].sum() + RIDGE)
        if gain > best:
            best, out = gain, values
    return best, out


def fit(x: np.ndarray, y: np.ndarray, *, rounds: int = ROUNDS, pair_rounds: int = PAIR_ROUNDS, pairs: int = PAIRS) -> AdditiveModel:
    """Cyclic boosting of the tables, then of the strongest pairs."""
    if not len(y):
        return AdditiveModel(0.0)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    intercept = math.log(share / (1 - share))
    if y.min() == y.max():
        return AdditiveModel(intercept)
    edges = [_cuts(x[:, j], BINS) for j in range(x.shape[1])]
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    sizes = [np.bincount(b, minlength=len(t)) for b, t in zip(bins, tables)]
    f = np.full(len(y), intercept)
    for _ in range(rounds):
        for b, table, n in zip(bins, tables, sizes):
            p = 1 / (1 + np.exp(-f))
            g = np.bincount(b, weights=y - p, minlength=len(table))
            h = np.bincount(b, weights=p * (1 - p), minlength=len(table))
            step = RATE * _tree(g, h, n)
            table += step
            f += step[b]
    coarse = [_cuts(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    grid = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(coarse)]

    def cells(a: int, b: int, weights: np.ndarray | None) -> np.ndarray:
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        return np.bincount(grid[a] * shape[1] + grid[b], weights=weights, minlength=shape[0] * shape[1]).reshape(shape)

    p = 1 / (1 + np.exp(-f))
    gains = {
        (a, b): _grid_tree(cells(a, b, y - p), cells(a, b, p * (1 - p)), cells(a, b, None))[0]
        for a, b in combinations(range(x.shape[1]), 2)
    }
    chosen = sorted(gains, key=lambda ab: (-gains[ab], ab))[:pairs]
    pair_tables = [np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for a, b in chosen]
    for _ in range(pair_rounds):
        for (a, b), table in zip(chosen, pair_tables):
            p = 1 / (1 + np.exp(-f))
            step = RATE * _grid_tree(cells(a, b, y - p), cells(a, b, p * (1 - p)), cells(a, b, None))[1]
            table += step
            f += step[grid[a], grid[b]]
    return AdditiveModel(
        intercept, tuple(edges), tuple(tables), tuple(coarse), tuple((a, b, t) for (a, b), t in zip(chosen, pair_tables))
    )


def measures(text: Column) -> Column:
    """The features of a text, an array of doubles."""

    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return pd.Series([measure(t) for t in texts], dtype=object)

    return measured(text)


def learn(docs: DataFrame, labels: DataFrame, *, column: str = "quality", rows: int = TRAIN_ROWS) -> AdditiveModel:
    """A model from at most ``rows`` labelled documents that are not held out."""
    found = labelled_sample(docs, labels, column, rows).select("label", measures(F.col("text")).alias("x")).toPandas()
    found = found.iloc[np.lexsort(np.array(found["x"].tolist()).T)] if len(found) else found
    x = np.array(found["x"].tolist(), float).reshape(-1, len(FEATURES))
    return fit(x, found["label"].to_numpy(float))


def score(text: Column, model: AdditiveModel) -> Column:
    """Probability that a text is of good quality."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        x = np.array([measure(t) for t in texts], float).reshape(-1, len(FEATURES))
        return pd.Series(model.probability(x))

    return scored(text)
