"""Quality classifier: generalised additive model with pairwise interactions (after Lou et al., 2013).

Every text becomes a few numeric features. Cyclic boosting visits one feature after the other and fits
a shallow tree over that feature's bins to the gradient of the log loss; the trees of a feature add up
to one lookup table. Then the pairs whose bins explain most of what is left are boosted the same way.
A score is the sigmoid of table entries added up, one vectorised lookup per table.

The model is fitted on the driver on at most ``MAX_ROWS`` labelled rows of features (no texts), chosen
by a seeded hash of the id; the features, the choice and the scores are Spark jobs over all rows.

Defined results: null and empty texts score from all-zero features; null labels are ignored; a document
with several labels counts with each; no labels at all give score 0.5; repeated rows are scored each;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_ROWS = 20_000
BINS = 32
PAIR_BINS = 8
ROUNDS = 60
PAIRS = 6
RATE = 0.15
FEATURES = ["log_words", "word_length", "upper", "digit", "symbol", "mark", "stop", "other_punct",
            "high", "line_words", "dup_lines", "distinct_words", "top_word"]


def _classes() -> np.ndarray:
    """Byte -> class: 0 letter, 1 upper, 2 digit, 3 symbol, 4 mark, 5 stop, 6 other, 7 high, 8 space, 9 newline."""
    c = np.full(256, 6, dtype=np.int64)
    c[ord("a"):ord("z") + 1] = 0
    c[ord("A"):ord("Z") + 1] = 1
    c[ord("0"):ord("9") + 1] = 2
    for ch in "#*$%&|<>":
        c[ord(ch)] = 3
    for ch in "!?":
        c[ord(ch)] = 4
    for ch in ".,;:":
        c[ord(ch)] = 5
    c[128:] = 7
    for ch in " \t\x0b\x0c\r":
        c[ord(ch)] = 8
    c[ord("\n")] = 9
    return c


CLASS = _classes()


def featurize(texts: list[str | None]) -> np.ndarray:
    """One row of ``FEATURES`` per text."""
    out = np.zeros((len(texts), len(FEATURES)))
    for i, t in enumerate(texts):
        raw = (t or "").encode("utf-8", "replace")
        words = raw.split()
        if not words:
            continue
        n = np.bincount(CLASS[np.frombuffer(raw, dtype=np.uint8)], minlength=10)
        chars = max(1, n[:8].sum())
        lines = [x for x in raw.split(b"\n") if x.strip()]
        kinds: dict[bytes, int] = {}
        for w in words:
            kinds[w] = kinds.get(w, 0) + 1
        w = len(words)
        out[i] = (np.log1p(w), chars / w, n[1] / chars, n[2] / chars, n[3] / w, n[4] / w, n[5] / w, n[6] / w,
                  n[7] / chars, w / len(lines), 1 - len(set(lines)) / len(lines), len(kinds) / w,
                  max(kinds.values()) / w)
    return out


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def features(texts: pd.Series) -> pd.Series:
    return pd.Series(list(featurize(list(texts))))


@dataclass
class Model:
    """Intercept, bin edges and lookup tables; pairs index the coarse edges."""

    base: float = 0.0
    edges: list = field(default_factory=list)
    coarse: list = field(default_factory=list)
    tables: list = field(default_factory=list)
    pairs: list = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[j], x[:, j], side="right")]
        for a, b, table in self.pairs:
            total += table[np.searchsorted(self.coarse[a], x[:, a], side="right"),
                           np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _cut(g: np.ndarray, h: np.ndarray, lo: int, hi: int) -> tuple[float, int]:
    """Best gain and place of one cut of the bins lo..hi."""
    gs, hs = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi])
    if hi - lo < 2:
        return 0.0, lo
    left, right = gs[:-1] ** 2 / (hs[:-1] + 1), (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1)
    gain = left + right - gs[-1] ** 2 / (hs[-1] + 1)
    k = int(gain.argmax())
    return float(gain[k]), lo + k + 1


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Leaf values per bin of a tree with at most ``leaves`` leaves."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        gains = [(*_cut(g, h, a, b), a, b) for a, b in parts]
        gain, at, a, b = max(gains)
        if gain <= 1e-6:
            break
        parts.remove((a, b))
        parts += [(a, at), (at, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Best four-leaf tree over a grid of bins: one cut of the first feature, one of the second."""
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a, b = G[:-1, :-1], H[:-1, :-1]
    g2, h2 = G[:-1, -1:] - a, H[:-1, -1:] - b
    g3, h3 = G[-1:, :-1] - a, H[-1:, :-1] - b
    g4, h4 = G[-1, -1] - a - g2 - g3, H[-1, -1] - b - h2 - h3
    gain = a ** 2 / (b + 1) + g2 ** 2 / (h2 + 1) + g3 ** 2 / (h3 + 1) + g4 ** 2 / (h4 + 1)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    out = np.empty_like(g)
    out[:i + 1, :j + 1] = a[i, j] / (b[i, j] + 1)
    out[:i + 1, j + 1:] = g2[i, j] / (h2[i, j] + 1)
    out[i + 1:, :j + 1] = g3[i, j] / (h3[i, j] + 1)
    out[i + 1:, j + 1:] = g4[i, j] / (h4[i, j] + 1)
    return float(gain[i, j] - G[-1, -1] ** 2 / (H[-1, -1] + 1)), out


def fit_rows(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, rate: float = RATE,
             n_pairs: int = PAIRS) -> Model:
    """Boost single features in turn, then the strongest pairs."""
    m = Model()
    if not len(x):
        return m
    p = (y.sum() + 1.0) / (len(y) + 2.0)
    m.base = float(np.log(p / (1 - p)))
    quantiles = lambda col, k: np.unique(np.quantile(col, np.linspace(0, 1, k + 1)[1:-1]))
    m.edges = [quantiles(x[:, j], BINS) for j in range(x.shape[1])]
    m.coarse = [quantiles(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(m.edges)]
    rough = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(m.coarse)]
    total = np.full(len(x), m.base)

    def gradient() -> tuple[np.ndarray, np.ndarray]:
        q = 1.0 / (1.0 + np.exp(-total))
        return y - q, q * (1 - q)

    for _ in range(rounds):
        for j, table in enumerate(m.tables):
            g, h = gradient()
            step = rate * _tree(np.bincount(bins[j], g, len(table)), np.bincount(bins[j], h, len(table)))
            table += step
            total += step[bins[j]]

    def grid(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(m.coarse[a]) + 1, len(m.coarse[b]) + 1)
        cell = rough[a] * shape[1] + rough[b]
        g, h = gradient()
        n = shape[0] * shape[1]
        return np.bincount(cell, g, n).reshape(shape), np.bincount(cell, h, n).reshape(shape)

    options = [(a, b) for a in range(x.shape[1]) for b in range(a) if len(m.coarse[a]) and len(m.coarse[b])]
    best = sorted(((_pair_tree(*grid(a, b))[0], a, b) for a, b in options), reverse=True)[:n_pairs]
    m.pairs = [(a, b, np.zeros((len(m.coarse[a]) + 1, len(m.coarse[b]) + 1))) for _, a, b in best]
    for _ in range(rounds // 2):
        for a, b, table in m.pairs:
            step = rate * _pair_tree(*grid(a, b))[1]
            table += step
            total += step[rough[a], rough[b]]
    return m


def fit(featured: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality",
        max_rows: int = MAX_ROWS, seed: int = 7) -> Model:
    """Fit on at most ``max_rows`` labelled rows of ``featured`` (doc_id, x), by seeded hash of the id."""
    marked = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(
        F.col(doc_id).alias("_id"), F.col(label).cast("double").alias("_y"))
    rows = featured.join(marked, featured["doc_id"] == marked["_id"]).select("x", "_y", "_id")
    rows = rows.orderBy(F.xxhash64(F.lit(seed), "_id"), "_id", "_y").limit(max_rows).select("x", "_y").toPandas()
    if not len(rows):
        return Model()
    return fit_rows(np.stack(rows["x"].to_numpy()), rows["_y"].to_numpy(dtype=float))


def scorer(model: Model):
    """Column function features -> score."""

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=float)
        return pd.Series(model.score(np.stack(x.to_numpy())))

    return score
