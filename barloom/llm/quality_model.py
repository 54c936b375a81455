"""Quality classifier: a generalised additive model with pairwise interactions.

Rates of each whole text are cut into quantile bins. Boosting goes round the features: each in turn gets a shallow tree
on the current residuals, added to its lookup table at a small rate; then the pairs that explain most of what is left
get tables of their own in the same way. A score is the logistic of an intercept plus one table entry per feature and pair.

Cases: a null or empty text has the features of no words and gets a score like any other; very long texts are read whole.
A value equal to a bin's edge lies in the bin above. Without labelled rows all
scores are 0.5. Repeated rows score alike; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import labelled
from barloom.llm.arrow import with_computed
from barloom.llm.quality_rules import text_features

NAMES = [
    "log_words", "word_length", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "digit_rate", "bang_rate",
    "pipe_rate", "stop_rate", "comma_rate", "words_per_line", "unique_rate", "one_byte_words", "longest_line_share", "non_ascii_rate",
]


def features(text: str | None) -> list[float]:
    """The values of NAMES for one text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    n, chars, symbols, dup, rep, lines, upper, _ = text_features(text)
    words, per, per_char = raw.split(), 1 / max(n, 1), 1 / max(len(raw), 1)
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    ascii_bytes = len(raw.translate(None, bytes(range(128, 256))))
    return [
        np.log1p(n), chars * per, symbols * per, dup / max(lines, 1), rep * per, upper * per_char, digits * per_char,
        raw.count(b"!") * per, raw.count(b"|") * per, raw.count(b".") * per, raw.count(b",") * per, n / max(lines, 1),
        len(set(words)) * per, sum(len(w) == 1 for w in words) * per, max(map(len, raw.split(b"\n"))) * per_char, 1 - ascii_bytes * per_char,
    ]


def feature_matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t) for t in texts], dtype=float).reshape(len(texts), len(NAMES))


def _best_splits(grad: np.ndarray, hess: np.ndarray, leaves: int, least: float) -> np.ndarray:
    """Leaf values by bin of a shallow tree on a row of bins: the best cut of any leaf, until there are ``leaves``."""
    cuts, n = [0, len(grad)], len(grad)
    g, h = np.r_[0.0, np.cumsum(grad)], np.r_[0.0, np.cumsum(hess)]
    score = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1.0)
    while len(cuts) - 1 < leaves:
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:], strict=False):
            mid = np.arange(a + 1, b)
            mid = mid[(h[mid] - h[a] >= least) & (h[b] - h[mid] >= least)]
            if len(mid):
                gain = score(a, mid) + score(mid, b) - score(a, b)
                k = int(np.argmax(gain))
                best = max(best, (float(gain[k]), int(mid[k])), key=lambda x: x[0])
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(n)
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1.0)
    return out


def _best_quarters(grad: np.ndarray, hess: np.ndarray, least: float) -> tuple[float, np.ndarray]:
    """Gain, and leaf values by cell, of the best tree on two axes: one cut of each."""
    g = np.pad(grad.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    h = np.pad(hess.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    i, j = np.arange(1, len(grad))[:, None], np.arange(1, grad.shape[1])[None, :]

    def quarters(c):
        a, left, top, all_ = c[i, j], c[i, -1] + 0 * j, c[-1, j] + 0 * i, c[-1, -1]
        return [a, left - a, top - a, all_ - left - top + a]

    parts = list(zip(quarters(g), quarters(h), strict=True))
    gain = sum(x**2 / (y + 1.0) for x, y in parts)
    gain = np.where(np.minimum.reduce([y for _, y in parts]) >= least, gain, -1.0)
    if not gain.size or gain.max() <= 0:
        return 0.0, np.zeros_like(grad)
    a, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
    value = [float(x[a, b] / (y[a, b] + 1.0)) for x, y in parts]
    out = np.empty_like(grad)
    out[: a + 1, : b + 1], out[: a + 1, b + 1 :], out[a + 1 :, : b + 1], out[a + 1 :, b + 1 :] = value
    return float(gain[a, b]), out


@dataclass
class AdditiveModel:
    edges: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    intercept: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]

    def raw_score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        if self.tables:
            fine, coarse = self.bins(x, self.edges), self.bins(x, self.coarse)
            for t, b in zip(self.tables, fine, strict=True):
                out += t[b]
            for (i, j), t in self.pairs.items():
                out += t[coarse[i], coarse[j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw_score(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 60, n_pairs: int = 10, rate: float = 0.1, n_bins: int = 64, n_coarse: int = 12) -> AdditiveModel:
    """Cyclic boosting of shallow trees with the logistic loss."""
    model = AdditiveModel()
    if not len(y):
        return model
    cut = lambda v, n: np.unique(np.quantile(v, np.linspace(0, 1, n + 1)[1:-1]))
    model.edges = [cut(x[:, j], n_bins) for j in range(x.shape[1])]
    model.coarse = [cut(x[:, j], n_coarse) for j in range(x.shape[1])]
    mean = (y.sum() + 0.5) / (len(y) + 1.0)
    model.intercept = float(np.log(mean / (1 - mean)))
    fine, coarse = model.bins(x, model.edges), model.bins(x, model.coarse)
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    f = np.full(len(y), model.intercept)

    def slopes():
        p = 1 / (1 + np.exp(-f))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j, b in enumerate(fine):
            grad, hess = slopes()
            n = len(model.tables[j])
            step = rate * _best_splits(np.bincount(b, grad, n), np.bincount(b, hess, n), 4, 2.0)
            model.tables[j] += step
            f += step[b]

    def cells(i, j, values):
        shape = (len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)
        return np.bincount(coarse[i] * shape[1] + coarse[j], values, shape[0] * shape[1]).reshape(shape)

    grad, hess = slopes()
    gains = {ij: _best_quarters(cells(*ij, grad), cells(*ij, hess), 2.0)[0] for ij in combinations(range(x.shape[1]), 2)}
    chosen = sorted(gains, key=lambda ij: (-gains[ij], ij))[:n_pairs]
    model.pairs = {(i, j): np.zeros((len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)) for i, j in chosen}
    for _ in range(pair_rounds):
        for i, j in chosen:
            grad, hess = slopes()
            step = rate * _best_quarters(cells(i, j, grad), cells(i, j, hess), 2.0)[1]
            model.pairs[i, j] += step
            f += step[coarse[i], coarse[j]]
    return model


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = labelled.MAX_ROWS) -> AdditiveModel:
    """Fit on a bounded sample of labelled rows; only their features come to the driver."""
    picked = labelled.sample(docs, labels, label_col, max_rows).select(F.col("doc_id").cast("string").alias("doc_id"), "y", "text")

    def start():
        return lambda texts: dict(zip(NAMES, feature_matrix(texts).T, strict=True))

    pdf = with_computed(picked, "text", start, ", ".join(f"{n} double" for n in NAMES)).toPandas()
    pdf = pdf.sort_values(["doc_id", *NAMES], ignore_index=True)  # the order of tasks must not matter
    return fit(pdf[NAMES].to_numpy(float), pdf["y"].to_numpy(float))


def score(docs: DataFrame, model: AdditiveModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) of each whole text."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return with_computed(slim, "text", lambda: lambda texts: {"score": model.score(feature_matrix(texts))}, "score double")
