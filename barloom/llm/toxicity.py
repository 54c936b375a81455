"""Toxicity by cumulative-link ordinal regression on sparse text features.

Features are the words of a text and the beginnings of its words, in lower case. A feature is telling if chance alone would
put so many toxic rows among the rows that have it with a probability of at most ``alpha`` (Chernoff's bound on the binomial
tail, so the rule is the same for few and for many rows); the ``n_features`` most telling make the vocabulary. Labelled
toxic documents get severity grades 1 to 3 by thirds of how much telling vocabulary they use, all others grade 0. One
vector of weights serves all thresholds: P(grade > k) = logistic(w . x - theta_k), theta ascending. The output is the
expected grade.

A text is toxic if P(grade > 0) is above the model's cut. The cut comes from rows that were held out: the sample is dealt
into ``FOLDS`` parts by a hash of the id, each part is scored by a model that chose its vocabulary and learnt from the
others, and the cut is the score that at most ``max_false`` of the held-out rows labelled not toxic exceed, but never less
than ``min_cut``.

Cases: a null, empty or wordless text has no features and the severity of such a text. Very long texts are read whole.
Without labelled toxic rows nothing is toxic. Ties: features of equal probability are taken by name; a score equal to the
cut is not toxic. Repeated rows score alike; an empty table gives an empty result; other columns are ignored by
``grade_documents`` and come back unchanged from ``keep_civil``, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import labelled
from barloom.llm.arrow import filtered, with_computed
from barloom.llm.common import Scratch

PREFIXES = (3, 4, 5, 6)
GRADES, FOLDS = 3, 3
#: Lower-case letters, digits and all beyond ASCII make words.
PART = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().encode("utf-8", "replace").translate(PART).decode("utf-8").split()


def feature_names(words: set[str]) -> set[str]:
    """The words, and ^ with the first characters of each longer one."""
    return words | {"^" + w[:k] for w in words for k in PREFIXES if len(w) > k}


@dataclass
class OrdinalModel:
    vocabulary: dict[str, int]
    weights: np.ndarray
    theta: np.ndarray  # ascending; empty if there was nothing to learn
    cut: float = 0.5

    def __post_init__(self):
        self.names = set(self.vocabulary)

    def row(self, text: str | None) -> tuple[list[int], list[float]]:
        """Columns and values, log(1 + count), of one text's features."""
        words = words_of(text)
        hit = feature_names(set(words)) & self.names
        if not hit:
            return [], []
        count: Counter[str] = Counter()
        for w in words:
            for name in (w, *("^" + w[:k] for k in PREFIXES if len(w) > k)):
                if name in hit:
                    count[name] += 1
        cols = sorted((self.vocabulary[n], c) for n, c in count.items())
        return [c for c, _ in cols], [float(np.log1p(n)) for _, n in cols]

    def exceed(self, texts: list[str | None]) -> np.ndarray:
        """P(grade > k) by text and threshold k = 0, 1, 2."""
        return exceed([self.row(t) for t in texts], self.weights, self.theta)


def exceed(rows: list[tuple[list[int], list[float]]], weights: np.ndarray, theta: np.ndarray) -> np.ndarray:
    if not len(theta):
        return np.zeros((len(rows), GRADES))
    dot = np.array([float(weights[c] @ np.array(v)) if c else 0.0 for c, v in rows])
    return 1 / (1 + np.exp(-np.clip(dot[:, None] - theta[None, :], -30, 30)))


def fit_ordinal(rows: list[tuple[list[int], list[float]]], y: np.ndarray, n_features: int, steps: int = 150, rate: float = 0.1, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds by Adam on the likelihood of the grades."""
    size = np.array([len(c) for c, _ in rows])
    at = np.repeat(np.arange(len(rows)), size)
    col = np.concatenate([np.array(c, dtype=np.int64) for c, _ in rows]) if size.sum() else np.zeros(0, np.int64)
    val = np.concatenate([np.array(v, dtype=float) for _, v in rows]) if size.sum() else np.zeros(0)
    share = [(y > k).mean() for k in range(GRADES)]
    start = np.array([-np.log((s + 1e-4) / (1 - s + 1e-4)) for s in share])
    # theta_0, then the logarithms of the gaps, keep the thresholds in order
    par = np.r_[np.zeros(n_features), start[0], np.log(np.maximum(np.diff(start), 0.1))]
    m, v = np.zeros_like(par), np.zeros_like(par)
    edge = np.eye(GRADES + 1)[y]
    for t in range(1, steps + 1):
        w, gaps = par[:n_features], np.exp(par[n_features + 1 :])
        theta = par[n_features] + np.r_[0.0, np.cumsum(gaps)]
        dot = np.bincount(at, w[col] * val, len(rows))
        s = 1 / (1 + np.exp(-np.clip(dot[:, None] - theta, -30, 30)))  # P(y > k)
        full = np.hstack([np.ones((len(y), 1)), s, np.zeros((len(y), 1))])
        prob = np.maximum(((full[:, :-1] - full[:, 1:]) * edge).sum(1), 1e-9)
        slope = s * (1 - s)
        # d prob / d (dot - theta_k): the grade above gains, the grade below loses
        d = (edge[:, 1:] - edge[:, :-1]) * slope / prob[:, None]
        g_theta = d.sum(0)  # of the negative log-likelihood, by theta
        g = np.empty_like(par)
        g[:n_features] = -np.bincount(col, d.sum(1)[at] * val, n_features) / len(y) + decay * w
        g[n_features] = g_theta.sum() / len(y)
        g[n_features + 1 :] = np.cumsum(g_theta[::-1])[::-1][1:] * gaps / len(y)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        par -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return par[:n_features], par[n_features] + np.r_[0.0, np.cumsum(np.exp(par[n_features + 1 :]))]


def graded_fit(rows: list[tuple[list[int], list[float]]], toxic: np.ndarray, n_features: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds after the toxic rows have got their grades: thirds of the sum of their features."""
    mass = np.array([sum(v) for _, v in rows])
    if not toxic.any():
        return np.zeros(0), np.zeros(0)
    thirds = np.quantile(mass[toxic], [1 / 3, 2 / 3])
    return fit_ordinal(rows, np.where(toxic, 1 + (mass[:, None] > thirds[None, :]).sum(1), 0), n_features)


def telling(counts: DataFrame, n_rows: int, n_toxic: int, n: str, toxic: str, alpha: float, n_features: int) -> list[str]:
    """The most telling features of ``counts`` (name, rows, toxic rows), given how many rows and toxic rows there are."""
    if not 0 < n_toxic < n_rows:
        return []
    rate = n_toxic / n_rows
    share = F.col(toxic) / F.col(n)
    part = lambda p, base: F.when(p > 0, p * F.log(p / base)).otherwise(0.0)
    chance = F.round(-F.col(n) * (part(share, rate) + part(1 - share, 1 - rate)), 9)  # its logarithm
    found = counts.filter(F.col(n) > 0).filter(share > rate).select("name", chance.alias("chance")).filter(F.col("chance") <= float(np.log(alpha)))
    return [r["name"] for r in found.orderBy("chance", "name").limit(n_features).collect()]


def train(
    docs: DataFrame, labels: DataFrame, label_col: str = "toxic", max_rows: int = labelled.MAX_ROWS, n_features: int = 1024,
    alpha: float = 0.01, max_false: float = 0.005, min_cut: float = 0.25,
) -> OrdinalModel:
    """Fit on a bounded sample of labelled rows. Features are counted on Spark; only the vocabulary's part comes to the driver."""
    scratch = Scratch(docs.sparkSession)
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold")
    picked = scratch.write(labelled.sample(docs, labels, label_col, max_rows).select(F.col("doc_id").cast("string").alias("doc_id"), "text", (F.col("y") > 0).alias("toxic"), fold))
    sizes = {r["fold"]: (r["n"], r["toxic"]) for r in picked.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.count_if("toxic").alias("toxic")).collect()}
    n, toxic = sum(a for a, _ in sizes.values()), sum(b for _, b in sizes.values())
    if not 0 < toxic < n:
        scratch.close()
        return OrdinalModel({}, np.zeros(0), np.zeros(0))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen, bad = Counter(), Counter()
            for text, y, part in zip(pdf["text"], pdf["toxic"], pdf["fold"], strict=True):
                names = [(x, part) for x in feature_names(set(words_of(text)))]
                seen.update(names)
                if y:
                    bad.update(names)
            yield pd.DataFrame({"name": [x for x, _ in seen], "fold": [k for _, k in seen], "n": list(seen.values()), "toxic": [bad[k] for k in seen]})

    counted = picked.select("text", "toxic", "fold").mapInPandas(count, "name string, fold int, n long, toxic long")
    both = lambda cond, k: [F.sum(F.when(cond, F.col(c)).otherwise(0)).alias(f"{c}{k}") for c in ("n", "toxic")]
    every = F.lit(True)
    counts = scratch.write(counted.groupBy("name").agg(*both(every, ""), *[x for k in range(FOLDS) for x in both(F.col("fold") != k, k)]))
    chosen = {None: telling(counts, n, toxic, "n", "toxic", alpha, n_features)}
    for k in range(FOLDS):
        out = sizes.get(k, (0, 0))
        chosen[k] = telling(counts, n - out[0], toxic - out[1], f"n{k}", f"toxic{k}", alpha, n_features)
    union = sorted(set().union(*chosen.values()))
    seer = OrdinalModel({x: i for i, x in enumerate(union)}, np.zeros(len(union)), np.zeros(0))

    def start():
        def vectors(texts):
            rows = [seer.row(t) for t in texts]
            # as bytes: an empty list has no type
            return {"cols": [np.array(c, np.int32).tobytes() for c, _ in rows], "vals": [np.array(v, float).tobytes() for _, v in rows]}

        return vectors

    got = with_computed(picked, "text", start, "cols binary, vals binary").toPandas()
    got = got.sort_values(["doc_id", "cols", "vals"], ignore_index=True, kind="stable")  # the order of tasks must not matter
    rows = [(np.frombuffer(c, np.int32), np.frombuffer(v, float)) for c, v in zip(got["cols"], got["vals"], strict=True)]
    y, part = got["toxic"].to_numpy(bool), got["fold"].to_numpy(int)

    def narrowed(names: list[str]) -> list[tuple[list[int], list[float]]]:
        to = np.full(len(union), -1)
        to[[seer.vocabulary[x] for x in names]] = np.arange(len(names))
        return [(to[c][to[c] >= 0].tolist(), v[to[c] >= 0].tolist()) for c, v in rows]

    held = np.zeros(n)
    for k in range(FOLDS):
        if (part == k).any():
            use = narrowed(chosen[k])
            w, theta = graded_fit([r for r, p in zip(use, part, strict=True) if p != k], y[part != k], len(chosen[k]))
            held[part == k] = exceed([r for r, p in zip(use, part, strict=True) if p == k], w, theta)[:, 0]
    cut = max(min_cut, float(np.quantile(held[~y], 1 - max_false, method="higher")))
    weights, theta = graded_fit(narrowed(chosen[None]), y, len(chosen[None]))
    scratch.close()
    return OrdinalModel({x: i for i, x in enumerate(chosen[None])}, weights, theta, cut)


def grade_documents(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, severity (expected grade, 0 to 3), p_toxic (of any grade above 0), grade (likeliest), toxic (p_toxic above the model's cut)."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return with_computed(slim, "text", lambda: lambda texts: graded(model, texts), "severity double, p_toxic double, grade int, toxic boolean")


def graded(model: OrdinalModel, texts: list[str | None]) -> dict[str, np.ndarray]:
    p = model.exceed(texts)
    full = np.hstack([np.ones((len(p), 1)), p, np.zeros((len(p), 1))])
    return {"severity": p.sum(1), "p_toxic": p[:, 0], "grade": np.argmax(full[:, :-1] - full[:, 1:], axis=1).astype(np.int32), "toxic": p[:, 0] > model.cut}


def keep_civil(docs: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """The rows whose text is not toxic, with all their columns."""
    return filtered(docs, text_col, lambda: lambda texts: ~graded(model, texts)["toxic"])
