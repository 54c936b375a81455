"""Quality rules with adaptive thresholds: per language and source, from mergeable quantile sketches.

Base features are exact and come from one pass over the whole texts. Quantile sketches (``percentile_approx``, merged
from partial sketches of each task) per language and source give each rate its own upper fence, in place of one fixed
cut-off; documents meet their fences in a join with the small table of thresholds.

A fence lies ``spread`` times the distance from the median to the ``high`` quantile above the median, so it follows what
is usual in its group alone. A group's fence is drawn towards that of its language, and a language's towards that of all
documents, with the weight of ``prior`` documents: small groups lean on the larger ones without a size at which the rule
changes. A document fails a rate only if its count also exceeds the fence by more than chance explains: by ``noise``
standard deviations of a count with the fence as its rate (and by ``noise`` at least, where the fence is 0).

Cases: a null, empty or blank text has no words: all counts are 0 and the base rule rejects it. Null languages and
sources form groups of their own. A rate equal to its fence is within it. Long texts are counted whole; the allowance for
chance shrinks with their length. Repeated rows are judged alike and each counts in its group. An empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.arrow import with_computed
from barloom.llm.common import Scratch

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 8
#: Rates that have an upper fence: the count and what it is a part of.
RATES = {
    "symbol_rate": ("n_symbols", "n_words"), "dup_line_rate": ("n_dup_lines", "n_lines"), "repeat_rate": ("n_repeat_words", "n_words"),
    "upper_rate": ("n_upper", "word_chars"), "stutter_rate": ("n_stutters", "n_words"),
}
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_stutters long"


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words that lie in windows of ``size`` words found twice or more in the list."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    seq = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.uint64)
    if len(ids) > len(words) - 1:
        return 0
    seq = (seq + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    seq ^= seq >> np.uint64(29)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        h = h * np.uint64(0xD6E8FEB86659FD93) + seq[j : j + n]
    order = np.argsort(h, kind="stable")
    twin = h[order[1:]] == h[order[:-1]]
    if not twin.any():
        return 0
    hit = np.zeros(n, dtype=bool)
    hit[order[1:][twin]] = hit[order[:-1][twin]] = True
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, np.flatnonzero(hit), 1)
    np.add.at(edge, np.flatnonzero(hit) + size, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def text_features(text: str | None) -> tuple[int, ...]:
    """The columns of FEATURES for one text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes are split at ASCII white space only
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (
        len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
        repeated_words(words), len(lines), len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
        sum(map(eq, words, words[1:])),
    )


def base_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """doc_id, the kept columns, and FEATURES of each whole text."""
    slim = docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).alias("text"))
    names = [x.split()[0] for x in FEATURES.split(", ")]

    def start():
        return lambda texts: dict(zip(names, np.array([text_features(t) for t in texts], dtype=np.int64).reshape(len(texts), len(names)).T, strict=True))

    return with_computed(slim, "text", start, FEATURES)


def with_rates(features: DataFrame) -> DataFrame:
    return features.withColumns({r: F.col(n) / F.greatest(F.col(of), F.lit(1)) for r, (n, of) in RATES.items()})


def fences(rates: DataFrame, by: list[str], accuracy: int = 1000, high: float = 0.75, spread: float = 3.0) -> DataFrame:
    """Upper fences by group: the median plus ``spread`` times the distance from it to the ``high`` quantile."""
    sketch = [F.percentile_approx(r, [0.5, high], accuracy).alias(r) for r in RATES]
    q = rates.groupBy(*by).agg(F.count(F.lit(1)).alias("n_group"), *sketch)
    return q.select(*by, "n_group", *[(F.col(r)[0] + spread * (F.col(r)[1] - F.col(r)[0])).alias(f"max_{r}") for r in RATES])


def exceeds(rate: str, noise: float) -> Column:
    """Whether the count of a rate lies above its fence by more than chance explains.

    Repeated words come in runs of a window, so their chance is that of runs.
    """
    n, of = RATES[rate]
    expected = F.col(f"max_{rate}") * F.col(of)
    run = WINDOW if rate == "repeat_rate" else 1
    return F.col(n) > expected + noise * F.sqrt(F.greatest(expected, F.lit(float(run))) * run)


def base_failed(min_words: int = 20, max_repeat_percent: int = 30) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def adaptive_quality(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    prior: float = 50.0, accuracy: int = 1000, high: float = 0.75, spread: float = 3.0, noise: float = 4.0,
) -> DataFrame:
    """One row per document: doc_id, base features, rates, its fences, ``failed_rules``, base_failed and kept."""
    scratch = Scratch(docs.sparkSession)
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    rates = scratch.write(with_rates(base_features(named)))
    every = fences(rates, [], accuracy, high, spread).first()  # one row
    by_lang = fences(rates, ["lang"], accuracy, high, spread)
    by_both = fences(rates, ["lang", "source"], accuracy, high, spread)
    limits = [f"max_{r}" for r in RATES]
    drawn = lambda own, n, wider: (own * n + wider * prior) / (n + prior)
    a, b = by_both.alias("a"), by_lang.alias("b")

    def fence(x: str) -> Column:
        lang = drawn(F.col(f"b.{x}"), F.col("b.n_group"), F.lit(every[x]).cast("double"))
        return drawn(F.col(f"a.{x}"), F.col("a.n_group"), lang).alias(x)

    # one row per language and source: a small table, which Spark broadcasts if its written size allows
    table = scratch.write(
        a.join(b, F.col("a.lang").eqNullSafe(F.col("b.lang"))).select(
            F.col("a.lang").alias("of_lang"), F.col("a.source").alias("of_source"), *map(fence, limits)
        )
    )
    joined = rates.join(table, rates["lang"].eqNullSafe(table["of_lang"]) & rates["source"].eqNullSafe(table["of_source"]), "left")
    failed = F.array_compact(F.array(*[F.when(exceeds(r, noise), F.lit(r)) for r in RATES]))
    return (
        joined.withColumn("base_failed", base_failed())
        .withColumn("failed_rules", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
        .drop("of_lang", "of_source")
    )
