"""Operators 5 and 6: held-out accuracy, plain loops over tables and weights, determinism, odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import labelled as labelled_rows
from barloom.llm import quality_model, registry, toxicity
from tests.llm.fixtures import empty, odd

SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_rows(spark):
    rows = registry.op5_quality_model(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    bad = [r for r in held if r.quality == 0]
    good = [r for r in held if r.quality == 1]
    assert len(bad) > 5 and np.mean([r.predicted == 0 for r in bad]) >= 0.8
    assert np.mean([r.predicted == 1 for r in good]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    again = registry.op5_quality_model(spark, SF).collect()
    assert sorted(map(str, again)) == sorted(map(str, registry.op5_quality_model(spark, SF).collect())) and len(again) == 1000


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_model.fit(x[:3000], y[:3000], rounds=20, pair_rounds=60, n_pairs=2)
    assert (0, 1) in model.pairs
    assert ((model.score(x[3000:]) > 0.5) == (y[3000:] > 0.5)).mean() > 0.9


def test_ordinal_gradient_and_order():
    rng = np.random.default_rng(1)
    rows, y = [], []
    for _ in range(600):
        k = int(rng.integers(0, 4))
        rows.append(([0, 1] if k else [1], [float(k), 1.0] if k else [1.0]))
        y.append(k)
    w, theta = toxicity.fit_ordinal(rows, np.array(y), 2)
    assert (np.diff(theta) > 0).all() and w[0] > 1
    model = toxicity.OrdinalModel({"bad": 0, "x": 1}, w, theta)
    out = toxicity.graded(model, ["x", "bad x", "bad bad bad bad x", None])
    assert out["severity"][0] < out["severity"][1] < out["severity"][2]


def flags(spark, sf, held_out):
    """(labelled toxic, flagged) of the rows in question, after learning from the others, or from all."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    fourth = F.pmod(F.xxhash64(F.lit("x"), "doc_id"), F.lit(4)) == 0
    model = toxicity.train(docs, labels.filter(~fourth) if held_out else labels)
    asked = labels.filter(fourth) if held_out else labels
    rows = toxicity.grade_documents(docs, model).withColumnRenamed("toxic", "flag").join(asked, "doc_id").collect()
    assert all(0 <= r.severity <= 3 and r.flag == (r.p_toxic > model.cut) for r in rows)
    return [(r.toxic == 1, r.flag) for r in rows]


def test_toxicity(spark):
    """4 to 5 % of the toxic labels are on texts without a telling word."""
    found = flags(spark, SF, False)
    assert np.mean([f for t, f in found if t]) >= 0.9 and np.mean([f for t, f in found if not t]) <= 0.01


def test_toxicity_on_held_out_rows(spark):
    found = flags(spark, SF.replace("0.01", "0.1"), True)
    assert np.mean([f for t, f in found if t]) >= 0.85 and np.mean([f for t, f in found if not t]) <= 0.01


def test_scores_equal_plain_loops(spark):
    """One entry of each table, or one weight a feature, at a time."""
    docs = spark.read.parquet(f"{SF.replace('0.01', '0.001')}/documents.parquet").select("doc_id", "text").unionByName(odd(spark).select("doc_id", "text"))
    learn, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    logistic = lambda x: 1 / (1 + math.exp(-min(max(x, -30), 30)))
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    key = lambda t: (str(t[0]), *t[1:])

    additive = quality_model.train(learn, labels)
    assert additive.pairs and sum(np.abs(t).sum() for t in additive.tables) > 0
    want = []
    for doc_id, text in texts:
        x = [float(v) for v in quality_model.feature_matrix([text])[0]]
        place = lambda edges: [sum(e <= v for e in part) for v, part in zip(x, edges, strict=True)]  # noqa: B023, E731
        fine, coarse = place(additive.edges), place(additive.coarse)
        total = additive.intercept + sum(float(t[b]) for t, b in zip(additive.tables, fine, strict=True)) + sum(float(t[coarse[i]][coarse[j]]) for (i, j), t in additive.pairs.items())
        want.append((doc_id, logistic(total)))
    got = [(r.doc_id, r.score) for r in quality_model.score(docs, additive).collect()]
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[0] == w[0] and g[1] == pytest.approx(w[1], abs=1e-9)

    ordinal = toxicity.train(learn, labels)
    want = []
    for doc_id, text in texts:
        words, dot = toxicity.words_of(text), 0.0
        for name, at in ordinal.vocabulary.items():
            n = sum(w.startswith(name[1:]) and len(w) > len(name) - 1 for w in words) if name[0] == "^" else words.count(name)
            dot += float(ordinal.weights[at]) * math.log(1 + n)
        above = [logistic(dot - float(t)) for t in ordinal.theta]
        grades = [a - b for a, b in zip([1.0, *above], [*above, 0.0], strict=True)]
        want.append((doc_id, sum(above), above[0], grades.index(max(grades)), above[0] > ordinal.cut))
    got = [(r.doc_id, r.severity, r.p_toxic, r.grade, r.toxic) for r in toxicity.grade_documents(docs, ordinal).collect()]
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[0] == w[0] and g[3:] == w[3:] and g[1:3] == pytest.approx(w[1:3], abs=1e-9)
    assert any(w[4] for w in want) and not all(w[4] for w in want)


@pytest.mark.parametrize("labelled", [True, False])
def test_odd_rows(spark, labelled):
    labels = spark.createDataFrame([(4, 1, 0), (7, 0, 1), (None, 1, 1), (99, 1, 1)] if labelled else [], "doc_id long, quality int, toxic int")
    for docs, n in ((odd(spark), 10), (empty(spark), 0)):
        assert quality_model.score(docs, quality_model.train(docs, labels)).count() == n
        model = toxicity.train(docs, labels)
        assert toxicity.grade_documents(docs, model).count() == n
        assert toxicity.keep_civil(docs, model).count() <= n


def test_a_repeated_id_is_one_labelled_row(spark):
    rows = [(1, f"text {i % 40}") for i in range(400)] + [(i, f"own {i}") for i in range(2, 8)] + [(8, None), (8, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 9)], "doc_id long, toxic int")
    got = labelled_rows.sample(docs, labels, "toxic", max_rows=8).collect()
    again = labelled_rows.sample(docs.repartition(3), labels, "toxic", max_rows=8).collect()
    assert sorted(r.doc_id for r in got) == list(range(1, 9)) and sorted(got) == sorted(again)
    assert all(r.y == r.doc_id % 2 for r in got) and {r.text for r in got if 1 < r.doc_id < 8} == {f"own {i}" for i in range(2, 8)}
