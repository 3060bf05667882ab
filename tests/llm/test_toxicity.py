"""Ordinal toxicity: the fit is a maximum of the likelihood, severity is that of plain code, grades are those of the labels."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from sievelake.llm import toxicity

SCHEMA = "doc_id bigint, text string, toxic string, severity double"


def sentence(rng, n=30):
    return " ".join("".join(rng.choice("abcdef") for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    rows = [(i, sentence(rng) + " awful" * (i % 4 >= 2) + " nastyword worse" * (i % 4 == 3), "x", 0.0) for i in range(400)]
    return spark.createDataFrame([*rows, (None, None, "x", 0.0), (1000, "", "x", 0.0), (3, rows[3][1], "x", 0.0)], SCHEMA)


def plain_probabilities(model, text):
    found = Counter()
    for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
        for f in {w, *(w[:n] + "*" for n in toxicity.PREFIXES if len(w) > n)}:
            if f in model.weights:
                found[f] += 1
    z = sum(model.weights[f] * math.log(1 + c) for f, c in found.items())
    return [1 / (1 + math.exp(t - z)) for t in model.thresholds]


def test_graded_labels(spark, docs):
    labels = spark.createDataFrame([(i, max(0, i % 4 - 1)) for i in range(300)] + [(1, None), (None, 2), (9999, 2)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    got = toxicity.score_toxicity(docs, model).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        p = plain_probabilities(model, texts[r.doc_id])
        assert abs(r.severity - sum(p)) < 1e-9 and r.grade == sum(x >= 0.5 for x in p) and r.rejected == (p[0] >= 0.5)
    assert all(r.grade == max(0, r.doc_id % 4 - 1) for r in got if r.doc_id is not None and 300 <= r.doc_id < 400)  # held out
    assert not any(r.rejected for r in got if r.doc_id in (None, 1000))


def test_binary_labels_give_one_threshold(spark, docs):
    labels = spark.createDataFrame([(i, int(i % 4 >= 2)) for i in range(200)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    assert len(model.thresholds) == 1
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([i for i in range(400) if i % 4 < 2] + [None, 1000], key=repr)


def test_no_or_one_class(spark, docs):
    labels = spark.createDataFrame([(i, 0) for i in range(50)], "doc_id long, toxic int")
    for these in (labels, labels.limit(0)):
        assert toxicity.fit_toxicity(docs, these).thresholds == ()
        assert toxicity.drop_toxic(docs, these).count() == docs.count()
    empty = spark.createDataFrame([], SCHEMA)
    assert toxicity.score_toxicity(empty, toxicity.OrdinalModel()).count() == 0 and toxicity.drop_toxic(empty, labels).count() == 0


def test_gap_in_grades_shares_a_threshold(spark, docs):
    labels = spark.createDataFrame([(i, 3 * int(i % 4 >= 2)) for i in range(200)], "doc_id long, toxic int")
    t = toxicity.fit_toxicity(docs, labels).thresholds
    assert len(t) == 3 and len(set(t)) == 1


def test_fit_is_a_maximum():
    rng = np.random.default_rng(3)
    x = rng.poisson(1.0, (600, 4)).astype(float)
    z = x @ np.array([1.5, -1.0, 0.5, 0.0]) + rng.logistic(size=600)
    grade, weight = np.digitize(z, [0.5, 2.0]), rng.integers(1, 4, 600)
    l2 = 1e-3

    def likelihood(w, cuts):
        edge = np.hstack([np.ones((600, 1)), 1 / (1 + np.exp(-((x @ w)[:, None] - cuts[None]))), np.zeros((600, 1))])
        p = edge[np.arange(600), grade] - edge[np.arange(600), grade + 1]
        return (weight * np.log(p)).sum() / weight.sum() - l2 / 2 * (w**2).sum()

    w, cuts = toxicity.fit_ordinal(x, grade, weight, 3, l2=l2, steps=3000)
    best = likelihood(w, cuts)
    for k in range(4):
        for step in (-0.05, 0.05):
            assert likelihood(w + step * np.eye(4)[k], cuts) < best
    for k in range(2):
        for step in (-0.05, 0.05):
            assert likelihood(w, cuts + step * np.eye(2)[k]) < best
    assert abs(w[0] - 1.5) < 0.3 and abs(w[1] + 1.0) < 0.3
