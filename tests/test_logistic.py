"""The logistic regression against plain arithmetic."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vacantia.operators import classify

FEATURES = 64


def corpus(n, seed):
    rng = random.Random(seed)
    words = {"a": "red green blue", "b": "green one two", "c": "two three blue"}
    shared = [f"w{i}" for i in range(8)]
    return [(i, label, " ".join(rng.choices(words[label].split() + shared, k=rng.randrange(3, 12))).title())
            for i in range(n) for label in [rng.choice("aabc")]]


@pytest.fixture(scope="module")
def fitted(spark):
    given = corpus(240, 1)
    rows = spark.createDataFrame(given, "doc_id long, label string, description string")
    rows = rows.unionByName(spark.createDataFrame([(900, None, "red"), (901, "a", None)], rows.schema))
    return given, rows, classify.train_logistic(rows, features=FEATURES, iterations=400, tolerance=1e-9)


def plain_features(given, model):
    """Counts of hashed words, weighted by the logarithm of their rarity."""
    hashing = model.stages[1]
    counts = [Counter(hashing.indexOf(w) for w in re.findall(r"\w+", text.lower())) for _, _, text in given]
    texts_with = Counter(i for c in counts for i in c)
    out = np.zeros((len(given), FEATURES))
    for row, c in enumerate(counts):
        for i, n in c.items():
            out[row, i] = n * math.log((len(given) + 1) / (texts_with[i] + 1))
    return out


def probabilities(x, weights, intercepts):
    scores = x @ weights.T + intercepts
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def test_optimum_by_plain_arithmetic(fitted):
    given, rows, model = fitted
    x, regression = plain_features(given, model), model.stages[-2]
    labels = model.stages[-1].getLabels()
    assert labels == ["a", "b", "c"]
    real = np.array([[label == c for c in labels] for _, label, _ in given], float)
    weights, intercepts = regression.coefficientMatrix.toArray(), regression.interceptVector.toArray()
    spread = x.std(axis=0, ddof=1)

    def loss(w, b):
        p = (probabilities(x, w, b) * real).sum(axis=1)
        return -np.log(p).mean() + classify.PENALTY / 2 * ((w * spread) ** 2).sum()

    said = probabilities(x, weights, intercepts)
    slope = (said - real).T @ x / len(x)
    gradient = np.divide(slope, spread, out=np.zeros_like(slope), where=spread > 0) + classify.PENALTY * weights * spread
    assert np.abs(gradient).max() < 1e-4 and np.abs((said - real).sum(axis=0)).max() < 0.02
    found = {r["label"]: r for r in classify.optimality(rows, model).collect()}
    for i, name in enumerate(labels):
        assert found[name]["texts"] == real[:, i].sum()
        assert abs(found[name]["expected_texts"] - said[:, i].sum()) < 1e-6
        assert abs(found[name]["gradient"] - np.abs(gradient[i]).max()) < 1e-7
    best, rng = loss(weights, intercepts), np.random.default_rng(2)
    for _ in range(50):
        assert loss(weights + rng.normal(0, 0.05, weights.shape), intercepts + rng.normal(0, 0.05, 3)) > best


def test_predictions_by_plain_arithmetic(fitted):
    given, rows, model = fitted
    said = probabilities(plain_features(given, model), model.stages[-2].coefficientMatrix.toArray(),
                         model.stages[-2].interceptVector.toArray())
    found = {r["doc_id"]: r["predicted_label"] for r in classify.predict_logistic(rows, model).collect()}
    assert set(found) == {i for i, _, _ in given} | {900, 901}
    for (i, _, _), p in zip(given, said):
        assert found[i] == "abc"[p.argmax()]


def test_a_model_that_stopped_early_is_told(fitted):
    _, rows, model = fitted
    early = classify.train_logistic(rows, features=FEATURES, iterations=2)
    worst = lambda m: classify.optimality(rows, m).agg(F.max("gradient")).first()[0]
    assert worst(early) > 1e-3 > 1e-4 > worst(model)


def test_texts_are_split_once(spark, monkeypatch):
    """Words hashed beforehand give the same model and labels, and no step of ``lr_domain`` reads texts again."""
    given = corpus(120, 3) + [(900, "a", None)]
    rows = spark.createDataFrame(given, "doc_id long, label string, description string")
    hashed = classify.hash_words(rows, features=FEATURES)
    assert "description" not in hashed.columns and hashed.count() == len(given)
    known = rows.filter("description is not null").select("doc_id")
    models = [classify.train_logistic(r, features=FEATURES) for r in (rows, hashed.join(known, "doc_id"))]
    assert np.allclose(*[m.stages[-2].coefficientMatrix.toArray() for m in models], atol=1e-6)
    by_text = {tuple(r) for r in classify.predict_logistic(rows, models[0]).collect()}
    assert by_text == {tuple(r) for r in classify.predict_logistic(hashed, models[0]).collect()} and len(by_text) == len(given)

    from conftest import FOLDER
    from vacantia.plans.queries import QUERIES
    calls = []
    split = classify.RegexTokenizer._transform
    monkeypatch.setattr(classify.RegexTokenizer, "_transform", lambda self, table: calls.append(self) or split(self, table))
    assert QUERIES["lr_domain"](spark, FOLDER).count() > 0
    assert len(calls) == 1
