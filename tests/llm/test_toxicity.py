import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from vacantia.llm import toxicity


def test_ordinal_fit_recovers_order():
    """Shared weights and ordered thresholds from simulated grades."""
    rng = np.random.default_rng(4)
    true = np.array([2.0, 1.0, -1.0, 0.0])
    rows = []
    for _ in range(4000):
        places = np.flatnonzero(rng.random(4) < 0.5)
        score = true[places].sum() + rng.logistic()
        rows.append((places.tolist(), [1.0] * len(places), int(score > 0.5) + int(score > 2.0)))
    weights, thresholds = toxicity.fit_ordinal(rows, 4, 3)
    assert np.allclose(weights, true, atol=0.35)
    assert np.allclose(thresholds, [0.5, 2.0], atol=0.35) and thresholds[0] <= thresholds[1]


def corpus(rng, start, n):
    bad, words = ["blorg", "Vexnor!", "vexnash", "vexnill"], [f"w{i}" for i in range(400)]
    docs, grades = [], []
    for i in range(start, start + n):
        grade = rng.choice([0, 0, 0, 1, 2])
        text = rng.choices(words, k=60) + rng.choices(bad, k=[0, 1, 6][grade])
        rng.shuffle(text)
        docs.append((i, " ".join(text)))
        grades.append((i, grade))
    return docs, grades


def test_held_out_accuracy(spark, docs_of):
    rng = random.Random(5)
    seen, grades = corpus(rng, 0, 800)
    unseen, wanted = corpus(rng, 1000, 300)
    table = spark.createDataFrame(grades, "doc_id long, grade int")
    rows = toxicity.graded(docs_of(*seen), table, "doc_id", "text", "grade")
    chosen = toxicity.choose(rows)
    model = toxicity.train(toxicity.vectors(rows, chosen), chosen, 3)
    found = {r["key"]: r for r in toxicity.predict(docs_of(*unseen), model).collect()}
    wanted = dict(wanted)
    right = sum((found[i]["grade"] > 0) == (g > 0) for i, g in wanted.items())
    assert right >= 0.97 * len(wanted)
    mean = lambda g: np.mean([found[i]["expected_severity"] for i, x in wanted.items() if x == g])
    assert mean(0) < 0.2 < mean(1) < mean(2)
    for r in found.values():
        assert abs(sum(r["above"]) - r["expected_severity"]) < 1e-9 and r["above"][0] >= r["above"][1]


def test_edge_cases(spark, docs_of):
    docs = docs_of((1, None), (2, ""), (2, ""), (None, "word " * 20000))
    none = spark.createDataFrame([], "doc_id long, toxic int")
    some = spark.createDataFrame([(1, None), (None, 1), (2, 0), (2, 0)], "doc_id long, toxic int")
    for labels in (none, some):
        rows = toxicity.graded(docs, labels, "doc_id", "text", "toxic")
        chosen = toxicity.choose(rows)
        model = toxicity.train(toxicity.vectors(rows, chosen), chosen, 3)
        found = toxicity.predict(docs, model).collect()
        assert len(found) == 4 and all(r["expected_severity"] < 1e-6 and r["grade"] == 0 for r in found)
    assert toxicity.predict(docs.limit(0), model).count() == 0


def penalised(rows, size, rest, decay=2e-5):
    """The mean log-likelihood less the penalty, row by row in plain Python."""
    weights, thresholds = rest[:size], rest[size:]
    total = 0.0
    for places, values, grade in rows:
        score = sum(weights[p] * v for p, v in zip(places, values))
        above = [1.0, *[1 / (1 + math.exp(t - score)) for t in thresholds], 0.0]
        total += math.log(above[grade] - above[grade + 1])
    return total / len(rows) - decay / 2 * sum(w * w for w in weights)


def test_fit_is_the_optimum():
    """Differences of the plain likelihood vanish at the fit, and no step away from it is better."""
    rng = np.random.default_rng(6)
    rows = []
    for _ in range(300):
        places = np.flatnonzero(rng.random(5) < 0.5)
        values = rng.uniform(1, 3, len(places))
        score = (np.array([1.0, -0.5, 0.3, 0.0, -1.0])[places] * values).sum() + rng.logistic()
        rows.append((places.tolist(), values.tolist(), int(score > -0.5) + int(score > 1.0)))
    rest = np.concatenate(toxicity.fit_ordinal(rows, 5, 3, rounds=3000))
    best, h = penalised(rows, 5, rest), 1e-5
    for step in np.eye(len(rest)):
        slope = (penalised(rows, 5, rest + h * step) - penalised(rows, 5, rest - h * step)) / (2 * h)
        assert abs(slope) < 1e-3
    for _ in range(50):
        assert penalised(rows, 5, rest + rng.normal(0, 0.2, len(rest))) <= best + 1e-9
    early = np.concatenate(toxicity.fit_ordinal(rows, 5, 3))
    assert penalised(rows, 5, early) >= best - 1e-3


def test_features_by_plain_counts(spark, docs_of):
    """The features are those that plain counts choose, however many; other columns are not read."""
    rng = random.Random(8)
    seen, grades = corpus(rng, 0, 300)
    table = spark.createDataFrame(grades, "doc_id long, grade int").withColumn("text", F.lit("clash"))
    docs = docs_of(*seen).withColumns({c: F.lit("clash") for c in ("grade", "key", "places", "bucket", "severe")})
    rows = toxicity.graded(docs, table, "doc_id", "text", "grade")
    n, severe, by_id = Counter(), Counter(), dict(grades)
    for i, text in seen:
        found = {b for w in set(text.lower().split()) for b in toxicity.buckets_of(w)}
        n.update(found)
        severe.update(found if by_id[i] > 0 else ())
    above = sum(g > 0 for g in by_id.values())
    rate = above / len(by_id)
    want = {b for b in n if severe[b] >= 3 and (severe[b] - n[b] * rate) / math.sqrt(n[b] * rate * (1 - rate)) >= 4
            and severe[b] * (len(by_id) - above) >= 2 * above * (n[b] - severe[b])}
    chosen = toxicity.choose(rows)
    assert set(chosen.tolist()) == want and len(want) == len(chosen) > 3
    made = toxicity.vectors(rows, chosen)
    assert made.columns == ["key", "grade", "places", "values"] and made.count() == len(seen)
    found = toxicity.predict(docs, toxicity.train(made, chosen, 3))
    assert found.columns == ["key", "expected_severity", "grade", "above"] and found.count() == len(seen)
