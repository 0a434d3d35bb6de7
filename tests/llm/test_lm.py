import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from vacantia.llm import lm


def plain(rows, weights):
    tokens = [(k, (t or "").encode().lower().split() + [lm.END], k is not None and zlib.crc32(str(k).encode()) % 7 == 2) for k, t in rows]
    count, pair = Counter(), Counter()
    for _, t, held in tokens:
        if not held:
            count.update(t)
            pair.update(zip([lm.END, *t], t))
    n, v = sum(count.values()), len(count)
    out = []
    for k, t, held in tokens:
        total = 0.0
        for h, w in zip([lm.END, *t], t):
            a = weights[count[h].bit_length()]
            total += math.log10(a[0] * (pair[h, w] / count[h] if count[h] else 0) + a[1] * count[w] / max(1, n) + a[2] / (v + 1))
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t)
        out.append((k, held, len(t), sum(count[w] > 0 for w in t), n, round(base, 6), round(total, 6)))
    return sorted(out, key=repr)


def scored(docs, monkeypatch, chunk, parts):
    learned, learn = [], lm.learn
    monkeypatch.setattr(lm, "learn", lambda *a: learned.append(learn(*a)) or learned[-1])
    monkeypatch.setattr(lm, "CHUNK_CHARS", chunk)
    monkeypatch.setattr(lm, "PART_KEYS", parts)
    rows = [(r["key"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6))
            for r in lm.score(docs).collect()]
    return sorted(rows, key=repr), learned[0]


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"W{i}" for i in range(300)]
    rows = []
    for k in range(n):
        at, text = rng.randrange(300), []
        for _ in range(rng.randrange(60)):
            at = (at * 7 + rng.choice([0, 1, 1, 2])) % 300 if rng.random() < 0.8 else rng.randrange(300)
            text.append(words[at])
        rows.append((k, " ".join(text)))
    return rows + [(None, "w1 w2"), (None, None), (5, "w1"), (5, "w1"), (10**9, ""), (77, "x " * 3000)]


def test_against_plain_counts(docs_of, monkeypatch):
    rows = corpus(16, 400)
    docs = docs_of(*rows).withColumn("chunk", F.lit("clash")).withColumn("held", F.lit(0))
    for chunk, parts in ((10**7, 10**6), (3000, 500)):
        found, weights = scored(docs, monkeypatch, chunk, parts)
        assert found == plain(rows, weights)


def test_context_helps_on_held_out_text(docs_of, monkeypatch):
    found, weights = scored(docs_of(*corpus(17, 1500)), monkeypatch, 10**7, 10**6)
    held = [r for r in found if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held) + 0.05 * sum(r[2] for r in held)
    assert weights[0][0] == 0 and np.allclose(weights.sum(axis=1), 1)


def test_weights_raise_the_held_out_likelihood():
    rng = np.random.default_rng(18)
    cells = ((rng.integers(1, 8, 500) * lm.GRID + rng.integers(0, 90, 500)) * lm.GRID + rng.integers(30, 60, 500))
    counts = rng.integers(1, 50, 500)
    value = lambda q: np.where(q > 0, 2.0 ** ((q + lm.LOW) / lm.PER_OCTAVE), 0)
    estimates = np.stack([value(cells // lm.GRID % lm.GRID), value(cells % lm.GRID), np.ones(500)], axis=1)
    gain = [float((counts * np.log((estimates * lm.learn(cells, counts, n)[cells // lm.GRID ** 2]).sum(axis=1))).sum())
            for n in (1, 3, 10, 40)]
    assert gain == sorted(gain)


def test_packing():
    rng = np.random.default_rng(19)
    for values in (np.zeros(0, np.uint64), np.zeros(5, np.uint64), rng.integers(0, 300, 1000), rng.integers(0, 2**64, 77, dtype=np.uint64)):
        assert np.array_equal(lm.unpack(lm.pack(values)), values.astype(np.uint64))


def test_no_rows(docs_of):
    assert lm.score(docs_of((1, "x")).limit(0)).count() == 0
    only_held = [k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2][0]
    row = lm.score(docs_of((only_held, "a b"))).first()
    assert (row["train_tokens"], row["n_known"], row["base_score"]) == (0, 0, 0.0) and row["score"] <= 0
