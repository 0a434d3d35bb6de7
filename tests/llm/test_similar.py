import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vacantia.llm import similar
from vacantia.llm.common import components


def shingles(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).split(" ")
    words = [w for w in " ".join(words).replace("\n", " ").split(" ") if w]
    if not words:
        return set()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows):
    """n_shingles and component of each row, by all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return sorted(((k, len(s), least.get(find(i))) for i, ((k, _), s) in enumerate(zip(rows, sets))), key=repr)


def result(docs):
    return sorted((tuple(r) for r in similar.shingle_groups(docs).collect()), key=repr)


def near(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(rng):
    rows, key = [], 0
    passage = [f"p{i}" for i in range(60)]
    for size in (1, 2, 3, 5, 6, 7, 8, 10, 12, 20, 36, 60, 130, 300):
        for _ in range(4):
            base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
            for edits in (0, 0, 1, 1, 2, 3, 4, size // 8, size // 12, size // 20):
                rows.append((key, near(rng, base, edits)))
                key += 1
                if rng.random() < 0.2:
                    rows.append((key, rows[-1][1].upper() + " \n"))
                    key += 1
    for _ in range(60):  # a passage shared by different texts, short and long
        around = [f"a{rng.randrange(10**6)}" for _ in range(rng.choice([10, 40, 100]))]
        rows.append((key, " ".join(around + passage)))
        key += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("star, costly", [(4, 32), (4, 3), (0, 2)])
def test_against_all_pairs(docs_of, monkeypatch, star, costly):
    """Also with no star and nearly every list taken for a long one."""
    monkeypatch.setattr(similar, "STAR", star)
    monkeypatch.setattr(similar, "COSTLY", costly)
    monkeypatch.setattr(similar, "BLOCK_ELEMENTS", 1 << 12)
    rows = corpus(random.Random(12 + costly))
    docs = docs_of(*rows).withColumn("node", F.lit("clash")).withColumn("digest", F.lit(0))
    assert result(docs) == brute(rows)


def test_edge_cases(docs_of):
    long = " ".join(f"x{i}" for i in range(20000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, long), (7, long), (8, long + " y"),
            (9, "a b c d e f"), (9, "g h i j k l"), (None, "a b c d e f"), (None, "lonely text here"), (None, None)]
    docs = docs_of(*rows)
    assert result(docs) == brute(rows)
    assert result(docs.limit(0)) == []
    kept = similar.keep_one(docs.withColumn("shared", F.lit(1)))
    assert kept.columns == [*docs.columns, "shared"]
    assert sorted(((r["doc_id"], (r["text"] or "")[:3]) for r in kept.collect()), key=repr) == sorted(
        [(1, ""), (2, ""), (3, " \n"), (4, "one"), (6, "one"), (7, "x0 "), (9, "a b"), (9, "g h"), (None, "lon"), (None, "")], key=repr)


def test_pigeonhole():
    """A linked pair shares a signature even when the surplus is spent on the shared ones."""
    rng = np.random.default_rng(13)
    for _ in range(3000):
        r = int(rng.choice([1, 2, 3, 5, 6, 7, 8, 15, 16, 31, 40, 63, 100, 127, 255, 400]))
        s = int(rng.integers(r, 4 * r // 3 + 1))
        common = -(-3 * (r + s) // 7)
        if common > r:
            continue
        a = np.unique(rng.integers(0, 2**64, r, dtype=np.uint64))
        b = np.unique(np.concatenate([rng.choice(a, common, replace=False), rng.integers(0, 2**64, s - common, dtype=np.uint64)]))
        assert similar.linked(a, b)
        sig, role, surplus = similar.signatures(a)
        other, others, _ = similar.signatures(b)
        if surplus == similar.HARD:
            continue
        own, offered = other[(others & (similar.PLAIN | similar.BELOW)) > 0], other[(others & similar.OFFERED) > 0]
        raised = (role & similar.RAISED) > 0
        plain = ((role & similar.PLAIN) > 0) & ~raised
        assert (np.isin(sig[plain], own).sum() > surplus or np.isin(sig[raised], np.concatenate([own, offered])).any()
                or np.isin(sig[(role & similar.DELETED) > 0], own).any())


def test_sets_without_a_valuation(docs_of, monkeypatch):
    """With one segment only, almost no set can be valued, and blocks do the work."""
    monkeypatch.setattr(similar, "segments", lambda band: 1)
    monkeypatch.setattr(similar, "BLOCK", 7)
    rng = random.Random(14)
    rows = [(k, near(rng, [f"w{k // 5}x{i}" for i in range(40)], k % 3)) for k in range(40)]
    assert result(docs_of(*rows)) == brute(rows)


def test_components(spark):
    rng = random.Random(15)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(150)]
    edges += edges[:20]
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    linked = {n for a, b in edges if a != b for n in (a, b)}
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r["node"], r["component"]) for r in found) == sorted((n, find(n)) for n in linked)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
