import random

import numpy as np
from pyspark.sql import functions as F

from vacantia.llm import leaks

WORDS = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in ("rt", "n", "ls", "mp")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def least_edits(pattern, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def edited(rng, text, n):
    letters = list(text)
    for _ in range(n):
        i = rng.randrange(len(letters))
        kind = rng.randrange(3)
        if kind == 0:
            letters[i] = rng.choice("qxyz")
        elif kind == 1:
            del letters[i]
        else:
            letters.insert(i, rng.choice("qxyz"))
    return "".join(letters)


def test_against_full_alignment():
    rng = random.Random(6)
    items = [(0, prose(rng, 12)[:60]), (1, prose(rng, 40)[:100])]
    patterns = leaks.Patterns(items)
    for _ in range(150):
        item, text = rng.choice(items)
        texts = [prose(rng, rng.randrange(12)) + edited(rng, text, rng.randrange(9)) + prose(rng, rng.randrange(12)),
                 prose(rng, 30)]
        out = leaks.search([0, 1], texts, patterns)
        got = dict(zip(zip(out["key"], out["item"]), out["edits"]))
        for d, whole in enumerate(texts):
            for w, codes in enumerate(patterns.codes):
                edits = least_edits(list(map(chr, codes)), leaks.normal(whole))
                assert got.get((d, patterns.items[w])) == (edits if edits <= patterns.edits[w] else None)


def test_documents(spark, docs_of):
    rng = random.Random(7)
    items = [(i, prose(rng, 45)) for i in range(5)] + [(8, "rare short"), (9, None), (10, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    dirty = {1: (prose(rng, 50) + "\n" + items[0][1].upper().replace(" ", "\n ") + prose(rng, 50), 0),
             2: (items[1][1][70:190], 1), 3: (edited(rng, items[2][1], 4), 2), 4: ("a rare  short b", 8),
             5: (prose(rng, 9000) + " " + items[3][1], 3), None: (items[4][1], 4)}
    clean = {i: (prose(rng, 80), None) for i in range(20, 40)} | {41: (None, None), 42: ("", None)}
    docs = docs_of(*[(k, t) for k, (t, _) in {**dirty, **clean}.items()], (1, dirty[1][0]))
    docs = docs.withColumn("key", F.lit("clash")).withColumn("item", F.lit(0))
    for block in (10**6, 300):  # one pass, several passes
        found = leaks.leaked_items(leaks.leaks(docs, bench, block=block)).collect()
        assert {(r["key"], r["item"]) for r in found} == {(k, item) for k, (_, item) in dirty.items()}
    left = leaks.drop_leaks(docs, bench)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(clean)
    assert leaks.leaks(docs.limit(0), bench).count() == 0
    assert leaks.leaks(docs, bench.limit(0)).count() == 0


def test_hits_in_pieces(monkeypatch):
    """Counts agree when hits are expanded a few at a time."""
    rng = random.Random(8)
    text = prose(rng, 40)
    patterns = leaks.Patterns([(i, text) for i in range(3)])
    codes = leaks.code_points(text * 3)
    whole = patterns.bands(codes, 200)
    monkeypatch.setattr(leaks, "EXPAND", 7)
    for a, b in zip(whole, patterns.bands(codes, 200)):
        assert np.array_equal(np.sort(a), np.sort(b))


def test_short_windows_against_full_alignment():
    """Every window of the short kind within one edit of a text is found, and no other."""
    rng = random.Random(9)
    items = [(0, prose(rng, 14)[:77]), (1, prose(rng, 30)[:140])]
    patterns = leaks.Patterns(items, cuts=(leaks.LONG, leaks.SHORT))
    for _ in range(40):
        item, text = rng.choice(items)
        begin = rng.randrange(len(text) - 50)
        piece = edited(rng, text[begin:begin + 50], rng.randrange(4))
        whole = leaks.normal(prose(rng, rng.randrange(8)) + piece + prose(rng, rng.randrange(8)))
        found = leaks.search([0], [whole], patterns)
        want = sorted((patterns.items[w], patterns.starts[w], edits) for w, codes in enumerate(patterns.codes)
                      if (edits := least_edits(list(map(chr, codes)), whole)) <= patterns.edits[w])
        assert sorted(zip(found["item"], found["window"], found["edits"])) == want


def found_keys(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {(r["key"], r["item"]) for r in leaks.leaks(docs, bench).select("key", "item").distinct().collect()}


def test_recall_of_excerpts(spark):
    """Excerpts of 13 words and more are all found, of 8 and 10 nearly all, clean texts never."""
    rng = random.Random(10)
    words = [[rng.choice(WORDS) + rng.choice(WORDS)[:rng.randrange(5)] for _ in range(120)] for _ in range(20)]
    texts, where = [], []
    for n in (8, 10, 13, 15):
        for i in range(100):
            item = i % 20
            begin = rng.randrange(121 - n)
            texts.append(" ".join([prose(rng, 40), *words[item][begin:begin + n], prose(rng, 40)]))
            where.append((n, item))
    texts += [prose(rng, 100) for _ in range(200)]
    found = found_keys(spark, texts, [(i, " ".join(w)) for i, w in enumerate(words)])
    assert found <= {(k, item) for k, (_, item) in enumerate(where)}
    share = {n: sum((k, item) in found for k, (size, item) in enumerate(where) if size == n) / 100 for n in (8, 10, 13, 15)}
    assert share[13] == share[15] == 1 and share[10] >= 0.98 and share[8] >= 0.75, share


def test_one_replaced_word_in_a_short_item(spark):
    rng = random.Random(11)
    items, texts = [], []
    for i in range(100):
        words = prose(rng, 60)[:rng.choice((45, 60, 80, 99))].split()
        items.append((i, " ".join(words)))
        words[rng.randrange(len(words))] = "qu" + "".join(rng.choice("xyzw") for _ in range(4))
        texts.append(" ".join([prose(rng, 30), *words, prose(rng, 30)]))
    texts += [prose(rng, 100) for _ in range(100)]
    found = found_keys(spark, texts, items)
    assert found <= {(i, i) for i in range(100)} and len(found) >= 98
