import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vacantia.llm import divergence as D
from vacantia.llm.vocabulary import Transducer

DOCS = "doc_id long, text string, lang string, source string"
TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=3, top=200):
    """The result of rows ``(text, lang, source)`` by plain counting."""
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        spread = Counter(t for d in own for t in set(d[2]))
        kept = sorted((t for t, n in spread.items() if n >= least), key=lambda t: t.encode())
        counts = defaultdict(Counter)
        for _, source, terms in own:
            counts[source].update(t for t in terms if spread[t] >= least)

        def shares(c):
            return {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        whole = shares(sum(counts.values(), Counter()))
        of = {s: shares(c) for s, c in counts.items()}
        for a in of:
            pairs = [(b, sum((of[a][t] - of[b][t]) ** 2 // of[b][t] for t in kept)) for b in of if b != a]
            terms = [(t, (of[a][t] - whole[t]) ** 2 // whole[t]) for t in kept if counts[a][t] and of[a][t] > whole[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out |= {(lang, a, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)}
    return out


def found(table):
    rows = [tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in table.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def random_docs(rng, n, sources=5):
    words = ["Alpha", "beta", "ALPHA", "é", "étude", "ÉTUDE", "Ünder", "z", "zz", "zzz", "梦想", "😀", "g-h", "x1y", "q_r", "\x80"]
    words += ["".join(rng.choices("abcé", k=rng.randrange(1, 5))) for _ in range(60)]
    return [(" ".join(rng.choices(words, k=rng.randrange(0, 40))), rng.choice(["en", "de", None]),
             rng.choice([f"s{i}" for i in range(sources)] + [None])) for _ in range(n)]


def test_transducer_finds_places_and_terms():
    rng = random.Random(11)
    for _ in range(200):
        terms = sorted({bytes(rng.choices(b"ab\xc3\xff", k=rng.randrange(0, 6))) for _ in range(rng.randrange(1, 40))})
        made = Transducer(**Transducer.build(terms))
        assert [made.term(i) for i in range(len(terms))] == terms
        asked = terms + [bytes(rng.choices(b"ab\xc3\xffz", k=rng.randrange(0, 8))) for _ in range(30)]
        assert made.ordinals(asked).tolist() == [terms.index(t) if t in terms else -1 for t in asked]


def test_transducer_is_minimal():
    stems, ends = ["walk", "talk", "jump", "link"], ["", "s", "ed", "ing", "er", "ers"]
    terms = sorted((a + b).encode() for a in stems for b in ends)
    made = Transducer(**Transducer.build(terms))
    # States that accept the same rest of a term are one: count the distinct rests.
    rests = {frozenset(t[len(p):] for t in terms if t.startswith(p)) for p in {t[:i] for t in terms for i in range(len(t) + 1)}}
    assert len(made.finals) == len(rests)
    with pytest.raises(ValueError):
        Transducer.build([b"b", b"a"])


def test_shares_are_exact():
    rng = random.Random(12)
    for _ in range(2000):
        total = rng.randrange(1, 10**rng.randrange(1, 15))
        count = rng.randrange(0, min(total, 9 * 10**13))
        assert D.share(np.array([count]), total)[0] == 1 + 10**9 * (count + 1) // total


def test_sums_of_pairs_against_all_terms():
    rng = np.random.default_rng(13)
    for _ in range(20):
        n_terms, n = int(rng.integers(1, 60)), int(rng.integers(1, 7))
        matrix = rng.integers(0, 5, (n, n_terms)) * (rng.random((n, n_terms)) < 0.4)
        of_source, of_term = np.nonzero(matrix)
        totals = matrix.sum(axis=1) + n_terms + 3
        sums = D.pair_sums(n_terms, of_term, of_source, matrix[of_source, of_term].astype(np.int64), totals)
        p = D.share(matrix, totals[:, None])
        for a in range(n):
            for b in range(n):
                if a != b:
                    assert sums[a, b] == D.apart(p[a], p[b]).sum()


@pytest.mark.parametrize("shard_terms, entries, top", [(1 << 13, 1_500_000, 200), (7, 20, 3)])
def test_against_plain_counting(spark, monkeypatch, shard_terms, entries, top):
    monkeypatch.setattr(D, "ENTRIES", entries)
    monkeypatch.setattr(D, "CELLS", 2 * entries)
    rows = random_docs(random.Random(14), 120)
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], DOCS).repartition(3)
    docs = docs.withColumns({"term": F.lit("x"), "no": F.lit(1), "VALUE": F.lit(2)})
    assert found(D.audit(docs, top=top, shard_terms=shard_terms)) == brute(rows, top=top)


def test_null_repeated_long_and_no_rows(spark):
    rows = [(None, None, None), ("a b a", "en", "s"), ("a b a", "en", "s"), ("a b a", "en", "s"), ("", "en", "t"), ("A.", "en", "u"),
            ("c", "fr", "s"), (None, "fr", "t"), ("long " * 200_000 + "é" * 100_000, "en", "t")]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], DOCS)
    got = found(D.audit(docs))
    assert got == brute(rows)
    assert ("fr", "s", "pair", "t", 0, 1) in got  # no kept terms
    assert D.audit(docs.limit(0)).count() == 0


def test_other_column_names(spark):
    rows = random_docs(random.Random(15), 30, 2)
    table = spark.createDataFrame(rows, "body string, language string, host string")
    assert found(D.audit(table, "body", "language", "host")) == brute(rows)
