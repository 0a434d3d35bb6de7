"""Language profiles against plain counting, and how often they are right."""

import math
import random
import re
from collections import Counter

import pytest
from conftest import FOLDER
from pyspark.sql import functions as F

from vacantia.operators import language as L
from vacantia.plans.queries import QUERIES

LETTERS = re.compile(r"[^\W\d_]+")


def grams(text, sizes=L.SIZES):
    plain = " " + " ".join(LETTERS.findall((text or "").lower())) + " "
    plain = " " if not plain.strip() else plain
    return [plain[i:i + n] for n in sizes for i in range(len(plain) - n + 1)]


def profiles(rows, languages, most):
    counts = {name: Counter(g for lang, text in rows if lang == name for g in grams(text)) for name in languages}
    everything = set().union(*counts.values())
    listed = {g for c in counts.values() for g in sorted(c, key=lambda g: (-c[g], g.encode()))[:most]}
    return {g: [round(L.UNIT * math.log((c[g] + 1) / (sum(c.values()) + len(everything)))) for c in counts.values()] for g in listed}


def detect(text, model, languages):
    found = [model[g] for g in grams(text) if g in model]
    sums = [sum(column) for column in zip(*found)] if found else [0] * len(languages)
    return (*sums, languages[sums.index(max(sums))] if found else L.UNKNOWN)


TRAINING = [("en", "The cat is on the mat, isn't it? 12 o'clock"), ("en", "A thing of beauty"), ("de", "Die Katze ist auf der Matte"),
            ("de", "Schöne Größe, für ÜBER"), ("fr", "Le chat est là où ça va"), ("xx", "zzz zzz zzz"), (None, "no"), ("fr", None), ("de", "…!")]
ASKED = ["the", "Die Größe", "où", "", None, "123 !?", "qqq", "the der le", "Thé ", "x" * 5000 + " the"]


@pytest.mark.parametrize("most", [5, 3000])
def test_profiles_against_plain_counting(spark, most):
    languages = ("en", "de", "fr")
    rows = spark.createDataFrame(TRAINING, "lang string, text string").repartition(3)
    table = L.learn_profiles(rows, languages, most=most)
    wanted = profiles(TRAINING, languages, most)
    assert {r["gram"]: [r[f"w_{n}"] for n in languages] for r in table.collect()} == wanted
    assert len(wanted) <= 3 * most
    docs = spark.createDataFrame(list(enumerate(ASKED)), "doc_id long, text string").withColumn("gram", F.lit("clash"))
    found = L.detect_by_profiles(docs, table, languages).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in found} == {i: detect(t, wanted, languages) for i, t in enumerate(ASKED)}


def test_no_rows(spark):
    rows = spark.createDataFrame([], "lang string, text string")
    table = L.learn_profiles(rows, ("en", "de"))
    assert table.count() == 0
    docs = spark.createDataFrame([(1, "the")], "doc_id long, text string")
    assert [tuple(r) for r in L.detect_by_profiles(docs, table, ("en", "de")).collect()] == [(1, 0, 0, "Unknown")]
    assert L.detect_by_profiles(docs.limit(0), table, ("en", "de")).count() == 0


def test_profiles_tell_more_than_stop_words(spark):
    rows = QUERIES["language_profile_eval"](spark, FOLDER).collect()
    right = {kind: [sum(r[c] for r in rows if r["kind"] == kind) for c in ("n", "profiles_right", "words_right")] for kind in ("whole", "sentence", "mixed")}
    for n, by_profiles, by_words in right.values():
        assert n > 0 and by_profiles >= 0.9 * n and by_profiles >= by_words
    for r in rows:
        if r["kind"] == "sentence":
            assert r["profiles_right"] >= 0.9 * r["n"]


def test_no_gram_becomes_a_row(spark, capsys, monkeypatch):
    """Texts meet the table where they stand: no n-gram is a row that is joined or shuffled."""
    plans = []
    monkeypatch.setattr(L, "stored", lambda table, name: plans.append(table) or table)
    rows = spark.createDataFrame(TRAINING, "lang string, text string")
    table = spark.createDataFrame(L.learn_profiles(rows, ("en", "de")).collect())
    docs = spark.createDataFrame(list(enumerate(ASKED)), "doc_id long, text string")
    for plan in (*plans, L.detect_by_profiles(docs, table, ("en", "de"))):
        plan.explain()
        said = capsys.readouterr().out
        assert "Aggregate" in said and "Generate" not in said and "Join" not in said


@pytest.mark.parametrize("sizes", [(1, 2, 3), (2,), (1, 4, 30)])
@pytest.mark.parametrize("letters", ["abc", "".join(map(chr, range(0x4E00, 0x4E00 + 3000))) + "\U00020000"])
@pytest.mark.parametrize("table", [L.TABLE, 0])
def test_counts_and_sums_of_any_size(monkeypatch, sizes, letters, table):
    draw = random.Random(7)
    texts = [" ".join(["", *("".join(draw.choices(letters, k=draw.randint(1, 9))) for _ in range(draw.randint(0, 40))), ""]) for _ in range(60)]
    texts = [text if text else " " for text in texts]

    def plain(text):
        return [text[i:i + n] for n in sizes for i in range(len(text) - n + 1)]

    monkeypatch.setattr(L, "PIECE", 500)
    monkeypatch.setattr(L, "WINDOW", 37)
    monkeypatch.setattr(L, "TABLE", table)
    counts = Counter()
    for codes, _ in L.pieces(texts):
        counts.update(L.tally(codes, sizes))
    assert counts == Counter(g for text in texts for g in plain(text) if "  " not in g)
    kept = {g: (draw.randint(-9, 9), draw.randint(-9, 9)) for g in sorted(counts)[::3]}
    lookup = L.Lookup([(g, *w) for g, w in kept.items()], 2, sizes)
    found = [row for codes, starts in L.pieces(texts) for row in lookup(codes, starts).T.tolist()]
    assert found == [[sum(c) for c in zip((0, 0, 0), *[(1, *kept[g]) for g in plain(text) if g in kept])] for text in texts]
