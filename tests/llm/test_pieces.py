import hashlib
import random

import public_tokenizers
import pytest
from conftest import FOLDER
from pyspark.sql import functions as F

from vacantia.llm import pieces as P
from vacantia.llm.queries import QUERIES

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def encoder():
    return P.Encoder(MODEL)


def test_ids_are_the_librarys(encoder):
    encoder.check()
    rng = random.Random(3)
    marks = ["▁", " ", "  ", " " * 15, "\n", "\t", "\0", "é", "梦", "😀", "́", "ing", "the", "0", "12", ".", "'", "Ω"]
    letters = "abcdeinorst ▁"
    texts = ["", " ", "\n", " a", "a ", "▁", "▁▁ ▁", "ab" * 20_000, "ſ" * 300, " " * 1000, "x" * 5000 + "\n" * 70]
    texts += ["".join(rng.choices(marks, k=rng.randrange(14))) for _ in range(3000)]
    texts += ["".join(rng.choices(letters, k=rng.randrange(40))) for _ in range(3000)]
    for text in texts:
        assert encoder(text) == encoder.library.encode(text), repr(text)


def test_without_cuts(encoder):
    """Backtracking alone, over whole texts: failed positions and steps back are met."""
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choices(["in", "g", "s", "t", "er", "▁", "an", "d", "\n", "th"], k=rng.randrange(200)))
        whole = encoder.library.normalize(text)
        assert list(encoder.encoded(whole)) == encoder.library.encode(text)


def test_two_neighbours_fit_or_not(encoder):
    token = {t: i for i, t in enumerate(encoder.texts)}
    for left, right in (("t", "he"), ("▁th", "e"), ("▁the", "re"), ("▁▁", "▁▁▁▁"), ("▁" * 16, "▁▁")):
        fits = encoder.fits(token[left], token[right])
        assert fits == (P.merged(left + right, encoder.scores)[0] == [left, right])
    assert not encoder.fits(token["t"], token["he"])
    assert encoder.fits(token["▁" * 16], token["▁▁"])


def test_fitting_is_merging_again(encoder):
    """Also for pieces of equal scores, the runs of space marks."""
    rng = random.Random(5)
    runs = [t for t, text in enumerate(encoder.texts) if not text.strip("▁")]
    pairs = [(a, b) for a in runs for b in runs]
    pairs += [(rng.randrange(len(encoder.texts)), rng.randrange(len(encoder.texts))) for _ in range(3000)]
    pairs += [(rng.randrange(3000), rng.randrange(3000)) for _ in range(3000)]
    for left, right in pairs:
        one, two = encoder.texts[left], encoder.texts[right]
        assert encoder.fits(left, right) == (P.merged(one + two, encoder.scores)[0] == [one, two]), (one, two)


def test_forgetting(monkeypatch):
    monkeypatch.setattr(P, "REMEMBERED", 3)
    small = P.Encoder(MODEL)
    for text in ("one two three", "four five six seven", "one two", "one three"):
        assert small(text) == small.library.encode(text)
        assert len(small.known) <= 8 and len(small.compatible) <= 3


def test_whole_table(spark, engine, encoder):
    found = {r["doc_id"]: r for r in QUERIES["op12_merge_pieces"](spark, FOLDER).collect()}
    rows = engine.execute("SELECT doc_id, text FROM documents").fetchall()
    assert len(found) == len(rows)
    for doc, text in rows:
        ids = encoder.library.encode(text or "")
        assert found[doc]["n_tokens"] == len(ids)
        assert found[doc]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found[doc]["decoded_sha256"] == hashlib.sha256(encoder.library.decode(ids).encode()).hexdigest()


def test_null_repeated_clashing_and_no_rows(spark, docs_of):
    docs = docs_of((1, None), (2, ""), (3, "a  b"), (3, "a  b"), (None, "c"), (4, "long " * 300_000))
    docs = docs.withColumns({"key": F.lit("x"), "ids": F.lit(1), "KEY_": F.lit(2)}).repartition(2)
    found = P.decode(P.encode(docs, MODEL), MODEL).collect()
    got = sorted((r["key"] or 0, len(r["ids"]), len(r["text"])) for r in found)
    assert got == [(0, 1, 1), (1, 0, 0), (2, 0, 0), (3, 3, 4), (3, 3, 4), (4, 300_001, 1_500_000)]
    empty = P.decode(P.encode(docs.limit(0), MODEL), MODEL)
    assert empty.columns == ["key", "ids", "text"] and empty.count() == 0


def test_keys_of_other_types(spark):
    docs = spark.createDataFrame([("a", "x y")], "name string, body string")
    assert [r["key"] for r in P.encode(docs, MODEL, "name", "body").collect()] == ["a"]
