import random

from vacantia.llm import quality


def brute(text):
    words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i:i + 3]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t")]
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(covered))


MEASURES = ("q_n_words", "q_word_chars", "q_n_symbols", "q_n_dup_lines", "q_n_repeat_words")


def test_measures(docs_of):
    rng = random.Random(1)
    texts = [None, "", " \n\t", "a", "a a", "a a a", "a a a a", "x y z x y z", "one\none\n\n one\none",
             "é# $$ ñ|", " a　b c", "w " * 20000]
    texts += ["".join(rng.choice(["a ", "b ", "c\n", "# ", "dd\t"]) for _ in range(rng.randrange(60))) for _ in range(150)]
    found = {r["doc_id"]: r for r in quality.measures(docs_of(*enumerate(texts))).collect()}
    for i, text in enumerate(texts):
        assert tuple(found[i][m] for m in MEASURES) == brute(text), repr(text)[:80]


def clean(i):
    return " ".join(f"word{i}x{k}" for k in range(60))


def test_hosts(docs_of):
    bad = [(i, "no", "bad") for i in range(30)] + [(30, clean(30), "bad")]
    good = [(100 + i, clean(i), "good") for i in range(40)] + [(140, "short", "good")]
    alone = [(200, clean(200), None), (201, None, None)]
    docs = docs_of(*bad, *good, *alone)
    kept = {r["doc_id"]: r["q_kept"] for r in quality.assess(docs).collect()}
    assert not kept[30], "the host's failures outweigh a clean text"
    assert all(kept[100 + i] for i in range(40)) and not kept[140]
    assert kept[200] and not kept[201]
    left = quality.keep_good(docs)
    assert left.columns == docs.columns
    assert {r["doc_id"] for r in left.collect()} == {k for k, v in kept.items() if v}


def test_few_documents_are_shrunk(docs_of):
    """One failure of one host's only two documents doesn't condemn it."""
    many = [(i, clean(i), f"h{i % 20}") for i in range(400)]
    rates = quality.host_rates(quality.measures(docs_of(*many, (900, "short", "rare"), (901, clean(901), "rare"))))
    rate = {(r["host"], r["rule"]): r["rate"] for r in rates.collect()}
    assert 0 < rate["rare", "too_short"] < 0.5


def test_repeats_empty_and_other_columns(spark, docs_of):
    from pyspark.sql import functions as F
    docs = docs_of((1, clean(1)), (1, clean(1)), (2, "x")).withColumn("host", F.lit("clash")).withColumn("n", F.lit(0))
    left = quality.keep_good(docs)
    assert [r["doc_id"] for r in left.collect()] == [1, 1] and left.columns == docs.columns
    assert quality.assess(docs.limit(0)).count() == 0


def test_columns_named_like_the_measures(docs_of):
    from pyspark.sql import functions as F
    names = ("q_text", "q_n_words", "q_kept", "q_host", "q_document", "q_words", "host", "a.b")
    docs = docs_of(*[(i, clean(i)) for i in range(10)], (20, "x"), (21, None)).withColumns({c: F.lit(c + "!") for c in names})
    left = quality.keep_good(docs)
    assert left.columns == docs.columns
    assert sorted(map(tuple, left.collect())) == sorted(tuple(r) for r in docs.collect() if r["doc_id"] < 10)
