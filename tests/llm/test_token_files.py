import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from vacantia.llm import token_files as T

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoder():
    return T.Encoder(VOCABULARY)


def test_pieces_give_the_tokenizers_ids(encoder):
    rng = random.Random(9)
    letters = " \n\t ab'sé1.,!　 \0Ꙁ<|endoftext|>"
    texts = ["", " ", "  ", "a  b", "a   b ", "<|endoftext|> x", "it's ISN'T we'll", "é" * 500, "a" * 300 + " b"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(4000)]
    for _ in range(2):  # unknown pieces, then known ones
        ids, counts = encoder(texts, T.END)
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for text, part, wanted in zip(texts, parts, encoder.whole(texts)):
            assert part.tolist() == [*wanted, T.END], repr(text)


def test_forgetting(encoder):
    small = T.Encoder(VOCABULARY, most=5)
    for text in ("one two three", "four five six seven", "one two"):
        assert small([text], 2)[0].tolist() == [*small.whole([text])[0], 2]


@pytest.mark.parametrize("kind", ["random", "repeats", "run", "short", "empty"])
def test_grammar_round_trip(kind):
    rng = np.random.default_rng(10)
    ids = {"random": rng.integers(0, 50000, 20000), "repeats": np.tile(rng.integers(0, 300, 50), 500),
           "run": np.full(9999, 7), "short": np.array([5]), "empty": np.zeros(0, int)}[kind].astype(np.uint32)
    base, rules, lengths, symbols = T.compress(ids)
    assert np.array_equal(T.decode(base, rules, lengths, symbols), ids)
    for _ in range(30):
        a, b = sorted(rng.integers(0, len(ids) + 1, 2).tolist())
        assert np.array_equal(T.decode(base, rules, lengths, symbols, a, b), ids[a:b])
    if kind in ("repeats", "run"):
        assert len(symbols) < len(ids) / 5
    assert (lengths == [len(T.decode(base, rules, lengths, np.array([base + i], np.uint32))) for i in range(len(rules))]).all()


def pair_counts(symbols):
    pairs = symbols[:-1].astype(np.uint64) << np.uint64(32) | symbols[1:].astype(np.uint64)
    return np.unique(pairs, return_counts=True)[1]


@pytest.mark.parametrize("kind", ["skewed", "few", "colliding"])
def test_no_frequent_pair_is_left(monkeypatch, kind):
    rng = np.random.default_rng(12)
    if kind == "colliding":  # every pair falls into one of two slots
        monkeypatch.setattr(T, "SLOT_BITS", 1)
    ids = {"skewed": rng.zipf(1.2, 200_000) % 30_000, "few": rng.integers(0, 12, 50_000),
           "colliding": rng.zipf(1.3, 30_000) % 500}[kind].astype(np.uint32)
    base, rules, lengths, symbols = T.compress(ids)
    assert pair_counts(symbols).max() < T.LEAST
    assert np.array_equal(T.decode(base, rules, lengths, symbols), ids)


def test_files(spark, docs_of, encoder):
    rng = random.Random(11)
    texts = {i: " ".join(rng.choice(["alpha", "Beta,", "γάμμα", "\n", "x y z"]) for _ in range(rng.randrange(200)))
             for i in rng.sample(range(10**6), 300)}
    texts |= {-5: None, 10**6 + 1: "long " * 20000}
    docs = docs_of(*texts.items()).withColumn("key", F.lit("clash")).withColumn("shard", F.lit(1))
    path = T.shared_path(spark, "test-tokens")
    T.write_tokens(docs.repartition(3), path, VOCABULARY, shard_ids=5000)
    found = {r["key"]: r for r in T.read_tokens(spark, path).collect()}
    start = 0
    for key in sorted(texts):
        ids = [*encoder.whole([texts[key] or ""])[0], T.END]
        r = found[key]
        assert (r["start"], r["n_tokens"]) == (start, len(ids))
        assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        start += len(ids)


def test_repeated_null_and_no_rows(spark, docs_of):
    found = T.token_files(docs_of((3, "a b"), (3, "a b"), (None, "c"), (1, None)), VOCABULARY).collect()
    assert sorted((r["start"], r["key"], r["n_tokens"]) for r in found) == [(0, None, 2), (2, 1, 1), (3, 3, 3), (6, 3, 3)]
    assert T.token_files(docs_of((1, "x")).limit(0), VOCABULARY).count() == 0


@pytest.mark.parametrize("bits", [3, T.SLOT_BITS])
def test_chosen_pairs_are_found_by_slot(monkeypatch, bits):
    """Places of frequent pairs, also of those that share a slot; with enough slots hardly any is searched for."""
    symbols = np.random.default_rng(3).integers(0, 60, 40_000).astype(np.uint32)
    plain, searched, search = {}, [], np.searchsorted
    for i, pair in enumerate(zip(symbols[:-1].tolist(), symbols[1:].tolist())):
        plain.setdefault(pair[0] << 32 | pair[1], []).append(i)
    monkeypatch.setattr(T, "SLOT_BITS", bits)
    monkeypatch.setattr(T.np, "searchsorted", lambda a, v, **how: searched.append(np.size(v)) or search(a, v, **how))
    chosen, at, which = T.frequent(symbols, 500, 8)
    found = {pair: at[which == i].tolist() for i, pair in enumerate(chosen.tolist())}
    assert len(found) == 500 and found == {pair: plain[pair] for pair in found}
    assert min(map(len, found.values())) >= max(len(v) for k, v in plain.items() if k not in found)
    assert bits == 3 or sum(searched) < len(at) / 10
