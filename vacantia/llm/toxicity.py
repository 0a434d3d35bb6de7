"""Toxicity grades by cumulative-link ordinal regression.

For ordered grades 0 .. K-1 the model says P(grade > k) = 1 / (1 + exp(t_k - w x)): one weight per
feature, shared by all thresholds t_0 <= t_1 <= ...  The expected severity of a text is the sum of
these probabilities.

Features are a text's words (lower case, without marks at their ends) and the first 3 to 6
characters of them, hashed to ``BUCKETS`` numbers.  In how many graded documents each number
occurs, and in how many of a grade above 0, is counted over all of them by a shuffle of sums.  A
number becomes a feature, valued 1 + log(1 + occurrences per hundred words), if it occurs in at least
``LEAST_SHARE`` of the documents above grade 0 (and in 3 of them), if its odds there are at least
``LEAST_ODDS`` times those at grade 0, and if chance alone is unlikely (``LEAST_Z``).  As a document
holds a bounded number of distinct words on average, the share bounds the features by a figure that
does not move with the input: 1 / ``LEAST_SHARE`` times that number.  The regression is fitted on the driver to at
most ``SAMPLE`` graded documents (those with the smallest hash of their key), a few numbers each.
Scoring reads every text once and sends nothing but the model.

Defined cases: a null or wordless text has no features and gets the grade the thresholds give; a
document graded more than once takes its highest grade, null grades are ignored; with no graded
document, or none above grade 0, every probability is 0; repeated rows give a row each; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import distinct, numbered, small, text_of
from vacantia.sources.tables import stored

BUCKETS = 1 << 22
PREFIXES = (3, 4, 5, 6)
MARKS = ".,;:!?\"'()[]{}|*_-"
LEAST_SHARE = 1 / 2000
LEAST_ODDS = 2
LEAST_Z = 4.0
SAMPLE = 20_000
ROUNDS = 500
FEW = 500_000  # grades that may be broadcast
WORDS_KEPT = 200_000
CHUNK_DOCS = 4_000


# --- features ----------------------------------------------------------------------

def buckets_of(word: str) -> set[int]:
    """Numbers of a word's features."""
    stem = word.strip(MARKS)
    names = [f"w{stem}", *[f"{n}{stem[:n]}" for n in PREFIXES if len(stem) >= n]] if stem else []
    return {xxhash.xxh64_intdigest(name) % BUCKETS for name in names}


class WordBuckets(dict):
    """The same, remembered per worker."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= WORDS_KEPT:
            self.clear()
        value = self[word] = tuple(buckets_of(word))
        return value


WORD_BUCKETS = WordBuckets()


def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents by feature number, and those graded above 0, summed over some documents."""
    def out(found):
        buckets = np.concatenate([b for b, _ in found])
        severe = np.repeat([s for _, s in found], [len(b) for b, _ in found])
        place, n = numbered(buckets)
        return pa.RecordBatch.from_arrays([
            pa.array(distinct(buckets).astype(np.int32)), pa.array(n.astype(np.int64)),
            pa.array(np.bincount(place, severe, len(n)).astype(np.int64))], names=["bucket", "n", "severe"])

    found = []
    for batch in batches:
        for text, grade in zip(batch.column(0), batch.column(1).to_pylist()):
            words = set(text.as_py().lower().split())
            buckets = {b for w in words for b in WORD_BUCKETS[w]}
            found.append((np.fromiter(buckets, np.int64, len(buckets)), grade > 0))
            if len(found) >= CHUNK_DOCS:
                yield out(found)
                found = []
    if found:
        yield out(found)


class Vector:
    """Values of the chosen features in a text."""

    def __init__(self, chosen: np.ndarray):
        self.place = {int(b): i for i, b in enumerate(chosen)}
        self.of_word: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str) -> tuple[list[int], list[float]]:
        words = text.lower().split()
        if len(self.of_word) > WORDS_KEPT:
            self.of_word.clear()
        counts: Counter = Counter()
        known = self.of_word
        for word, n in Counter(words).items():
            places = known.get(word)
            if places is None:
                places = known[word] = tuple(self.place[b] for b in buckets_of(word) if b in self.place)
            for p in places:
                counts[p] += n
        return list(counts), [1 + float(np.log1p(100 * n / len(words))) for n in counts.values()]


# --- model -------------------------------------------------------------------------

@dataclass(frozen=True)
class Model:
    chosen: np.ndarray  # feature numbers
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - np.asarray(scores)[:, None], -60, 60)))


def fit_ordinal(rows: list[tuple[list[int], list[float], int]], size: int, grades: int, rounds: int = ROUNDS,
                rate: float = 0.05, decay: float = 2e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of the highest penalised likelihood, by Adam on all rows."""
    of_row = np.repeat(np.arange(len(rows)), [len(p) for p, _, _ in rows])
    places = np.array([x for p, _, _ in rows for x in p], np.int64)
    values = np.array([x for _, v, _ in rows for x in v])
    grade = np.array([g for _, _, g in rows])
    # Thresholds are a first one and positive steps, so that they stay in order.
    rest = np.concatenate([np.full(size, 0.1), [1.0], np.zeros(grades - 2)])
    first, second = np.zeros_like(rest), np.zeros_like(rest)

    def sigmoid(x):
        return 1 / (1 + np.exp(-np.clip(x, -60, 60)))

    def thresholds(raw):
        return raw[0] + np.concatenate([[0.0], np.cumsum(np.exp(raw[1:]))])

    for step in range(1, rounds + 1):
        t = thresholds(rest[size:])
        score = np.bincount(of_row, values * rest[places], len(rows))
        # P(grade >= g) with 1 before the first and 0 behind the last threshold.
        at_least = np.concatenate([np.ones((len(rows), 1)), sigmoid(score[:, None] - t), np.zeros((len(rows), 1))], axis=1)
        some = np.arange(len(rows))
        low, high = at_least[some, grade], at_least[some, grade + 1]
        p = np.maximum(low - high, 1e-12)
        d_low, d_high = low * (1 - low) / p, high * (1 - high) / p
        slope = (d_low - d_high) / len(rows)
        gradient = np.zeros_like(rest)
        gradient[:size] = np.bincount(places, values * slope[of_row], size) - decay * rest[:size]
        d_t = np.zeros(grades - 1)
        np.add.at(d_t, np.maximum(grade - 1, 0), -np.where(grade > 0, d_low, 0) / len(rows))
        np.add.at(d_t, np.minimum(grade, grades - 2), np.where(grade < grades - 1, d_high, 0) / len(rows))
        gradient[size] = d_t.sum()
        gradient[size + 1:] = np.cumsum(d_t[::-1])[::-1][1:] * np.exp(rest[size + 1:])
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient ** 2
        rest = rest + rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    return rest[:size], thresholds(rest[size:])


def graded(docs: DataFrame, grades: DataFrame, key: str, text: str, grade: str) -> DataFrame:
    """``(key, text, grade)`` of the documents with a grade."""
    highest = stored(grades.filter(F.col(key).isNotNull() & F.col(grade).isNotNull())
                     .groupBy(F.col(key).alias("key")).agg(F.max(F.col(grade).cast("int")).alias("grade")), "grades")
    return docs.select(F.col(key).alias("key"), text_of(text).alias("text")).join(small(highest, FEW), "key")


def choose(rows: DataFrame) -> np.ndarray:
    """The feature numbers that are more frequent above grade 0, those most surely so first."""
    sums = rows.select("text", "grade").mapInArrow(presence, "bucket int, n long, severe long")
    counts = stored(sums.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("severe").alias("severe")), "feature-counts")
    total, severe = rows.agg(F.count("*"), F.coalesce(F.sum((F.col("grade") > 0).cast("long")), F.lit(0))).first()
    if not severe or severe == total:
        return np.zeros(0, np.int64)
    rate = severe / total
    z = (F.col("severe") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
    common = F.col("severe") >= max(3, severe * LEAST_SHARE)
    odds = F.col("severe") * (total - severe) >= LEAST_ODDS * severe * (F.col("n") - F.col("severe"))
    best = counts.filter(common & odds).withColumn("z", z).filter(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "bucket")
    return np.array([r["bucket"] for r in best.select("bucket").collect()], np.int64)


def vectors(rows: DataFrame, chosen: np.ndarray) -> DataFrame:
    """``(key, grade, places, values)`` of graded documents."""
    def make(batches):
        vector = Vector(chosen)
        for batch in batches:
            made = [vector(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([p for p, _ in made], pa.list_(pa.int32())),
                pa.array([v for _, v in made], pa.list_(pa.float64()))], names=["key", "grade", "places", "values"])

    return rows.select(F.col("key").cast("long").alias("key"), "grade", "text").mapInArrow(
        make, "key long, grade int, places array<int>, values array<double>")


def train(made: DataFrame, chosen: np.ndarray, grades: int, sample: int = SAMPLE) -> Model:
    """The model fitted to at most ``sample`` rows of ``vectors``."""
    if not len(chosen):
        return Model(chosen, np.zeros(0), np.full(grades - 1, 60.0))
    some = made.orderBy(F.xxhash64("key"), "key").limit(sample).collect()
    weights, thresholds = fit_ordinal([(r["places"], r["values"], r["grade"]) for r in some], len(chosen), grades)
    return Model(chosen, weights, thresholds)


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key, expected_severity, grade, above array`` (P(grade > k))."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        model = shared.value
        vector = Vector(model.chosen)
        for batch in batches:
            made = [vector(t.as_py()) for t in batch.column(1)]
            scores = np.array([sum(model.weights[i] * v for i, v in zip(p, values)) for p, values in made])
            above = model.above(scores)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(above.sum(axis=1)), pa.array((above >= 0.5).sum(axis=1).astype(np.int32)),
                pa.array(above.tolist(), pa.list_(pa.float64()))], names=["key", "expected_severity", "grade", "above"])

    rows = docs.select(F.col(key).cast("long").alias("key"), text_of(text).alias("text"))
    return rows.mapInArrow(score, "key long, expected_severity double, grade int, above array<double>")


# --- grades from two-valued labels -------------------------------------------------

def split_severe(made: DataFrame) -> DataFrame:
    """Rows of ``vectors`` with a two-valued label get three grades: of the documents labelled 1,
    those with more than the median of chosen features per word are graded 2."""
    density = F.aggregate("values", F.lit(0.0), lambda total, v: total + F.exp(v - 1) - 1)
    marked = stored(made.withColumn("density", density), "feature-vectors")
    middle = marked.filter("grade > 0").agg(F.percentile_approx("density", 0.5)).first()[0]
    raised = F.coalesce((F.col("grade") > 0) & (F.col("density") > F.lit(middle).cast("double")), F.lit(False))
    return marked.withColumn("grade", F.col("grade") + raised.cast("int")).drop("density")
