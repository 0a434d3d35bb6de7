"""Domain classification and language detection.

Naive Bayes in DataFrame steps is the model whose arithmetic can be checked; the
``pyspark.ml`` logistic regression is the quality model.  Texts are used whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, IndexToString, RegexTokenizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia import rules
from vacantia.functions.text import let, sql_text
from vacantia.sources.tables import stored

WORDS = r"[\p{L}\p{N}_]+"
NO_TEXT = "No description provided"
HOT_SHARE = 1e-4
PENALTY = 0.01
FEATURES = 1 << 16


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))


def _words_of(rows: DataFrame, key: str, text: Column) -> DataFrame:
    # An outer generator: for an inner one Spark would first filter on the size of the array
    # and so split each text twice.
    return rows.select(key, F.explode_outer(words(text)).alias("word")).filter("word is not null")


def _n(label: str) -> str:
    return f"n_{label}"


def _score(label: str) -> str:
    return f"score_{label}"


def train_naive_bayes(rows: DataFrame, label: str = "label", text: str = "description",
                      labels: Sequence[str] = rules.LABELS) -> tuple[DataFrame, DataFrame]:
    """The model: a word table and one row of label priors.

    Words ``(word, n_<label>, score_<label>, hot)``: counts and smoothed log probabilities.
    ``hot`` marks words with at least 1/10,000 of some label's words: there are at most
    ``10,000 * len(labels)`` of them.  Priors ``(score_<label>)``: log shares of the texts, null
    for an absent label.

    Texts are read once: each adds a null word, whose counts are the texts per label.  Counts
    are formed map-side, one row per word and task, and stored; all else is read from them.
    """
    used = rows.filter(F.col(text).isNotNull() & F.col(label).isin(*labels))
    marked = F.concat(F.array(F.lit(None).cast("string")), words(F.col(text)))
    counts = stored(
        used.select(label, F.explode_outer(marked).alias("word")).groupBy("word").agg(
            *[F.count_if(F.col(label) == c).alias(_n(c)) for c in labels]), "word-counts")
    texts, known = counts.filter("word is null"), counts.filter("word is not null")
    total = sum((F.col(_n(c)) for c in labels), F.lit(0))
    priors = texts.select(*[F.log(F.nullif(F.col(_n(c)), F.lit(0)) / total).alias(_score(c)) for c in labels])
    sums = known.agg(F.struct(F.count("*").alias("words"),
                              *[F.sum(_n(c)).alias(_n(c)) for c in labels]).alias("s")).scalar()
    scores = [F.log((F.col(_n(c)) + 1) / (F.coalesce(sums[_n(c)], F.lit(0)) + sums["words"])).alias(_score(c))
              for c in labels]
    hot = F.lit(False)
    for c in labels:
        hot = hot | ((F.col(_n(c)) > 0) & (F.col(_n(c)) >= sums[_n(c)] * HOT_SHARE))
    return known.select("word", *[_n(c) for c in labels], *scores, hot.alias("hot")), priors


def predict_naive_bayes(docs: DataFrame, model: DataFrame, priors: DataFrame, key: str = "doc_id",
                        text: str = "description", labels: Sequence[str] = rules.LABELS) -> DataFrame:
    """``(key, score_<label>..., predicted_label)``; words the model lacks are passed over.

    Texts are split into words once, map-side into counts per text and word.  Hot words, a bounded
    list, are looked up by broadcast first: they drop to one partial sum per text, and only the
    rare words, which hold no heavy key, go on to meet the rest of the model in a shuffled join.
    Ties go to the label named first; labels not in training never win.
    """
    scores = [_score(c) for c in labels]
    hot = model.filter("hot").select(F.col("word").alias("hot_word"), *[F.col(s).alias(f"hot_{s}") for s in scores])
    rest = model.filter("not hot").select("word", *scores)
    looked_up = (_words_of(docs, key, F.coalesce(text, F.lit(NO_TEXT)))
                 .join(F.broadcast(hot), F.col("word") == F.col("hot_word"), "left")
                 .groupBy(key, F.when(F.col("hot_word").isNull(), F.col("word")).alias("word"))
                 .agg(F.count("*").alias("n"), *[F.sum(f"hot_{s}").alias(f"hot_{s}") for s in scores]))
    # A text's row without a word holds the sum of its hot words and finds no partner.
    met = looked_up.join(rest, "word", "left")
    sums = met.groupBy(key).agg(*[F.sum(F.when(F.col("word").isNull(), F.col(f"hot_{s}"))
                                        .otherwise(F.col(s) * F.col("n"))).alias(s) for s in scores])
    prior = priors.select(F.struct(*scores)).scalar()
    full = docs.select(key).join(sums, key, "left").select(
        key, *[(F.coalesce(F.col(s), F.lit(0.0)) + prior[s]).alias(s) for s in scores])
    best = F.greatest(*scores)
    predicted = F.coalesce(*[F.when(F.col(_score(c)) == best, c) for c in labels])
    return full.withColumn("predicted_label", predicted)


def _hashing(text: str, features: int) -> list:
    return [RegexTokenizer(inputCol=text, outputCol="words", pattern=WORDS, gaps=False),
            HashingTF(inputCol="words", outputCol="tf", numFeatures=features)]


def hash_words(rows: DataFrame, text: str = "description", features: int = FEATURES) -> DataFrame:
    """The rows with ``tf``, how often each hashed word occurs in a text, in place of the text; stored,
    so that texts are split once for training and prediction.  They are spread evenly."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    filled = rows.withColumn(text, F.coalesce(text, F.lit(NO_TEXT))).repartition(cores)
    return stored(PipelineModel(_hashing(text, features)).transform(filled).drop(text, "words"), "hashed-words")


def train_logistic(rows: DataFrame, label: str = "label", text: str = "description",
                   features: int = FEATURES, iterations: int = 20, tolerance: float = 1e-6,
                   penalty: float = PENALTY) -> PipelineModel:
    """Hashed TF-IDF with multinomial logistic regression, fitted until the penalised likelihood
    changes by less than ``tolerance`` of itself or for ``iterations``.  ``optimality`` measures how
    near its top that is.  Rows of ``hash_words``, of as many features, are taken as they are."""
    hashing = _hashing(text, features)
    known = rows.filter(F.col(label).isNotNull())
    if "tf" not in rows.columns:
        known = hash_words(known.filter(F.col(text).isNotNull()).select(label, text), text, features)
    # Every iteration reads the training set and adds up vectors as long as the model, one per task.
    used = known.select(label, "tf").coalesce(rows.sparkSession.sparkContext.defaultParallelism)
    model = Pipeline(stages=[
        StringIndexer(inputCol=label, outputCol="label_id", stringOrderType="alphabetAsc",
                      handleInvalid="skip"),
        IDF(inputCol="tf", outputCol="features"),
        LogisticRegression(featuresCol="features", labelCol="label_id", maxIter=iterations,
                           tol=tolerance, regParam=penalty, predictionCol="predicted_id"),
    ]).fit(used)
    back = IndexToString(inputCol="predicted_id", outputCol="predicted_label",
                         labels=model.stages[0].labels)
    return PipelineModel(hashing + model.stages[1:] + [back])


def predict_logistic(docs: DataFrame, model: PipelineModel, key: str = "doc_id",
                     text: str = "description") -> DataFrame:
    """``(key, predicted_label)``; rows of ``hash_words`` are taken as they are."""
    if "tf" in docs.columns:
        return PipelineModel(model.stages[2:]).transform(docs).select(key, "predicted_label")
    filled = docs.withColumn(text, F.coalesce(text, F.lit(NO_TEXT)))
    return model.transform(filled).select(key, "predicted_label")


def optimality(rows: DataFrame, model: PipelineModel, label: str = "label", text: str = "description",
               penalty: float = PENALTY) -> DataFrame:
    """How near a model of ``train_logistic`` is to the top of its likelihood on its training rows:
    ``(label, texts, expected_texts, gradient)`` for each of its labels.

    ``expected_texts`` is the sum of the label's probabilities over all texts; at the top it equals
    ``texts``, the label's number of texts, as the intercepts are not penalised.  ``gradient`` is
    the largest derivative, in absolute value, by a weight of the label, where features count in
    units of their standard deviation, as the penalty does.  All sums over texts are formed in one
    aggregation of vectors as long as the model's; only these come to the driver.
    """
    labels = model.stages[-1].getLabels()
    regression = model.stages[-2]
    used = rows.filter(F.col(text).isNotNull() & F.col(label).isin(*labels)).select(label, text)
    given = model.transform(used).select(label, "features", vector_to_array("probability").alias("p"))

    def sums(weight: Column) -> Column:
        return F.struct(F.sum(weight).alias("texts"), Summarizer.sum(F.col("features"), weight).alias("features"))

    found = given.agg(
        Summarizer.variance(F.col("features")).alias("variance"), F.count("*").alias("n"),
        *[sums((F.col(label) == c).cast("double")).alias(f"is_{i}") for i, c in enumerate(labels)],
        *[sums(F.col("p")[i]).alias(f"p_{i}") for i in range(len(labels))]).first()
    spread = np.sqrt(found["variance"].toArray())
    weights = regression.coefficientMatrix.toArray()
    out = []
    for i, name in enumerate(labels):
        real, said = found[f"is_{i}"], found[f"p_{i}"]
        distance = said["features"].toArray() - real["features"].toArray()
        slope = np.divide(distance, spread, out=np.zeros_like(spread), where=spread > 0) / found["n"]
        gradient = slope + penalty * weights[i] * spread
        out.append((name, int(real["texts"]), float(said["texts"]), float(np.abs(gradient).max())))
    return rows.sparkSession.createDataFrame(out, "label string, texts long, expected_texts double, gradient double")


def predict_with(docs: DataFrame, load: Callable[[], Callable[[list[str]], list[str]]],
                 key: str = "doc_id", text: str = "description", batch: int = 32) -> DataFrame:
    """Labels by a model of the caller's: ``load`` runs once per task and gives a function from
    texts to labels, which is called with ``batch`` texts at a time."""
    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            texts = frame["body"].tolist()
            labels = [x for i in range(0, len(texts), batch) for x in model(texts[i:i + batch])]
            yield pd.DataFrame({key: frame[key], "predicted_label": labels})

    given = docs.select(key, F.coalesce(text, F.lit(NO_TEXT)).alias("body"))
    kind = given.schema[key].dataType.simpleString()
    return given.mapInPandas(score, f"`{key}` {kind}, predicted_label string")


def _words_literal(listed: Sequence[str]) -> Column:
    return F.expr("array(" + ", ".join(map(sql_text, listed)) + ")")


def detect_language(text: Column, stopwords: Mapping[str, Sequence[str]] = rules.STOPWORDS) -> Column:
    """Language with the most distinct stop words in the text; ties go to the one listed first.

    ``Unknown`` when there is none.  Works within the row.
    """
    everything = sorted({word for listed in stopwords.values() for word in listed})

    def pick(found: Column) -> Column:
        hits = [F.size(F.array_intersect(found, _words_literal(listed))) for listed in stopwords.values()]
        scored = F.array(*[
            F.struct(hit.alias("hits"), F.lit(-i).alias("rank"), F.lit(name).alias("language"))
            for i, (name, hit) in enumerate(zip(stopwords, hits))])
        return let(F.array_max(scored), lambda best: F.when(best["hits"] > 0, best["language"]).otherwise("Unknown"))

    known = F.array_intersect(words(F.coalesce(text, F.lit(""))), _words_literal(everything))
    return let(known, pick)
