"""The stages from captured pages to reports, each a function of DataFrames.

Stages meet in stored tables (``sources.tables.write_by``, ``sources.versions``), so a later
stage reads columns and partitions it needs and a failed one is simply run again.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia import rules
from vacantia.functions.text import date_column, year_month, year_of_month
from vacantia.operators import classify, dedup, extract, label, merge, skills, trends
from vacantia.sources.tables import stored

TARGET_DOMAINS = ("IT", "Finance", "HR")
# Boards whose layout has no country column.
SOURCE_COUNTRY = {"ch": "CH"}


def collect_board(pages: DataFrame) -> DataFrame:
    """Pages of boards to their postings, the earliest of each."""
    return dedup.dedup_postings(extract.extract_postings(pages))


def build_corpus(boards: Mapping[str, DataFrame], key: str = "posting_id") -> DataFrame:
    """Boards' tables to one stored corpus whose rows have a unique ``key``.

    All rows are kept, equal ones too, so a key cannot come from the row.  It is drawn at
    random and fixed by storing: what a repeated task drew before is never seen.
    """
    return stored(merge.merge_sources(boards).withColumn(key, F.expr("uuid()")), "corpus")


def label_corpus(corpus: DataFrame, key: str = "posting_id") -> DataFrame:
    """The corpus with ``domain_label`` by a classifier trained on its weak labels.

    The training set, capped per label, is stored before it is split; the corpus is then split
    into words once, and only keys and labels are shuffled beside it.
    """
    training = stored(label.weak_labels(corpus, key).withColumn("row_id", F.concat_ws(":", key, "label"))
                      .select("row_id", "label", "description"), "training")
    used = label.train_val_split(training, "label", "row_id").filter("split = 'train'")
    model, priors = classify.train_naive_bayes(used)
    predicted = classify.predict_naive_bayes(corpus, stored(model, "word-model"), priors, key).select(
        key, F.col("predicted_label").alias("domain_label"))
    return corpus.join(stored(predicted, "labels"), key)


def target_postings(labelled: DataFrame) -> DataFrame:
    """Postings of the analysed domains with ``year_month``, ``year`` and ``country``.

    The month is that of the posting date, else of the capture; rows without one are dropped.
    """
    posted = F.col("date_posted") if "date_posted" in labelled.columns else F.lit(None).cast("string")
    other = "timestamp" if "timestamp" in labelled.columns else date_column(labelled.columns)
    captured = F.col(other) if other else F.lit(None).cast("string")
    country = F.nullif(F.col("country"), F.lit("")) if "country" in labelled.columns else F.lit(None).cast("string")
    for source, code in SOURCE_COUNTRY.items():
        country = F.when((F.col("source") == source) & country.isNull(), code).otherwise(country)
    return (labelled.filter(F.col("domain_label").isin(*TARGET_DOMAINS))
            .withColumn("year_month", year_month(posted, captured)).withColumn("country", country)
            .withColumn("year", year_of_month(F.col("year_month"))).filter("year is not null"))


def domain_trends(target: DataFrame, taxonomy: DataFrame, key: str = "posting_id",
                  min_jobs: int = rules.MIN_JOBS) -> DataFrame:
    """Hard and soft skills of all domains to their twelve trend tables, in one job."""
    found = skills.extract_skills(target, taxonomy, key=key, keep=[key, "domain_label", "year", "country"])
    return trends.all_trends(found, min_jobs=min_jobs)
