"""Classification metrics.  Rows are reduced to label pairs before anything else happens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions.text import label_column, strip


def with_true_label(rows: DataFrame) -> DataFrame:
    """Hand-labelled rows whose label column has one of its usual names, as ``true_label``."""
    return rows.withColumn("true_label", F.col(f"`{label_column(rows.columns)}`"))


def confusion_matrix(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Count per (true, predicted) label pair."""
    stripped = rows.select(*by, strip(F.col("true_label")).alias("true_label"),
                           strip(F.col("predicted_label")).alias("predicted_label"))
    return (stripped.filter("true_label is not null and predicted_label is not null")
            .groupBy(*by, "true_label", "predicted_label").agg(F.count("*").alias("n")))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def class_metrics(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of every label, true or predicted; 0 for 0/0."""
    pairs = confusion_matrix(rows, by)
    right = F.col("true_label") == F.col("predicted_label")
    # Each pair counts once for its true label and once for its predicted label.
    sides = pairs.select(*by, F.explode(F.array(
        F.struct(F.col("true_label").alias("label"), F.col("n").alias("support"),
                 F.lit(0).cast("bigint").alias("predicted"), F.when(right, F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("predicted_label").alias("label"), F.lit(0).cast("bigint").alias("support"),
                 F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("hit")),
    )).alias("s")).select(*by, "s.*")
    counts = sides.groupBy(*by, "label").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"),
        F.sum("hit").alias("hit"))
    return counts.select(
        *by, "label", _ratio(F.col("hit"), F.col("predicted")).alias("precision"),
        _ratio(F.col("hit"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("hit"), F.col("predicted") + F.col("support")).alias("f1"),
        "support", "hit")


def summary(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, support-weighted F1 and size, overall or per group."""
    return class_metrics(rows, by).groupBy(*by).agg(
        _ratio(F.sum("hit"), F.sum("support")).alias("accuracy"),
        _ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
        F.sum("support").alias("sample_size"))


def report(rows: DataFrame) -> DataFrame:
    """Per-label metrics followed by accuracy, macro and weighted averages."""
    labels = class_metrics(rows)
    none = F.lit(None).cast("double")

    def weighted(name: str) -> Column:
        return _ratio(F.sum(F.col(name) * F.col("support")), F.sum("support"))

    totals = labels.agg(F.array(
        F.struct(F.lit("accuracy").alias("label"), none.alias("precision"), none.alias("recall"),
                 _ratio(F.sum("hit"), F.sum("support")).alias("f1"),
                 F.sum("support").alias("support")),
        F.struct(F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"),
                 F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
                 F.sum("support").alias("support")),
        F.struct(F.lit("weighted avg").alias("label"), weighted("precision").alias("precision"),
                 weighted("recall").alias("recall"), weighted("f1").alias("f1"),
                 F.sum("support").alias("support")),
    ).alias("rows")).select(F.inline("rows"))
    return labels.drop("hit").unionByName(totals)
