"""Weak labels, capped samples and the stratified split.

Samples are the rows with the smallest ``md5(key-seed)`` of their label, so they depend on
neither partitions nor retries.  The exact cut-off hash is found on narrow data and the wide
rows are then only filtered: no label, however large, passes through one task.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vacantia import rules

_BUCKET_DIGITS = 4


def sample_hash(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")))


def cutoffs(rows: DataFrame, label: str, hashed: str, labels: Sequence[str],
            quota: Callable[[Column, Column], Column]) -> DataFrame:
    """``(label, pool, quota, cutoff)``: the quota-th smallest hash, null if all rows fit.

    Hash prefixes are counted first (65,536 per label at most); only rows of the prefix the
    quota falls into are ranked.
    """
    bucket = F.substring(hashed, 1, _BUCKET_DIGITS)
    counts = (rows.filter(F.col(label).isin(*labels))
              .groupBy(label, bucket.alias("bucket")).agg(F.count("*").alias("n")))
    whole, upto = W.partitionBy(label), W.partitionBy(label).orderBy("bucket")
    sized = (counts.withColumn("pool", F.sum("n").over(whole))
             .withColumn("upto", F.sum("n").over(upto))
             .withColumn("quota", quota(F.col(label), F.col("pool")).cast("bigint")))
    # One row per label: the bucket that holds the quota-th row.
    border = (sized.groupBy(label, "pool", "quota")
              .agg(F.min(F.when(F.col("upto") >= F.col("quota"), F.struct(
                  "bucket", (F.col("quota") - F.col("upto") + F.col("n")).alias("rank")))
              ).alias("edge"))
              .select(label, "pool", "quota", "edge.bucket", "edge.rank"))
    near = rows.select(label, hashed, bucket.alias("bucket")).join(
        F.broadcast(border.select(label, "bucket", "rank")), [label, "bucket"])
    rank = F.row_number().over(W.partitionBy(label).orderBy(hashed))
    cut = (near.withColumn("rn", rank).filter(F.col("rn") == F.col("rank"))
           .select(label, F.col(hashed).alias("cutoff")))
    return border.select(label, "pool", "quota").join(cut, label, "left")


def _in_smallest(rows: DataFrame, label: str, key: str, seed: int, labels: Sequence[str],
                 quota: Callable[[Column, Column], Column]) -> DataFrame:
    """Rows with a flag ``chosen``: among the quota of their label, null for labels not listed.
    ``key`` must be unique."""
    hashed = rows.withColumn("_hash", sample_hash(key, seed))
    cut = cutoffs(hashed.select(label, "_hash"), label, "_hash", labels, quota)
    # One row per label of a closed list, so the broadcast is bounded.
    joined = hashed.join(F.broadcast(cut), label, "left")
    chosen = F.when(F.col("quota").isNull(), None).when(F.col("quota") <= 0, False).when(F.col("pool") <= F.col("quota"), True).otherwise(
        F.col("_hash") <= F.col("cutoff"))
    return joined.withColumn("chosen", chosen).drop("_hash", "cutoff", "pool", "quota")


def stratified_sample(rows: DataFrame, label: str, key: str, caps: Mapping[str, int],
                      seed: int = rules.SAMPLE_SEED) -> DataFrame:
    """At most ``caps[label]`` rows of each label, drawn by hash."""
    def quota(name: Column, pool: Column) -> Column:
        out = F.lit(0)
        for value, cap in caps.items():
            out = F.when(name == value, cap).otherwise(out)
        return F.least(out, pool)

    return _in_smallest(rows, label, key, seed, list(caps), quota).filter("chosen").drop("chosen")


def train_val_split(rows: DataFrame, label: str, key: str, labels: Sequence[str] = rules.LABELS,
                    share: float = 0.2, seed: int = rules.SAMPLE_SEED) -> DataFrame:
    """Rows with ``split``: in each of ``labels`` round(share * n) rows are ``val``, the rest
    ``train``.  Every row is kept; one whose label is null or not listed has a null ``split``."""
    flagged = _in_smallest(rows, label, key, seed, labels, lambda _, pool: F.round(pool * share))
    return flagged.withColumn("split", F.when(F.col("chosen"), "val").when(~F.col("chosen"), "train")).drop("chosen")


def label_pools(corpus: DataFrame) -> DataFrame:
    """Titled postings with each label their source or title earns; some earn several.

    One pass: the labels are an array, exploded.
    """
    title, source = F.col("title"), F.col("source")
    marked = {name: title.rlike(f"(?i){words}") for name, words in rules.TITLE_MARKERS.items()}
    earned = F.array(
        F.when(source == rules.LABEL_SOURCES["IT"], "IT"),
        F.when((source == rules.LABEL_SOURCES["Finance"]) & marked["Finance"], "Finance"),
        F.when(marked["HR"], "HR"), F.when(marked["Other"], "Other"))
    return (corpus.filter("title is not null")
            .withColumn("label", F.explode(F.filter(earned, lambda x: x.isNotNull()))))


def weak_labels(corpus: DataFrame, key: str = "doc_id", caps: Mapping[str, int] = rules.LABEL_CAPS,
                seed: int = rules.SAMPLE_SEED) -> DataFrame:
    """Training set: the labelled pools, each sampled down to its cap."""
    return stratified_sample(label_pools(corpus), "label", key, caps, seed)


def label_index(rows: DataFrame, label: str) -> DataFrame:
    """Labels of a closed set and their ids, by name."""
    known = rows.filter(F.col(label).isNotNull()).select(label).distinct()
    return known.agg(F.array_sort(F.collect_list(label)).alias("all")).select(
        F.posexplode("all").alias("label_id", label))
