"""Earliest captures and postings, and what is still to be fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vacantia.functions.text import strip
from vacantia.functions.urls import capture_url, is_job_url
from vacantia.sources import versions
from vacantia.sources.tables import stored


def earliest_captures(captures: DataFrame) -> DataFrame:
    """One capture per address: the smallest time stamp text.  Aggregates map-side."""
    return (captures.groupBy("original_url").agg(F.min("timestamp").alias("timestamp"))
            .select("timestamp", "original_url",
                    capture_url(F.col("timestamp"), F.col("original_url")).alias("wayback_url")))


def posting_key() -> Column:
    return F.coalesce(F.nullif(strip(F.col("job_id")), F.lit("")), F.col("original_url"), F.lit(""))


def dedup_postings(postings: DataFrame) -> DataFrame:
    """The earliest posting of each key: the stripped job id, else the address.

    A minimum over whole rows, so each task sends one row per key however many copies a key
    has.  Ties in the time stamp fall to the addresses, then to the other columns.
    """
    first = [F.coalesce("timestamp", F.lit("")).alias("_ts"),
             F.coalesce("original_url", F.lit("")).alias("_url"),
             F.coalesce("wayback_url", F.lit("")).alias("_capture")]
    best = postings.groupBy(posting_key().alias("_key")).agg(
        F.min(F.struct(*first, *postings.columns)).alias("best"))
    return best.select(*[F.col(f"best.{c}").alias(c) for c in postings.columns])


# --- kept up to date -----------------------------------------------------------------

def merge_captures(captures: DataFrame, root: str, buckets: int = versions.BUCKETS) -> int:
    """Merge a batch of captures into the stored table of earliest ones at ``root``.

    Any split into batches, in any order, gives the table that one batch gives; only the buckets
    that hold the batch's addresses are read and written.
    """
    least = captures.groupBy("original_url").agg(F.min("timestamp").alias("timestamp"))
    return versions.upsert(stored(least, "captures"), root, "original_url", lambda both: both.groupBy("original_url").agg(
        F.min("timestamp").alias("timestamp")), buckets)


def merged_captures(spark: SparkSession, root: str) -> DataFrame:
    """The table that ``merge_captures`` keeps, as ``earliest_captures`` gives it."""
    return earliest_captures(versions.read_version(spark, root, "original_url string, timestamp string")[1])


def merge_postings(postings: DataFrame, root: str, buckets: int = versions.BUCKETS) -> int:
    """Merge a batch of postings into the stored table of deduplicated ones at ``root``."""
    def kept(rows: DataFrame) -> DataFrame:
        return dedup_postings(rows).withColumn("posting_key", posting_key())

    return versions.upsert(stored(kept(postings), "postings"), root, "posting_key", lambda both: kept(both.drop("posting_key")), buckets)


def merged_postings(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """The table that ``merge_postings`` keeps."""
    return versions.read_version(spark, root, schema)[1]


def done_urls(stored: DataFrame, column: str = "wayback_url") -> DataFrame:
    """Addresses already stored; blanks do not count."""
    url = strip(F.col(column))
    return stored.select(url.alias(column)).filter(F.col(column) != "").distinct()


def pending_captures(captures: DataFrame, stored: DataFrame, column: str = "wayback_url") -> DataFrame:
    """Captures whose address is not stored yet."""
    return captures.join(done_urls(stored, column), column, "left_anti")


def pending_job_captures(captures: DataFrame, stored: DataFrame) -> DataFrame:
    """What is still to be fetched: captures ``(board, original_url, timestamp)`` of job pages, the
    earliest of each address, less those stored."""
    jobs = captures.filter(is_job_url(F.col("original_url"), F.col("board")))
    return pending_captures(earliest_captures(jobs), stored)
