"""Resumable ingest of captured pages with Structured Streaming.

Each batch takes new page files, drops junk and pages already stored, extracts postings and
writes them to a folder of its own (``batch=<id>``).  A batch repeated after a failure
overwrites its own folder, so postings are neither lost nor doubled.

An index of the stored addresses, ``<target>.index``, is kept in buckets by their hash.  A batch
reads the buckets its own addresses fall into and no others, and merges what it has stored into
these.  The postings are written first: if the index is behind, it is by the batch that is repeated.
``sources.versions.vacuum`` removes the buckets' former versions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.functions.pages import is_junk
from vacantia.functions.text import strip
from vacantia.functions.urls import capture_url
from vacantia.operators.dedup import pending_captures
from vacantia.operators.extract import page_outcomes
from vacantia.rules import POSTING_FIELDS
from vacantia.sources import versions
from vacantia.sources.tables import stored

BUCKETS = versions.BUCKETS
INDEX = "wayback_url string, batch bigint"


def stored_postings(spark: SparkSession, target: str, keep: Mapping[str, str] = {}) -> DataFrame:
    """Postings of all finished batches; empty before the first one.

    ``keep`` gives the types of further columns that were carried along.
    """
    columns = {**keep, "board": "string", **dict.fromkeys(POSTING_FIELDS, "string"), "batch": "bigint"}
    schema = ", ".join(f"{name} {kind}" for name, kind in columns.items())
    try:
        return spark.read.schema(schema).parquet(target)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def with_address(pages: DataFrame) -> DataFrame:
    return pages.withColumn("wayback_url", strip(capture_url(F.col("timestamp"), F.col("original_url"))))


def one_per_capture(pages: DataFrame) -> DataFrame:
    """Pages with ``wayback_url``, one row each (map-side): of several copies one that is neither
    missing nor junk, among these the smallest markup."""
    keyed = pages if "wayback_url" in pages.columns else with_address(pages)
    rest = [c for c in keyed.columns if c not in ("wayback_url", "html")]
    ranked = F.struct(is_junk(F.col("html"), F.col("board")).alias("junk"), F.col("html").isNull().alias("missing"), "html", *rest)
    best = keyed.groupBy("wayback_url").agg(F.min(ranked).alias("p"))
    return best.select("wayback_url", *[F.col(f"p.{c}").alias(c) for c in ("html", *rest)])


def index_of(target: str) -> str:
    return f"{target.rstrip('/')}.index"


def stored_addresses(spark: SparkSession, target: str, asked: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``(wayback_url, batch)`` of the buckets into which the addresses ``asked`` fall."""
    touched = [r[0] for r in asked.select(versions.bucket_of(F.col("wayback_url"), buckets)).distinct().collect()]
    return versions.read_version(spark, index_of(target), INDEX, touched)[1]


def index_postings(postings: DataFrame, target: str, buckets: int = BUCKETS) -> None:
    """Merge the addresses of ``postings(wayback_url, batch)`` into the index; an index that is
    lost is made anew from ``stored_postings``."""
    rows = postings.select(strip(F.col("wayback_url")).alias("wayback_url"), "batch").filter("wayback_url != ''")
    first = rows.groupBy("wayback_url").agg(F.min("batch").alias("batch"))
    versions.upsert(stored(first, "addresses"), index_of(target), "wayback_url",
                    lambda both: both.groupBy("wayback_url").agg(F.min("batch").alias("batch")), buckets)


def ingest_batch(pages: DataFrame, batch: int, target: str, keep: Sequence[str] = (), buckets: int = BUCKETS) -> None:
    """Write the postings of pages not stored by another batch.

    Addresses alone meet the index; of the pages only those still to be stored go on, and the
    join shares its key with the choice of one page per capture.
    """
    spark = pages.sparkSession
    given = with_address(pages)
    asked = stored(given.select("wayback_url").distinct(), "asked")
    before = stored_addresses(spark, target, asked, buckets).filter(F.col("batch") != batch)
    fresh = one_per_capture(given.join(pending_captures(asked, before), "wayback_url", "left_semi")).drop("wayback_url")
    saved = page_outcomes(fresh, keep).filter("status = 'saved'").drop("status")
    saved.write.mode("overwrite").parquet(f"{target.rstrip('/')}/batch={batch}")
    index_postings(stored_postings(spark, target).filter(F.col("batch") == batch), target, buckets)


def incremental_ingest(pages: DataFrame, target: str, checkpoint: str, keep: Sequence[str] = ()):
    """Start a run over the pages available now; run it again to take what came since.

    ``pages`` is a streaming DataFrame ``(board, original_url, timestamp, html)``; ``keep``
    names further columns of it to store.
    """
    return (pages.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
            .foreachBatch(lambda batch, number: ingest_batch(batch, number, target, keep)).start())


def outcome_counts(pages: DataFrame) -> DataFrame:
    """How many pages of each board were saved, junk, empty or failed."""
    return page_outcomes(pages).groupBy("board", "status").agg(F.count("*").alias("n"))
