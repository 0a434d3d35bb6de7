"""What several operators of this subpackage share: words, stored tables, components."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.sources.tables import stored

#: White space is the six ASCII characters; a word is a longest run of others.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
FEW_EDGES = 200_000


def text_of(column: str = "text") -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text, in order, as an array."""
    return F.array_remove(F.split(text, SPACE + "+"), "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.transform(F.array(value), use)[0]


def small(table: DataFrame, rows: int) -> DataFrame:
    """Ask for a broadcast of a stored table if it has at most ``rows`` rows.

    A larger table is left to the planner, which then shuffles both sides.
    """
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def running(table: DataFrame, order: list[Column], name: str, **sums: Column) -> DataFrame:
    """``table`` with, for each of ``sums``, the total over all rows before the row in ``order``.

    The rows are dealt by range and stored; a window runs within each range only, and what lies
    before a range comes from one total per range.  Rows that tie in ``order`` come in any order.
    """
    placed = stored(table.withColumns(sums).repartitionByRange(*order)
                    .withColumn("range_no", F.spark_partition_id()), name)
    by_range = placed.groupBy("range_no").agg(*[F.sum(c).alias(c) for c in sums])
    before = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_range.select("range_no", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_start")
                                           for c in sums])
    within = Window.partitionBy("range_no").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = placed.join(F.broadcast(starts), "range_no")
    return (rows.withColumns({c: F.col(f"{c}_start") + F.coalesce(F.sum(c).over(within), F.lit(0)) for c in sums})
            .drop("range_no", *[f"{c}_start" for c in sums]))


def distinct(values: np.ndarray) -> np.ndarray:
    """The sorted distinct values; a sort is several times faster here than numpy's hash table."""
    ordered = np.sort(values)
    return ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])] if len(ordered) else ordered


def numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each value among the sorted distinct ones, and how often each of these occurs."""
    order = np.argsort(values)
    ordered = values[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(values) else np.zeros(0, bool)
    place = np.empty(len(values), np.int64)
    place[order] = np.cumsum(first) - 1
    return place, np.diff(np.flatnonzero(first), append=len(values))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``edges(a long, b long)``: ``(node, component)``.

    ``component`` is the smallest node that can be reached.  Alternates large-star and
    small-star steps: each is a grouped minimum and a join on edges alone, so no component is
    ever gathered, and the number of rounds grows with the logarithm of the longest path.
    Every round is written to the shared folder, which cuts the lineage.  Nodes without an
    edge to another node are not returned; self loops and repeated edges do no harm.
    """
    def fingerprint(table):
        row = table.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")),
                        F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        return tuple(row)

    def large_star(table):
        both = table.unionByName(table.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        return (both.join(least, "a").filter("b > a")
                .select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct())

    def small_star(table):
        least = table.groupBy("a").agg(F.min("b").alias("m"))
        others = table.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        roots = least.select("a", F.col("m").alias("b"))
        return others.unionByName(roots).filter("a != b").distinct()

    larger, smaller = F.greatest("a", "b"), F.least("a", "b")
    current = stored(edges.filter("a != b").select(larger.alias("a"), smaller.alias("b")).distinct(), name)
    seen = fingerprint(current)
    while seen[0]:
        # A few edges are not worth a shuffle: in one partition the steps need none.
        compact = current.coalesce(1) if seen[0] <= FEW_EDGES else current
        current = stored(small_star(large_star(compact)), name)
        now = fingerprint(current)
        if now == seen:
            break
        seen = now
    members = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.unionByName(members.select(F.col("component").alias("node"), "component").distinct())
