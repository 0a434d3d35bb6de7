"""Board tables to one corpus."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.functions.text import description_column


def standardize(table: DataFrame, source: str) -> DataFrame | None:
    """Description column renamed, rows without one dropped, source added.

    None when the table has no description column.
    """
    column = description_column(table.columns)
    if column is None:
        return None
    if column != "description":
        table = table.withColumnRenamed(column, "description")
    return table.filter("description is not null").withColumn("source", F.lit(source))


def merge_sources(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Union by name of the boards' tables; columns a board lacks are null.  No dedup."""
    merged = [t for t in (standardize(df, s) for s, df in tables.items()) if t is not None]
    if not merged:
        raise ValueError("no table has a description column")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), merged)


def skipped_sources(tables: Mapping[str, DataFrame]) -> list[str]:
    """Sources left out of the merge because they have no description column."""
    return [s for s, df in tables.items() if description_column(df.columns) is None]
