"""Lookup joins that broadcast only what was measured, and another way beyond that."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 32


def measured_bytes(table: DataFrame) -> int:
    """Size of a lookup table as text, by one aggregate over it."""
    row = table.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))) + 32).alias("n")).first()
    return int(row["n"] or 0)


def lookup_join(facts: DataFrame, lookup: DataFrame, on: Sequence[str], small: bool,
                salt: Column) -> DataFrame:
    """Inner join of many facts with a lookup table.

    ``small`` says that the table was measured and fits a broadcast.  Otherwise both sides are
    shuffled; each key is spread over ``SALTS`` partitions by ``salt``, an expression that
    differs between facts of one key, so that a key holding a third of the facts is split.
    """
    if small:
        return facts.join(F.broadcast(lookup), list(on))
    spread = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int"))
    return salted.join(spread, [*on, "_salt"]).drop("_salt")
