"""Student's t tail as a plain expression."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS = 400


def _integral(low: Column, high: Column, power: Column) -> Column:
    """Simpson's rule for cos(x) ** power."""
    width = (high - low) / STEPS

    def add(acc: Column, i: Column) -> Column:
        weight = F.when((i == 0) | (i == STEPS), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
        return acc + weight * F.pow(F.greatest(F.cos(low + width * i), F.lit(0.0)), power)

    return F.aggregate(F.sequence(F.lit(0), F.lit(STEPS)), F.lit(0.0), add) * width / 3


def two_sided_p(t: Column, df: Column) -> Column:
    """P(|T| > t).  With x = atan(t / sqrt(df)) the density is proportional to
    cos(x) ** (df - 1), so p is a ratio of two integrals.  Beyond 12 standard widths nothing
    is left, which keeps the steps fine for a large df."""
    top = F.least(F.lit(math.pi / 2), 12 / F.sqrt(df))
    x = F.least(F.atan(F.abs(t) / F.sqrt(df)), top)
    return _integral(x, top, df - 1) / _integral(F.lit(0.0), top, df - 1)
