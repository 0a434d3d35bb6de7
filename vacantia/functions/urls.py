"""Expressions on posting addresses, chosen by board."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantia import rules


def by_board(board: Column, table: Mapping, make: Callable[[object], Column], default=None) -> Column:
    """CASE over the boards of a rule table; only the row's own branch is evaluated."""
    out = None
    for name, rule in table.items():
        out = (F if out is None else out).when(board == name, make(rule))
    return out.otherwise(default)


def any_of(conditions) -> Column:
    out = F.lit(False)
    for condition in conditions:
        out = out | condition
    return out


def all_of(conditions) -> Column:
    out = F.lit(True)
    for condition in conditions:
        out = out & condition
    return out


def is_job_url(url: Column, board: Column) -> Column:
    low = F.lower(url)
    required = by_board(
        board, rules.URL_REQUIRED, lambda patterns: all_of(low.rlike(p) for p in patterns), False)
    excluded = by_board(
        board, rules.URL_EXCLUDES, lambda texts: any_of(low.contains(t) for t in texts), True)
    return F.coalesce(required & ~excluded, F.lit(False))


def job_id_from_url(url: Column, board: Column) -> Column:
    """First pattern found, on the address as written; '' when none is."""

    def ids(patterns) -> Column:
        found = []
        for pattern, group, longest in patterns:
            part = F.regexp_extract(url, pattern, group)
            found.append(F.nullif(F.substring(part, 1, longest) if longest else part, F.lit("")))
        return F.coalesce(*found, F.lit(""))

    return F.coalesce(by_board(board, rules.JOB_ID_PATTERNS, ids, ""), F.lit(""))


def country_from_url(url: Column) -> Column:
    low = F.lower(url)
    out = None
    for keyword, code in rules.URL_COUNTRIES:
        out = (F if out is None else out).when(low.contains(keyword), code)
    return out.otherwise("")


def capture_url(timestamp: Column, original_url: Column) -> Column:
    return F.concat(F.lit(rules.CAPTURE_PREFIX), timestamp, F.lit("/"), original_url)
