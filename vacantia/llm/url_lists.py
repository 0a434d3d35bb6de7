"""URL filters with dated lists: a temporal join.

List entries are dated: a pattern enters or leaves a list on a day.  Each entry holds from its day
to the pattern's next entry in that list, so entries become validity intervals.  A capture is
judged by the entries active on its day: its URL's keys (host, every parent domain, host with
every path prefix) are joined as of that day, and the most specific active pattern decides; of
equally long ones a blocking one.

Intervals are cut at month borders, and month and pattern together are the key of an equi-join.
That spreads a host with many captures over the months and keeps the candidates of a key to those
of one month; what remains of skew the planner splits.  Captures are first reduced to distinct URLs
and days, and only those with an active entry come back to the captures.

Defined cases: a null or unparsable URL and a null day match nothing; of several entries for one
pattern on one day a removal wins; an entry without a day or pattern is ignored; the day an entry
is added counts, the day it is removed doesn't; repeated captures give a row each; empty lists
block nothing; an empty table gives an empty result; ``judged`` adds its columns to the captures'
own and needs their names to be free.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.sources.tables import stored

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.$", "")


def keys_of(url: Column) -> Column:
    """Patterns that would cover a URL: parent domains, the host, the host with path prefixes."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(labels, lambda label, i: F.array_join(F.slice(labels, i + 1, F.size(labels) - i), "."))
    segments = F.array_remove(F.split(F.regexp_extract(url, PATH, 1), "/"), "")
    paths = F.transform(segments, lambda s, i: F.concat(host, F.lit("/"), F.array_join(F.slice(segments, F.lit(1), i + 1), "/")))
    return F.when(host != "", F.concat(domains, paths)).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """``(list, pattern, valid_from, valid_to)`` from ``(list, pattern, day, added boolean)``; an
    entry that nothing follows is open, its ``valid_to`` null."""
    dated = entries.filter("day is not null and pattern is not null")
    daily = dated.groupBy("list", "pattern", "day").agg(F.min("added").alias("added"))
    following = F.lead("day").over(Window.partitionBy("list", "pattern").orderBy("day"))
    return (daily.withColumn("valid_to", following).filter("added")
            .select("list", "pattern", F.col("day").alias("valid_from"), "valid_to"))


def month(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def decisions(captures: DataFrame, entries: DataFrame, blocking: list[str], url: str = "url",
              day: str = "day") -> DataFrame:
    """``(url, day, n_active, pattern, list, blocked)`` of the distinct captures with an active
    entry; lists not in ``blocking`` allow."""
    distinct = captures.select(F.col(url).alias("url"), F.col(day).alias("day")).filter("day is not null").distinct()
    # Months after the last capture need no piece.
    first, last = distinct.agg(F.min(month(F.col("day"))), F.max(month(F.col("day")))).first()
    end = F.date_sub("valid_to", 1)
    pieces = (intervals(entries).filter(F.col("valid_to").isNull() | (F.col("valid_from") < F.col("valid_to")))
              .withColumn("low", F.greatest(month(F.col("valid_from")), F.lit(first or 0)))
              .withColumn("high", F.least(month(end), F.lit(last or 0)))  # least passes over the null of an open one
              .filter("low <= high")
              .select("list", "pattern", "valid_from", "valid_to", F.explode(F.sequence("low", "high")).alias("month")))
    asked = distinct.select("url", "day", month(F.col("day")).alias("month"),
                            F.explode(F.array_distinct(keys_of(F.col("url")))).alias("pattern"))
    active = (asked.join(pieces, ["pattern", "month"])
              .filter((F.col("valid_from") <= F.col("day")) & (F.col("valid_to").isNull() | (F.col("day") < F.col("valid_to")))))
    blocks = F.col("list").isin(blocking)
    best = F.max(F.struct(F.length("pattern").alias("n"), blocks.alias("blocked"), "pattern", "list")).alias("best")
    return (active.groupBy("url", "day").agg(F.count("*").alias("n_active"), best)
            .select("url", "day", "n_active", "best.pattern", "best.list", "best.blocked"))


def judged(captures: DataFrame, entries: DataFrame, blocking: list[str], url: str = "url", day: str = "day") -> DataFrame:
    """The captures with ``n_active``, the deciding ``pattern`` and ``list``, and ``blocked``."""
    found = stored(decisions(captures, entries, blocking, url, day), "url-decisions")
    named = found.withColumnsRenamed({"url": "decided_url", "day": "decided_day"})
    on = (F.col(url) == F.col("decided_url")) & (F.col(day) == F.col("decided_day"))
    return (captures.join(named, on, "left").drop("decided_url", "decided_day")
            .withColumns({"n_active": F.coalesce("n_active", F.lit(0)), "blocked": F.coalesce("blocked", F.lit(False))}))
