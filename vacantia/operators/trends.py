"""Yearly skill shares and their top lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vacantia import rules

ALL = "*"


def skill_counts(postings: DataFrame, skills: str, keys: Sequence[str]) -> DataFrame:
    """Count per keys and skill in one pass; the rows with a null skill count the postings.

    Each posting adds one null to its skills, so postings without skills count in the totals
    and the input is read once.  Counts are formed map-side.
    """
    marked = F.concat(F.array(F.lit(None).cast("string")), F.col(skills))
    present = postings
    for key in keys:
        present = present.filter(F.col(key).isNotNull())
    return (present.select(*keys, F.explode_outer(marked).alias("skill"))
            .groupBy(*keys, "skill").agg(F.count("*").alias("skill_count")))


def shares(counts: DataFrame, keys: Sequence[str], keep_totals: bool = False) -> DataFrame:
    """Counts with the total of their group and the share in percent.

    The totals are rows among the counts, so a window finds them (a join would read the
    postings again).  A group has one row per skill of the dictionary.
    """
    total = F.max(F.when(F.col("skill").isNull(), F.col("skill_count"))).over(W.partitionBy(*keys))
    out = counts.withColumn("total_jobs", total).withColumn(
        "percentage", F.col("skill_count") / F.col("total_jobs") * 100)
    return out if keep_totals else out.filter("skill is not null")


def top_skills(trends: DataFrame, keys: Sequence[str], top_k: int = rules.TOP_SKILLS) -> DataFrame:
    """The ``top_k`` skills of each group by share; ties by name."""
    order = W.partitionBy(*keys).orderBy(F.desc("percentage"), "skill")
    return trends.withColumn("rn", F.row_number().over(order)).filter(
        F.col("rn") <= top_k).drop("rn")


def skill_trends(postings: DataFrame, skills: str, keys: Sequence[str] = ("year",),
                 min_jobs: int = rules.MIN_JOBS, top_k: int = rules.TOP_SKILLS,
                 countries: Sequence[str] = rules.TREND_COUNTRIES) -> DataFrame:
    """Top skills per group with enough postings, by year or by country and year."""
    if "country" in keys:
        postings = postings.filter(F.col("country").isin(*countries))
    enough = shares(skill_counts(postings, skills, keys), keys).filter(
        F.col("total_jobs") >= min_jobs)
    return top_skills(enough, keys, top_k)


def all_trends(postings: DataFrame, kinds: Mapping[str, str] = {"hard": "hard_skills", "soft": "soft_skills"},
               min_jobs: int = rules.MIN_JOBS, top_k: int = rules.TOP_SKILLS,
               countries: Sequence[str] = rules.TREND_COUNTRIES) -> DataFrame:
    """Every trend table in one job: domain x kind x (all countries together, each country).

    ``country`` is ``*`` in the tables over all countries.  The finest counts are formed once;
    the coarser ones are sums of them.
    """
    both = F.explode(F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.col(column).alias("skills"))
        for kind, column in kinds.items()])).alias("k")
    long = postings.filter("year is not null and domain_label is not null").select(
        "domain_label", "year", F.coalesce("country", F.lit("?")).alias("country"), both)
    fine = skill_counts(long.select("domain_label", "year", "country", "k.kind", "k.skills"),
                        "skills", ["domain_label", "kind", "year", "country"])
    keys = ["domain_label", "kind", "country", "year"]
    scopes = F.explode(F.when(F.col("country").isin(*countries), F.array(F.lit(ALL), F.col("country")))
                       .otherwise(F.array(F.lit(ALL)))).alias("scope")
    rolled = (fine.select("domain_label", "kind", "year", "skill", "skill_count", scopes)
              .groupBy("domain_label", "kind", F.col("scope").alias("country"), "year", "skill")
              .agg(F.sum("skill_count").alias("skill_count")))
    enough = shares(rolled, keys).filter(F.col("total_jobs") >= min_jobs)
    return top_skills(enough, keys, top_k)
