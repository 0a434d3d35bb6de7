"""Market structure: growth of skills, skill bloat, co-occurrence, convergence, geography.

The definitions are textbook ones and our own choice:

* growth: least squares of the yearly share on the year, years without the skill count as 0;
* bloat: Welch's t-test and Cohen's d (pooled) of skills per posting, late against early years;
* co-occurrence: a pair is kept when it is in at least ``theta`` of the year's postings;
* density: 2E / (V (V - 1)), V the skills that reach the same ``theta``;
* convergence: cosine and Jaccard index of two domains' share vectors per year.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vacantia import rules
from vacantia.functions.tdist import two_sided_p
from vacantia.operators import joins
from vacantia.operators.trends import shares, skill_counts
from vacantia.sources.tables import stored

YEAR_ZERO = 2000  # years are counted from here so that squares stay small


def skill_growth(postings: DataFrame, skills: str, by: Sequence[str] = ("domain_label",),
                 min_jobs: int = rules.MIN_JOBS) -> DataFrame:
    """Slope, intercept, R2, t and p of each skill's yearly share.

    Years without the skill enter through the sums over years, so the skill-by-year grid is
    never built.
    """
    by = list(by)
    keys = [*by, "year"]
    enough = shares(skill_counts(postings, skills, keys), keys, keep_totals=True).filter(
        F.col("total_jobs") >= min_jobs)
    x, y = (F.col("year") - YEAR_ZERO).cast("double"), F.col("percentage")
    sums = enough.groupBy(*by, "skill").agg(
        F.count("*").alias("k"), F.sum(x).alias("kx"), F.sum(x * x).alias("kxx"),
        F.sum(y).alias("sy"), F.sum(x * y).alias("sxy"), F.sum(y * y).alias("syy"))
    # The group of totals has a row for every year with enough postings.
    for column, part in (("n", "k"), ("sx", "kx"), ("sxx", "kxx")):
        sums = sums.withColumn(column, F.max(F.when(F.col("skill").isNull(), F.col(part))).over(W.partitionBy(*by)))
    n = F.col("n")
    joined = sums.filter("skill is not null").filter(n >= 3).select(
        *by, "skill", "n",
        (F.col("sxx") - F.col("sx") * F.col("sx") / n).alias("dxx"),
        (F.col("sxy") - F.col("sx") * F.col("sy") / n).alias("dxy"),
        (F.col("syy") - F.col("sy") * F.col("sy") / n).alias("dyy"),
        (F.col("sx") / n + YEAR_ZERO).alias("mx"), (F.col("sy") / n).alias("my"))
    slope = F.col("dxy") / F.col("dxx")
    fitted = joined.withColumn("slope", slope).withColumn(
        "rest", F.greatest(F.col("dyy") - F.col("slope") * F.col("dxy"), F.lit(0.0)))
    error = F.sqrt(F.col("rest") / (n - 2) / F.col("dxx"))
    tested = fitted.withColumn("t_stat", F.when(error > 0, F.col("slope") / error))
    return tested.select(
        *by, "skill", F.col("n").alias("years"), "slope",
        (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"),
        F.when(F.col("dyy") > 0, F.col("dxy") * F.col("dxy") / (F.col("dxx") * F.col("dyy"))).alias("r2"),
        "t_stat", F.when(F.col("t_stat").isNotNull(), two_sided_p(F.col("t_stat"), (n - 2).cast("double")))
        .alias("p_value"))


def skills_per_posting(postings: DataFrame, skills: str, by: Sequence[str] = ("year",)) -> DataFrame:
    """Mean, median and 90th percentile (interpolated) of the number of skills.

    Everything follows from the counts per number of skills, a few hundred rows per group.
    """
    by = list(by)
    counts = (postings.select(*by, F.size(skills).alias("k")).dropna(subset=by)
              .groupBy(*by, "k").agg(F.count("*").alias("n")))
    upto = F.sum("n").over(W.partitionBy(*by).orderBy("k"))
    total = F.sum("n").over(W.partitionBy(*by))
    ranked = counts.withColumn("upto", upto).withColumn("total", total)

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("upto") > rank, F.col("k")))

    def quantile(q: float) -> tuple[Column, Column, Column]:
        place = (F.col("total") - 1) * F.lit(q)
        return at(F.floor(place)), at(F.ceil(place)), F.max(place - F.floor(place))

    aggregates = [F.sum("n").alias("postings"), F.sum(F.col("n") * F.col("k")).alias("all_skills")]
    for name, q in (("median", 0.5), ("p90", 0.9)):
        low, high, part = quantile(q)
        aggregates += [low.alias(f"{name}_low"), high.alias(f"{name}_high"), part.alias(f"{name}_part")]

    def value(name: str) -> Column:
        low, high = F.col(f"{name}_low"), F.col(f"{name}_high")
        return (low + (high - low) * F.col(f"{name}_part")).alias(f"{name}_skills")

    return ranked.groupBy(*by).agg(*aggregates).select(
        *by, "postings", (F.col("all_skills") / F.col("postings")).alias("mean_skills"),
        value("median"), value("p90"))


def _periods(postings: DataFrame, skills: str, early: tuple[int, int], late: tuple[int, int],
             by: Sequence[str]) -> DataFrame:
    """Size, mean and sample variance of skills per posting in both periods, from whole sums."""
    year, k = F.col("year"), F.size(skills).cast("bigint")
    aggregates = []
    for name, (first, last) in (("early", early), ("late", late)):
        inside = year.between(first, last)
        aggregates += [F.count_if(inside).alias(f"n_{name}"),
                       F.sum(F.when(inside, k)).alias(f"s_{name}"),
                       F.sum(F.when(inside, k * k)).alias(f"q_{name}")]
    sums = postings.groupBy(*by).agg(*aggregates).filter("n_early > 1 and n_late > 1")
    for name in ("early", "late"):
        n, s, q = F.col(f"n_{name}"), F.col(f"s_{name}"), F.col(f"q_{name}")
        sums = sums.withColumn(f"mean_{name}", s / n).withColumn(
            f"var_{name}", (q - s * (s / n)) / (n - 1))
    return sums


def bloat_welch(postings: DataFrame, skills: str, early: tuple[int, int], late: tuple[int, int],
                by: Sequence[str] = ("domain_label",)) -> DataFrame:
    """Welch's t, its degrees of freedom and the two-sided p."""
    sums = _periods(postings, skills, early, late, by)
    a, b = F.col("var_late") / F.col("n_late"), F.col("var_early") / F.col("n_early")
    tested = sums.filter((a + b) > 0).withColumn(
        "t_stat", (F.col("mean_late") - F.col("mean_early")) / F.sqrt(a + b)).withColumn(
        "df", (a + b) * (a + b) / (a * a / (F.col("n_late") - 1) + b * b / (F.col("n_early") - 1)))
    return tested.select(*by, "n_early", "n_late", "mean_early", "mean_late", "t_stat", "df",
                         two_sided_p(F.col("t_stat"), F.col("df")).alias("p_value"))


def bloat_cohen(postings: DataFrame, skills: str, early: tuple[int, int], late: tuple[int, int],
                by: Sequence[str] = ("domain_label",)) -> DataFrame:
    """Cohen's d with the pooled standard deviation, late minus early."""
    sums = _periods(postings, skills, early, late, by)
    pooled = F.sqrt(((F.col("n_early") - 1) * F.col("var_early") + (F.col("n_late") - 1) * F.col("var_late"))
                    / (F.col("n_early") + F.col("n_late") - 2))
    return sums.select(*by, "mean_early", "mean_late", pooled.alias("pooled_sd"),
                       F.when(pooled > 0, (F.col("mean_late") - F.col("mean_early")) / pooled).alias("cohens_d"))


def frequent_skills(postings: DataFrame, skills: str, theta: float, by: Sequence[str]) -> DataFrame:
    """Skills in at least ``theta`` of a group's postings, with the group's size.  Stored."""
    counts = skill_counts(postings, skills, by)
    return stored(shares(counts, by).filter(F.col("percentage") >= theta * 100), "frequent-skills")


def cooccurrence(postings: DataFrame, skills: str, theta: float, key: str = "posting_id",
                 by: Sequence[str] = ("domain_label", "year"),
                 frequent: DataFrame | None = None, limit: int = joins.BROADCAST_BYTES) -> DataFrame:
    """Skill pairs ``skill_a < skill_b`` in at least ``theta`` of a group's postings.

    A pair reaches ``theta`` only if both skills do, so all others are dropped first.  At most
    (mean skills per posting) / theta skills per group are left, which bounds both the lookup
    table and the pairs of one posting.  Pairs are formed row by row from the posting's own
    array and counted map-side; postings themselves are not shuffled.
    """
    by = list(by)
    if frequent is None:
        frequent = frequent_skills(postings, skills, theta, by)
    lists = frequent.groupBy(*by, "total_jobs").agg(F.array_sort(F.collect_list("skill")).alias("common"))
    if joins.measured_bytes(frequent) <= limit:
        kept = postings.join(F.broadcast(lists), by).select(
            *by, "total_jobs", F.array_intersect("common", skills).alias("items"))
    else:
        long = postings.select(key, *by, F.explode(skills).alias("skill"))
        kept = (joins.lookup_join(long, frequent.select(*by, "skill", "total_jobs"), [*by, "skill"],
                                  False, F.col(key))
                .groupBy(key, *by, "total_jobs").agg(F.array_sort(F.collect_set("skill")).alias("items")))
    pairs = (kept.select(*by, "total_jobs", "items", F.posexplode_outer("items").alias("at", "skill_a"))
             .select(*by, "total_jobs", "skill_a",
                     F.explode_outer(F.slice("items", F.col("at") + 2, F.size("items"))).alias("skill_b"))
             .filter("skill_b is not null"))
    return (pairs.groupBy(*by, "total_jobs", "skill_a", "skill_b").agg(F.count("*").alias("pair_count"))
            .withColumn("support", F.col("pair_count") / F.col("total_jobs"))
            .filter(F.col("support") >= theta))


def network_density(postings: DataFrame, skills: str, theta: float, key: str = "posting_id",
                    by: Sequence[str] = ("domain_label", "year")) -> DataFrame:
    """Nodes, edges and density of each group's network."""
    by = list(by)
    frequent = frequent_skills(postings, skills, theta, by)
    nodes = frequent.groupBy(*by).agg(F.count("*").alias("nodes"))
    edges = cooccurrence(postings, skills, theta, key, by, frequent).groupBy(*by).agg(
        F.count("*").alias("edges"))
    possible = F.col("nodes") * (F.col("nodes") - 1)
    return nodes.join(edges, by, "left").na.fill(0, ["edges"]).withColumn(
        "density", F.when(possible > 0, 2 * F.col("edges") / possible).otherwise(0.0))


def skill_degrees(pairs: DataFrame, by: Sequence[str] = ("domain_label", "year")) -> DataFrame:
    """Number of partners of each skill in the network."""
    ends = pairs.select(*by, F.explode(F.array("skill_a", "skill_b")).alias("skill"))
    return ends.groupBy(*by, "skill").agg(F.count("*").alias("degree"))


def convergence(postings: DataFrame, skills: str, left: str = "IT", right: str = "Finance") -> DataFrame:
    """Per year cosine of the two domains' share vectors and Jaccard index of their skills."""
    chosen = postings.filter(F.col("domain_label").isin(left, right))
    keys = ["domain_label", "year"]
    share = shares(skill_counts(chosen, skills, keys), keys)
    side = {name: F.coalesce(F.max(F.when(F.col("domain_label") == name, F.col("percentage"))), F.lit(0.0))
            for name in (left, right)}
    paired = share.groupBy("year", "skill").agg(side[left].alias("a"), side[right].alias("b"))
    dot, aa, bb = (F.sum(F.col(p) * F.col(q)) for p, q in (("a", "b"), ("a", "a"), ("b", "b")))
    return paired.groupBy("year").agg(
        F.count_if((F.col("a") > 0) & (F.col("b") > 0)).alias("shared_skills"),
        F.count("*").alias("all_skills"),
        F.when((aa > 0) & (bb > 0), dot / F.sqrt(aa * bb)).otherwise(0.0).alias("cosine")
    ).withColumn("jaccard", F.col("shared_skills") / F.col("all_skills"))


def geo_benchmark(postings: DataFrame, skills: str, base: str = "US", min_jobs: int = rules.MIN_JOBS,
                  countries: Sequence[str] = rules.TREND_COUNTRIES) -> DataFrame:
    """Each country's share of a skill minus the base country's in the same year."""
    keys = ["year", "country"]
    chosen = postings.filter(F.col("country").isin(*countries))
    share = shares(skill_counts(chosen, skills, keys), keys).filter(F.col("total_jobs") >= min_jobs)
    # At most one row per country in a (year, skill) group.
    own = F.max(F.when(F.col("country") == base, F.col("percentage"))).over(W.partitionBy("year", "skill"))
    return (share.withColumn("base_percentage", F.coalesce(own, F.lit(0.0)))
            .filter(F.col("country") != base)
            .withColumn("gap", F.col("percentage") - F.col("base_percentage")))
