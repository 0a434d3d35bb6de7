"""Corpus profile: size, fill, dates, lengths, flags.

Rows are reduced to (source, year) or (source, length) counts map-side, so a source holding a
third of the corpus costs no more than a small one after the first stage.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vacantia import rules
from vacantia.functions.text import date_column, description_column, is_blank, parse_date


def with_metadata(table: DataFrame, meta: DataFrame) -> DataFrame:
    """Country, sector and region of the source, ``?`` when it is not listed."""
    joined = table.join(meta, "source", "left")
    for column in ("country", "sector", "region"):
        joined = joined.withColumn(column, F.coalesce(column, F.lit("?")))
    return joined


def source_profile(corpus: DataFrame, description: str = "description", date: str = "date_posted") -> DataFrame:
    """One row per source: rows, valid descriptions, missing share, mean length, date span."""
    valid = ~is_blank(F.col(description))
    day = parse_date(F.col(date))
    by_year = (
        corpus.select("source", valid.alias("valid"), F.length(description).alias("chars"), day.alias("day"))
        .groupBy("source", F.year("day").alias("year"))
        .agg(F.count("*").alias("n"), F.count_if("valid").alias("valid"),
             F.sum(F.when(F.col("valid"), F.col("chars"))).alias("chars"),
             F.min("day").alias("oldest"), F.max("day").alias("newest")))
    totals = by_year.groupBy("source").agg(
        F.sum("n").alias("total_vacancies"), F.sum("valid").alias("valid_desc"),
        F.sum("chars").alias("chars"), F.min("oldest").alias("oldest"),
        F.max("newest").alias("newest"), F.count("year").alias("years_covered"))

    def shown(day: str) -> Column:
        return F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.lit("N/A"))

    missing = F.round((F.col("total_vacancies") - F.col("valid_desc")) / F.col("total_vacancies") * 100, 1)
    mean = F.when(F.col("valid_desc") > 0, (F.col("chars") / F.col("valid_desc")).cast("bigint")).otherwise(0)
    return totals.select(
        "source", "total_vacancies", "valid_desc", missing.alias("missing_pct"),
        mean.alias("avg_desc_length"), shown("oldest").alias("oldest_record"),
        shown("newest").alias("newest_record"), "years_covered",
        F.when(100 - missing >= rules.FILL_MODERATE, "high")
        .when(100 - missing >= rules.FILL_LOW, "moderate").otherwise("low").alias("fill_band"))


def resolved(board: DataFrame, source: str) -> DataFrame:
    """A board's ``source, description, date_posted``, its own columns found by their names; null
    text where it has none."""
    found = {"description": description_column(board.columns), "date_posted": date_column(board.columns)}
    return board.select(F.lit(source).alias("source"), *[
        (F.col(f"`{name}`") if name else F.lit(None)).cast("string").alias(column) for column, name in found.items()])


def mixed_profile(boards: Mapping[str, DataFrame]) -> DataFrame:
    """``source_profile`` of boards whose tables have different columns."""
    return source_profile(reduce(DataFrame.unionByName, [resolved(table, name) for name, table in boards.items()]))


def null_rates(table: DataFrame, columns: Sequence[str], by: str = "source") -> DataFrame:
    """Null share in percent of every column and source."""
    rates = table.groupBy(by).agg(*[
        F.round(F.count_if(F.col(c).isNull()) / F.count("*") * 100, 1).alias(c) for c in columns])
    return rates.unpivot([by], list(columns), "column_name", "null_pct")


def yearly_counts(corpus: DataFrame, date: str = "date_posted") -> DataFrame:
    """Postings per source and year; undated ones do not count."""
    return (corpus.select("source", F.year(parse_date(F.col(date))).alias("year"))
            .groupBy("source", "year").agg(F.count("*").alias("n")).filter("year is not null"))


def yearly_matrix(counts: DataFrame, sources: Sequence[str], first: int = 2010, last: int = 2025) -> DataFrame:
    """Year by source, zeros filled."""
    return (counts.filter(F.col("year").between(first, last)).groupBy("year")
            .pivot("source", list(sources)).agg(F.sum("n")).na.fill(0))


def coverage(matrix: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Each source's yearly counts over its largest one (a source without any stays 0)."""
    top = F.max("n").over(W.partitionBy("source"))
    long = matrix.unpivot(["year"], list(sources), "source", "n")
    return long.withColumn("relative", F.col("n") / F.when(top > 0, top).otherwise(1))


def totals_by(profile: DataFrame, key: str) -> DataFrame:
    """Postings per country or sector of the sources, with shares."""
    sums = profile.groupBy(key).agg(F.sum("total_vacancies").alias("total_vacancies"))
    # A handful of rows: one per country or sector.
    everything = F.sum("total_vacancies").over(W.partitionBy(F.lit(0)))
    return sums.withColumn("share_pct", F.round(F.col("total_vacancies") / everything * 100, 1))


def corpus_totals(profile: DataFrame) -> DataFrame:
    usable = is_usable()
    return profile.agg(
        F.count("*").alias("sources"), F.sum("total_vacancies").alias("total_vacancies"),
        F.sum("valid_desc").alias("valid_desc"),
        F.round(F.sum("valid_desc") / F.sum("total_vacancies") * 100, 1).alias("fill_pct"),
        F.count_if(usable).alias("usable_sources"),
        F.coalesce(F.sum(F.when(usable, F.col("total_vacancies"))), F.lit(0)).alias("usable_vacancies"),
        F.coalesce(F.sum(F.when(usable, F.col("valid_desc"))), F.lit(0)).alias("usable_valid_desc"))


def _fill() -> Column:
    return 100 - F.col("missing_pct")


def _percent(value: Column) -> Column:
    """Whole percent, halves to even."""
    return F.concat(F.bround(value, 0).cast("int").cast("string"), F.lit("%"))


def is_usable(min_fill: float = rules.USABLE_FILL, min_size: int = rules.USABLE_SIZE) -> Column:
    return (_fill() >= min_fill) & (F.col("total_vacancies") >= min_size)


def usable_sources(profile: DataFrame, min_fill: float = rules.USABLE_FILL,
                   min_size: int = rules.USABLE_SIZE) -> DataFrame:
    return profile.filter(is_usable(min_fill, min_size)).withColumn("fill_pct", F.round(_fill(), 1))


def excluded_sources(profile: DataFrame, min_fill: float = rules.USABLE_FILL,
                     min_size: int = rules.USABLE_SIZE) -> DataFrame:
    """The other sources, with the reasons."""
    reasons = F.concat_ws(
        " | ",
        F.when(_fill() < min_fill, F.concat(F.lit("fill="), _percent(_fill()))),
        F.when(F.col("total_vacancies") < min_size,
               F.concat(F.lit("size="), F.format_number("total_vacancies", 0))))
    return profile.filter(~is_usable(min_fill, min_size)).withColumn("reason", reasons)


def quality_flags(profile: DataFrame, small: int = rules.SMALL_SOURCE) -> DataFrame:
    fill, chars, years = _fill(), F.col("avg_desc_length"), F.col("years_covered")
    text = F.concat_ws(
        " | ",
        F.when(fill < rules.FILL_LOW, F.concat(F.lit("⚠ Low description fill rate ("), _percent(fill), F.lit(")")))
        .when(fill < rules.FILL_MODERATE,
              F.concat(F.lit("△ Moderate description fill rate ("), _percent(fill), F.lit(")"))),
        F.when((chars > 0) & (chars < rules.SHORT_TEXT),
               F.concat(F.lit("⚠ Short avg description ("), chars.cast("string"), F.lit(" chars)"))),
        F.when(years <= rules.NARROW_YEARS,
               F.concat(F.lit("△ Narrow time window ("), years.cast("string"), F.lit(" year(s))"))),
        F.when(F.col("total_vacancies") < small,
               F.concat(F.lit("△ Small dataset ("), F.format_number("total_vacancies", 0), F.lit(" records)"))))
    return profile.withColumn("fill", _percent(fill)).withColumn(
        "status", F.when(text == "", "✅ Good").otherwise(text))


def length_histogram(corpus: DataFrame, description: str = "description", shortest: int = 50,
                     longest: int = 10000, bins: int = 50) -> DataFrame:
    """Per source ``bins`` equal bins between the extreme lengths, and the median.

    Texts of 50 characters or fewer are left out and lengths are clipped at 10,000, so a
    source has at most 9,950 distinct lengths; everything follows from their counts.
    """
    clipped = F.least(F.length(description), F.lit(longest))
    counts = (corpus.filter(F.length(description) > shortest)
              .groupBy("source", clipped.alias("chars")).agg(F.count("*").alias("n")))
    whole, upto = W.partitionBy("source"), W.partitionBy("source").orderBy("chars")
    placed = (counts.withColumn("low", F.min("chars").over(whole))
              .withColumn("high", F.max("chars").over(whole))
              .withColumn("total", F.sum("n").over(whole))
              .withColumn("upto", F.sum("n").over(upto)))
    # The two middle rows; the same one when the total is odd.
    first = F.min(F.when(F.col("upto") >= F.expr("(total + 1) div 2"), F.col("chars"))).over(whole)
    second = F.min(F.when(F.col("upto") >= F.expr("total div 2 + 1"), F.col("chars"))).over(whole)
    width = F.col("high") - F.col("low")
    position = F.when(width == 0, bins // 2).otherwise(
        F.least(F.expr(f"((chars - low) * {bins}) div nullif(high - low, 0)"), F.lit(bins - 1)))
    binned = (placed.withColumn("median_chars", (first + second) / 2)
              .withColumn("bin", position.cast("int"))
              .groupBy("source", "low", "high", "median_chars", "bin").agg(F.sum("n").alias("n")))
    filled = F.map_from_entries(F.collect_list(F.struct("bin", "n")))
    return (binned.groupBy("source", "low", "high", "median_chars").agg(filled.alias("by_bin"))
            .withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
            .select("source", "bin", F.coalesce(F.try_element_at("by_bin", F.col("bin")), F.lit(0)).alias("n"),
                    "low", "high", "median_chars"))


def sample_descriptions(corpus: DataFrame, key: str = "doc_id", description: str = "description",
                        seed: int = rules.SAMPLE_SEED) -> DataFrame:
    """One valid description per source, drawn by hash; the first 300 characters are shown."""
    drawn = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")))
    preview = F.substring(description, 1, 300)
    return (corpus.filter(~is_blank(F.col(description)))
            .groupBy("source").agg(F.min(F.struct(drawn.alias("h"), F.col(key).alias("k"), preview.alias("t"))).alias("m"))
            .select("source", F.col("m.k").alias(key), F.col("m.t").alias("sample")))
