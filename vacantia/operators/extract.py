"""Captured pages to postings: one narrow pass, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia import rules
from vacantia.functions import pages as P
from vacantia.functions import text as T
from vacantia.functions import urls as U


def _country(board: Column, found: Column, url: Column) -> Column:
    """The board's country; some boards take the one in the structured data first."""
    fixed = U.by_board(board, rules.BOARD_COUNTRY, F.lit, "")
    found = F.nullif(found, F.lit(""))
    from_json = F.when(board.isin(*rules.COUNTRY_FROM_JSON), F.coalesce(found, fixed))
    from_url = F.coalesce(F.nullif(U.country_from_url(url), F.lit("")), found, F.lit(""))
    return F.when(board == "efinancialcareers", from_url).otherwise(F.coalesce(from_json, fixed))


def extract_postings(pages: DataFrame, keep: Sequence[str] = (), drop_empty: bool = True,
                     main_chars: int | None = None) -> DataFrame:
    """Pages ``(board, original_url, timestamp, html)`` to the 12 posting fields.

    JSON-LD wins when it has a title; else the board's selectors complete what it left.
    Pages with neither title nor description are dropped unless ``drop_empty`` is off.
    ``keep`` names further page columns to carry.  ``main_chars`` cuts the page's main content,
    where it stands in for a description (the collectors cut at ``rules.MAIN_CONTENT_CHARS``).
    Boards' own limits, in ``rules``: the length of ids (``JOB_ID_PATTERNS``) and texts too long
    for a company or employment type (``TOO_LONG``).
    """
    board, html, url = F.col("board"), F.col("html"), F.col("original_url")
    staged = pages.select(
        *keep, "board", "original_url", "timestamp", "html",
        P.jsonld_fields(html, F.lit("")).alias("ld"))
    untitled = F.col("ld.title") == ""
    staged = staged.withColumn("plain", F.when(untitled, T.drop_noise(html)))
    found = F.when(untitled, P.selector_fields(F.col("plain"), board))
    staged = staged.withColumn("found", found).select(
        *keep, "board", "original_url", "timestamp", "ld",
        *[F.get("found", F.lit(i)).alias(f"at_{field}") for i, field in enumerate(P.FIELDS)])

    def pick(field: str) -> Column:
        return F.coalesce(F.col(f"at_{field}"), F.col(f"ld.{field}"))

    place = T.split_location(F.col("at_location"))
    located = F.col("at_location").isNotNull()
    second = F.size(F.split("at_location", ",")) > 1
    main = F.substring("at_main", 1, main_chars) if main_chars else F.col("at_main")
    description = F.coalesce(F.nullif(pick("description"), F.lit("")), main, F.lit(""))
    country = F.when((board == "stackoverflow") & located & second, place["country"]).otherwise(
        _country(board, F.col("ld.country"), url))
    region = (F.when((board == "dice") & located & second, place["region"])
              .when(board == "monster", pick("region")).otherwise(F.col("ld.region")))
    posting = F.struct(
        *keep, "board",
        U.job_id_from_url(url, board).alias("job_id"),
        pick("title").alias("title"),
        pick("company").alias("company"),
        F.when(located, place["city"]).otherwise(F.col("ld.city")).alias("city"),
        region.alias("region"),
        country.alias("country"),
        pick("employment_type").alias("employment_type"),
        pick("date_posted").alias("date_posted"),
        description.alias("description"),
        U.capture_url(F.col("timestamp"), url).alias("wayback_url"),
        "original_url", "timestamp")
    made = F.array(posting)
    if drop_empty:
        made = F.filter(made, lambda p: (p["title"] != "") | (p["description"] != ""))
    # A generator, so that later filters on the fields do not extract them again.
    return staged.select(F.inline(made) if drop_empty else F.inline_outer(made))


def page_outcomes(pages: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Postings of all pages with ``status``: errors, junk, empty or saved."""
    junk = P.is_junk(F.col("html"), F.col("board"))
    staged = pages.withColumn("junk", junk)
    # Junk pages keep their row but are not parsed.
    staged = staged.withColumn("missing", F.col("html").isNull()).withColumn(
        "html", F.when(~F.col("junk"), F.col("html")).otherwise(""))
    out = extract_postings(staged, keep=(*keep, "missing", "junk"), drop_empty=False)
    status = (F.when(F.col("missing"), "errors").when(F.col("junk"), "junk")
              .when((F.col("title") == "") & (F.col("description") == ""), "empty")
              .otherwise("saved"))
    return out.withColumn("status", status).drop("missing", "junk")


def extract_archive_postings(pages: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Pages ``(archive_url, html)`` of the nine-field layout: first JSON-LD posting, no title test.

    A list of locations counts for its first entry.
    """
    first = F.slice(P.posting_nodes(F.col("html")), 1, 1)
    staged = pages.select(*keep, "archive_url", F.explode_outer(first).alias("node")).filter("node is not null")

    def at(path: str) -> Column:
        return F.try_variant_get("node", path, "string")

    def address(part: str) -> Column:
        return F.coalesce(at(f"$.jobLocation[0].address.{part}"),
                          at(f"$.jobLocation.address.{part}"), F.lit(""))

    body = T.tags_to_pieces(T.drop_noise(F.coalesce(at("$.description"), F.lit(""))))
    return staged.select(
        *keep, "archive_url",
        F.coalesce(at("$.title"), F.lit("")).alias("title"),
        F.coalesce(at("$.hiringOrganization.name"), F.lit("")).alias("company"),
        at("$.datePosted").alias("date_posted"),
        at("$.validThrough").alias("valid_through"),
        at("$.employmentType").alias("employment_type"),
        address("addressLocality").alias("city"),
        address("postalCode").alias("postal_code"),
        body.alias("description_preview"))


def page_descriptions(pages: DataFrame, written: str | None = None) -> DataFrame:
    """``(wayback_url, found, status)`` of stored pages ``(wayback_url, html)``, one row per address:
    ``junk`` if all its pages are, ``empty`` without a description, else ``filled``.

    Of several pages the longest description counts or, with ``written``, that of the page written
    last (the largest value of that column) among those that are not junk.
    """
    kept = pages.filter("wayback_url is not null").withColumn("junk", P.is_junk(F.col("html")))
    plain = T.drop_noise(F.when(~F.col("junk"), F.col("html")))
    rows = kept.withColumn("plain", plain).select(T.settled(
        F.col("wayback_url"), F.col("junk"), (F.col(written) if written else F.lit(None)).alias("written"),
        F.when(~F.col("junk"), P.page_description(F.col("html"), F.col("plain"))).alias("found")))
    rank = F.struct((~F.col("junk")).alias("good"), "written", F.length("found").alias("n"), "found")
    best = rows.groupBy("wayback_url").agg(F.max(rank).alias("best"))
    return best.select(
        "wayback_url", F.coalesce("best.found", F.lit("")).alias("found"),
        F.when(~F.col("best.good"), "junk").when(F.coalesce("best.found", F.lit("")) != "", "filled")
        .otherwise("empty").alias("status"))


def lacks_description() -> Column:
    key = F.coalesce(T.strip(F.col("wayback_url")), F.lit(""))
    return T.is_blank(F.col("description")) & (key != "")


def backfill_descriptions(postings: DataFrame, pages: DataFrame, written: str | None = None) -> DataFrame:
    """Fill blank descriptions from stored pages ``(wayback_url, html)``; all else stays.

    Only rows that lack a description meet the pages, so the wide rows are not shuffled.
    Pages are reduced to one description per address first (map side), so a page captured
    many times costs one row; see ``page_descriptions`` for which one.
    """
    todo = lacks_description()
    found = page_descriptions(pages, written).filter("status = 'filled'").select("wayback_url", "found")
    filled = (
        postings.filter(todo).join(found, "wayback_url", "left")
        .withColumn("description", F.coalesce("found", "description"))
        .select(*postings.columns))
    return postings.filter(~todo).unionByName(filled)


def backfill_outcomes(postings: DataFrame, pages: DataFrame, written: str | None = None) -> DataFrame:
    """How many of the postings that lack a description were filled, stayed empty, had only junk
    pages or no page: ``(status, n)``."""
    todo = postings.filter(lacks_description()).select("wayback_url")
    status = page_descriptions(pages, written).select("wayback_url", "status")
    return (todo.join(status, "wayback_url", "left").groupBy(F.coalesce("status", F.lit("missing")).alias("status"))
            .agg(F.count("*").alias("n")))
