from pyspark.sql import functions as F
"""Pages to postings on hand-made markup."""

from vacantia import rules
from vacantia.operators.extract import (
    backfill_descriptions, extract_archive_postings, extract_postings, page_outcomes,
)

LD = '<script type="application/ld+json">{}</script>'
FILL = "<p>" + "filler " * 100 + "</p>"


def posting(spark, board, html, url="https://x/1", **settings):
    pages = spark.createDataFrame([(board, url, "20200101000000", html)],
                                  "board string, original_url string, timestamp string, html string")
    rows = extract_postings(pages, **settings).collect()
    return rows[0].asDict() if rows else None


def test_jsonld_order_and_arrays(spark):
    html = (LD.format("{broken") + LD.format('[{"@type":"X"},{"@type":"JobPosting","title":"First"}]')
            + LD.format('{"@type":"JobPosting","title":"Second"}'))
    assert posting(spark, "monster", html)["title"] == "First"
    assert posting(spark, "monster", html)["country"] == "US"


def test_untitled_jsonld_leaves_fields_for_selectors(spark):
    html = LD.format('{"@type":"JobPosting","title":" ","datePosted":"2020-02-03","hiringOrganization":"text",'
                     '"jobLocation":{"address":{"addressLocality":"Ulm","addressCountry":"AT"}},"description":"<b>D</b>"}')
    row = posting(spark, "stepstone", html + '<h1 class="x Job-Title">T<i>!</i></h1>')
    assert (row["title"], row["date_posted"], row["city"], row["country"], row["description"], row["company"]) == (
        "T!", "2020-02-03", "Ulm", "AT", "D", "")


def test_nested_elements_are_whole(spark):
    html = ('<h1>T</h1><div class="job-description">a<div>b<div>c</div></div>d<divider>e</divider></div><div>f</div>')
    assert posting(spark, "dice", html)["description"] == "a b c d e"


def test_unclosed_element_runs_to_the_end(spark):
    assert posting(spark, "dice", '<h1>T</h1><div id="jobDescription">a <p>b')["description"] == "a b"


def test_selector_order_and_limits(spark):
    long = "n" * 100
    html = (f'<h1></h1><div class="company">{long}</div><span class="employer">Small</span>'
            '<meta itemprop="employmentType" content="Full &amp; fine"><time>3 May</time>'
            "<span class='location'>Genf, GE , CH</span>")
    row = posting(spark, "stackoverflow", html + '<a class="job-link">Linked</a>')
    assert (row["title"], row["company"], row["employment_type"], row["date_posted"], row["city"], row["country"]) == (
        "Linked", "Small", "Full & fine", "3 May", "Genf", "CH")
    row = posting(spark, "dice", html + "<h1>T</h1>")
    assert row is None or row["title"] == ""  # the first h1 is empty and no other is looked at


def test_class_words_match_in_any_class_and_comments_do_not_count(spark):
    html = '<!-- <h1>Old</h1> --><h1 id="a" class="b job-detail--big title">T</h1>'
    assert posting(spark, "stackoverflow", html)["title"] == "T"


def test_main_content_of_one_board(spark):
    html = "<h1>T</h1><main>" + "ab " * 2000 + "</main>"
    row = posting(spark, "jobs_cz", html, "https://www.jobs.cz/rpd/1234567/")
    assert len(row["description"]) == 5999, "whole by default"
    row = posting(spark, "jobs_cz", html, "https://www.jobs.cz/rpd/1234567/", main_chars=rules.MAIN_CONTENT_CHARS)
    assert len(row["description"]) == 3000 and row["job_id"] == "1234567" and row["country"] == "CZ"
    assert posting(spark, "dice", "<h1>T</h1><main>ab</main>")["description"] == ""


def test_empty_pages_are_dropped(spark):
    assert posting(spark, "dice", "<p>nothing</p>") is None


def test_outcomes(spark):
    pages = [("dice", None), ("dice", "<h1>T</h1>"), ("dice", FILL + "CAPTCHA"), ("dice", FILL), ("dice", "<h1>T</h1>" + FILL),
             ("stepstone", "<h1>404</h1>" + FILL), ("dice", "<h1>404</h1>" + FILL)]
    table = spark.createDataFrame([(i, b, "u", "1", h) for i, (b, h) in enumerate(pages)],
                                  "n int, board string, original_url string, timestamp string, html string")
    found = {r["n"]: r["status"] for r in page_outcomes(table, keep=["n"]).collect()}
    assert [found[i] for i in range(7)] == ["errors", "junk", "junk", "empty", "saved", "saved", "junk"]


def test_archive_layout(spark):
    html = LD.format('[{"@type":"JobPosting","title":"","validThrough":"2020-01-01","description":"<p> a  b </p><p>c</p>"}]')
    pages = spark.createDataFrame([("u1", html), ("u2", "<p>none</p>")], "archive_url string, html string")
    (row,) = extract_archive_postings(pages).collect()
    assert (row["archive_url"], row["title"], row["valid_through"], row["date_posted"], row["description_preview"]) == (
        "u1", "", "2020-01-01", None, "a  b c")


def test_backfill_keeps_everything_else(spark):
    postings = spark.createDataFrame(
        [(1, "a", "own"), (2, "a", " "), (3, "b", None), (4, "", None), (5, None, None), (6, "c", "")],
        "n int, wayback_url string, description string")
    text = "word " * 60
    pages = spark.createDataFrame(
        [("a", f'<div itemprop="description">{text}</div>' + FILL), ("a", f'<div itemprop="description">{text}more</div>' + FILL),
         ("b", '<div itemprop="description">short</div>' + FILL), ("c", f'<div itemprop="description">{text}</div>just a moment' + FILL)],
        "wayback_url string, html string")
    found = {r["n"]: r["description"] for r in backfill_descriptions(postings, pages).collect()}
    assert found == {1: "own", 2: text + "more", 3: None, 4: None, 5: None, 6: ""}


def test_attribute_quoting(one):
    """Values in double, single and no quotes are read alike."""
    from vacantia.functions import pages as P
    for quote in ('"', "'", ""):
        html = f"<div itemprop={quote}description{quote} id=x>Body</div><time datetime={quote}2018-03-01{quote}>x days</time>"
        found = one(lambda h: P.first_element(h, F.lit("div"), F.lit(P.open_tag_pattern("div", "itemprop", "description")))["inner"], html)
        assert found == ["Body"]
        assert one(lambda h: P._attribute(F.regexp_extract(h, "<time[^>]*>", 0), "datetime"), html) == ["2018-03-01"]
    assert one(lambda h: P._attribute(h, "content"), "<meta name=a>") == [""]
