"""Text, address and date rules on hand-made rows."""

from pyspark.sql import functions as F

from vacantia.functions import pages as P
from vacantia.functions import text as T
from vacantia.functions import urls as U


def test_clean_and_blank(one):
    assert one(T.clean_text, "  a \u00a0\t b\x1c\x1dc\n", None, "   ", "a b") == ["a b c", "", "", "a b"]
    assert one(T.is_blank, None, "", " \u00a0\n", " x ") == [True, True, True, False]


def test_entities_decode_once(one):
    rows = ("a&nbsp;b &amp;lt; &lt;b&gt; &#228;&#x20AC;&#65 &unknown; &", "no reference", "&amp;amp;")
    assert one(T.decode_entities, *rows) == ["a\u00a0b &lt; <b> ä€A &unknown; &", "no reference", "&amp;"]


def test_markup_to_text(one):
    html = "<p>A<!-- x --><b> b </b>&amp; c<script>var a='<p>';</script><br/>1 < 2</p>"
    assert one(T.html_to_text, html) == ["A b & c 1 < 2"]
    assert one(T.tags_to_nothing, " De <b> x </b> y &nbsp;") == ["Dexy"]
    assert one(T.tags_to_pieces, "a  b<i> c </i>") == ["a  b c"]


def test_long_runs_of_tags(one):
    html = "<p>" * 200_000 + "x" + "</p>" * 200_000
    assert one(T.tags_to_nothing, html) == ["x"]
    assert one(lambda c: P.is_junk(c), html, " " * 2_000_000 + "x", "y" * 2_000_000) == [False, True, False]


def test_location(one):
    rows = ("Bern , BE,CH", "Zug", None, "a, b")
    parts = one(lambda c: F.struct(*[v.alias(k) for k, v in T.split_location(c).items()]), *rows)
    assert [tuple(p) for p in parts] == [("Bern", "BE", "CH"), ("Zug", "", ""), ("", "", ""), ("a", "b", "b")]


def test_dates(one):
    shown = lambda c: F.date_format(T.parse_date(c), "yyyy-MM-dd HH:mm")
    rows = ("2020-01-02", "20200102030405", "2020-01-02T03:04:05Z", "Posted 3 days ago", "2.1.2020",
            "Jan 2, 2020", "January 2, 2020", "2 Jan 2020", "2020", "31.2.2020", None, "", "12345", "2020-13-45")
    assert one(shown, *rows) == [
        "2020-01-02 00:00", "2020-01-02 03:04", "2020-01-02 03:04", None, "2020-01-02 00:00",
        "2020-01-02 00:00", "2020-01-02 00:00", "2020-01-02 00:00", "2020-01-01 00:00", None, None, None, None, None]


def test_year_of_month(one):
    assert one(T.year_of_month, "2019-05", "nan", None, "") == [2019, None, None, None]


def test_skill_list_text(one):
    assert one(T.parse_list, "[]", "['a', \"b's\"]") == [[], ["a", "b's"]]


def test_file_names(one):
    names = ("stepstone_de_jobs_dedup.csv", "dice_com_cleaned.csv", "ch_data.csv", "x_jobs.csv")
    assert one(T.slug_of_file, *names) == ["stepstone_de", "dice_com", "ch_data", "x"]
    assert one(T.source_of_file, *names) == ["stepstone", "dice", "ch", "x"]


def test_column_choice():
    assert T.description_column(["id", "Job_Description", "description"]) == "Job_Description"
    assert T.description_column(["id", "full_text", "Description"], loose=False) == "full_text"
    assert T.date_column(["id", "timestamp", "date_posted"]) == "timestamp"
    assert T.label_column(["a", "b", "c"]) == "c" and T.label_column(["true_label", "x"]) == "true_label"


def test_job_urls(one):
    rows = (
        ("https://www.dice.com/jobs/detail/Java-Dev/10/AbC?x", "dice", True, "AbC"),
        ("https://www.dice.com/jobs/detail/x/", "dice", False, ""),
        ("https://www.dice.com/job-detail/" + "k" * 60, "dice", True, "k" * 50),
        ("https://www.efinancialcareers.com/a.ID0123", "efinancialcareers", True, "0123"),
        ("https://www.efinancialcareers.com/jobs/a.id0123", "efinancialcareers", False, "0123"),
        ("https://stackoverflow.com/jobs/77/dev?so_source=x", "stackoverflow", False, "77"),
        ("https://www.monster.com/job-openings/a--0A1B2C3D-1111-2222-3333-444400000000", "monster", True,
         "0A1B2C3D-1111-2222-3333-444400000000"),
        ("https://www.stepstone.de/5/1234567", "stepstone", True, "1234567"),
        ("https://www.pracuj.pl/praca/x,oferta,1234", "pracuj", True, "1234"),
        ("https://www.jobs.cz/rpd/1234567/?page=2", "jobs_cz", False, "1234567"),
        ("https://elsewhere.org/", "unknown", False, ""),
    )
    pairs = [(u, b) for u, b, _, _ in rows]
    assert one(U.is_job_url, *pairs) == [r[2] for r in rows]
    assert one(U.job_id_from_url, *pairs) == [r[3] for r in rows]


def test_country_of_url(one):
    rows = ("https://x/jobs-USA-London", "https://x/Zurich", "https://x/rome", None)
    assert one(U.country_from_url, *rows) == ["US", "CH", "", ""]


def test_named_references_of_all_alphabets(one):
    texts = ["Pr&aacute;ce", "&Scaron;koda", "&lstrok;&oacute;d&zacute;", "&frac12; &there4;", "&nosuch; &amp;lstrok;", "a & b &"]
    assert one(T.decode_entities, *texts) == ["Práce", "Škoda", "łódź", "½ ∴", "&nosuch; &lstrok;", "a & b &"]
