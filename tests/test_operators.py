"""Semantics, properties and independence of partitions."""

import math

from pyspark.sql import functions as F

from vacantia.functions.tdist import two_sided_p
from vacantia.operators import dedup, evaluate, label, merge, profile, structure, trends
from vacantia.sources import tables


def test_dedup_keys_and_ties(spark):
    schema = "job_id string, original_url string, wayback_url string, timestamp string"
    rows = spark.createDataFrame([
        (" 1 ", "b", "w1", "2020"), ("1", "a", "w2", "2020"), ("1", "a", "w3", "2021"),
        ("", "u", "w4", "2"), (None, "u", "w5", "1"), ("", None, "w6", "5"), (" ", None, "w7", "4")], schema)
    once = dedup.dedup_postings(rows)
    assert sorted(r["wayback_url"] for r in once.collect()) == ["w2", "w5", "w7"]
    assert sorted(map(repr, dedup.dedup_postings(once).collect())) == sorted(map(repr, once.collect()))


def test_resume_ignores_blanks(spark):
    captures = spark.createDataFrame([("a",), ("b",)], "wayback_url string")
    stored = spark.createDataFrame([(" a ",), ("",), (None,)], "wayback_url string")
    assert [r[0] for r in dedup.pending_captures(captures, stored).collect()] == ["b"]


def test_merge_aligns_columns(spark):
    one = spark.createDataFrame([("x", "A")], "description string, title string")
    two = spark.createDataFrame([(None, "u"), (" ", "v")], "Description_Preview string, url string")
    none = spark.createDataFrame([(1,)], "n int")
    boards = {"one": one, "two": two, "none": none}
    rows = {(r["source"], r["description"], r["title"], r["url"]) for r in merge.merge_sources(boards).collect()}
    assert rows == {("one", "x", "A", None), ("two", " ", None, "v")}
    assert merge.skipped_sources(boards) == ["none"]


def jobs(spark, rows):
    return spark.createDataFrame(rows, "year int, country string, skills array<string>")


def test_support_boundary_and_totals(spark):
    rows = [(2001, "CH", ["a"] if i < 3 else []) for i in range(30)] + [(2002, "CH", ["a"])] * 29
    out = trends.skill_trends(jobs(spark, rows), "skills").collect()
    assert [tuple(r) for r in out] == [(2001, "a", 3, 30, 10.0)]


def test_top_list_ties_by_name(spark):
    names = [f"s{i:02d}" for i in range(33)]
    out = trends.skill_trends(jobs(spark, [(2001, "CH", names)] * 30), "skills").collect()
    assert sorted(r["skill"] for r in out) == names[:30]


def test_countries_and_null_keys(spark):
    rows = [(2001, "CH", ["a"])] * 30 + [(2001, None, ["a"])] * 5 + [(2001, "CZ", ["a"])] * 30 + [(None, "CH", ["a"])]
    table = jobs(spark, rows)
    assert [tuple(r) for r in trends.skill_trends(table, "skills").collect()] == [(2001, "a", 65, 65, 100.0)]
    by = trends.skill_trends(table, "skills", ["year", "country"]).collect()
    assert [(r["country"], r["total_jobs"]) for r in by] == [("CH", 30)]


def test_samples_do_not_depend_on_partitions(data):
    caps = {"IT": 7, "Finance": 5, "HR": 11, "Other": 0}
    rows = data.postings()
    a = {tuple(r) for r in label.weak_labels(rows, caps=caps).select("doc_id", "label").collect()}
    b = {tuple(r) for r in label.weak_labels(rows.repartition(13), caps=caps).select("doc_id", "label").collect()}
    assert a == b
    assert {k: sum(1 for _, x in a if x == k) for k in caps} == caps


def test_title_words_match_inside_words_and_labels_overlap(spark):
    rows = spark.createDataFrame([(1, "Three Chrome tabs", "x"), (2, None, "stackoverflow"), (3, "HR Mechanic", "stackoverflow")],
                                 "doc_id int, title string, source string")
    found = sorted((r["doc_id"], r["label"]) for r in label.weak_labels(rows).collect())
    assert found == [(1, "HR"), (3, "HR"), (3, "IT"), (3, "Other")]


def test_split_sizes(data):
    counts = label.train_val_split(data.postings(), "domain_label", "doc_id").groupBy("domain_label", "split").count()
    sizes = {(r[0], r[1]): r[2] for r in counts.collect()}
    for name in ("IT", "Finance", "HR", "Other"):
        total = sizes[name, "val"] + sizes[name, "train"]
        assert sizes[name, "val"] == math.floor(0.2 * total + 0.5)


def test_metrics(spark):
    rows = spark.createDataFrame([(" A", "A"), ("A", "B"), ("B", "A "), ("C", "A")], "true_label string, predicted_label string")
    found = {r["label"]: r for r in evaluate.report(rows).collect()}
    assert found["C"]["precision"] == 0 and found["C"]["support"] == 1
    assert math.isclose(found["A"]["f1"], 0.4) and math.isclose(found["accuracy"]["f1"], 0.25)
    assert sum(found[x]["support"] for x in "ABC") == 4


def test_quality_texts(spark):
    row = ("s", 100, 37, 62.5, 120, 2)
    table = spark.createDataFrame([row], "source string, total_vacancies bigint, valid_desc bigint, missing_pct double,"
                                  "avg_desc_length bigint, years_covered bigint")
    (out,) = profile.quality_flags(table).collect()
    assert out["status"] == ("⚠ Low description fill rate (38%) | ⚠ Short avg description (120 chars) | "
                             "△ Narrow time window (2 year(s)) | △ Small dataset (100 records)")


def test_profile_of_a_source_without_text_or_dates(spark):
    table = spark.createDataFrame([("s", " ", "soon"), ("s", None, None)], "source string, description string, date_posted string")
    (row,) = profile.source_profile(table).collect()
    assert (row["valid_desc"], row["missing_pct"], row["avg_desc_length"], row["oldest_record"], row["years_covered"]) == (
        0, 100.0, 0, "N/A", 0)


def test_t_tails(spark):
    """Printed two-sided 5% and 1% points of Student's t."""
    points = [(12.706, 1.0, 0.05), (4.303, 2.0, 0.05), (2.571, 5.0, 0.05), (3.169, 10.0, 0.01), (2.042, 30.0, 0.05),
              (1.980, 120.0, 0.05), (1.960, 1e6, 0.05), (0.0, 7.5, 1.0), (-2.571, 5.0, 0.05)]
    rows = spark.createDataFrame(points, "t double, df double, p double").withColumn("q", two_sided_p(F.col("t"), F.col("df")))
    for r in rows.collect():
        assert abs(r["p"] - r["q"]) < 2e-4, r


def posts(data):
    return data.baskets()


def test_network_properties(data):
    out = structure.network_density(posts(data), "soft_skills", 0.05).collect()
    assert out and all(0 <= r["density"] <= 1 for r in out)


def test_pairs_by_shuffle_equal_pairs_by_broadcast(data):
    table = posts(data)
    a = structure.cooccurrence(table, "soft_skills", 0.05)
    b = structure.cooccurrence(table.repartition(7), "soft_skills", 0.05, limit=0)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(a.columns).collect()))


def test_cohen_changes_sign(data):
    a = structure.bloat_cohen(posts(data), "hard_skills", (1995, 1997), (1999, 2001)).collect()
    b = structure.bloat_cohen(posts(data), "hard_skills", (1999, 2001), (1995, 1997)).collect()
    other = {r["domain_label"]: r["cohens_d"] for r in b}
    assert a and all(math.isclose(r["cohens_d"], -other[r["domain_label"]]) for r in a)


def test_csv_dialect(spark, tmp_path):
    from vacantia.schema import text_schema
    (tmp_path / "a_jobs.csv").write_text('x,y\n"say ""hi""\nthere",NA\n"",  \nnull,z\n', encoding="utf-8")
    (tmp_path / "MASTER_x.csv").write_text("x,y\nq,q\n", encoding="utf-8")
    schema = text_schema("x", "y")
    rows = tables.read_csv(spark, str(tmp_path / "a_jobs.csv"), schema, multi_line=True).collect()
    assert [tuple(r) for r in rows] == [('say "hi"\nthere', None), (None, "  "), (None, "z")]
    files = {r["file_name"] for r in tables.read_board_files(spark, str(tmp_path / "*.csv"), schema, multi_line=True).collect()}
    assert files == {"a_jobs.csv"}


def test_partitioned_sink(spark, tmp_path):
    table = spark.createDataFrame([(i, "hot" if i % 3 else "cold") for i in range(90)], "n int, source string")
    tables.write_by(table, str(tmp_path / "out"), "source")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 90


def test_split_keeps_rows_of_other_labels(spark):
    rows = spark.createDataFrame([(i, ["IT", "Chef", None][i % 3]) for i in range(60)], "doc_id long, label string")
    out = label.train_val_split(rows, "label", "doc_id").collect()
    assert len(out) == 60
    assert {r["split"] for r in out if r["label"] == "IT"} == {"train", "val"}
    assert {r["split"] for r in out if r["label"] != "IT"} == {None}


def test_sorted_report(spark, tmp_path):
    tables.write_sorted(spark.range(100).selectExpr("id * 37 % 100 AS id"), str(tmp_path / "r"), "id")
    files = sorted((tmp_path / "r").glob("*.csv"))
    lines = [int(x) for f in files for x in f.read_text().split()[1:]]
    assert lines == sorted(lines) and len(lines) == 100


def test_backfill_takes_the_longest_or_the_last_page(spark):
    from vacantia.operators import extract
    body = lambda word, n: f'<div itemprop="description">{(word + " ") * n}</div>' + "<p>filler</p>" * 60
    pages = spark.createDataFrame([("w", body("long", 300), 1), ("w", body("last", 100), 2), ("w", "captcha", 3)],
                                  "wayback_url string, html string, seen int")
    postings = spark.createDataFrame([("w", None), ("w", "kept"), ("x", None)], "wayback_url string, description string")
    first = lambda rows: sorted({r["description"].split()[0] for r in rows.collect() if r["description"]})
    assert first(extract.backfill_descriptions(postings, pages)) == ["kept", "long"]
    assert first(extract.backfill_descriptions(postings, pages, "seen")) == ["kept", "last"]
    assert {r["status"]: r["n"] for r in extract.backfill_outcomes(postings, pages).collect()} == {"filled": 1, "missing": 1}
