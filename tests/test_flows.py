"""Stages put together, stored versions and a caller's own model."""

from pyspark.sql import functions as F

from vacantia.operators import classify, extract
from vacantia.plans import flows
from vacantia.sources import versions

FILL = "<p>" + "filler " * 100 + "</p>"


def test_pages_to_corpus(spark):
    pages = spark.createDataFrame([
        ("dice", "https://www.dice.com/job-detail/7", "2", "<h1>Late</h1><div itemprop='description'>d</div>" + FILL),
        ("dice", "https://www.dice.com/job-detail/7", "1", "<h1>Early</h1><div itemprop='description'>d</div>" + FILL)],
        "board string, original_url string, timestamp string, html string")
    (row,) = flows.collect_board(pages).collect()
    assert (row["title"], row["wayback_url"]) == ("Early", "https://web.archive.org/web/1/https://www.dice.com/job-detail/7")


def test_equal_rows_are_kept_apart(spark):
    rows = spark.createDataFrame([("a", "t"), ("a", "t"), ("b", None)], "description string, title string")
    corpus = flows.build_corpus({"one": rows, "two": rows})
    assert corpus.count() == 6 and corpus.select("posting_id").distinct().count() == 6


def test_labels_to_trends(spark, data):
    boards = {s: data.postings().filter(F.col("source") == s).drop("source", "domain_label", "year_month")
              for s in ("stackoverflow", "efinancialcareers", "stepstone", "ch")}
    corpus = flows.build_corpus(boards)
    labelled = flows.label_corpus(corpus)
    assert labelled.count() == corpus.count()
    assert {r[0] for r in labelled.select("domain_label").distinct().collect()} <= {"IT", "Finance", "HR", "Other"}
    out = flows.domain_trends(flows.target_postings(labelled), data.view("v_taxonomy"), min_jobs=1)
    assert out.count() > 0 and out.filter("percentage > 100 or skill_count > total_jobs").count() == 0


def test_rewriting_a_table_from_itself(spark, tmp_path):
    path = str(tmp_path / "postings")
    first = spark.createDataFrame([("u", None), ("v", "own")], "wayback_url string, description string")
    versions.write_version(first, path)
    pages = spark.createDataFrame([("u", f"<section itemprop='description'>{'word ' * 60}</section>" + FILL)],
                                  "wayback_url string, html string")
    versions.update(spark, path, first.schema, lambda table: extract.backfill_descriptions(table, pages))
    found = {r[0]: r[1] for r in versions.read_version(spark, path, first.schema)[1].collect()}
    assert found == {"u": ("word " * 60).strip(), "v": "own"}


def test_own_model(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, None), (3, "x")], "doc_id int, description string")
    out = classify.predict_with(docs, lambda: lambda texts: [str(len(t)) for t in texts], batch=2)
    assert {r["doc_id"]: r["predicted_label"] for r in out.collect()} == {1: "3", 2: "23", 3: "1"}


def test_absent_label_never_wins(spark):
    rows = spark.createDataFrame([("a b", "IT"), ("c", "HR")], "description string, label string")
    model, priors = classify.train_naive_bayes(rows)
    docs = spark.createDataFrame([(1, "a a"), (2, "c"), (3, "zzz"), (4, None)], "doc_id int, description string")
    out = {r["doc_id"]: r["predicted_label"] for r in classify.predict_naive_bayes(docs, model, priors).collect()}
    assert out == {1: "IT", 2: "HR", 3: "IT", 4: "IT"}
