"""What plans must and must not hold, and heavy keys."""

import time

import pytest
from conftest import FOLDER
from pyspark.sql import functions as F

from vacantia.functions import pages
from vacantia.operators import dedup, skills, trends
from vacantia.plans.queries import QUERIES, corpus_skills

BUILDS = sorted(set(QUERIES) - {"lr_domain", "lr_eval", "lr_optimum", "nb_eval", "incremental_ingest", "scan_csv_roundtrip", "source_file_report", "merge_readable_files",
                                "earliest_capture_batches", "dedup_postings_batches"})


def plan(table):
    return table._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BUILDS)
def test_no_python_no_cross_join(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in text, bad


def test_dictionary_is_broadcast_and_tokens_are_not_shuffled(data):
    text = plan(corpus_skills(data))
    assert text.count("BroadcastHashJoin") >= 2
    before = text[:text.index("posexplode")]
    assert "collect_list" in before  # the only shuffle above the tokens follows the gathering of matches


def test_large_dictionary_is_not_broadcast(data):
    words = skills.vocabulary(skills.taxonomy_entries(data.view("v_taxonomy")))
    data.spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = skills.with_skills(data.postings(), "doc_id", "description", words, {"hard": "hard_skills"}, limit=0)
        assert "BroadcastHashJoin" not in plan(out)
    finally:
        data.spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_postings_are_read_once_for_counts_and_totals(data):
    table = data.postings().selectExpr("2001 AS year", "array(source) AS skills")
    text = plan(trends.skill_trends(table, "skills"))
    assert text.count("FileScan") == 1


def test_one_key_with_a_third_of_the_rows(spark):
    rows = spark.range(30000).selectExpr(
        "if(id % 3 = 0, 'hot', concat('k', id % 500)) AS job_id", "concat('u', id) AS original_url",
        "concat('w', id) AS wayback_url", "cast(20200000000000 + (id * 7919) % 30000 AS string) AS timestamp")
    out = dedup.dedup_postings(rows.repartition(16))
    assert out.count() == 501
    assert "partial_min" in plan(out)  # each task sends one row per key


def seconds(run):
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


def in_proportion(run, small, large):
    """Time grows no faster than about the size (the fixed part of a query helps)."""
    run(small)
    return seconds(lambda: run(large)) <= 2.5 * large / small * max(0.4, seconds(lambda: run(small)))


def test_pages_of_many_elements(spark):
    def run(n):
        body = "".join(f"<p>w{i}</p>" for i in range(n)) + '<div class="similar-jobs">x<div>y</div></div>' + "<i>end</i>"
        page = f'<div class="listing-content">{body}</div>'
        out = spark.createDataFrame([(page,)], "html string").select(pages.page_description(F.col("html"), F.col("html")).alias("d"))
        text = out.first()["d"]
        assert text.startswith("w0 w1") and text.endswith("end") and "x y" not in text
    assert in_proportion(run, 10000, 40000)


def test_texts_of_many_matches(spark):
    def run(n):
        text = " ".join(["sql", "in", "python"][i % 3] for i in range(n))
        docs = spark.createDataFrame([(1, text)], "doc_id long, description string")
        assert skills.extract_synonyms(docs).first()["extracted_skills"] == ["Python", "SQL"]
    assert in_proportion(run, 25000, 100000)


def test_first_element_costs_no_more_with_a_long_rest(spark):
    def run(n):
        html = "<h1>Title <b>x</b></h1>" + "<p>text</p>" * n
        out = spark.createDataFrame([(html,)], "html string").select(
            pages.first_element(F.col("html"), F.lit("h1"), F.lit(pages.open_tag_pattern("h1", "", ""))).alias("e"))
        assert out.first()["e"]["inner"] == "Title <b>x</b>"
    assert in_proportion(run, 25000, 100000)
