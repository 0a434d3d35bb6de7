"""Incremental ingest equals batch extraction and is repeatable."""

from vacantia.operators.extract import page_outcomes
from vacantia.streaming import ingest

SCHEMA = "board string, original_url string, timestamp string, html string"
FILL = "<p>" + "filler " * 100 + "</p>"


def page(n, title):
    return ("dice", f"https://www.dice.com/job-detail/{n}", "20200101000000", f"<h1>{title}</h1>{FILL}")


def run(spark, folder, target, progress):
    pages = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    ingest.incremental_ingest(pages, target, progress).awaitTermination()
    return sorted((r["job_id"], r["title"]) for r in ingest.stored_postings(spark, target).collect())


def test_ingest(spark, tmp_path):
    folder, target, progress = (str(tmp_path / n) for n in ("pages", "store", "progress"))
    first = spark.createDataFrame([page(1, "A"), page(1, "A"), page(2, "B"), ("dice", "u", "1", "short")], SCHEMA)
    first.coalesce(1).write.parquet(folder)
    assert run(spark, folder, target, progress) == [("1", "A"), ("2", "B")]
    batch = page_outcomes(ingest.one_per_capture(first)).filter("status = 'saved'")
    assert sorted((r["job_id"], r["title"]) for r in batch.collect()) == [("1", "A"), ("2", "B")]
    assert run(spark, folder, target, progress) == [("1", "A"), ("2", "B")]
    spark.createDataFrame([page(2, "changed"), page(3, "C")], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    assert run(spark, folder, target, progress) == [("1", "A"), ("2", "B"), ("3", "C")]


def test_repeated_batch_overwrites_itself(spark, tmp_path):
    target = str(tmp_path / "store")
    pages = spark.createDataFrame([page(1, "A"), page(2, "B")], SCHEMA)
    for _ in range(2):
        ingest.ingest_batch(pages, 0, target)
    assert ingest.stored_postings(spark, target).count() == 2


def test_new_progress_folder_adds_nothing(spark, tmp_path):
    """Losing the progress folder replays all files; what is stored still counts as done."""
    folder, target = str(tmp_path / "pages"), str(tmp_path / "store")
    spark.createDataFrame([page(1, "A"), page(2, "B")], SCHEMA).coalesce(1).write.parquet(folder)
    assert len(run(spark, folder, target, str(tmp_path / "p1"))) == 2
    spark.createDataFrame([page(3, "C")], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    assert len(run(spark, folder, target, str(tmp_path / "p2"))) == 3


def test_good_copy_beats_junk_and_missing(spark, tmp_path):
    """One batch, one capture, three copies: the good page is stored."""
    good = page(1, "A")
    copies = [good, (*good[:3], "short"), (*good[:3], None), (*good[:3], "<p>" + "captcha " * 100)]
    for n, order in enumerate((copies, copies[::-1])):
        target = str(tmp_path / f"store{n}")
        ingest.ingest_batch(spark.createDataFrame(order, SCHEMA), 0, target)
        assert [r["title"] for r in ingest.stored_postings(spark, target).collect()] == ["A"]
