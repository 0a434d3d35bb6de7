"""Versions with a log, tables in buckets, and what is kept up to date with them."""

import random

import pytest
from pyspark.sql import functions as F
from test_streaming import SCHEMA, page

from vacantia.operators import dedup
from vacantia.sources import versions
from vacantia.streaming import ingest

ROW = "id long, name string"


def rows(spark, *data):
    return spark.createDataFrame(list(data), ROW)


def content(spark, root):
    return sorted(tuple(r) for r in versions.read_version(spark, root, ROW)[1].collect())


def test_versions_follow_each_other(spark, tmp_path):
    root = str(tmp_path / "t")
    assert versions.read_version(spark, root, ROW)[0] == 0 and content(spark, root) == []
    assert versions.write_version(rows(spark, (1, "a")), root) == 1
    assert versions.write_version(rows(spark, (2, "b")), root) == 2
    assert content(spark, root) == [(2, "b")]


def test_the_second_of_two_writers_is_told_or_does_it_again(spark, tmp_path):
    root = str(tmp_path / "t")
    versions.write_version(rows(spark, (1, "a")), root)
    one, other = (versions.read_version(spark, root, ROW) for _ in range(2))
    assert versions.write_version(one[1].unionByName(rows(spark, (2, "b"))), root, one[0]) == 2
    with pytest.raises(versions.Conflict):
        versions.write_version(other[1].unionByName(rows(spark, (3, "c"))), root, other[0])
    assert content(spark, root) == [(1, "a"), (2, "b")]
    calls = []

    def change(table):
        if not calls:  # another writer is faster
            versions.write_version(versions.read_version(spark, root, ROW)[1].unionByName(rows(spark, (4, "d"))), root, 2)
        calls.append(1)
        return table.unionByName(rows(spark, (3, "c")))

    assert versions.update(spark, root, ROW, change) == 4 and len(calls) == 2
    assert content(spark, root) == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]


def test_what_a_dead_writer_leaves_is_not_seen_and_goes(spark, tmp_path):
    root = str(tmp_path / "t")
    for n in range(4):
        versions.write_version(rows(spark, (n, "x")), root)
    rows(spark, (9, "dead")).write.parquet(f"{root}/data/dead")
    (tmp_path / "t" / "aside" / "half").write_text("{")
    assert content(spark, root) == [(3, "x")]
    assert versions.vacuum(spark, root, keep=2) and (tmp_path / "t" / "data" / "dead").exists()  # too young
    gone = versions.vacuum(spark, root, keep=2, age=-5)
    assert "data/dead" in gone and "aside/half" in gone
    assert content(spark, root) == [(3, "x")] and len(list((tmp_path / "t" / "data").iterdir())) == 2
    assert versions.write_version(rows(spark, (5, "y")), root) == 5


def keep_least(both):
    return both.groupBy("id").agg(F.min("name").alias("name"))


def test_only_touched_buckets_are_read_and_written(spark, tmp_path):
    root = str(tmp_path / "t")
    versions.upsert(rows(spark, *[(i, f"n{i}") for i in range(200)]), root, "id", keep_least, 8)
    before = versions.latest(versions.Folder(spark, root))[1]["parts"]
    versions.upsert(rows(spark, (7, "a"), (7, "b")), root, "id", keep_least, 8)
    after = versions.latest(versions.Folder(spark, root))[1]["parts"]
    bucket = spark.range(7, 8).select(versions.bucket_of(F.col("id"), 8)).first()[0]
    assert [b for b in before if before[b] != after[b]] == [str(bucket)]
    assert content(spark, root) == sorted((i, "a" if i == 7 else f"n{i}") for i in range(200))
    read = versions.read_version(spark, root, ROW, [bucket])[1]
    assert all(f"bucket={bucket}/" in f for f in read.inputFiles()) and read.inputFiles()
    with pytest.raises(ValueError):
        versions.upsert(rows(spark, (1, "x")), root, "id", keep_least, 4)


def test_upsert_that_loses_the_race_merges_again(spark, tmp_path):
    root = str(tmp_path / "t")
    versions.upsert(rows(spark, (1, "m"), (2, "m")), root, "id", keep_least, 2)
    calls = []

    def merge(both):
        if not calls:
            calls.append(1)
            versions.upsert(rows(spark, (1, "a"), (3, "z")), root, "id", keep_least, 2)
        return keep_least(both)

    versions.upsert(rows(spark, (1, "k"), (2, "b")), root, "id", merge, 2)
    assert content(spark, root) == [(1, "a"), (2, "b"), (3, "z")]


@pytest.mark.parametrize("buckets", [1, 7])
def test_any_split_into_batches_gives_the_same(spark, tmp_path, buckets):
    rng = random.Random(buckets)
    data = [(f"u{rng.randrange(25)}", str(20100101000000 + rng.randrange(50))) for _ in range(120)] + [(None, "2"), (None, "1")]
    rng.shuffle(data)
    table = spark.createDataFrame(data, "original_url string, timestamp string")
    wanted = sorted(map(str, dedup.earliest_captures(table).collect()))
    root = str(tmp_path / "c")
    cuts = [0, 5, 60, 61, len(data)]
    for lo, hi in zip(cuts, cuts[1:]):
        dedup.merge_captures(spark.createDataFrame(data[lo:hi], table.schema), root, buckets)
    assert sorted(map(str, dedup.merged_captures(spark, root).collect())) == wanted
    dedup.merge_captures(table.limit(0), root, buckets)
    assert dedup.merged_captures(spark, root).count() == len(wanted)


def test_ingest_reads_the_buckets_of_its_own_addresses(spark, tmp_path):
    target = str(tmp_path / "store")
    ingest.ingest_batch(spark.createDataFrame([page(n, "A") for n in range(30)], SCHEMA), 0, target, buckets=16)
    asked = ingest.with_address(spark.createDataFrame([page(3, "B")], SCHEMA)).select("wayback_url")
    found = ingest.stored_addresses(spark, target, asked, 16)
    assert len({f.split("bucket=")[1].split("/")[0] for f in found.inputFiles()}) == 1
    assert 0 < found.count() < 30


def test_ingest_with_all_addresses_in_one_bucket(spark, tmp_path):
    target = str(tmp_path / "store")
    for batch, numbers in enumerate(([1, 2], [2, 3], [1, 2, 3, 4])):
        for _ in range(2):  # repeated after a failure
            ingest.ingest_batch(spark.createDataFrame([page(n, f"{batch}") for n in numbers], SCHEMA), batch, target, buckets=1)
    found = sorted((r["job_id"], r["title"]) for r in ingest.stored_postings(spark, target).collect())
    assert found == [("1", "0"), ("2", "0"), ("3", "1"), ("4", "2")]
