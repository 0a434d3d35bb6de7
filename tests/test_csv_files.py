"""CSV read in byte ranges, against the standard library's reader."""

import csv
import io
import random

import pytest
from conftest import FOLDER  # noqa: F401

from vacantia.schema import text_schema
from vacantia.sources import csv_files

NAMES = ("a", "b", "c")


def write(path, rows, ending="\n", header=NAMES):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=ending)
    writer.writerow(header)
    writer.writerows(rows)
    path.write_bytes(out.getvalue().encode())


def random_rows(rng, n):
    pieces = ["x", "yy", ",", '"', "\n", "\n\n", "é", "梦", " ", '""', "'", "long " * 9]
    return [["".join(rng.choices(pieces, k=rng.randrange(0, 7))) or f"v{i}" for _ in NAMES] for i in range(n)]


def cells(rows):
    return sorted(tuple(x for x in r) for r in rows)


@pytest.fixture
def small_ranges(spark):
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")

    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    yield use
    spark.conf.set("spark.sql.files.maxPartitionBytes", kept[0])
    spark.conf.set("spark.sql.files.openCostInBytes", kept[1])


@pytest.mark.parametrize("size, ending", [(37, "\n"), (200, "\n"), (150, "\r\n"), (10_000_000, "\n")])
def test_ranges_cut_anywhere(spark, tmp_path, small_ranges, size, ending):
    rng = random.Random(size)
    wanted = []
    for name in ("one.csv", "two.csv"):
        rows = random_rows(rng, 60)
        write(tmp_path / name, rows, ending)
        wanted += rows
    (tmp_path / "empty.csv").write_bytes(b"")
    small_ranges(size)
    found = csv_files.read_ranges(spark, str(tmp_path), text_schema(*NAMES))
    assert cells([r[n] for n in NAMES] for r in found.collect()) == cells(wanted)
    if size < 1000:
        tasks = spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions()
        assert tasks > 20


def test_one_record_over_many_ranges(spark, tmp_path, small_ranges):
    rows = [["a", "line\n" * 300 + '"end"', "b"], ["c", "d", "e"]]
    write(tmp_path / "x.csv", rows)
    small_ranges(50)
    found = csv_files.read_ranges(spark, str(tmp_path), text_schema(*NAMES)).collect()
    assert cells([r[n] for n in NAMES] for r in found) == cells(rows)


def test_missing_values_and_types(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b\n1,NA\n2,\n,"z"\n\n')
    found = csv_files.read_ranges(spark, str(tmp_path), text_schema("a", "b"))
    assert cells(((r["a"] or "-"), (r["b"] or "-")) for r in found.collect()) == [("-", "z"), ("1", "-"), ("2", "-")]


def test_headers_of_several_layouts_and_bad_records(spark, tmp_path):
    (tmp_path / "one.csv").write_text('id,Description\n1,"a, b"\n2,too,many\n3\n4,"x ""y"""\n')
    (tmp_path / "two.csv").write_text('"Description","id"\r\n"p\nq",5\r\n')
    (tmp_path / "three.csv").write_text("id,title\n6,t\n")
    (tmp_path / "four.csv").write_text("")
    (tmp_path / "five.csv").write_text('id,Description\n7,"open\n8,x\n')
    rows = csv_files.by_header(spark, str(tmp_path), ("id", "Description"))
    good = sorted((r["id"], r["Description"]) for r in rows.collect() if not r["bad"])
    assert good == [("1", "a, b"), ("4", 'x "y"'), ("5", "p\nq"), ("6", None)]
    names = ["one.csv", "four.csv", "six.csv"]
    report = {r["name"]: tuple(r)[1:] for r in csv_files.file_report(spark, str(tmp_path), rows, names).collect()}
    assert report == {"one.csv": ("partly read", 4, 2), "two.csv": ("read", 1, 0), "three.csv": ("no description", 1, 0),
                      "four.csv": ("empty", 0, 0), "six.csv": ("empty", 0, 0), "five.csv": ("partly read", 1, 1)}


def test_no_files_with_content(spark, tmp_path):
    (tmp_path / "x.csv").write_text("")
    assert csv_files.read_ranges(spark, str(tmp_path), text_schema("a")).count() == 0
    assert csv_files.by_header(spark, str(tmp_path), ("a",)).count() == 0
