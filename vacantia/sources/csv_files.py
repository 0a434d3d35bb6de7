"""CSV files with line breaks inside fields, read in byte ranges, and a report of what was read.

A line break ends a record only outside quotes, so a range of a file can be cut into records once
it is known whether it begins inside quotes.  The quotes of a range are counted in one pass, the
prefix sum of the ranges' parities says how each begins (one row per range), and a second pass cuts
the lines.  Lines that are a record of their own, nearly all, stay where they are read; only those
of records with line breaks are gathered, by record, also across ranges.  A file of any size is
read by as many tasks as it has ranges.

The dialect is that of the collectors: commas, quotes doubled inside quoted fields, UTF-8, lines
ending in ``\\n`` or ``\\r\\n``, a header in each file.  A quote that is never closed takes the lines
up to the next one with it, as it does in any reader.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from vacantia.functions.text import file_name
from vacantia.sources.tables import missing_to_null, stored

QUOTING = {"quote": '"', "escape": '"'}
FEW_RANGES = 200_000
LINE = "file string, block long, line long, odd boolean, outside boolean, start_out long, start_in long, value string"
RANGE = "file string, block long, odd boolean, start_out long, start_in long"


def runs(files: pa.Array, blocks: np.ndarray) -> Iterator[tuple[int, int]]:
    """Rows of one range of one file after the other."""
    n = len(blocks)
    change = blocks[1:] != blocks[:-1]
    if n > 1:
        change |= pc.not_equal(files[1:], files[:-1]).to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(change) + 1).tolist(), n]
    return zip(cuts, cuts[1:])


def numbered_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with their number in the range, whether they have an odd number of quotes, whether
    they begin outside quotes if the range does, and the line at which the record they belong to
    begins, if the range begins outside or inside quotes (-1: in an earlier range)."""
    key, line, parity, start_out, start_in = None, 0, 0, -1, -1
    for batch in batches:
        if not batch.num_rows:
            continue
        files, blocks, values = batch.column("file"), batch.column("block").to_numpy(), batch.column("value")
        odd = pc.count_substring(values, '"').to_numpy(zero_copy_only=False) & 1
        for lo, hi in runs(files, blocks):
            here = files[lo].as_py(), int(blocks[lo])
            if here != key:
                key, line, parity, start_out, start_in = here, 0, 0, -1, -1
            quotes = parity + np.concatenate([[0], np.cumsum(odd[lo:hi])])
            inside = quotes[:-1] & 1
            numbers = np.arange(line, line + hi - lo)
            from_out = np.maximum(np.maximum.accumulate(np.where(inside == 0, numbers, -1)), start_out)
            from_in = np.maximum(np.maximum.accumulate(np.where(inside == 1, numbers, -1)), start_in)
            yield pa.RecordBatch.from_arrays(
                [files[lo:hi], batch.column("block")[lo:hi], pa.array(numbers), pa.array(odd[lo:hi] == 1), pa.array(inside == 0),
                 pa.array(from_out), pa.array(from_in), values[lo:hi]],
                names=["file", "block", "line", "odd", "outside", "start_out", "start_in", "value"])
            line, parity, start_out, start_in = line + hi - lo, int(quotes[-1]), int(from_out[-1]), int(from_in[-1])


def measured_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each range's last line: parity of the whole range, and its last beginnings of a record."""
    key, last = None, None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, *last)], names=["file", "block", "odd", "start_out", "start_in"])

    for batch in numbered_lines(batches):
        here = batch.column("file")[0].as_py(), batch.column("block")[0].as_py()
        if key is not None and here != key:
            yield row()
        n = batch.num_rows - 1
        key = here
        last = (batch.column("odd")[n].as_py() == batch.column("outside")[n].as_py(), batch.column("start_out")[n].as_py(),
                batch.column("start_in")[n].as_py())
    if key is not None:
        yield row()


def records(spark: SparkSession, path) -> DataFrame:
    """``(file, block, line, record)``: the text of every record, header included, and its place.
    A file's header is the record at block 0 and line 0."""
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    ranges = raw.mapInArrow(measured_ranges, RANGE)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range.
    begins = ranges.withColumn("inside", F.coalesce(F.sum(F.col("odd").cast("int")).over(before), F.lit(0)) % 2 == 1)
    own = F.when(F.col("inside"), F.col("start_in")).otherwise(F.col("start_out"))
    opened = F.last(F.when(own >= 0, F.struct("block", own.alias("line"))), ignorenulls=True).over(before)
    begins = begins.withColumn("open", opened).select("file", "block", "inside", "open")
    begins = begins if begins.limit(FEW_RANGES + 1).count() > FEW_RANGES else F.broadcast(begins)

    lines = raw.mapInArrow(numbered_lines, LINE).join(begins, ["file", "block"])
    start = F.when(F.col("inside"), F.col("start_in")).otherwise(F.col("start_out"))
    alone = (F.col("outside") != F.col("inside")) & ~F.col("odd")
    lines = lines.select("file", "block", "line", "value", alone.alias("alone"), F.when(
        start >= 0, F.struct("block", start.alias("line"))).otherwise(F.col("open")).alias("first"))
    whole = lines.filter("alone").select("file", "block", "line", F.col("value").alias("record"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("block", "line", "value"))), lambda x: x["value"])
    gathered = (lines.filter("not alone").groupBy("file", "first").agg(F.array_join(texts, "\n").alias("record"))
                .select("file", "first.block", "first.line", "record"))
    cut = whole.unionByName(gathered).withColumn("record", F.regexp_replace("record", r"\r$", ""))
    return cut.filter("record != ''")


def is_header() -> Column:
    return (F.col("block") == 0) & (F.col("line") == 0)


def read_ranges(spark: SparkSession, path, schema: StructType) -> DataFrame:
    """The records of all files by position, ``schema`` naming the columns, and ``file``; texts that
    stand for a missing value become null."""
    layout = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    found = records(spark, path).filter(~is_header()).select(F.from_csv("record", layout, QUOTING).alias("r"), "file")
    return found.select(*[(missing_to_null(F.col(f"r.`{f.name}`")) if f.dataType == StringType() else F.col(f"r.`{f.name}`")).alias(f.name)
                          for f in schema.fields], "file")


# --- by header, with a report ----------------------------------------------------------

def n_fields(record: Column) -> Column:
    """Fields of a record; null if a quote is not closed or stands inside an unquoted field."""
    bare = F.regexp_replace(record, '(^|,)"([^"]|"")*+"(?=,|$)', "$1")
    return F.when(~F.contains(bare, F.lit('"')), F.regexp_count(bare, F.lit(",")) + 1)


def headers(spark: SparkSession, path) -> DataFrame:
    """``(file, header)``: the names in each file's first line, which hold neither commas nor line
    breaks; a file without any bytes has none."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"), "value")
    first = lines.filter("block = 0").groupBy("file").agg(F.min_by("value", "place").alias("value"))
    return first.select("file", F.transform(F.split("value", ","), lambda x: F.regexp_replace(x, '^"|"?\r?$', "")).alias("header"))


def by_header(spark: SparkSession, path, names: Sequence[str]) -> DataFrame:
    """Records by their file's own header: ``names`` as texts, null where the header lacks one,
    with ``file`` and ``bad``: another number of fields than the header has, or quotes that do not
    close.  Headers may differ in columns and in order."""
    known = stored(headers(spark, path), "csv-headers")
    widest = known.agg(F.max(F.size("header"))).first()[0] or 1
    layout = ", ".join(f"c{i} string" for i in range(widest))
    rows = records(spark, path).filter(~is_header()).join(known, "file").select(
        "file", "header", F.coalesce(n_fields(F.col("record")) != F.size("header"), F.lit(True)).alias("bad"),
        F.from_csv("record", layout, QUOTING).alias("r"))
    fields = F.array(*[f"r.c{i}" for i in range(widest)])
    return rows.select("file", "bad", *[F.get(fields, F.array_position("header", F.lit(n)).cast("int") - 1).alias(n) for n in names])


def file_report(spark: SparkSession, path, rows: DataFrame, expected: Sequence[str], name: Callable[[Column], Column] = file_name,
                required: str = "description") -> DataFrame:
    """``(name, status, n_records, n_bad)`` of the files behind ``path``, ``rows`` being what
    ``by_header`` made of them: ``read``, ``partly read`` (some records are bad), ``no <required>``
    (a file without a column whose name holds that) or ``empty`` (expected, but without a line:
    readers do not list files without bytes).  Files of equal name count together."""
    counts = rows.groupBy(name(F.col("file")).alias("name")).agg(F.count("*").alias("n_records"), F.count_if("bad").alias("n_bad"))
    named = F.exists("header", lambda column: F.contains(F.lower(column), F.lit(required)))
    known = headers(spark, path).groupBy(name(F.col("file")).alias("name")).agg(F.bool_and(named).alias("usable"))
    asked = spark.createDataFrame([(x,) for x in expected], "name string")
    every = asked.join(known, "name", "full").join(counts, "name", "left").na.fill(0, ["n_records", "n_bad"])
    status = (F.when(F.col("usable").isNull(), "empty").when(~F.col("usable"), f"no {required}")
              .when(F.col("n_bad") > 0, "partly read").otherwise("read"))
    return every.select("name", status.alias("status"), "n_records", "n_bad")
