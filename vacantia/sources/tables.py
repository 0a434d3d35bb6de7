"""Readers and writers: CSV interchange, taxonomy, file inventory, stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from vacantia import rules
from vacantia.functions.text import file_name
from vacantia.functions.urls import capture_url
from vacantia.session import shared_path

# Quotes are doubled, fields may hold line breaks.
CSV_DIALECT = {"header": "true", "quote": '"', "escape": '"', "encoding": "UTF-8"}


def missing_to_null(column: Column) -> Column:
    """Texts a CSV reader takes for a missing value become null."""
    return F.when(~column.isin(*rules.NA_TEXTS), column)


def read_csv(spark: SparkSession, path, schema: StructType, multi_line: bool = False) -> DataFrame:
    """CSV files with a header and an explicit schema.

    Collectors' files hold no line breaks within fields (their texts are collapsed), so files are
    split.  A file with line breaks inside fields cannot be: ``multi_line`` reads each file in
    one task.
    """
    table = (spark.read.schema(schema).options(**CSV_DIALECT).option("multiLine", str(multi_line).lower())
             .csv(path))
    return table.select(*[
        missing_to_null(F.col(f.name)).alias(f.name) if f.dataType == StringType() else F.col(f.name)
        for f in schema.fields])


def read_board_files(spark: SparkSession, pattern: str, schema: StructType, exclude: str = "MASTER",
                     multi_line: bool = False) -> DataFrame:
    """Files matching a glob, with ``file_name``; names holding ``exclude`` are left out."""
    table = (spark.read.schema(schema).options(**CSV_DIALECT).option("multiLine", str(multi_line).lower())
             .csv(pattern).withColumn("file_name", file_name(F.col("_metadata.file_path"))))
    cleaned = [missing_to_null(F.col(f.name)).alias(f.name) for f in schema.fields]
    return table.filter(~F.col("file_name").contains(exclude)).select(*cleaned, "file_name")


def write_csv(table: DataFrame, path: str, mode: str = "error") -> None:
    (table.write.mode(mode).options(**CSV_DIALECT)
     .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
     .option("nullValue", "").option("emptyValue", "").csv(path))


def write_by(table: DataFrame, path: str, *keys: str, mode: str = "error") -> None:
    """Parquet partitioned by ``keys``.  Rebalancing splits a key that holds much of the rows."""
    table.hint("rebalance", *keys).write.mode(mode).partitionBy(*keys).parquet(path)


def write_sorted(table: DataFrame, path: str, *order: str, mode: str = "error") -> None:
    """A report as CSV files whose rows are sorted through all files."""
    write_csv(table.orderBy(*order), path, mode)


def stored(table: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read back: computed once, known size,
    short lineage, and safe against lost executors."""
    path = shared_path(table.sparkSession, name)
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """``{"data": [{"name", "type": {"name"}}]}`` to ``(position, name, type_name)``."""
    schema = "data array<struct<name string, type struct<name string>>>"
    return (spark.read.schema(schema).option("multiLine", "true").json(path)
            .select(F.posexplode("data").alias("position", "entry"))
            .select("position", F.col("entry.name").alias("name"), F.col("entry.type.name").alias("type_name")))


def file_inventory(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Name and size in MB of each file; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(file_name(F.col("path")).alias("file_name"),
                        (F.col("length") / 1024 / 1024).alias("size_mb"))


def capture_index(rows: DataFrame) -> DataFrame:
    """Index rows ``(timestamp, original_url)`` with the address of the capture."""
    return rows.select("timestamp", "original_url",
                       capture_url(F.col("timestamp"), F.col("original_url")).alias("wayback_url"))


def split_taxonomy(taxonomy: DataFrame) -> DataFrame:
    """Entries tagged ``hard`` or ``soft``; other types are left out."""
    kind = (F.when(F.col("type_name").isin(*rules.HARD_TYPES), "hard")
            .when(F.col("type_name").isin(*rules.SOFT_TYPES), "soft"))
    return taxonomy.withColumn("kind", kind).filter("kind is not null")
