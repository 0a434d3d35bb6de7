"""Column types of the tables."""

from pyspark.sql.types import StringType, StructField, StructType

from vacantia.rules import ARCHIVE_POSTING_FIELDS, POSTING_FIELDS


def text_schema(*names: str) -> StructType:
    return StructType([StructField(name, StringType()) for name in names])


POSTING = text_schema(*POSTING_FIELDS)
ARCHIVE_POSTING = text_schema(*ARCHIVE_POSTING_FIELDS)
CAPTURE = text_schema("timestamp", "original_url", "wayback_url")
