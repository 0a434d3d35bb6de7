"""Tables that are rewritten while others read and write them: versions with a log.

A table is a folder: data in folders of their own under ``data``, never changed once written, and a
log of numbered entries under ``log``.  An entry says which data folders make up that version.  It
is written aside and renamed to its number, which fails if the number is taken: of two writers that
start from one version only the first gets the next number, the other reads again and does its
change on top (``update``), or is told (``Conflict``).  Data without an entry, as a writer that
died leaves it, is never seen; ``vacuum`` removes it, and versions no reader needs any more.

A table may be kept in buckets by a hash of its key.  A change then reads and writes only the
buckets its keys fall into; the others' folders are taken over from the version before.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ATTEMPTS = 20
BUCKETS = 256
WEEK = 7 * 24 * 3600


class Conflict(RuntimeError):
    """Another writer has committed a version since the one that was read."""


class Folder:
    """The few file operations that data sources do not offer, in any file system Spark can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.files = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.hadoop.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> dict[str, int]:
        """What lies in a folder, with the time of its last change in seconds."""
        at = self.path(folder)
        if not self.files.exists(at):
            return {}
        return {s.getPath().getName(): s.getModificationTime() / 1000 for s in self.files.listStatus(at)}

    def text(self, name: str) -> str:
        stream = self.files.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Create a file whole or not at all; false if there is one."""
        aside = f"aside/{uuid.uuid4().hex}"
        stream = self.files.create(self.path(aside), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        self.files.mkdirs(self.path(name).getParent())
        context = self.hadoop.FileContext.getFileContext(self.path("").toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self.hadoop.Options.Rename, 0)
        try:
            context.rename(self.path(aside), self.path(name), none)
        except Py4JJavaError as error:
            self.files.delete(self.path(aside), False)
            if error.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                return False
            raise
        return True

    def remove(self, name: str) -> None:
        self.files.delete(self.path(name), True)


def latest(folder: Folder) -> tuple[int, dict]:
    """The number and entry of the newest version; 0 and no parts before the first."""
    numbers = [int(name) for name in folder.names("log") if name.isdigit()]
    if not numbers:
        return 0, {"parts": {}}
    return max(numbers), json.loads(folder.text(f"log/{max(numbers):020d}"))


def commit(folder: Folder, base: int, entry: dict) -> int:
    """Make ``entry`` the version after ``base``."""
    if not folder.create(f"log/{base + 1:020d}", json.dumps(entry)):
        raise Conflict(f"version {base + 1} of {folder.root} is taken")
    return base + 1


# --- whole tables ------------------------------------------------------------------

def write_version(table: DataFrame, root: str, base: int | None = None) -> int:
    """Add a whole new version; its number.  ``base`` is the version it was made from; without one
    it replaces whatever is newest when it is done."""
    folder = Folder(table.sparkSession, root)
    part = uuid.uuid4().hex
    table.write.parquet(f"{folder.root}/data/{part}")
    for _ in range(ATTEMPTS):
        try:
            return commit(folder, latest(folder)[0] if base is None else base, {"parts": {"": part}})
        except Conflict:
            if base is not None:
                raise
    raise Conflict(f"{folder.root} is being written by too many")


def read_version(spark: SparkSession, root: str, schema: StructType | str, buckets: Sequence[int] | None = None) -> tuple[int, DataFrame]:
    """The newest version with its number; of a table in buckets, those asked for."""
    folder = Folder(spark, root)
    number, entry = latest(folder)
    wanted = entry["parts"] if buckets is None else {b: entry["parts"][b] for b in map(str, buckets) if b in entry["parts"]}
    paths = [f"{folder.root}/data/{part}" + (f"/bucket={bucket}" if bucket else "") for bucket, part in wanted.items()]
    return number, spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def update(spark: SparkSession, root: str, schema: StructType | str, change: Callable[[DataFrame], DataFrame]) -> int:
    """A version made of the newest one; done again on top of another writer's, if that was first."""
    for _ in range(ATTEMPTS):
        number, table = read_version(spark, root, schema)
        try:
            return write_version(change(table), root, number)
        except Conflict:
            continue
    raise Conflict(f"{root} is being written by too many")


# --- tables in buckets --------------------------------------------------------------

def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def upsert(rows: DataFrame, root: str, key: str, merge: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS) -> int:
    """Merge rows into a table in buckets by ``key``: ``merge`` makes the new content of the buckets
    that the rows fall into from their old content and the rows, all of the rows' columns.

    ``rows`` should be a stored table: its buckets are looked up first, and a lost race does the
    merge again.
    """
    spark, schema = rows.sparkSession, rows.schema
    folder = Folder(spark, root)
    touched = sorted(r[0] for r in rows.select(bucket_of(F.col(key), buckets)).distinct().collect())  # at most ``buckets``
    for _ in range(ATTEMPTS):
        number, entry = latest(folder)
        if entry.get("buckets", buckets) != buckets:
            raise ValueError(f"{root} is kept in {entry['buckets']} buckets")
        if not touched:
            return number
        old = read_version(spark, root, schema, touched)[1]
        part = uuid.uuid4().hex
        merged = merge(old.unionByName(rows)).withColumn("bucket", bucket_of(F.col(key), buckets))
        merged.repartition("bucket").write.partitionBy("bucket").parquet(f"{folder.root}/data/{part}")
        try:
            return commit(folder, number, {"buckets": buckets, "parts": {**entry["parts"], **{str(b): part for b in touched}}})
        except Conflict:
            continue
    raise Conflict(f"{root} is being written by too many")


def vacuum(spark: SparkSession, root: str, keep: int = 2, age: float = WEEK) -> list[str]:
    """Remove entries but the newest ``keep`` and data that none of these names and that is older
    than ``age`` seconds, which must be longer than any writer or reader takes; what was removed."""
    import time
    folder = Folder(spark, root)
    entries = sorted(name for name in folder.names("log") if name.isdigit())
    kept, old = entries[-keep:], entries[:-keep]
    named = {part for name in kept for part in json.loads(folder.text(f"log/{name}"))["parts"].values()}
    before = time.time() - age
    gone = [f"log/{name}" for name in old]
    for place in ("data", "aside"):
        gone += [f"{place}/{name}" for name, changed in folder.names(place).items() if name not in named and changed < before]
    for name in gone:
        folder.remove(name)
    return gone
