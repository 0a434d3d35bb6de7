import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))

from vacantia.plans.fixtures import TABLES, Inputs  # noqa: E402
from vacantia.session import local_session  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session("4", memory="6g", app="tests")


@pytest.fixture(scope="session")
def data(spark):
    return Inputs(spark, FOLDER)


@pytest.fixture(scope="session")
def engine():
    engine = duckdb.connect()
    for table in TABLES:
        engine.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return engine


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate a function of text columns on hand-made rows."""
    def run(make, *rows):
        from pyspark.sql import functions as F
        width = len(rows[0]) if isinstance(rows[0], tuple) else 1
        names = [f"c{i}" for i in range(width)]
        table = [(i, *(r if width > 1 else (r if isinstance(r, tuple) else (r,)))) for i, r in enumerate(rows)]
        schema = "i int, " + ", ".join(f"{n} string" for n in names)
        out = spark.createDataFrame(table, schema).select("i", make(*map(F.col, names)).alias("v"))
        return [r["v"] for r in sorted(out.collect(), key=lambda r: r["i"])]
    return run
