"""Run registered queries and their SQL side by side: ``compare.py [folder] [names...]``."""

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from vacantia.plans.fixtures import TABLES  # noqa: E402
from vacantia.plans.queries import ORACLES, QUERIES  # noqa: E402
from vacantia.session import local_session  # noqa: E402


def value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return float(f"{v:.9g}") if isinstance(v, float) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(value(r[i]) for i in order) for r in data), key=repr)


def compare(spark, engine, name, folder):
    start = time.time()
    out = QUERIES[name](spark, folder)
    found = rows(out.columns, [tuple(r) for r in out.collect()])
    spent = time.time() - start
    if name not in ORACLES:
        return f"rows only ({len(found)})", spent, []
    answer = engine.execute(ORACLES[name])
    columns = [c[0] for c in answer.description]
    wanted = rows(columns, answer.fetchall())
    notes = []
    if sorted(columns) != sorted(out.columns):
        notes.append(f"columns {sorted(out.columns)} != {sorted(columns)}")
    kinds = {c: str(t[1]) for c, t in zip(columns, answer.description)}
    for field in out.schema.fields:
        notes.append(f"  {field.name}: {field.dataType.simpleString()} / {kinds.get(field.name)}")
    if found != wanted:
        notes.insert(0, f"{len(found)} rows, {len(wanted)} wanted")
        a, b = set(map(repr, found)), set(map(repr, wanted))
        notes += ["  got    " + x[:600] for x in sorted(a - b)[:3]] + ["  wanted " + x[:600] for x in sorted(b - a)[:3]]
        return "DIFFERENT", spent, notes
    return f"same ({len(found)})", spent, notes if "columns" in "".join(notes[:1]) else []


def main():
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = local_session("8")
    engine = duckdb.connect()
    for t in TABLES:
        engine.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    bad = 0
    for name in names:
        try:
            status, spent, notes = compare(spark, engine, name, folder)
        except Exception as error:  # show and go on
            status, spent, notes = "ERROR", 0.0, [str(error)[:900]]
        bad += status in ("DIFFERENT", "ERROR")
        print(f"{name:28s} {status:20s} {spent:6.2f}s", flush=True)
        for note in notes:
            print("   ", note)
    print("bad:", bad)


if __name__ == "__main__":
    main()
