"""Registered queries against their SQL, and the registration itself."""

import pytest
from compare import value
from conftest import FOLDER

from vacantia.llm.queries import ORACLES, QUERIES


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(value(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, engine, name):
    out = QUERIES[name](spark, FOLDER)
    answer = engine.execute(ORACLES[name])
    columns = [c[0] for c in answer.description]
    assert sorted(columns) == sorted(out.columns)
    assert rows(out.columns, [tuple(r) for r in out.collect()]) == rows(columns, answer.fetchall())


def test_one_query_for_each_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14))


def test_entry_has_them():
    import __spark_entry__ as entry
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
