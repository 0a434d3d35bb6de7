"""Every registered query against its SQL at the smallest scale."""

import pytest
from compare import compare
from conftest import FOLDER

from vacantia.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, engine, name):
    status, _, notes = compare(spark, engine, name, FOLDER)
    assert status.startswith(("same", "rows only")), notes


def test_only_known_queries_lack_a_check():
    assert set(QUERIES) - set(ORACLES) == {"lr_domain", "lr_eval"}


def test_entry(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).count() > 0


def test_classifiers_beat_the_largest_label(spark):
    """The check has exact numbers for Naive Bayes; the regression must do about as well."""
    for name in ("nb_eval", "lr_eval"):
        rows = {r["language"]: r for r in QUERIES[name](spark, FOLDER).collect()}
        assert rows["all"]["sample_size"] == sum(r["sample_size"] for k, r in rows.items() if k != "all")
        assert 0 < rows["all"]["accuracy"] <= 1
    largest = 0.25  # labels of the test corpus are drawn evenly
    assert rows["all"]["accuracy"] >= largest - 0.1


def test_every_posting_is_labelled(spark):
    from vacantia.plans.fixtures import Inputs
    assert QUERIES["lr_domain"](spark, FOLDER).count() == Inputs(spark, FOLDER).postings().count()
