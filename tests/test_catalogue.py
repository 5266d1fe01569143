"""Every registered query of the core against its SQL in another engine."""

import pytest

from rangeflow.plans import catalogue
from tests.conftest import DATA


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_rows_as_sql(name, spark, duck, same):
    got, want = catalogue.QUERIES[name](spark, DATA).toPandas(), duck.execute(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert same(got, want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_rows_only(name, spark):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


def test_entry_without_the_optional_part():
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
