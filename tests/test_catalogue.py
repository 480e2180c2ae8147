"""Every query of the library against its SQL; those without SQL run and give rows."""

import pytest
from conftest import DATA, rows

from terravane.plans import catalogue

#: Whose SQL takes long, and is compared at the larger size only.
SLOW = {"g27_pit_filling", "q15_pits", "r10_hysteresis", "g03_merge_nodes"}


@pytest.mark.parametrize("name", sorted(set(catalogue.ORACLES) - SLOW))
def test_against_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA).toPandas()
    want = duck.execute(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, duck, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


def test_entry_without_training_operators():
    import __spark_entry__

    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
