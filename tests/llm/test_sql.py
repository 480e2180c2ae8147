"""Operators that SQL can express, against their SQL on the small tables."""

import pytest
from conftest import DATA, rows

from terravane.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    want = duck.execute(registry.ORACLES[name]).df()
    assert rows(got) == rows(want[list(got.columns)])
