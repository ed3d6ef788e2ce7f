"""Each registered query of the engine against its SQL."""

from __future__ import annotations

import pytest
from conftest import SF
from oracle import same

from isogrid.plans.queries import ORACLES, QUERIES


def test_all_have_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    same(QUERIES[name](spark, SF), ORACLES[name], SF)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["row", "col", "value", "n"]
    assert set(e.oracle_sql()) <= set(e.queries())
