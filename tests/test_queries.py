"""Every registered query of the engine against its SQL counterpart on the smallest tables."""

import pytest

from showerloom.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_sql(spark, small, duck, same, name):
    same(catalog.queries()[name](spark, small), duck, catalog.oracle_sql()[name])


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 1
