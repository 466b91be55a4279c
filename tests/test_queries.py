"""Every registered query of the reference's operators against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest
from compare import assert_same

from tessera.plans.catalog import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, duck, name):
    assert_same(QUERIES[name](spark, sf_dir), duck.execute(ORACLE_SQL[name]))


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())
