"""Every registered query of the reference operators against its SQL on the smallest tables."""

import pytest

from wayline.plans import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(name, spark, sf_dir, same_rows):
    same_rows(registry.QUERIES[name](spark, sf_dir), registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL) - {"typo_clusters"}))
def test_runs_without_sql(name, spark, sf_dir):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["src", "dst", "weight", "rr", "suppressed"]
    assert set(e.oracle_sql()) <= set(e.queries())
