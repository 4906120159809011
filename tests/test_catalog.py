"""Every registered query with SQL gives the same rows in the other engine."""

import pytest
from comparing import rows_of

from lociq import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, duck, sf_dir, name):
    ours, theirs = catalog.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    assert rows_of(ours) == rows_of(theirs)


@pytest.mark.parametrize("name", ["gt_filter_flags", "seq_error_status", "spatial_filter", "range_detect"])
def test_is_not_vacuous(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 50


def test_entry_is_importable_and_complete():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
