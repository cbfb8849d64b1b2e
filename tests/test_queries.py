import pytest
from compare import connect, differences

from __spark_entry__ import entry, oracle_sql, queries
from tabloom.plans.catalog import build_catalog

# The corpus queries have tests of their own.
NAMES = sorted(name for name in build_catalog().checks)


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, sf_dir, con, name):
    assert differences(queries()[name](spark, sf_dir), con, oracle_sql()[name]) == []


def test_every_check_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_flagship_scores_the_holdout(spark):
    scored = entry(spark)
    assert scored.columns == ["row_id", "target", "prediction"] and scored.count() > 0
