"""Every query against its SQL twin on the smallest tables."""

import pytest

from evidara import plans
from tests.conftest import SMALL


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query_equals_sql(name, spark, duck, same_rows):
    same_rows(plans.queries()[name](spark, SMALL).toPandas(), duck.sql(plans.oracle_sql()[name]).df())


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
