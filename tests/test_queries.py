"""Every query against its SQL on the smallest tables; those without SQL must have rows and finite numbers."""

import numpy as np
import pytest

from tessera.plans import catalogue
from tests.harness import assert_same, connection

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir), SQL[name], connection(sf_dir))


# Studies whose invariants are tested in test_models.py on small inputs run here no more than once.
SLOW = {"robustness_grid", "population_summary", "gender_gap", "pension_bootstrap", "glidepath_search", "market_scenarios"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_runs(spark, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir).toPandas()
    assert len(frame)
    numbers = frame.select_dtypes("number").to_numpy(float)
    assert not np.isnan(numbers).any()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
