"""Every registered query with an oracle equals its DuckDB statement."""
import pytest

from rolloutlens.plans.catalog import ORACLE, QUERIES
from rolloutlens.plans.check import compare

from .conftest import SF_ORACLE


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    ok, msg = compare(QUERIES[name](spark, SF_ORACLE), duck, ORACLE[name])
    assert ok, msg


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_oracle_runs(spark, name):
    df = QUERIES[name](spark, SF_ORACLE)
    assert df.count() >= 0
