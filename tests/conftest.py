import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = os.environ.get("ROLLOUTLENS_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from rolloutlens.session import local_session
    s = local_session("*", shuffle_partitions=8)
    # a query whose generated code fails to compile must fail the tests, not
    # fall back silently to interpreted evaluation
    s.conf.set("spark.sql.codegen.fallback", "false")
    yield s
    from rolloutlens.session import drop_scratch
    drop_scratch(s)
    s.stop()


@pytest.fixture(scope="session")
def duck():
    from rolloutlens.plans.check import duckdb_conn
    return duckdb_conn(SF_ORACLE)
