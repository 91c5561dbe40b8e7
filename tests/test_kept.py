"""R5, R6, R7 and S4/S5 over all kept rows, beyond the budget of R2."""
import pytest
from pyspark.sql import functions as F

from rolloutlens.plans.catalog import ORACLE, QUERIES
from rolloutlens.plans import q_batching as Q  # noqa: I001 - the catalog comes first
from rolloutlens.plans.check import compare, duckdb_conn

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name,times", [("r5_repeat_kept", Q.CFG.rep_num), ("r6_shuffle_kept", Q.CFG.rep_num),
                                        ("r7_shard_kept", 1), ("s4_s5_kept_roundtrip", 1)])
def test_all_kept_rows_take_part(spark, name, times):
    df, n = QUERIES[name](spark, SF), Q._kept(spark, SF).count()
    assert n > Q.CFG.int_num
    assert df.count() == n * times
    assert df.agg(F.min("prompt_idx")).first()[0] < Q.CFG.start_idx
    ok, msg = compare(df, duckdb_conn(SF), ORACLE[name])
    assert ok, msg
