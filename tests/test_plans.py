"""Plan checks: native operators stay in the JVM, filters and column
pruning reach the scan, big tables are never forced into a broadcast."""
import pytest

from rolloutlens.plans.catalog import QUERIES

from .conftest import SF_SMALL

PYTHON_OK = {"x1_user_reward", "st1_streaming_buffer"}  # the user-UDF path and the stateful stream


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - PYTHON_OK - {"st2_running_metrics"}))
def test_no_python_in_native_queries(spark, name):
    plan = _plan(QUERIES[name](spark, SF_SMALL))
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_user_reward_uses_arrow(spark):
    assert "ArrowEvalPython" in _plan(QUERIES["x1_user_reward"](spark, SF_SMALL))


def test_scan_prunes_columns(spark):
    plan = _plan(QUERIES["a4_format_reward"](spark, SF_SMALL))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_beta_zero_skips_reference_join(spark):
    from rolloutlens.operators import token_loss as TL
    from rolloutlens.sources import fixtures as FX
    with_ref = _plan(TL.sequence_terms(FX.sequences(spark, SF_SMALL), beta=0.04))
    no_ref = _plan(TL.sequence_terms(FX.sequences(spark, SF_SMALL, with_ref=False), beta=0.0))
    assert with_ref.count("Join") > no_ref.count("Join")


def _window_partition_specs(plan: str) -> list[str]:
    import re
    return re.findall(r"Window \[.*?\], \[([^\]]*)\], \[", plan)


def test_group_work_has_no_unpartitioned_window(spark):
    """Ordered group work never runs a window over the whole table: every
    Window node has a partition spec (the chunk and batch carries are
    partitioned too)."""
    from rolloutlens.operators import batching as B
    from rolloutlens.plans.catalog import event_scored
    from rolloutlens.plans.q_batching import CFG
    from rolloutlens.plans.scoring import buffer_rows
    plans = {name: _plan(QUERIES[name](spark, SF_SMALL))
             for name in ("g2_majority_vote", "w2_compare_previous", "w4_cumsum_forward")}
    plans["fill_budget"] = _plan(B.fill_budget(buffer_rows(event_scored(spark, SF_SMALL)), CFG))
    for name, plan in plans.items():
        specs = _window_partition_specs(plan)
        assert specs, name
        assert all(s.strip() for s in specs), (name, specs)


def test_run_logs_are_scanned_once(spark, monkeypatch):
    """The text is read by the one plan that makes the table of splits; it
    moves only that table, and all later plans read what is written."""
    from rolloutlens.operators import runlog as RL
    plans = []
    monkeypatch.setattr(RL, "materialize", lambda d, name, f=RL.materialize: plans.append(_plan(d)) or f(d, name))
    for name in ("l1_train_points", "l2_l3_test_points", "l4_l5_metric_series", "w3_rolling_mean"):
        plans.clear()
        plans.append(_plan(QUERIES[name](spark, SF_SMALL)))
        made = [p for p in plans if "FileScan text" in p]
        assert len(made) == 1 and made[0].count("FileScan text") == 1 and made[0].count("Exchange") == 1, name
        assert sum(p.count("Exchange") for p in plans) <= 12, name
