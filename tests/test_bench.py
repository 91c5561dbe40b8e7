"""The bench times the slow kinds of work too, not the quick ones alone."""
import bench
from rolloutlens.plans.catalog import QUERIES


def test_headline_has_run_logs_and_streams():
    assert {"l1_train_points", "w3_rolling_mean", "st1_streaming_buffer", "p8_remove_stutter"} <= set(bench.HEADLINE)
    assert set(bench.HEADLINE) <= set(QUERIES)
