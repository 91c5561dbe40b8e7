"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is run to completion through the ``noop`` sink (every column is
computed, nothing is collected). A first pass over all queries warms the JVM
and compiles the generated code; the second pass is timed (steady state).
The first pass's total is reported as ``cold_value``. Before both, the tables
are rewritten as one file per core, untimed: the given files hold a single row
group each, which no engine can split, while a real data set has many files.
Prints one JSON line:
{"metric": "total_query_seconds", "value": N, "unit": "sec", "queries": {...}, "sf": ...}
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    # text rewards on rollouts derived from documents
    "a4_format_reward", "a13_weighted_reward", "a7_length_reward", "a8_cosine_reward",
    "a9_repetition_documents",
    # group work on rollouts derived from events (8 per prompt)
    "w1_group_advantage", "f2_positive_advantage", "g2_majority_vote", "g4_run_metrics",
    # skew-safe ordered and unordered group statistics on lineitem
    "w5_zscore_ragged",
    # token arrays on embeddings
    "t4_log_softmax_gather", "t10_sequence_loss", "t12_clip_ratio",
    # budget fill and buffer
    "r2_fill_budget",
    # whole-text stutter removal, run logs line by line, cumulative metrics, one streamed collection
    "p8_remove_stutter", "l1_train_points", "w3_rolling_mean", "g6_cumulative_metrics", "st1_streaming_buffer",
]


def staged(spark, sf_dir: str, files: int) -> str:
    """The tables as ``files`` files each."""
    from rolloutlens.session import scratch_path
    out = scratch_path(spark, "bench-tables")
    for t in ("documents", "events", "lineitem", "embeddings", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").repartition(files).write.parquet(f"{out}/{t}.parquet")
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from rolloutlens.plans.catalog import QUERIES
    from rolloutlens.session import drop_scratch, local_session

    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2 if cpus.isdigit() else 16)
    names = [n for n in HEADLINE if n in QUERIES]
    data = staged(spark, sf_dir, int(cpus) if cpus.isdigit() else 8)

    def run_all() -> dict:
        out = {}
        for name in names:
            t = time.time()
            QUERIES[name](spark, data).write.format("noop").mode("overwrite").save()
            out[name] = round(time.time() - t, 3)
        return out

    cold = run_all()
    times = run_all()
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "cold_value": round(sum(cold.values()), 3),
                      "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus}))
    drop_scratch(spark)
    spark.stop()


if __name__ == "__main__":
    main()
