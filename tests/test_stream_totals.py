"""ST2 inside the stream: the vote of a group, restarts, late rows, equality with the batch metrics."""
import random

import pytest

from rolloutlens.operators import groups as G
from rolloutlens.plans.scoring import group_report, score, scored_table
from rolloutlens.streaming import metrics as RM

from .test_streaming_state import CFG, SCHEMA, deliver, folders, row


def batch_metrics(spark, rows):
    sc = scored_table(score(spark.createDataFrame(rows, SCHEMA).drop("arrival_ts")))
    return G.run_metrics(sc, group_report(sc)).first()


def same(got, want):
    for c in ("acc_ave", "acc_major", "length", "reward"):
        assert got[c] == pytest.approx(want[c], abs=1e-12), c
    assert (got["n_groups"], got["n_rows"]) == (want["n_groups"], want["n_rows"])


ANSWERS = [r"\boxed{1}", r"\boxed{0.5}", r"\boxed{\frac{1}{2}}", r"\boxed{x}", "no answer", r"\boxed{2/4}", r"\boxed{1.0}"]


def test_votes_equal_the_native_ones(spark):
    rng = random.Random(5)
    rows = [(p, g, r"\boxed{1}" if p % 4 else "no label", rng.choice(ANSWERS[:rng.randint(1, 7)])) for p in range(60) for g in range(6)]
    sc = scored_table(score(spark.createDataFrame(rows, "prompt_idx long, gen_idx int, gold string, content string")))
    want = {r["prompt_idx"]: r["majority"] for r in G.majority_run(sc).collect()}
    held = {}
    for r in sorted(sc.collect()):
        a = r["ans"]
        held.setdefault(r["prompt_idx"], []).append({"acc": r["acc"], "canon": a["canon"], "no_gold": r["gold_ans"]["canon"] is None,
                                                     "num": None if a["num"] is None else str(a["num"]), "den": None if a["den"] is None else str(a["den"])})
    assert {p: RM.majority(rs) for p, rs in held.items()} == want and set(want.values()) == {0.0, 1.0}


def test_totals_after_every_restart_equal_the_batch(spark):
    src, sink, ckpt = folders(spark)
    rng = random.Random(3)
    rows = [row(p, g, rng.randint(0, 300), rng.choice(ANSWERS)) for p in range(14) for g in range(4)]
    rng.shuffle(rows)
    seen = []
    for k in range(0, len(rows), 28):
        deliver(spark, src, rows[k:k + 28] + rows[max(0, k - 6):k])  # some come twice
        RM.start_running_metrics(spark, src, sink, ckpt, CFG, max_files_per_trigger=1, state_partitions=2).awaitTermination()
        seen += rows[k:k + 28]
        done = {p for p in range(14) if sum(r[0] == p for r in seen) == 4}
        if done:
            same(RM.running_metrics(spark, sink).first(), batch_metrics(spark, [r for r in seen if r[0] in done]))
    assert len(done) == 14


def test_late_rows_and_timed_out_groups_do_not_count(spark):
    src, sink, ckpt = folders(spark)
    full = [row(p, g, 60 * p + g) for p in range(1, 5) for g in range(4)]
    deliver(spark, src, [row(0, g, g) for g in range(3)])
    for p in range(1, 5):
        deliver(spark, src, [r for r in full if r[0] == p])
    deliver(spark, src, [row(0, 3, 3)])  # completes prompt 0 only after the watermark has passed it
    RM.start_running_metrics(spark, src, sink, ckpt, CFG, max_files_per_trigger=1, watermark="10 minutes", timeout_ms=600_000,
                             state_partitions=2).awaitTermination()
    same(RM.running_metrics(spark, sink).first(), batch_metrics(spark, full))
