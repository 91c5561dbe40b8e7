"""Chunked ordered helpers equal their whole-group versions at any chunk size."""
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rolloutlens.operators import groups as G
from rolloutlens.operators import ordered as OR
from rolloutlens.plans.catalog import event_scored

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def skewed(spark):
    """One hot key holding most rows, plus many small keys."""
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    return ev.select(F.when(F.col("event_id") < 700, F.lit(0)).otherwise(F.col("event_id") % 37 + 1).alias("k"),
                     F.col("event_id").alias("pos"), F.col("value"))


@pytest.mark.parametrize("chunk", [1, 3, 64, OR.CHUNK])
def test_with_previous(skewed, chunk):
    dense = skewed.withColumn("pos", F.row_number().over(Window.partitionBy("k").orderBy("pos")) - 1)
    want = dense.withColumn("prev_value", F.lag("value").over(Window.partitionBy("k").orderBy("pos")))
    got = OR.with_previous(dense, "k", "pos", ["value"], chunk=chunk)
    cols = ["k", "pos", "prev_value"]
    assert sorted(got.select(cols).collect()) == sorted(want.select(cols).collect())


@pytest.mark.parametrize("chunk", [1, 5, OR.CHUNK])
def test_running_sum_max(skewed, chunk):
    w = Window.partitionBy("k").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    want = skewed.withColumn("s", F.sum("value").over(w)).withColumn("m", F.max("value").over(w))
    got = OR.running_max(OR.running_sum(skewed, "k", "pos", "value", "s", chunk=chunk),
                         "k", "pos", "value", "m", chunk=chunk)
    a = sorted((r.k, r.pos, round(r.s, 6), r.m) for r in got.collect())
    b = sorted((r.k, r.pos, round(r.s, 6), r.m) for r in want.collect())
    assert a == b


def test_global_rank_is_exact(skewed):
    h = skewed.withColumn("h", F.xxhash64("pos", F.lit(7)))
    got = OR.global_rank(h, ["h", "pos"], bits=4).select("pos", "rank")
    want = h.withColumn("rank", F.row_number().over(Window.orderBy("h", "pos")) - 1).select("pos", "rank")
    assert sorted(got.collect()) == sorted(want.collect())


@pytest.mark.parametrize("chunk", [1, 2, 3])
def test_majority_chunk_invariant(spark, chunk):
    sc = event_scored(spark, SF_SMALL)
    a = sorted(G.majority_run(sc, chunk=chunk).collect())
    b = sorted(G.majority_run(sc).collect())
    assert a == b


def majority_model(answers, accs):
    """Longest run of consecutive equal non-null answers; first member's acc."""
    best, best_n, i = None, 0, 0
    while i < len(answers):
        if answers[i] is None:
            i += 1
            continue
        j = i
        while j + 1 < len(answers) and answers[j + 1] is not None and answers[j + 1] == answers[i]:
            j += 1
        if j - i + 1 > best_n:
            best, best_n = accs[i], j - i + 1
        i = j + 1
    return 0.0 if best is None else best


def test_majority_model(spark):
    groups = {0: ["1", "2", "1", "2", "2", "1", "1"], 1: [None, None], 2: ["3", None, "3", "3"],
              3: ["1", "1", "2", "2"], 4: ["5"]}
    gold = {0: "1", 1: "1", 2: "3", 3: "2", 4: "4"}
    rows = []
    for k, ans in groups.items():
        for i, a in enumerate(ans):
            content = rf"\boxed{{{a}}}" if a is not None else "none"
            rows.append((k, i, rf"\boxed{{{gold[k]}}}", content))
    from rolloutlens.plans.scoring import score
    df = score(spark.createDataFrame(rows, "prompt_idx long, gen_idx int, gold string, content string"))
    got = {r.prompt_idx: r.majority for r in G.majority_run(df).collect()}
    want = {k: majority_model(a, [1.0 if x == gold[k] else 0.0 for x in a]) for k, a in groups.items()}
    assert got == want
    # 1,2,1,2,2,1,1 with gold 1: runs "2,2" and "1,1" tie, the earlier wins -> 0.0,
    # while the mode (1, four times) would give 1.0
    assert got[0] == 0.0
    mode = {r.prompt_idx: r.majority_mode for r in G.majority_mode(df).collect()}
    assert mode[0] == 1.0
