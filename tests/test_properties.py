"""Properties from the rules and error cases."""
import pytest
from pyspark.sql import functions as F

from rolloutlens.config import RunConfig
from rolloutlens.functions import tokens as TK
from rolloutlens.operators import batching as B
from rolloutlens.operators import groups as G
from rolloutlens.operators import normalize as N
from rolloutlens.plans import scoring as S
from rolloutlens.plans.catalog import event_scored
from rolloutlens.sources import fixtures as FX
from rolloutlens.sources import readers as RD

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def scored(spark):
    return event_scored(spark, SF_SMALL)


def test_advantages_sum_to_zero(scored):
    adv = G.with_advantages(scored)
    sums = adv.groupBy("prompt_idx").agg(F.sum("advantage").alias("s")).collect()
    assert max(abs(r.s) for r in sums) < 1e-9


def test_advantage_shift_invariant(scored):
    a = {(r.prompt_idx, r.gen_idx): r.advantage for r in G.with_advantages(scored).collect()}
    shifted = scored.withColumn("reward", F.col("reward") + 3.0)
    b = {(r.prompt_idx, r.gen_idx): r.advantage for r in G.with_advantages(shifted).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_buffer_rows_positive_and_informative(scored):
    rows = S.buffer_rows(scored).collect()
    assert rows and all(r.advantage > 0 and r.std >= 0.1 for r in rows)


def fill_model(kept, cfg):
    """The collection loop: whole batches in order until the budget is met."""
    by_batch = {}
    for r in sorted(kept):
        if r[0] >= cfg.start_idx:
            by_batch.setdefault(r[0] // cfg.prompts_per_batch, []).append(r)
    buf = []
    for b in sorted(by_batch):
        if len(buf) >= cfg.int_num:
            break
        buf += by_batch[b]
    return buf[: cfg.int_num]


@pytest.mark.parametrize("start,budget", [(0, 50), (7, 100), (30, 10 ** 6), (5, 1)])
def test_fill_budget_equals_loop(scored, start, budget):
    cfg = RunConfig(group_size=8, max_num_seq=32, int_num=budget, start_idx=start)
    kept = S.buffer_rows(scored)
    keys = [(r.prompt_idx, r.gen_idx) for r in kept.collect()]
    got = [(r.prompt_idx, r.gen_idx) for r in B.fill_budget(kept, cfg).orderBy("position").collect()]
    assert got == fill_model(keys, cfg)
    assert len(got) <= budget


def test_shuffle_is_a_seeded_permutation(spark):
    d = FX.read_table(spark, SF_SMALL, "documents").select("doc_id")
    a = B.seeded_shuffle(d, "doc_id", 42).collect()
    b = B.seeded_shuffle(d, "doc_id", 42).collect()
    c = B.seeded_shuffle(d, "doc_id", 7).collect()
    ranks = sorted(r.shuffle_rank for r in a)
    assert ranks == list(range(len(ranks)))
    assert {r.doc_id: r.shuffle_rank for r in a} == {r.doc_id: r.shuffle_rank for r in b}
    assert {r.doc_id: r.shuffle_rank for r in a} != {r.doc_id: r.shuffle_rank for r in c}


def test_kl_nonnegative_and_ratio_one(spark):
    s = FX.sequences(spark, SF_SMALL)
    k = s.select(F.array_min(TK.approx_kl(F.col("logp"), F.col("ref_logp"), "k2")).alias("k2"),
                 F.array_min(TK.approx_kl(F.col("logp"), F.col("ref_logp"), "k3")).alias("k3")).collect()
    assert all(r.k2 >= 0 and r.k3 >= -1e-12 for r in k)
    same = s.withColumn("old_logp", F.col("logp"))
    from rolloutlens.operators import token_loss as TL
    m = TL.batch_metrics(TL.sequence_terms(same, beta=0.0)).collect()
    assert all((r.clip_ratio or 0.0) == 0.0 for r in m)
    with pytest.raises(ValueError):
        TK.approx_kl(F.col("logp"), F.col("ref_logp"), "k9")


def test_cumsum_forward_plus_reverse(spark):
    from rolloutlens.plans.q_normalize import tokens_long
    t = tokens_long(spark, SF_SMALL)
    f = N.cumulative_sum(t, "seq_id", "pos", "value", "fwd")
    r = N.cumulative_sum(f, "seq_id", "pos", "value", "rev", reverse=True)
    tot = t.groupBy("seq_id").agg(F.sum("value").alias("tot"))
    bad = r.join(tot, "seq_id").filter(F.abs(F.col("fwd") + F.col("rev") - F.col("tot") - F.col("value")) > 1e-9)
    assert bad.count() == 0


def test_zscore_single_row_group_is_null(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.1), (2, 0.3)], "group_id long, value double")
    z = {(r.group_id, r.value): r.z for r in N.zscore(df, "group_id", "value").collect()}
    assert z[(1, 0.5)] is None and z[(2, 0.1)] < 0 < z[(2, 0.3)]


def test_lower_columns_rejects_collisions(spark):
    df = spark.createDataFrame([(1, 2)], "A int, b int").withColumnRenamed("b", "a_")
    assert RD.lower_columns(df).columns == ["a", "a_"]
    with pytest.raises(ValueError):
        RD.lower_columns(spark.createDataFrame([(1, 2)], "Q int, x int").toDF("Q", "q"))


def test_result_invariant_to_repartition(spark, scored):
    a = sorted(G.majority_run(scored).collect())
    b = sorted(G.majority_run(scored.repartition(3)).collect())
    assert a == b
