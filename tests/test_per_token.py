"""Log-probabilities of every token from chunked logits against plain numbers."""
import math
import random

import pytest

from rolloutlens.operators import token_loss as TL
from rolloutlens.sources import fixtures as FX

from .conftest import SF_SMALL

INF = float("inf")


def plain(x, target):
    if target is None or not 0 <= target < len(x) or x[target] is None:
        return None
    top = max(x)
    return None if top == -INF else x[target] - top - math.log(sum(math.exp(v - top) for v in x))


@pytest.mark.parametrize("width", [1, 3, 7, 100])
def test_any_chunk_size(spark, width):
    rng = random.Random(width)
    rows, want = [], {}
    for s in range(6):
        ids = [rng.randrange(20) for _ in range(5)]
        if s == 4:
            ids[2] = 99  # no such id
        for p in range(4):
            x = [rng.choice([rng.uniform(-3, 3), rng.uniform(-800, 800), -INF]) for _ in range(20)]
            if (s, p) == (2, 1):
                x = [-INF] * 20
            if (s, p) == (3, 1):
                x = [700.0] * 20
            want[(s, p)] = plain(x, ids[p + 1])
            rows += [(s, p, o, x[o:o + width], ids[p + 1]) for o in range(0, 20, width)]
        want.setdefault("ids", {})[s] = ids
    ids = want.pop("ids")
    rng.shuffle(rows)
    chunks = spark.createDataFrame(rows, "seq_id long, pos int, offset int, logits array<float>, target int").repartition(3)
    seqs = spark.createDataFrame(list(ids.items()), "seq_id long, input_ids array<int>")
    for d in (TL.per_token_logps(chunks), TL.per_token_logps(chunks.drop("target"), seqs)):
        got = {(r["seq_id"], r["pos"]): r["logp"] for r in d.collect()}
        assert set(got) == set(want)
        for k, w in want.items():
            assert got[k] == (None if w is None else -INF if w == -INF else pytest.approx(w, rel=1e-5, abs=1e-4)), k


def test_chunks_are_reduced_before_the_shuffle(spark):
    plan = TL.per_token_logps(FX.logit_chunks(spark, SF_SMALL).withColumn("target", FX.F.lit(3)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan
    assert "logits" not in plan.split("Exchange")[0].split("partial")[0].split("ObjectHashAggregate")[-1]


def test_last_position_has_no_target(spark):
    chunks = spark.createDataFrame([(1, 0, 0, [1.0, 2.0]), (1, 1, 0, [1.0, 2.0])], "seq_id long, pos int, offset int, logits array<double>")
    seqs = spark.createDataFrame([(1, [0, 1])], "seq_id long, input_ids array<int>")
    assert [(r["pos"], round(r["logp"], 6)) for r in TL.per_token_logps(chunks, seqs).collect()] == [(0, round(plain([1.0, 2.0], 1), 6))]
    assert TL.per_token_logps(chunks.limit(0), seqs).count() == 0
