"""Toxicity: held-out quality, trees and calibration against plain versions, edge cases."""
import random

import numpy as np
import pytest

from rolloutlens.llm import common as C
from rolloutlens.llm import toxicity as X

from .conftest import EDGES

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    return X.fit(C.table(spark, SF, "documents"), X.learn_rows(C.table(spark, SF, "labels")))


def test_held_out_quality(spark, model):
    got = X.score(C.table(spark, SF, "documents"), model).join(C.table(spark, SF, "labels"), "doc_id").where(C.fold("doc_id", 3) == 1).collect()
    pos, neg = (np.array([r["score"] for r in got if r["toxic"] == y]) for y in (1, 0))
    order = (pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean()
    assert len(pos) > 100 and order > 0.95  # area under the curve
    assert (pos >= X.THRESHOLD).mean() > 0.85 and (neg >= X.THRESHOLD).mean() < 0.02


def test_rows_match_one_by_one_scores(documents, model):
    s = X.Scorer(model)
    got = sorted(((r["doc_id"], r["score"], r["predicted"]) for r in X.score(documents(EDGES), model).collect()), key=str)
    one = [float(s.score([t or ""])[0]) for _, t in EDGES]
    assert got == sorted(((i, v, int(v >= X.THRESHOLD)) for (i, _), v in zip(EDGES, one)), key=str)
    assert all(0 <= v <= 1 for v in one) and one[0] == one[1] == float(s.score([""])[0])


def test_obfuscated_and_second_person_features():
    f = X.Features({"w:idiot": 5.0, "s:loser": 3.0})
    at = {n: k for k, n in enumerate(X.FEATURES)}
    x = f.of("You are an idiot and you know it")
    assert x[at["near_second"]] == 1 and x[at["strong_density"]] == pytest.approx(1 / 8)
    assert f.of("an id1ot! here")[at["mixed_hits"]] > 0 and f.of("plain")[at["mixed_hits"]] == 0
    assert f.of("losers everywhere")[at["stem_density"]] == 0.5 and f.of("loser")[at["stem_density"]] == 0
    assert f.of("") == [0.0] * len(X.FEATURES) and len(f.of("a" * 300_000)) == len(X.FEATURES)


def test_trees_follow_the_data():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) & (x[:, 2] < 0.3)).astype(int)
    m = X.fit_trees(x, y)
    assert ((X.tree_margin(m, x) > 0) == y).mean() > 0.99
    for row in rng.integers(0, 2000, 20):  # a plain walk down every tree
        total = m["base"]
        for feats, at, weight in m["trees"]:
            node = 0
            while node < len(feats):
                node = 2 * node + 1 + (x[row, feats[node]] > at[node])
            total += weight[node - len(feats)]
        assert total == pytest.approx(X.tree_margin(m, x[row:row + 1])[0])


def test_isotonic_is_least_squares_and_monotone():
    rng = random.Random(2)
    margin = np.array([rng.choice([-2, -1, 0, 1, 2, 3]) + 0.0 for _ in range(200)])
    y = np.array([int(rng.random() < (m + 3) / 8) for m in margin])
    xs, p = X.fit_isotonic(margin, y, np.ones(200))
    assert (np.diff(p) >= 0).all() and (np.diff(xs) >= 0).all()
    # brute force over all monotone poolings of the six levels
    levels = sorted(set(margin))
    best = None
    for cuts in range(2 ** (len(levels) - 1)):
        groups, cur = [], [levels[0]]
        for k, v in enumerate(levels[1:]):
            if cuts >> k & 1:
                groups.append(cur)
                cur = []
            cur.append(v)
        groups.append(cur)
        means = [y[np.isin(margin, g)].mean() for g in groups]
        if all(a < b for a, b in zip(means, means[1:])):
            fit = {v: m for g, m in zip(groups, means) for v in g}
            loss = sum((fit[m] - t) ** 2 for m, t in zip(margin, y))
            best = min(best, (loss, fit), key=lambda z: z[0]) if best else (loss, fit)
    assert np.interp(levels, xs, p) == pytest.approx([best[1][v] for v in levels], abs=0.02)


def test_nothing_to_learn(documents, spark):
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    m = X.fit(documents(EDGES), labels)
    assert {r["score"] for r in X.score(documents(EDGES), m).collect()} == {0.0}
    empty = X.fit(documents([]), labels.limit(0))
    assert X.score(documents([]), empty).count() == 0


def test_stage_keeps_schema_and_clean_rows(edges, model):
    got = X.keep_clean(edges, model)
    s = X.Scorer(model)
    assert got.schema == edges.schema
    assert sorted(str(r["doc_id"]) for r in got.collect()) == sorted(str(i) for i, t in EDGES if t is None or s.score([t or ""])[0] < X.THRESHOLD)


def test_null_texts_stay_whatever_the_labels(documents, spark):
    """All labels 1: the empty text is scored as toxic, the null text is kept by rule."""
    docs = documents([(1, None), (2, "any words"), (3, ""), (None, None)])
    m = X.fit(docs, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int"))
    assert m["rate"] == 1.0
    assert [(r["doc_id"], r["text"]) for r in X.keep_clean(docs, m).orderBy("doc_id").collect()] == [(None, None), (1, None)]
