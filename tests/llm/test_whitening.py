"""Whitening against numpy's eigenvectors and plain whole numbers."""
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from rolloutlens.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, x string, n string, component string"


def table(spark, vectors, parts=3):
    return spark.createDataFrame([(i, v, "clash", "clash", "clash") for i, v in vectors], SCHEMA).repartition(parts)


def plain(vectors, k=W.K):
    """{id: [(component, n, deviation, |whitened|, explained)]} by numpy and whole numbers."""
    ok = [(i, [math.floor(W.GRID * float(np.float32(c))) for c in v]) for i, v in vectors
          if v and all(c is not None and math.isfinite(np.float32(c)) for c in v)]
    fit = sorted(set(tuple(x) for _, x in ok))
    n, d = len(fit), len(fit[0])
    s = [sum(x[j] for x in fit) for j in range(d)]
    mean = np.array([float(Fraction(t, n)) for t in s])
    centred = np.array(fit, float) - mean
    cov = centred.T @ centred / n
    value, vector = np.linalg.eigh(cov)
    value, vector = value[::-1][:k], vector[:, ::-1][:, :k]
    out = {}
    for i, x in ok:
        dev = sum((n * a - b) ** 2 for a, b in zip(x, s))
        w = (np.array(x, float) - mean) @ vector / np.sqrt(value)
        out.setdefault(i, []).append([(c + 1, n, dev, abs(w[c]), value[c] / np.trace(cov)) for c in range(len(value))])
    return out


def compare(got, want, tolerance=1e-9):
    rows = {}
    for r in got:
        rows.setdefault(r["id"], []).append(r)
    assert set(rows) == set(want)
    for i, rs in rows.items():
        expected = sorted(x for row in want[i] for x in row)
        mine = sorted((r["component"], r["n"], r["deviation"], abs(r["whitened"]), r["explained"]) for r in rs)
        assert [m[:3] for m in mine] == [e[:3] for e in expected]
        assert np.allclose([m[3:] for m in mine], [e[3:] for e in expected], rtol=tolerance, atol=tolerance)
    assert len({r["identity_error"] for r in got}) <= 1 and all(r["identity_error"] < 1e-9 for r in got)


def test_rows_equal_plain_whitening(spark):
    rng = np.random.default_rng(0)
    scale = 3.0 / np.arange(1, 9)
    vectors = [(i, (rng.standard_normal(8) * scale + 5).tolist()) for i in range(300)]
    vectors += [(1000 + i, vectors[7][1]) for i in range(400)]  # one vector more than half of all rows
    vectors += [(5, vectors[9][1]), (None, vectors[11][1]), (None, [0.0] * 8)]
    compare(W.whiten(table(spark, vectors)).collect(), plain(vectors))


def test_rows_that_take_no_part(spark):
    rng = random.Random(1)
    good = [(i, [rng.gauss(0, 1) * (j + 1) for j in range(6)]) for i in range(80)]
    bad = [(100, None), (101, []), (102, [1.0] * 5 + [None]), (103, [float("nan")] + [0.0] * 5), (104, [float("inf")] * 6),
           (105, [-float("inf")] + [1.0] * 5), (107, [1e37] * 6)]
    other = [(106, [1.0, 2.0])]
    compare(W.whiten(table(spark, good + bad + other)).collect(), plain(good))


def test_sign_is_the_same_for_all_rows(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, (rng.standard_normal(5) * [5, 4, 3, 2, 1]).tolist()) for i in range(200)]
    got = W.whiten(table(spark, vectors)).collect()
    x = np.floor(np.array([v for _, v in vectors], np.float32).astype(float) * W.GRID)
    for c in range(1, 5):
        w = np.array([r["whitened"] for r in sorted((r for r in got if r["component"] == c), key=lambda r: r["id"])])
        direction, *_ = np.linalg.lstsq(x - x.mean(axis=0), w, rcond=None)
        assert np.abs((x - x.mean(axis=0)) @ direction - w).max() < 1e-9


def test_few_dimensions_low_rank_and_empty_tables(spark):
    rng = np.random.default_rng(3)
    line = [(i, [float(t), 2.0 * t, -1.0 * t]) for i, t in enumerate(rng.integers(0, 50, 60).tolist())]
    got = W.whiten(table(spark, line)).collect()
    assert {r["component"] for r in got} == {1} and got[0]["explained"] == pytest.approx(1) and len(got) == 60
    assert W.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0  # no spread at all
    empty = W.whiten(table(spark, []))
    assert empty.count() == 0 and empty.columns == ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert {r["component"] for r in W.whiten(table(spark, [(i, [float(i * i), float(i)]) for i in range(9)])).collect()} == {1, 2}


def test_large_entries_stay_exact(spark):
    rng = random.Random(4)
    vectors = [(i, [float(rng.randint(-2**40, 2**40)) for _ in range(3)]) for i in range(40)]
    got = W.whiten(table(spark, vectors)).collect()
    want = plain(vectors)
    for r in got:
        dev = want[r["id"]][0][0][2]
        assert r["deviation"] == (dev if dev < 2**63 else None)
        assert abs(r["whitened"]) == pytest.approx(want[r["id"]][0][r["component"] - 1][3], rel=1e-6)


@pytest.mark.parametrize("d,kind", [(d, k) for d in (1, 2, 3, 10, 40) for k in ("full", "low rank", "equal", "graded", "pairs")])
def test_components_of_any_spectrum(d, kind):
    rng = np.random.default_rng(d)
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    spectrum = {"full": rng.uniform(1, 2, d), "low rank": np.r_[np.ones(max(1, d // 3)) * 3, np.zeros(d - max(1, d // 3))],
                "equal": np.ones(d), "graded": 10.0 ** -np.arange(d), "pairs": np.repeat(np.arange(d, 0, -1.0), 2)[:d]}[kind]
    v = (q * spectrum) @ q.T
    v = (v + v.T) / 2
    value, vector = W.leading(v)
    want = np.linalg.eigvalsh(v)[::-1][:len(value)]
    assert len(value) == min(4, d, (spectrum > 1e-12 * spectrum.sum()).sum())
    assert np.allclose(value, want, rtol=1e-9, atol=1e-14 * want[0])
    assert np.abs(vector @ vector.T - np.eye(len(value))).max() < 1e-9
    assert np.abs(v @ vector.T - vector.T * value).max() < 1e-12 * want[0] * d


def test_inertia_counts():
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 30):
        a = rng.standard_normal((n, n))
        a = a + a.T
        inertia, value = W.Inertia(a), np.linalg.eigvalsh(a)
        for shift in [*rng.uniform(-5, 5, 20), *(value[:-1] + value[1:]) / 2]:
            assert inertia.above(shift) == (value > shift).sum()


def test_a_missed_eigenvalue_is_an_error():
    v = np.diag([4.0, 3.0, 2.0, 1.0])
    with pytest.raises(ArithmeticError):
        W.feast(v, 2.5, 4.5, 3)  # only two are inside
