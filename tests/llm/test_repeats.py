"""Periodic runs against all lags tried one by one."""
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from rolloutlens.llm import repeats as R
from rolloutlens.plans.check import compare, duckdb_conn

from .conftest import EDGES


def plain_runs(w, least=6, exponent=4):
    out = []
    for q in range(1, len(w) // exponent + 1):
        i = q
        while i < len(w):
            if w[i] != w[i - q]:
                i += 1
                continue
            j = i
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            s, n = i - q, j - i + q
            if n >= max(least, exponent * q) and not any(p < q and q % p == 0 and a <= s and a + m >= s + n for a, m, p in out):
                out.append((s, n, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def found(texts, **args):
    """Per text: its runs, all texts handled together."""
    ids = {}
    words = [[ids.setdefault(x, len(ids)) for x in t] for t in texts]
    bounds = np.cumsum([0, *map(len, texts)])
    runs = R.find_runs(np.array([x for t in words for x in t], np.int64), bounds, **args)
    return [[(int(s - a), int(n), int(q)) for s, n, q in runs if a <= s < z] for a, z in zip(bounds, bounds[1:])]


def periodic(rng):
    """A text of random pieces, most of them repeated, some with one word changed."""
    w = []
    for _ in range(rng.randint(1, 6)):
        piece = [rng.choice("abcde"[:rng.randint(1, 5)]) for _ in range(rng.randint(1, 40))]
        w += piece * rng.choice([1, 1, 3, 4, 5, 9])
        if rng.random() < 0.4:
            w[rng.randrange(len(w))] = rng.choice("abx")
        w = w[:len(w) - rng.randint(0, 3)]
    return w


@pytest.mark.parametrize("seed", range(6))
def test_all_runs_are_found(seed, monkeypatch):
    rng = random.Random(seed)
    texts = [periodic(rng) for _ in range(60)] + [[rng.choice("ab") for _ in range(rng.randint(0, 200))] for _ in range(60)]
    texts += [list("a" * n) for n in (0, 1, 5, 6, 7, 300)]
    want = [plain_runs(t) for t in texts]
    assert found(texts) == want and sum(map(len, want)) > 100
    monkeypatch.setattr(R, "PACKED", 1)  # as for a text too long for packed keys
    assert found(texts) == want


@pytest.mark.parametrize("least,exponent", [(1, 3), (20, 3), (6, 7), (2, 4)])
def test_other_lengths_and_exponents(least, exponent):
    rng = random.Random(exponent)
    texts = [periodic(rng) for _ in range(80)]
    assert found(texts, min_words=least, min_exponent=exponent) == [plain_runs(t, least, exponent) for t in texts]


def test_shorter_exponents_are_refused(spark, edges):
    with pytest.raises(ValueError):
        R.periodic_runs(edges, min_exponent=2)


def test_operator_on_edge_rows(spark, edges):
    got = Counter((r["id"], r["n_words"], tuple(map(tuple, r["runs"])), r["collapsed"]) for r in R.periodic_runs(edges).collect())
    want = Counter()
    for i, t in EDGES:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = plain_runs(w) if len(w) < 600 else [(0, len(w), 9)]  # a sentence of nine words again and again
        want[(i, len(w), tuple(runs), plain_collapsed(w, runs))] += 1
    assert got == want
    assert R.periodic_runs(edges.limit(0)).count() == 0


def test_cost_of_one_word_and_of_long_periods():
    """A million equal words, and a period of 50,000: no quadratic work."""
    assert found([["a"] * 1_000_000]) == [[(0, 1_000_000, 1)]]
    piece = list(range(50_000))
    assert found([piece * 5 + [-1]]) == [[(0, 250_000, 50_000)]]


def test_other_white_space_is_part_of_words(spark, documents):
    texts = ["a b " * 7, "x\x85y\n" * 6, "  " * 8, "q\x1cq\t" * 6]
    got = {r["id"]: [tuple(x) for x in r["runs"]] for r in R.periodic_runs(documents(texts)).collect()}
    assert got == {0: [(0, 7, 1)], 1: [(0, 6, 1)], 2: [(0, 8, 1)], 3: [(0, 6, 1)]}


def test_query_equals_plain_rules(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join(periodic(rng))) for i in range(300)] + [(400, None), (401, ""), (402, " \n"), (-7, "b " * 9), (700, "é ñ " * 8)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in R.query(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    edited = 0
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        h = zlib.crc32(str(i).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (j - a) % p] if j >= a else w[j] for j in range(n)]
            edited += 1
        runs = plain_runs(w)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        r = got[i]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *(best or (None, None, None)))
        assert r["exponent_milli"] == (None if best is None else 1000 * best[1] // best[2])
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(plain_collapsed(w, runs).encode()).hexdigest()
    assert edited > 15


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    ok, why = compare(R.query(spark, sf), duckdb_conn(sf), R.SQL)
    assert ok, why
