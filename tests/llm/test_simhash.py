"""SimHash near-duplicates against all pairs of fingerprints."""
import itertools
import random

import numpy as np
import pytest
import xxhash

from rolloutlens.llm import common as C
from rolloutlens.llm import simhash as S

from .conftest import EDGES


def plain_fingerprint(text, shingle=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + shingle]) for i in range(len(words) - shingle + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, bits):
    """fps: (doc, fingerprint); smallest doc reachable."""
    docs = sorted({d for d, _ in fps})
    up = {d: d for d in docs}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d
    for (a, x), (b, y) in itertools.combinations(fps, 2):
        if bin(x ^ y).count("1") <= bits:
            p, q = root(a), root(b)
            up[max(p, q)] = min(p, q)
    return {d: root(d) for d in docs}


def test_fingerprints():
    rng = random.Random(1)
    texts = [t for _, t in EDGES if t != EDGES[5][1]] + [" ".join(rng.choice("ab Cd éÉ \x85x zz".split(" ")) for _ in range(n)) for n in range(1, 60)]
    for t in texts:
        assert S.fingerprint(t) == plain_fingerprint(t)


def near_codes(rng, n, centres=12):
    """Codes in clouds of a few bits around centres."""
    c = [rng.getrandbits(64) for _ in range(centres)]
    out = []
    for _ in range(n):
        x = rng.choice(c)
        for b in rng.sample(range(64), rng.randint(0, 5)):
            x ^= 1 << b
        out.append(x)
    return out


@pytest.mark.parametrize("bits", [0, 1, 2, 3, 4])
def test_links_reach_every_pair(spark, bits):
    rng = random.Random(bits)
    codes = sorted(set(near_codes(rng, 900)))
    df = spark.createDataFrame([(c - 2**64 if c >= 2**63 else c,) for c in codes], "fp long").repartition(3)
    got = [(r["a"] % 2**64, r["b"] % 2**64) for r in S.links(df, bits).collect()]
    assert all(bin(a ^ b).count("1") <= bits for a, b in got)
    up = {c: c for c in codes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in got:
        up[max(root(a), root(b))] = min(root(a), root(b))
    want = plain_components([(c, c) for c in codes], bits)
    assert {c: root(c) for c in codes} == want


@pytest.mark.parametrize("frequent", [2000, 2, 1])
def test_hot_values_are_salted_without_loss(spark, monkeypatch, frequent):
    """Values over a bucket are split whether the driver names them (frequent) or a join does."""
    monkeypatch.setattr(S, "BUCKET", 16)
    monkeypatch.setattr(S, "FREQUENT", frequent)
    split = []
    monkeypatch.setattr(S, "_split", lambda k, c, f=S._split: split.append(1) or f(k, c))
    rng = random.Random(9)
    base = rng.getrandbits(64)
    codes = {base}
    while len(codes) < 300:  # one dense cloud: every part value is hot
        x = base
        for b in rng.sample(range(64), rng.randint(1, 4)):
            x ^= 1 << b
        codes.add(x)
    codes = sorted(codes)
    df = spark.createDataFrame([(c - 2**64 if c >= 2**63 else c,) for c in codes], "fp long").repartition(3)
    pairs = [(r["a"], r["b"]) for r in S.links(df, 2).collect()]
    edges = spark.createDataFrame(pairs, "a long, b long")
    comp = {r["v"]: r["c"] for r in S.components(edges).collect()}
    signed = [c - 2**64 if c >= 2**63 else c for c in codes]
    up = plain_components([(s, s % 2**64) for s in signed], 2)
    assert {s: comp.get(s, s) for s in signed} == up
    assert bool(split) == (frequent < 20)


def test_split_puts_entries_apart_and_probes_everywhere(spark, monkeypatch):
    monkeypatch.setattr(S, "BUCKET", 10)
    keys = spark.createDataFrame([(0, 5, 0, probe, fp) for probe in (0, 1) for fp in range(95)] + [(0, 6, 0, 0, 1), (1, 5, 3, 1, 2)],
                                 "part int, value long, salt int, probe int, fp long")
    got = S._split(keys, spark.createDataFrame([(0, 5, 95)], "part int, value long, n long")).collect()
    entries = [r for r in got if r["value"] == 5 and r["part"] == 0 and r["probe"] == 0]
    assert sorted(r["fp"] for r in entries) == list(range(95)) and {r["salt"] for r in entries} == set(range(10))
    probes = [(r["fp"], r["salt"]) for r in got if r["value"] == 5 and r["part"] == 0 and r["probe"] == 1]
    assert sorted(probes) == [(f, s) for f in range(95) for s in range(10)]
    assert sorted(tuple(r) for r in got if (r["part"], r["value"]) != (0, 5)) == [(0, 6, 0, 0, 1), (1, 5, 3, 1, 2)]


def test_thresholds_cover_the_distance():
    rng = np.random.default_rng(0)
    for parts in (2, 3):
        cost = rng.random((parts, 3, 50)) * 100
        t = S.allocate(cost.cumsum(1), 2)
        assert (t.sum(1) == 2 - parts + 1).all() and t.min() >= -1 and t.max() <= 2
        every = [c for c in itertools.product(range(-1, 3), repeat=parts) if sum(c) == 3 - parts]
        total = lambda c, r: sum(cost.cumsum(1)[i, x, r] for i, x in enumerate(c) if x >= 0)
        for r in range(50):
            assert total(t[r], r) == pytest.approx(min(total(c, r) for c in every))


def test_bits_are_grouped_by_correlation():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (4000, 64))
    for k in range(32, 64):
        x[:, k] = x[:, k - 32] ^ (rng.random(4000) < 0.02)  # bit k follows bit k - 32
    groups = S.group_bits(4000, x.sum(0), x.T @ x, 2)
    assert sorted(sum(groups, [])) == list(range(64)) and sum(b ^ 32 in g for g in groups for b in g) >= 60


def test_components_of_long_chains(spark):
    n = 200
    order = list(range(n))
    random.Random(3).shuffle(order)
    pairs = list(zip(order, order[1:])) + [(1000, 1001), (1001, 1002), (7000, 7000)]
    got = {r["v"]: r["c"] for r in S.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{v: 0 for v in range(1, n)}, 1001: 1000, 1002: 1000}


def test_documents_against_all_pairs(documents):
    rng = random.Random(8)
    rows = list(EDGES)
    for k in range(60):
        words = [rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randint(0, 40)) for _ in range(rng.randint(2, 80))]
        rows.append((100 + 3 * k, " ".join(words)))
        for c in range(rng.randint(0, 2)):
            copy = list(words)
            copy[rng.randrange(len(copy))] = "changed"
            rows.append((101 + 3 * k + c, " ".join(copy)))
    fps = [(C.LAST_ID if i is None else i, plain_fingerprint(t)) for i, t in rows]
    want = plain_components(fps, 2)
    got = S.near_duplicates(documents(rows)).collect()
    assert sorted((r["doc"], r["fp"] % 2**64) for r in got) == sorted(fps)
    assert {r["doc"]: r["component"] for r in got} == want


def test_stage_keeps_one_row_of_each_group(edges):
    got = S.keep_first(edges)
    assert got.schema == edges.schema
    fps = [(C.LAST_ID if i is None else i, plain_fingerprint(t)) for i, t in EDGES]
    want = plain_components(fps, 2)
    ids = [C.LAST_ID if r["doc_id"] is None else r["doc_id"] for r in got.collect()]
    assert sorted(ids) == sorted(d for d, c in want.items() if d == c)


def test_empty_table(documents):
    assert S.near_duplicates(documents([])).count() == 0 and S.keep_first(documents([])).count() == 0
