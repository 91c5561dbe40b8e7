"""Mixing: targets against plain resharing, rounding against its invariants and a plain fold."""
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rolloutlens.llm import mixing as M


def plain_targets(sizes, weights=M.WEIGHTS, share=M.SHARE, limit=M.LIMIT):
    """Share by weight; cut what is above the limit and share it again, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    got, excess, free = dict.fromkeys(order, 0.0), share * sum(sizes.values()), set(order)
    while excess > 1e-9 and free:
        total = sum(w[s] for s in free)
        for s in free:
            got[s] += excess * w[s] / total
        excess = 0.0
        for s in list(free):
            if got[s] >= limit * sizes[s]:
                excess += got[s] - limit * sizes[s]
                got[s] = float(limit * sizes[s])
                free.discard(s)
    return got


def collected(df):
    return [r.asDict() for r in df.collect()]


def corpus(rng, n, sources):
    out = []
    for i in range(n):
        s = rng.choice(sources)
        out.append((i, " ".join(["w"] * int(rng.paretovariate(0.7) * 3 % 3000)), s))
    return out


@pytest.mark.parametrize("seed,sources", [(0, ["a", "b", "c", "d", None]), (1, ["hot"] * 8 + ["é", "z", "Z", "", "日本"]), (2, ["one"])])
def test_targets_copies_and_words(spark, seed, sources):
    rng = random.Random(seed)
    rows = corpus(rng, 700, sources)
    got = collected(M.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4), fan=8))
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = plain_targets(sizes)
    assert sorted((r["id"], r["size"], r["source_size"]) for r in got) == sorted((i, len(t.split()), sizes[s]) for i, t, s in rows)
    taken = defaultdict(int)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-9)
        rate = r["target"] / r["source_size"] if r["source_size"] else 0
        assert r["copies"] in ({int(rate)} if rate == int(rate) else {int(rate), int(rate) + 1}) and r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
    for s, t in taken.items():  # off by a part of one document, the last of its source
        assert abs(t - want[s]) <= max([len(x.split()) for _, x, y in rows if y == s])
    assert sum(abs(t - want[s]) for s, t in taken.items()) <= 0.02 * sum(want.values())


def test_reruns_agree_on_any_partitioning(spark):
    rows = corpus(random.Random(5), 300, ["a", "b", None])
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a, b = (sorted((r["id"], r["copies"]) for r in M.mix(df.repartition(n), fan=8).collect()) for n in (1, 7))
    assert a == b


def plain_pair(r, x, u):
    """The two documents after a pairing, as (size, mass)."""
    (rs, rm), (xs, xm) = r, x
    up, down = min(rs - rm, xm), min(rm, xs - xm)
    move = up if u * (up + down) < down else -down
    return (rs, rm + move), (xs, xm - move)


def test_pairing_keeps_words_and_expectations(spark):
    rng = random.Random(9)
    pairs = [((a := rng.randint(1, 50)), a * rng.random(), (b := rng.randint(1, 50)), b * rng.random(), rng.random()) for _ in range(400)]
    pairs += [(10, 4.0, 10, 6.0, u) for u in (0.1, 0.9)]  # both get settled at once
    d = spark.createDataFrame(pairs, "rs long, rm double, xs long, xm double, u double")
    item = lambda k: F.struct(F.col(f"{k}s").alias("size"), "u", F.lit(k).alias("id"), F.col(f"{k}m").alias("mass"), F.lit(False).alias("full"))
    kind = d.select(item("r").alias("i")).schema["i"].dataType.simpleString()
    state = F.struct(item("r").alias("left"), F.array().cast(f"array<{kind}>").alias("done"))
    for row in d.select("*", M._pair(state, item("x")).alias("s")).collect():
        want = dict(zip("rx", plain_pair((row.rs, row.rm), (row.xs, row.xm), row.u)))
        settled = {x.id: x.full for x in row.s.done}
        assert settled and set(settled) | ({row.s.left.id} if row.s.left else set()) == {"r", "x"}
        for k, full in settled.items():
            assert want[k][1] == pytest.approx(want[k][0] if full else 0, abs=1e-9)
        if row.s.left:
            assert row.s.left.mass == pytest.approx(want[row.s.left.id][1])


def test_every_document_has_its_source_rate(spark):
    """Over many seeds (other ids) a document's mean copies come near the rate."""
    rows = [(1000 * k + i, " ".join(["w"] * (i % 9 + 1)), "ab"[i % 2]) for k in range(60) for i in range(40)]
    got = collected(M.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    by = defaultdict(list)
    for r in got:
        by[(r["source"], r["size"])].append((r["copies"], r["target"] / r["source_size"]))
    for x in by.values():
        assert sum(c for c, _ in x) / len(x) == pytest.approx(x[0][1], abs=0.12)


def test_edges(spark, edges):
    got = collected(M.mix(edges.withColumn("source", F.when(F.col("doc_id") < 5, F.col("source")))))
    words = lambda t: len(re.findall(M.WORD, t or ""))
    from .conftest import EDGES
    assert Counter((r["id"], r["size"]) for r in got) == Counter((i, words(t)) for i, t in EDGES)
    assert all(r["copies"] <= 2 for r in got) and {r["source"] for r in got} == {"src", None}
    assert M.mix(edges.limit(0)).count() == 0
    empty = collected(M.mix(edges.where("text is null or text = ''")))
    assert [(r["size"], r["target"]) for r in empty] == [(0, 0.0)] * 3


def test_equal_rows_share_one_fraction(spark, monkeypatch):
    monkeypatch.setattr(M, "SPREAD", 7)
    rows = [(1, "a b c", "s")] * 101 + [(i, "x " * (i % 5 + 1), "st"[i % 2]) for i in range(2, 60)] + [(None, "n n", "t")] * 30
    got = collected(M.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)))
    assert len(got) == len(rows)
    for key, n in (((1, "s"), 101), ((None, "t"), 30)):
        mine = [r for r in got if (r["id"], r["source"]) == key]
        rate = mine[0]["target"] / mine[0]["source_size"]
        assert len(mine) == n and abs(sum(r["copies"] for r in mine) - n * rate) < 1
