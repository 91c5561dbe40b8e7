"""Fingerprints: spans and extensions against slices, rows against a plain loop."""
import hashlib
import random

import pytest
import xxhash

from rolloutlens.llm import common as C
from rolloutlens.llm import fingerprint as G

from .conftest import EDGES


def windows(text):
    return {text[i:i + G.WINDOW] for i in range(len(text) - G.WINDOW + 1)} or ({text} if text else set())


def test_spans_and_extensions_equal_slices():
    rng = random.Random(1)
    for text in ("abcabcabcabd" * 9, "日本語" * 20 + "x", "a" * 200, "\x00\x00a\x00"):
        p = G.PrefixHash(G.code_points(text))
        for _ in range(200):
            i, j = rng.randrange(len(text)), rng.randrange(len(text))
            n = rng.randint(0, len(text) - max(i, j))
            assert (p.span(i, i + n) == p.span(j, j + n)) == (text[i:i + n] == text[j:j + n])
            k = 0
            while max(i, j) + k < len(text) and text[i + k] == text[j + k]:
                k += 1
            assert p.extension(i, p, j) == k


def test_shared_prefix_arrays_equal_fresh_ones():
    a, b = "the first text, long enough to share " * 20, "and another tail"
    p = G.PrefixHash(G.code_points(a))
    e, f = G.PrefixHash(G.code_points(b), p, 100), G.PrefixHash(G.code_points(a[:100] + b))
    assert e.n == f.n and all((x == y).all() for x, y in zip(e.h, f.h))


def test_likeness_estimates_the_jaccard_index():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    for share in (0.0, 0.3, 0.6, 0.9, 1.0):
        common = [word() for _ in range(400)]
        a, b = (" ".join(w if rng.random() < share ** 0.1 else word() for w in common) for _ in range(2))
        x, y = windows(a), windows(b)
        assert abs(G.likeness(G.fingerprint(a), G.fingerprint(b)) - len(x & y) / len(x | y)) < 0.2
    a, b = "a short text of few windows", "a short text of two windows"
    assert G.likeness(G.fingerprint(a), G.fingerprint(b)) == pytest.approx(len(windows(a) & windows(b)) / len(windows(a) | windows(b)))
    assert G.likeness(G.fingerprint(""), G.fingerprint("")) == 1 and G.likeness(G.fingerprint(""), G.fingerprint("x")) == 0


def plain(rows):
    rows = sorted(((C.LAST_ID if i is None else i, t or "") for i, t in rows), key=lambda r: (r[0], (xxhash.xxh64(r[1].encode(), 42).intdigest() + 2**63) % 2**64))
    out = []
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        e = t[:len(t) - q] + nxt[:q]
        fp, fe, fn = map(G.fingerprint, (t, e, nxt))
        lcp = next((j for j in range(min(len(t), len(e))) if t[j] != e[j]), min(len(t), len(e)))
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), fp, fe, G.likeness(fp, fe), G.likeness(fp, fn), lcp))
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 2, 13])
def test_rows_equal_a_plain_loop(documents, spark, parts):
    rng = random.Random(parts)
    rows = EDGES + [(20 + 7 * k, " ".join(rng.choice("lorem ipsum dolor sit amet ☃ x".split()) for _ in range(rng.randint(0, 60)))) for k in range(60)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        assert sorted(map(tuple, G.fingerprints(documents(rows)).collect())) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_single_row_and_empty_table(documents):
    got = G.fingerprints(documents([(5, "the only document here")])).collect()
    assert [tuple(r) for r in got] == plain([(5, "the only document here")])
    assert G.fingerprints(documents([])).count() == 0


def test_document_table_edits_are_near_and_successors_are_not(spark):
    got = [r for r in G.query(spark, "/root/testdata/sf0.01").collect() if r["n_chars"] > 200]
    near = sorted(r["near_edited"] for r in got)
    after = sorted(r["near_next"] for r in got)
    assert near[len(near) // 20] > 0.4 and after[len(after) * 9 // 10] < 0.1


def test_a_hot_id_fills_many_ranges(documents, spark):
    rows = [(7, f"text number {k} of one and the same id") for k in range(600)] + [(k, f"other {k}") for k in range(300)] + [(None, f"null {k}") for k in range(300)]
    from pyspark.sql import functions as F
    dealt = G.ranges(documents(rows)).where("ahead = 0").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()
    assert len(dealt) > 4 and max(r["n"] for r in dealt) < 500 and sum(r["n"] for r in dealt) == len(rows)
    assert sorted(map(tuple, G.fingerprints(documents(rows)).collect())) == plain(rows)
