"""Packing: ids against the public library, places checked one by one, packing near the bound."""
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import tokenizers
from pyspark.sql import functions as F

from rolloutlens.llm import packing as P

from .conftest import EDGES


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(P.default_vocabulary())


def check_places(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def test_pieces_equal_the_library(documents, library):
    odd = ["a  b", " lead", "trail ", "x <|endoftext|> y", "it's I'll we've 12,345", "a \n b\n\nc", "日本語 テスト 😀"]
    rows = [*EDGES, *[(100 + k, t) for k, t in enumerate(odd)]]
    got = sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in P.pieces(documents(rows), capacity=64).collect()), key=str)
    want = []
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        starts = [0, *range(len(ids) % 64, len(ids), 64)] if len(ids) % 64 else list(range(0, len(ids), 64))
        for k, (a, z) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want.append((i, k, a, z - a, zlib.crc32(np.array(ids[a:z], "<u4").tobytes())))
    assert got == sorted(want, key=str)


def test_best_fit_takes_the_tightest_bin():
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 100, 400)
    where, offset, fill = P.best_fit(lengths, 100)
    bins = []  # plain: every bin is looked at
    for n in sorted(lengths.tolist(), reverse=True):
        room = [(100 - b, k) for k, b in enumerate(bins) if b + n <= 100]
        if room:
            bins[min(room)[1]] += n
        else:
            bins.append(n)
    assert sorted(fill.tolist()) == sorted(bins)
    assert fill.tolist() == [int(lengths[where == k].sum()) for k in range(len(fill))]


@pytest.mark.parametrize("per_task", [40_000, 150])
def test_rounds_keep_every_piece_and_pack_tightly(spark, per_task):
    rng = random.Random(6)
    items = [(k, rng.choice([rng.randint(1, 2047), rng.randint(1, 300)])) for k in range(3000)]
    df = spark.createDataFrame(items, "item long, length long")
    got = P.pack(df, per_task=per_task).join(df, "item").collect()
    assert sorted((r["item"], r["length"]) for r in got) == items
    n = check_places(got, P.CAPACITY)
    assert n <= 1.02 * sum(x for _, x in items) / P.CAPACITY + 1


def test_items_over_half_stay_apart(spark):
    df = spark.createDataFrame([(k, 1100) for k in range(500)], "item long, length long")
    got = P.pack(df, per_task=40).join(df, "item").collect()
    assert check_places(got, P.CAPACITY) == 500


@pytest.mark.parametrize("seed", range(3))
def test_bins_of_all_tasks_are_best_fitted_whatever_their_room(spark, seed):
    rng = random.Random(seed)
    items = list(enumerate(rng.choices([2047, 2041, 7], [16, 3, 1], k=400)))
    df = spark.createDataFrame(items, "item long, length long")
    per_task, tasks = 20, 20
    placed = df.repartition(tasks, F.xxhash64("item")).select(F.spark_partition_id().alias("task"), "item", "length").collect()
    fills = []  # plain: all tasks' bins in one best fit
    for t in range(tasks):
        fills += P.best_fit(np.array([r["length"] for r in sorted(placed, key=lambda r: r["item"]) if r["task"] == t], np.int64))[2].tolist()
    want = len(P.best_fit(np.array(fills))[2])
    assert want < len(fills)
    got = P.pack(df, per_task=per_task).join(df, "item").collect()
    assert sorted((r["item"], r["length"]) for r in got) == items
    assert check_places(got, P.CAPACITY) == want


@pytest.mark.parametrize("seed", range(5))
def test_small_bins_by_counts_equal_best_fit_over_all(seed):
    rng = random.Random(seed)
    fills = [rng.randint(51, 100) for _ in range(rng.randint(0, 12))]
    small = [(100 + k, rng.randint(1, 50)) for k in range(rng.randint(1, 25))]
    moves = P.join_small(small, {f: fills.count(f) for f in fills}, 100)
    _, _, want = P.best_fit(np.array(fills + [f for _, f in small]), 100)
    size, bins = dict(small), {("large", f, n + 1): f for f in set(fills) for n in range(fills.count(f))}
    bins |= {k: n for k, n in small if k not in {m[0] for m in moves}}
    for k, to, fill, place, shift in moves:
        at = ("large", fill, place) if to is None else to
        assert bins[at] == shift
        bins[at] += size[k]
    assert sorted(bins.values()) == sorted(want.tolist())


def test_documents_and_empty_table(documents):
    got = P.pack_documents(documents(EDGES), capacity=64).collect()
    assert len(got) == P.pieces(documents(EDGES), capacity=64).count()
    check_places(got, 64)
    assert P.pack_documents(documents([])).count() == 0
