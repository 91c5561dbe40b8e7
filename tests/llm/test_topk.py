"""Exact top-k against all distances."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolloutlens.llm import topk as K


def plain(rows, queries, k):
    out = []
    for q, c in queries:
        near = sorted((bin((c ^ x) & (2**64 - 1)).count("1"), i) for i, x in rows)[:k]
        out += [(q, r + 1, i, d) for r, (d, i) in enumerate(near)]
    return sorted(out)


def signed(x):
    return x - 2**64 if x >= 2**63 else x


@pytest.mark.parametrize("k,blocks", [(1, 1000), (10, 1000), (7, 90), (600, 1000)])
def test_results_equal_all_distances(spark, k, blocks):
    rng = random.Random(k)
    centres = [rng.getrandbits(64) for _ in range(20)]
    rows = [(i, rng.choice(centres) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 9)))) for i in range(400)]
    rows += [(500 + i, centres[0]) for i in range(100)]  # one very common code: ties by id
    rows += [(900, 0), (900, 0), (901, 2**64 - 1)]  # a repeated row
    df = spark.createDataFrame([(i, signed(c)) for i, c in rows], "id long, code long").repartition(3)
    got = K.search(df, df.where("id % 20 = 0"), k, block_rows=blocks)
    queries = [(i, c) for i, c in rows if i % 20 == 0]
    assert sorted(map(tuple, got.collect())) == plain(rows, queries, k)


def test_repeated_query_rows_have_their_own_neighbours(spark, tmp_path):
    bits = [([1.0] * n + [-1.0] * (64 - n)) for n in range(65)]
    rows = [(0, bits[5]), (0, bits[5]), (1, bits[4]), (2, bits[7]), (3, bits[1]), (20, bits[40]), (20, bits[60])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    codes = [(i, sum(1 << b for b, x in enumerate(v) if x > 0)) for i, v in rows]
    got = sorted(map(tuple, K.query(spark, str(tmp_path)).collect()))
    assert got == plain(codes, [c for c in codes if c[0] % 20 == 0], K.K)
    assert [g[2] for g in got if g[0] == 0 and g[1] <= 3] == [0, 0, 0, 0, 1, 1]
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert sorted(con.execute(K.SQL).fetchall()) == got


def test_rows_are_shuffled_once_and_queries_per_block(spark):
    df = spark.range(3000).select("id", F.xxhash64("id").alias("code"))
    plan = K.search(df, df.where("id % 20 = 0"), 3, block_rows=100)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(r#") == 1 and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_search_stops_early_on_near_codes():
    rng = np.random.default_rng(0)
    index = K.MultiIndex(np.arange(5000), rng.integers(0, 2**63, 5000))
    asked = []
    index.at_radius = lambda a, f=index.at_radius: asked.append(a) or f(a)
    ids, dist = index.search(int(index.code[17]), 1)
    assert (ids.tolist(), dist.tolist(), asked) == ([17], [0], [0])


def test_codes_of_edge_vectors(spark):
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("code", T.StringType())])
    v = [1.0 if b % 3 == 0 else -1.0 for b in range(64)]
    rows = [(1, v, "clash"), (2, None, ""), (3, [], ""), (4, [1.0], ""), (None, v, ""), (5, [0.0] * 64, ""), (6, [None] * 64, "")]
    got = {r["id"]: r["code"] for r in K.codes(spark.createDataFrame(rows, schema), "vec_id", "embedding").collect()}
    assert got == {1: signed(sum(1 << b for b in range(0, 64, 3))), 5: 0, 6: 0}
    none = K.codes(spark.createDataFrame([], schema), "vec_id", "embedding")
    assert K.search(none, none).count() == 0


@pytest.mark.parametrize("bits", [8, 32, 100, 128])
def test_vectors_of_another_length_than_64(spark, tmp_path, bits):
    rng = random.Random(bits)
    rows = [(i, [rng.choice([-1.0, 1.0]) for _ in range(bits)]) for i in range(150)] + [(200, [1.0] * 64), (201, None), (202, [])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    codes = [(i, sum(1 << b for b, x in enumerate(v) if x > 0)) for i, v in rows[:150]]
    want = []
    for q, c in codes[::K.QUERY_EVERY]:
        near = sorted((bin(c ^ x).count("1"), i) for i, x in codes)[:K.K]
        want += [(q, r + 1, i, d) for r, (d, i) in enumerate(near)]
    assert sorted(map(tuple, K.query(spark, str(tmp_path)).collect())) == sorted(want)
